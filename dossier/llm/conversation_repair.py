"""Repair of conversations by cheapest edits, found by a square-root checkpointed dynamic programme.

Rows of a conversation are kept, deleted or given the role user or assistant, and empty turns are inserted, until the initials of the roles read
``(s?(ua)+)?``. The programme runs over rows and the four states of that pattern. Costs run backward from the end; a backward vector holds
the least cost to go from each state. They are stored at checkpoints only, about the square root of the rows apart; the walk forward recomputes one
block of vectors at a time and takes, of the edits that stay on a cheapest way, the one whose initial is least in ASCII. An edit's initial and the
state fix what it does, so the initials (the audit) fix the repair.

A conversation of at most ROWS rows and BYTES bytes is one group. A longer one is dealt out in blocks of about the square root of its rows: blocks give
their costs between states, one short list of these for each conversation gives the vectors at the checkpoints, blocks walk from every
state, and a second short list tells which of these walks are taken.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ranked, ship, stored, tidy

#: Rows and bytes of a conversation that is handled as one group; rows of a block at least.
ROWS, BYTES, BLOCK_ROWS = 4096, 8 << 20, 64
REROLE = INSERT = UNENDED = 3
DELETE = 4
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Faults of a row, the first that applies.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing so far, after system, after user, after assistant. A row's initial leads on, or can't follow; an empty one changes nothing.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NO = -1
INITIALS = {"s": (AFTER_S, NO, NO, NO), "u": (AFTER_U, AFTER_U, NO, AFTER_U), "a": (NO, NO, AFTER_A, NO), "": (NOTHING, AFTER_S, AFTER_U, AFTER_A)}
OTHER = (NO, NO, NO, NO)
KINDS = [*INITIALS.values(), OTHER]
#: Where an inserted or re-roled turn leads, and the role that it has.
TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
FAR = 1 << 50
NOTHING_SHA256 = hashlib.sha256().hexdigest()
Vector = tuple[int, int, int, int]


def code(initial: str, fault: int) -> int:
    """What the programme needs of a row, as a small number."""
    kind = list(INITIALS).index(initial) if initial in INITIALS else len(INITIALS)
    return kind * 4 + fault


def _with_inserts(to_go: list[int]) -> Vector:
    """Costs from each state if turns may be inserted first."""
    n, s, u, a = to_go
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(n, INSERT + u), min(s, INSERT + u), u, a


#: Costs at the end of a conversation: nothing and after assistant are complete.
END: Vector = _with_inserts([0, FAR, FAR, 0])
_known: dict[tuple[int, Vector], tuple[Vector, int, tuple]] = {}


def step(row: int, after: Vector) -> tuple[Vector, int, tuple]:
    """From the vector after a row: the vector before it less its least cost, that cost, and for each state (edits up to and of the row, state after it, their cost)."""
    if (row, after) in _known:
        return _known[row, after]
    kind, fault = KINDS[row // 4], row % 4
    extra = UNENDED if fault == TRUNCATED else 0
    choices = []
    for q in range(4):
        some = [(DELETE + after[q], "D", q, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            if kind[q] != NO:
                some.append((extra + after[kind[q]], "K", kind[q], extra))
            some.append((REROLE + extra + after[TURN[q]], "R", TURN[q], REROLE + extra))
        choices.append(some)
    to_go = _with_inserts([min(some)[0] for some in choices])
    walks = []
    for q in range(4):
        letters, cost = "", 0
        while True:
            tight = [x for x in choices[q] if x[0] == to_go[q]]
            # D comes before I, and I before K and R
            if tight and (tight[0][1] == "D" or INSERT + to_go[TURN[q]] != to_go[q]):
                _, letter, q, own = min(tight, key=lambda x: x[1])  # noqa: PLW2901
                walks.append((letters + letter, q, cost + own))
                break
            letters, cost, q = letters + "I", cost + INSERT, TURN[q]  # noqa: PLW2901
    least = min(to_go)
    found = tuple(x - least for x in to_go), least, tuple(walks)
    if len(_known) < 1 << 16:
        _known[row, after] = found
    return found


def backward(rows: bytes, after: Vector) -> tuple[Vector, int]:
    """The vector before rows, less its least cost, and that cost."""
    total = 0
    for row in reversed(rows):
        after, least, _ = step(row, after)
        total += least
    return after, total


def walk(rows: bytes, after: Vector, state: int) -> tuple[list[str], int, int]:
    """The edits of each row from state on, the state behind them and their cost, given the vector after the rows.

    Backward vectors are kept at checkpoints and recomputed block by block.
    """
    size = max(1, math.isqrt(len(rows)))
    starts = range(0, len(rows), size)
    marks = {}
    for start in reversed(starts):
        marks[start] = after
        after, _ = backward(rows[start : start + size], after)
    found, total = [], 0
    for start in starts:
        behind, walks = marks[start], []
        for row in reversed(rows[start : start + size]):
            behind, _, choice = step(row, behind)
            walks.append(choice)
        for choice in reversed(walks):
            letters, state, cost = choice[state]
            found.append(letters)
            total += cost
    return found, state, total


def closing(state: int) -> str:
    """The turns inserted behind the last row."""
    letters = ""
    while state not in (NOTHING, AFTER_A):
        letters, state = letters + "I", TURN[state]
    return letters


def script(letters: str, state: int, roles: list[str | None]) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row, new role) for letters from state on; row is null for inserted turns, the new role for deleted and kept rows."""
    at = 0
    for letter in letters:
        if letter == "I":
            yield letter, None, ROLE[state]
            state = TURN[state]
            continue
        yield letter, at, ROLE[state] if letter == "R" else None
        if letter == "R":
            state = TURN[state]
        elif letter == "K":
            state = INITIALS[(roles[at] or "")[:1]][state]
        at += 1


def faults_of(rows: list[tuple]) -> list[int]:
    """The first fault of each (turn, role, text)."""
    seen, found = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        found.append(BLANK if not end else DUPLICATE if (role, text) in seen else SOUND if end in ENDS else TRUNCATED)
        seen.add((role, text))
    return found


def repaired(rows: list[tuple]) -> dict:
    """The summary of a conversation (turn, role, text) in order, its edits and its repaired turns."""
    faults = faults_of(rows)
    initials = [r[1][:1] for r in rows]
    codes = bytes(map(code, initials, faults))
    letters, state, cost = walk(codes, END, NOTHING)
    audit = "".join(letters) + closing(state)
    cost += INSERT * len(closing(state))
    edits, digest, first = [], hashlib.sha256(), True
    for edit, at, role in script(audit, NOTHING, [r[1] for r in rows]):
        turn, own, text = rows[at] if at is not None else (None, role, "")
        edits.append((edit, turn, role or own, text, None if at is None else faults[at]))
        if edit != "D":
            digest.update(("" if first else "\n").encode() + f"{role or own}:{text}".encode())
            first = False
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(), "edits": edits,
    }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "conv long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
EDITS = "conv long, block long, step long, edit string, turn long, role string, text string, fault int"
_COUNT_TYPES = {c: pa.int64() for c in ("conv", *COUNTS)}


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[tuple]]]:
    for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield conv, [(r["turn"], r["role"], r["text"]) for r in rows.as_py()]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [{"conv": conv} | repaired(rows) for conv, rows in _lists(batch)]
        names = ["conv", *COUNTS, "audit", "repaired_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], _COUNT_TYPES.get(c, pa.string())) for c in names], names=names)


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, rows in _lists(batch):
            edits = repaired(rows)["edits"]
            n = len(edits)
            columns = [pa.array([conv] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64())]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(columns + [pa.array([e[i] for e in edits], kind) for i, kind in enumerate(kinds)], names=["conv", "block", "step", "edit", "turn", "role", "text", "fault"])


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))


def _split(rows: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Conversations as one row each (conv, rows in order), and the rows of those that are too long for that (null if there are none)."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    long_ones, _ = stored(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv").alias("long_conv")), "long-conversations")
    n = long_ones.limit(BROADCAST_IDS + 1).count()
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    if not n:
        return rows.groupBy("conv").agg(listed.alias("rows")), None
    few = F.broadcast(long_ones) if n <= BROADCAST_IDS else long_ones
    same = rows["conv"].eqNullSafe(few["long_conv"])
    return rows.join(few, same, "left_anti").groupBy("conv").agg(listed.alias("rows")), rows.join(few, same, "left_semi")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs between states over each block, row by row, and the illegal pairs within it."""
    for batch in batches:
        costs = []
        for codes in batch.column(2).to_pylist():
            ends = [backward(bytes(codes), tuple(0 if q == end else FAR for q in range(4))) for end in range(4)]
            costs.append([min(vector[q] + least, FAR) for q in range(4) for vector, least in ends])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each block, from the blocks' costs (block, costs) in order."""
    for batch in batches:
        for conv, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            vector, found = END, []
            for block in reversed(blocks):
                found.append((block["block"], vector))
                costs = block["costs"]
                vector = [min(costs[4 * q + end] + vector[end] for end in range(4)) for q in range(4)]
                vector = tuple(x - min(vector) for x in vector)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([list(v) for _, v in found], pa.list_(pa.int64()))], names=["conv", "block", "vector"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and state: the edits, the state behind them and their cost; turns inserted at the end of the conversation are among the last block's."""
    for batch in batches:
        found = []
        for codes, vector, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            own = []
            for state in range(4):
                letters, end, cost = walk(bytes(codes), tuple(vector), state)
                more = closing(end) if last else ""
                own.append({"letters": "".join(letters) + more, "end": end, "cost": cost + INSERT * len(more)})
            found.append(own)
        kind = pa.list_(pa.struct([("letters", pa.string()), ("end", pa.int32()), ("cost", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["conv", "block", "walks"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block, from the states behind its walks (block, ends) in order."""
    for batch in batches:
        for conv, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state, found = NOTHING, []
            for block in blocks:
                found.append(state)
                state = block["ends"][state]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(found), pa.int64()), pa.array([b["block"] for b in blocks], pa.int64()), pa.array(found, pa.int32())], names=["conv", "block", "state"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits (step, edit, uid, new role) of blocks (conv, block, state, letters, initials, uids)."""
    for batch in batches:
        for conv, block, state, letters, initials, uids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            edits = list(script(letters, state, initials))
            n = len(edits)
            uid = [None if at is None else uids[at] for _, at, _ in edits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([e for e, _, _ in edits], pa.string()), pa.array(uid, pa.int64()), pa.array([r for _, _, r in edits], pa.string())],
                names=["conv", "block", "step", "edit", "uid", "new_role"],
            )


class _Long:
    """The repair of conversations that are dealt out in blocks."""

    def __init__(self, rows: DataFrame, block_rows: int):
        bare = F.rtrim(F.col("text"), F.lit(SPACE))
        digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        facts = rows.select("*", F.substring("role", 1, 1).alias("initial"), F.substring(bare, -1, 1).alias("last"), digest.alias("digest"), F.monotonically_increasing_id().alias("uid"))
        self.facts, _ = stored(facts, "long-rows")
        placed = ranked(self.facts.select("conv", "turn", "role", "text", "uid", "initial", "last", "digest"), ["conv"], ["turn", "role", "text", "uid"])
        # of equal rows the first in order is no duplicate: uids are unique, so the mark is joined without hot keys
        first = placed.groupBy("conv", "digest").agg(F.min("rank").alias("rank"))
        first = first.select(F.col("conv").alias("conv_f"), F.col("rank").alias("rank_f"), F.lit(True).alias("first"))
        placed = placed.select("conv", "turn", "rank", "total", "uid", "initial", "last")
        marked = placed.join(first, placed["conv"].eqNullSafe(first["conv_f"]) & (F.col("rank") == F.col("rank_f")), "left")
        fault = F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("last").isin(*ENDS), SOUND).otherwise(TRUNCATED)
        kind = F.lit(len(INITIALS))
        for i, initial in enumerate(INITIALS):
            kind = F.when(F.col("initial") == initial, i).otherwise(kind)
        size = F.greatest(F.lit(block_rows), F.ceil(F.sqrt("total"))).cast("long")
        rows_ = marked.select("conv", "turn", "uid", "rank", F.floor(F.col("rank") / size).alias("block"), fault.alias("fault"), "initial", (kind * 4 + fault).alias("code"), ((F.col("total") - 1) / size).cast("long").alias("last_block"))
        self.rows, _ = stored(rows_, "long-placed")
        members = F.sort_array(F.collect_list(F.struct("rank", "code", "uid", "initial")))
        blocks = self.rows.groupBy("conv", "block").agg(members.alias("m"), (F.first("last_block") == F.col("block")).alias("last"))
        self.blocks, _ = stored(blocks.select("conv", "block", "last", F.col("m.code").alias("codes"), F.col("m.uid").alias("uids"), F.col("m.initial").alias("initials")), "long-blocks")
        costs = self.blocks.select("conv", "block", "codes").mapInArrow(tidy(_matrices), "conv long, block long, costs array<long>")
        lists = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("blocks"))
        marks, _ = stored(lists.mapInArrow(tidy(_checkpoints), "conv long, block long, vector array<long>"), "long-checkpoints")
        walked = self._with(marks).select("conv", "block", "codes", "vector", "last")
        walks, _ = stored(walked.mapInArrow(tidy(_walks), "conv long, block long, walks array<struct<letters:string,end:int,cost:bigint>>"), "long-walks")
        ends = walks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", F.col("walks.end").alias("ends")))).alias("blocks"))
        taken = ends.mapInArrow(tidy(_taken), "conv long, block long, state int")
        chosen = self._with(taken, walks).withColumn("w", F.expr("walks[state]"))
        self.walks, _ = stored(chosen.select("conv", "block", "state", "w.letters", "w.cost"), "long-taken")

    def _with(self, right: DataFrame, left: DataFrame | None = None) -> DataFrame:
        left = self.blocks if left is None else left
        told = right.withColumnRenamed("conv", "conv_r").withColumnRenamed("block", "block_r")
        return left.join(told, left["conv"].eqNullSafe(told["conv_r"]) & (left["block"] == told["block_r"])).drop("conv_r", "block_r")

    def edits(self) -> DataFrame:
        told = self._with(self.walks).select("conv", "block", "state", "letters", "initials", "uids")
        told, _ = stored(told.mapInArrow(tidy(_told), "conv long, block long, step long, edit string, uid long, new_role string"), "long-edits")
        new = told.where("uid is null").select("conv", "block", "step", "edit", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), F.lit(None).cast("int").alias("fault"))
        own = told.where("uid is not null").join(self.facts.select("uid", "turn", "role", "text"), "uid").join(self.rows.select("uid", "fault"), "uid")
        return own.select("conv", "block", "step", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text", "fault").unionByName(new)

    def summaries(self) -> DataFrame:
        count = lambda fault, name: F.count_if(F.col("fault") == fault).alias(name)
        span = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("long").alias("span")
        counts = self.rows.groupBy("conv").agg(span, count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(TRUNCATED, "truncated"))
        turns = self.rows.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
        # pairs within a block, and the pair of its first row with the last one of the block before it
        inner = F.expr(f"case when size(initials) < 2 then 0 else size(filter(sequence(1, size(initials) - 1), i -> concat(initials[i - 1], initials[i]) not in {LEGAL})) end")
        ends = self.blocks.select("conv", inner.alias("inner"), F.lag(F.element_at("initials", -1)).over(Window.partitionBy("conv").orderBy("block")).alias("before"), F.col("initials")[0].alias("first"))
        outer = F.coalesce((~F.concat("before", "first").isin(*LEGAL)).cast("int"), F.lit(0))
        illegal = ends.groupBy("conv").agg(F.sum(F.col("inner") + outer).alias("illegal"))
        letters = F.sort_array(F.collect_list(F.struct("block", "letters")))
        audits = self.walks.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("audit"))
        turns_ = self.edits().where("edit <> 'D'").select("conv", "block", "step", "role", "text")
        # SHA-256 runs through a conversation in order: one task reads its turns as a stream, whatever its length
        hashes = turns_.repartition("conv").sortWithinPartitions("conv", "block", "step").mapInArrow(tidy(_hashed), "conv long, repaired_sha256 string")
        found = counts
        for more in (turns, illegal, audits, hashes):
            more = more.withColumnRenamed("conv", "conv_r")
            found = found.join(more, found["conv"].eqNullSafe(more["conv_r"]), "left").drop("conv_r")
        gaps = (F.col("span") - F.coalesce("turns", F.lit(0))).alias("gaps")
        return found.select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(NOTHING_SHA256)).alias("repaired_sha256"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's turns (conv, block, step, role, text), which come in order."""
    own, digest = (), None

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            if own != (conv,):
                if own:
                    yield given()
                own, digest = (conv,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if own:
        yield given()


def summaries(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = ROWS, most_bytes: int = BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation.

    Rows are taken by turn (nulls first), then role and text bytewise, so repeated rows are neighbours. A null role or text is one space, which is
    blank as a text and follows nothing as a role; an empty role has no initial and may be kept anywhere. A null id is a conversation. Texts may be of any length.
    gaps is the number of missing turns between the least and the greatest (0 without turns). A conversation of deleted rows
    only has the hash of the empty string. An empty table gives no rows. Only the four columns are read, so others may have any name.
    Whether a conversation is handled as one group (at most most_rows and most_bytes) or in blocks of at least block_rows doesn't change its result.
    """
    ship(conversations.sparkSession)
    short, long_ones = _split(_rows(conversations, id_col, turn_col, role_col, text_col), most_rows, most_bytes)
    found = short.mapInArrow(tidy(_summaries), SUMMARY)
    return found if long_ones is None else found.unionByName(_Long(long_ones, block_rows).summaries())


def edits(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = ROWS, most_bytes: int = BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv, block, step, edit (D, I, K or R), turn, role, text, fault: the edits of every conversation, in order of block and step.

    role is that after the edit; inserted turns have a null turn and fault and an empty text. Rows with edits other than D are the repaired conversation.
    What summaries() says of nulls, ties, lengths and empty tables holds here too.
    """
    ship(conversations.sparkSession)
    short, long_ones = _split(_rows(conversations, id_col, turn_col, role_col, text_col), most_rows, most_bytes)
    found = short.mapInArrow(tidy(_scripts), EDITS)
    return found if long_ones is None else found.unionByName(_Long(long_ones, block_rows).edits())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of ``conv_id:turn`` (nulls: a space) modulo 20 puts in: 0 drops a row, 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "nth")
