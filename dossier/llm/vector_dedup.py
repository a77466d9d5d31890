"""Near-duplicate vectors by collision-counting projections.

Vectors of unit length are projected on many random directions. Two of them collide in a projection if one lies in the window of
half-width w around the other; the difference of two vectors of cosine c projects on a normal variable of variance 2 (1 - c), so a pair at the least cosine
collides in a projection with a known chance, and its number of collisions is binomial. The count that it reaches with a
chance of at least 1 - MISS is asked of every pair; pairs that reach it are verified by their cosine in double precision.

Vectors of a label are sorted along the first projection and split along the others into leaves, whose values in every projection
span an interval. Leaves (and blocks of them) meet only if their intervals come within w of each other in enough projections: no pair of the others
can reach the count. Where leaves meet, windows are counted on whole numbers. A meeting gives each vector's number of links and a spanning
forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, shuffle_width, stored, tidy, with_groups, with_payloads
from .near_dedup import components
from .topk_search import small_batches

COSINE, PROJECTIONS = 0.93, 64
#: Half a window in standard deviations of the difference at the least cosine; the chance that a pair at the least cosine isn't verified.
HALF, MISS = 1.5, 1e-6
LEAF, BLOCK, PART = 256, 2048, 8192
#: Projections count in steps of REACH / STEPS and are held within REACH; beyond it windows only grow.
REACH, STEPS = 3.0, 16000
SEED = 20240607
BLOCKS = "block long, label string, data binary, lo array<int>, hi array<int>"


def counted(least: float, projections: int = PROJECTIONS) -> tuple[int, int]:
    """Half a window in steps, and the collisions that a pair of the least cosine reaches but for a chance of MISS."""
    if not -1 < least <= 1:
        raise ValueError("the least cosine is above -1 and at most 1")
    chance = math.erf(HALF / math.sqrt(2)) if least < 1 else 1.0
    below, need = 0.0, 0
    while need < projections:
        below += math.comb(projections, need) * chance**need * (1 - chance) ** (projections - need)
        if below > MISS:
            break
        need += 1
    # two values are rounded, by half a step each
    return math.ceil(HALF * math.sqrt(2 * (1 - least)) * STEPS / REACH) + 1, need


def _split(codes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows in leaves: halved along the projection in which they spread most."""
    if len(rows) <= LEAF:
        return [rows]
    own = codes[rows]
    along = own[:, int(np.argmax(own.std(0)))]
    order = np.argpartition(along, len(rows) // 2)
    return _split(codes, rows[order[: len(rows) // 2]]) + _split(codes, rows[order[len(rows) // 2 :]])


def _blocks(width: int, projections: int):
    """Blocks of the rows (label, lead, node, members, unit) of a task, which are sorted by label."""

    def packed(label, nodes, members, unit, codes) -> Iterator[pa.RecordBatch]:
        leaves = _split(codes.astype(np.int32), np.arange(len(nodes)))
        step = max(1, BLOCK // LEAF)
        for at in range(0, len(leaves), step):
            some = leaves[at : at + step]
            rows = np.concatenate(some)
            ends = np.cumsum([len(x) for x in some])
            own = codes[rows]
            lows = np.stack([codes[x].min(0) for x in some])
            highs = np.stack([codes[x].max(0) for x in some])
            head = np.array([len(rows), len(some), width, projections], "<i8")
            data = b"".join(x.tobytes() for x in (head, ends.astype("<i8"), nodes[rows], members[rows], unit[rows], own, lows, highs))
            yield pa.RecordBatch.from_arrays(
                [pa.array([packed.next], pa.int64()), pa.array([label], pa.string()), pa.array([data], pa.binary()), pa.array([lows.min(0).tolist()], pa.list_(pa.int32())), pa.array([highs.max(0).tolist()], pa.list_(pa.int32()))],
                names=["block", "label", "data", "lo", "hi"],
            )
            packed.next += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed.next = TaskContext.get().partitionId() << 32
        directions = np.random.default_rng(SEED).standard_normal((width, projections))
        label, held, n = None, [], 0

        def flush():
            nodes, members, unit = (np.concatenate([h[i] for h in held]) for i in range(3))
            values = np.clip(unit @ directions, -REACH, REACH)
            return packed(label, nodes, members, unit, np.rint(values * (STEPS / REACH)).astype("<i2"))

        for batch in batches:
            labels = batch.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(labels)) if labels[i] != labels[i - 1]], len(labels)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if n and (labels[a] != label or n >= PART):
                        yield from flush()
                        held, n = [], 0
                    label, c = labels[a], min(b, a + PART - n)
                    part = batch.slice(a, c - a)
                    unit = np.frombuffer(b"".join(part.column(4).to_pylist()), "<f8").reshape(c - a, width)
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), unit))
                    n, a = n + c - a, c
        if n:
            yield from flush()

    return run


def _units(width: int, projections: int):
    """lead (the first projection) and unit vector of (node, label, members, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.random.default_rng(SEED).standard_normal((width, projections))[:, 0]
        for batch in batches:
            v = batch.column(3)
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            dense = np.zeros((batch.num_rows, width))
            row = np.repeat(np.arange(batch.num_rows), lengths)
            dense[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = v.flatten().to_numpy()
            # scaled first, so that squares neither overflow nor vanish
            dense /= np.abs(dense).max(1, initial=1e-300, keepdims=True)
            dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
            data = [x.tobytes() for x in dense.astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(dense @ lead), batch.column(0), batch.column(2), pa.array(data, pa.binary())], names=["label", "lead", "node", "members", "unit"])

    return run


class _Block:
    def __init__(self, data: bytes):
        n, leaves, width, projections = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at = 32

        def take(kind: str, rows: int, columns: int = 1) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, rows * columns, at)
            at += found.nbytes
            return found.reshape(rows, columns) if columns > 1 else found

        ends = take("<i8", leaves)
        self.leaves = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))
        self.nodes, self.members = take("<i8", n), take("<i8", n)
        self.unit = take("<f8", n * width).reshape(n, width)
        self.codes = take("<i2", n * projections).reshape(n, projections)
        self.lo, self.hi = (take("<i2", leaves * projections).reshape(leaves, projections).astype(np.int32) for _ in range(2))
        # by projection, as unsigned numbers, for counting
        self.steps = np.ascontiguousarray(self.codes.T.astype(np.int32) + STEPS).astype(np.uint16)


def collisions(a: np.ndarray, b: np.ndarray, half: int, need: int) -> np.ndarray:
    """How many windows each row of a (projections x rows, unsigned steps) shares with each of b; counting ends where none can reach need."""
    count = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    apart, hit = np.empty(count.shape, np.uint16), np.empty(count.shape, bool)
    for j in range(len(a)):
        # a - b + half lies in 0 .. 2 half for a collision and beyond it, by wrapping round, for none
        np.subtract((a[j] + np.uint16(half))[:, None], b[j][None, :], out=apart)
        np.less_equal(apart, np.uint16(2 * half), out=hit)
        np.add(count, hit.view(np.uint8), out=count)
        if j % 8 == 7 and int(count.max()) + len(a) - 1 - j < need:
            break
    return count


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; root points from each vector to the smallest of its tree."""
    while True:
        x, y = root[i], root[j]
        differ = x != y
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root[:] = root[root]


def _meet(least: float, half: int, need: int):
    """node, links, top (the smallest vector of the node's tree) for each meeting (data, data_b) of two blocks; data_b is null where a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, data_b in zip(batch.column(0), batch.column(1), strict=True):
                a = _Block(data.as_py())
                same = not data_b.is_valid
                b = a if same else _Block(data_b.as_py())
                shift = 0 if same else len(a.nodes)
                nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
                links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for p, (a0, a1) in enumerate(a.leaves):
                    near = ((a.lo[p] - b.hi <= half) & (b.lo - a.hi[p] <= half)).sum(1) >= need
                    for q in np.flatnonzero(near):
                        if same and q < p:
                            continue
                        b0, b1 = b.leaves[q]
                        i, j = np.nonzero(collisions(a.steps[:, a0:a1], b.steps[:, b0:b1], half, need) >= need)
                        if same and p == q:
                            i, j = i[i < j], j[i < j]
                        if not len(i):
                            continue
                        if len(i) * 8 > (a1 - a0) * (b1 - b0):
                            cosine = (a.unit[a0:a1] @ b.unit[b0:b1].T)[i, j]
                        else:
                            cosine = np.einsum("ij,ij->i", a.unit[a0 + i], b.unit[b0 + j])
                        true = cosine >= least
                        i, j = a0 + i[true], b0 + j[true]
                        np.add.at(links, i, b.members[j])
                        np.add.at(links, shift + j, a.members[i])
                        _merge(root, i, shift + j)
                found = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(links[found]), pa.array(nodes[root[found]])], names=["node", "links", "top"])

    return run


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = COSINE, projections: int = PROJECTIONS) -> DataFrame:
    """id, n_links, component_id, kept: one row for each row of vectors.

    Two rows of the same label are linked if their cosine is at least least; n_links counts the other rows that a row is linked with, component_id
    is the smallest id that links reach, kept tells the rows of that id. A link at least itself is missed with a chance of MISS, closer ones less
    often; nothing below least is linked. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing. Missing trailing components count as 0. Equal vectors of a label are one vector with their number as weight. A null id takes part
    and names a component only if it has no other; rows that share an id are rows each; an empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    half, need = counted(least, projections)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & _usable(F.col("v")), F.unhex(F.sha2(F.concat_ws(":", "label", F.array_join("v", ",")), 256))))
    rows, _ = stored(rows, "vectors")
    total = rows.count()
    sets = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("members"), F.min("id").alias("least_id"))
    sets, _ = stored(sets.withColumn("node", F.monotonically_increasing_id()), "vector-sets")
    n, width = sets.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone

    units = sets.select("node", "label", "members", "v").mapInArrow(tidy(_units(width, projections)), "label string, lead double, node long, members long, unit binary")
    dealt = units.repartitionByRange(max(1, -(-n // PART)), "label", "lead", "node").sortWithinPartitions("label", "lead", "node")
    blocks, _ = stored(dealt.mapInArrow(tidy(_blocks(width, projections)), BLOCKS), "vector-blocks")
    heads = blocks.select("block", "label", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(shuffle_width(spark))).alias("bucket"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shuffle_width(spark) - 1).cast("long")))
    others = heads.select(F.col("block").alias("b"), "label", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), every.alias("bucket"))
    near = F.expr(f"aggregate(zip_with(zip_with(lo, hi_b, (x, y) -> x - y), zip_with(lo_b, hi, (x, y) -> x - y), (x, y) -> if(x <= {half} and y <= {half}, 1, 0)), 0, (x, y) -> x + y)")
    meetings = heads.join(others, ["label", "bucket"]).where(F.col("block") <= F.col("b")).where(near >= need).select(F.col("block").alias("a"), "b")
    meetings, _ = stored(meetings, "vector-meetings")
    with small_batches(spark, 8):
        pairs = with_payloads(meetings.where("a <> b"), blocks, "block", "data", {"a": "data_a", "b": "data_b"}).select("data_a", "data_b")
        own = blocks.select(F.col("data").alias("data_a"), F.lit(None).cast("binary").alias("data_b"))
        met, _ = stored(pairs.unionByName(own).mapInArrow(tidy(_meet(least, half, need)), "node long, links long, top long"), "vector-links")
    labels = components(met.where("node <> top").select(F.col("node").alias("x"), F.col("top").alias("y")).distinct()).withColumnRenamed("label", "top")
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = sets.select("node", "key", "members", "least_id").join(labels, "node", "left").join(linked, "node", "left")
    links = F.col("members") - 1 + F.coalesce("links", F.lit(0))
    named, _ = stored(named.select("key", "members", "least_id", F.coalesce("top", "node").alias("top"), links.alias("n_links")), "vector-named")
    tops = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    known, _ = stored(named.join(tops, "top").select("key", "members", "n_links", "component_id"), "vector-known")
    found = with_groups(rows.where("key is not null").select("id", "key"), known, "key", "members", total)
    return found.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
