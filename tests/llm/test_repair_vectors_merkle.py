"""Conversation repair, embedding near-dedup and the Merkle manifest against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.llm import conversation_repair, merkle, vector_dedup

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversations -------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """All edits of (turn, role, text), cheapest and then ASCII-least, by plain recursion over rows and states."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        """(cost, edits, turns) from row i on; at most two turns are inserted in a place, since two lead back."""
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, edits, turns = best(i + 1, state, 0)
            found.append((cost + 4, "D" + edits, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if not role or (state, role[0]) in follows:
                    cost, edits, turns = best(i + 1, follows[state, role[0]] if role else state, 0)
                    found.append((cost + more, "K" + edits, (f"{role}:{text}", *turns)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in follows:
                        cost, edits, turns = best(i + 1, new[0], 0)
                        found.append((cost + more + 3, "R" + edits, (f"{new}:{text}", *turns)))
        if inserted < 2:
            for new in ("user", "assistant"):
                if (state, new[0]) in follows:
                    cost, edits, turns = best(i, new[0], inserted + 1)
                    found.append((cost + 3, "I" + edits, (f"{new}:", *turns)))
        return min(found, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 0)
    numbers = [t for t, _, _ in rows if t is not None]
    count = Counter(faults)
    legal = [a[1][:1] + b[1][:1] in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], legal.count(False), cost, audit, sha("\n".join(turns)), turns


def some_conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ähm"]
    texts = ["Yes.", "No!", "Why?", "so", "", " \t", None, "é…", "Done. \n"]
    found = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            at = rng.choice([turn, turn, turn, turn + 2, None])
            found.append((conv if conv else None, at, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.6 else rng.choice(texts)))
    return found


@pytest.mark.parametrize(("most_rows", "block_rows"), [(4096, 64), (0, 1), (3, 2)])
def test_repair_is_the_cheapest_and_ascii_least(spark, most_rows, block_rows):
    rows = some_conversations(11, 60, 9) + [(99, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(150)] + [(98, i, "user", f"text {i % 3}") for i in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("x")).withColumn("conv", F.lit("y"))
    got = conversation_repair.summaries(table, most_rows=most_rows, block_rows=block_rows)
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(tuple(row))
    want = {c: plain_repair(r) for c, r in groups.items()}
    assert {r["conv"]: tuple(r)[1:] for r in got.collect()} == {c: w[:8] for c, w in want.items()}
    turns = {}
    for r in sorted(conversation_repair.edits(table, most_rows=most_rows, block_rows=block_rows).collect(), key=lambda r: (r["block"], r["step"])):
        if r["edit"] != "D":
            turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert {c: tuple(t) for c, t in turns.items()} == {c: w[8] for c, w in want.items() if w[8]}


def test_walk_with_checkpoints_equals_the_sum_of_its_blocks():
    rng = random.Random(5)
    for n in (1, 2, 17, 400):
        rows = bytes(rng.randrange(20) for _ in range(n))
        letters, state, cost = conversation_repair.walk(rows, conversation_repair.END, 0)
        first, total = conversation_repair.backward(rows, conversation_repair.END)
        assert cost + 3 * len(conversation_repair.closing(state)) == total + first[0] and len(letters) == n


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.summaries(none).collect() == [] == conversation_repair.edits(none).collect()


def test_repair_query_on_planted_rows(spark, tmp_path):
    rows = some_conversations(3, 80, 8)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    told = lambda x: " " if x is None else x
    groups = {}
    for conv, turn, role, text in rows:
        role, text, own = told(role), told(text), groups.setdefault(conv, [])
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: plain_repair(r)[:8] for c, r in groups.items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in entry.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    columns = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert {r[0]: r[1:] for r in con.execute(f"select {columns} from ({entry.oracle_sql()['op11_conversation_repair']})").fetchall()} == want


# --- vectors -------------------------------------------------------------------------------------------------------


def plain_classes(rows, least=vector_dedup.COSINE):
    """(id, n_links, component_id) of (id, vector, label), all pairs compared."""
    rows = [(i, None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or g is None else np.array(v, float), g) for i, v, g in rows]
    rows = [(i, None if v is None else v / np.abs(v).max(), g) for i, v, g in rows]
    width = max((len(v) for _, v, _ in rows if v is not None), default=1)
    unit = np.array([np.zeros(width) if v is None else np.pad(v, (0, width - len(v))) / np.linalg.norm(v) for _, v, _ in rows])
    near = (unit @ unit.T >= least) & np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((find(i), find(j)))
        top[b] = a
    least_id = {}
    for i, (own, _, _) in enumerate(rows):
        t = find(i)
        least_id[t] = own if least_id.get(t) is None else least_id[t] if own is None else min(own, least_id[t])
    return sorted(((own, int(near[i].sum()), least_id[find(i)], own == least_id[find(i)]) for i, (own, _, _) in enumerate(rows)), key=str)


def near_copies(rng, base, n, cosine):
    """n vectors at about the given cosine from base."""
    base = base / np.linalg.norm(base)
    noise = rng.standard_normal((n, len(base)))
    noise -= np.outer(noise @ base, base)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return (cosine * base + np.sqrt(1 - cosine**2) * noise) * rng.uniform(0.1, 10, (n, 1))


def test_vector_classes_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    vectors = [*rng.standard_normal((2300, 24))]
    for cosine in (0.925, 0.9299, 0.9301, 0.935, 0.95, 0.99):
        for _ in range(60):
            base = rng.standard_normal(24)
            vectors += [base, *near_copies(rng, base, 1, cosine)]
    vectors += [*near_copies(rng, rng.standard_normal(24), 300, 0.97)]
    rows = [(i, v.tolist(), int(rng.integers(0, 2))) for i, v in enumerate(vectors)]
    rows += [(10**6 + i, rows[3][1], rows[3][2]) for i in range(50)] + [(5, rows[3][1], rows[3][2]), (6, rows[9][1], None), (None, rows[9][1], rows[9][2])]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1e200] * 24, [1e-200] * 24, [1.0], [2.0, 0.0]]
    rows += [(2 * 10**6 + i, v, 1) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(map(tuple, vector_dedup.classes(table).collect()), key=str)
    want = [(a, b, c, d or a is None and c is None) for a, b, c, d in plain_classes(rows)]
    assert got == want
    assert sum(b > 0 for _, b, _, _ in got) > 500


def test_collisions_are_counted_as_windows_say():
    rng = np.random.default_rng(1)
    half, need = vector_dedup.counted(0.93)
    a, b = (rng.integers(0, 2 * vector_dedup.STEPS + 1, (64, n)).astype(np.uint16) for n in (37, 50))
    plain = (np.abs(a.astype(int)[:, :, None] - b.astype(int)[:, None, :]) <= half).sum(0)
    assert (vector_dedup.collisions(a, b, half, 0) == plain).all()
    assert ((vector_dedup.collisions(a, b, half, need) >= need) == (plain >= need)).all()
    # the count is calibrated: pairs at the least cosine nearly always reach it
    u = rng.standard_normal((4000, 32))
    v = np.array([near_copies(rng, x, 1, 0.93)[0] for x in u])
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v))
    directions = rng.standard_normal((32, 64))
    hits = (np.abs((u - v) @ directions) * vector_dedup.STEPS / vector_dedup.REACH <= half).sum(1)
    assert (hits >= need).all() and need > 32


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.classes(none).collect() == []


def test_embedding_query_on_planted_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    real = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    some = [r for r in real.collect()]
    more = [(10**6 + 10 * i + j, v.astype(np.float32).tolist(), some[i].label) for i in range(40) for j, v in enumerate(near_copies(rng, np.array(some[i].embedding), 3, 0.94))]
    real.unionByName(spark.createDataFrame(more, real.schema)).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["op12_embedding_dedup"]).fetchall())
    got = sorted(map(tuple, entry.queries()["op12_embedding_dedup"](spark, str(tmp_path)).collect()))
    assert got == want and sum(n > 0 for _, n, _, _ in got) >= 120


# --- Merkle --------------------------------------------------------------------------------------------------------


def H(*x):
    return sha("".join(x))


def plain_manifest(rows, tamper):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text), level by level."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda s: None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([H(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
        return found

    def path(tree, i):
        for level in tree[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            yield run[: i % 16], run[i % 16 + 1 :]
            i //= 16

    leaves = {}
    for r in rows:
        other = H(*map(told, r[:4]), told(low(r[4]))) if tamper(r[0]) else H(*map(told, r))
        leaves.setdefault(r[1], []).append((r[0], H(*map(told, r)), other))
    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        leaves[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(levels([x[1] for x in leaves[s]]))
    top, found = levels([t[-1][0] for t in trees]), []
    for k, s in enumerate(sources):
        for i, (own, leaf, other) in enumerate(leaves[s]):
            proof, at = [*path(trees[k], i), *path(top, k)], other
            for left, right in proof:
                at = H(*left, at, *right)
            found.append((own, leaf, trees[k][-1][0], top[-1][0], H(*[x for a, b in proof for x in a + b]), at, at == top[-1][0]))
    return sorted(found, key=str)


def tampered(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def some_docs(sources):
    rng = random.Random(4)
    return [(rng.choice([None, i, i, 7]), s, rng.choice(["en", None, "Ü"]), rng.choice([None, i]), rng.choice([None, "", "abc", "ABC Ü", "x" * 5000 + "Y"])) for s, n in sources for i in range(n)]


@pytest.mark.parametrize("sources", [[("a", 1)], [("a", 40)], [(None, 1), ("b", 2), ("Z", 16), ("é", 17), ("c", 300)], [(f"s{i}", i % 3 + 1) for i in range(290)] + [("big", 600)]])
def test_manifest_against_a_plain_one(spark, sources):
    rows = some_docs(sources)
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2))
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    change = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    got = merkle.manifest(docs, {"text": F.when(change, lower).otherwise(F.col("text"))})
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, tampered)
    assert all(r.verified for r in merkle.manifest(docs).select("verified").distinct().collect())


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_query_and_its_sql(spark, tmp_path):
    rows = [r for r in some_docs([(None, 3), ("b", 20), ("a", 300), ("c", 1)])]
    rows = [(10 * k + 3, *r[1:]) for k, r in enumerate(rows)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = sorted(map(tuple, entry.queries()["op13_merkle_manifest"](spark, str(tmp_path)).select(*columns.split(", ")).collect()), key=str)
    assert got == sorted(con.execute(f"select {columns} from ({entry.oracle_sql()['op13_merkle_manifest']})").fetchall(), key=str) == plain_manifest(rows, tampered)
