"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) is factored down a tree of three levels: class, subclass and bucket, then the word itself. The first three
factors are maximum-entropy models over hashed features of the history, so what is a word's chance within its class depends on the history
as well; only P(word | bucket) comes from the exact counts, of the one word in 4096 that share a bucket. Classes come from
clustering how shapes of words (their endings, or short words whole) follow each other, subclasses split a class's shapes into
parts of equal weight, and the bucket is part of the word's hash. Features are the last word, skips to the second and third last and the
last two words for the class, the last word and the skip to the second last for the subclass, the last word for the bucket.

The corpus is tokenised once into blocks of integer codes, written to the shared folder. Counts are summed over all blocks by
ranges of the word hash. Training runs in rounds of distributed gradient updates: each task takes gradient
steps over its blocks from the common parameters, and the parameters of all tasks are averaged by slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, ship, shuffle_width, stored, text_or_empty
from .topk_search import small_batches

#: Shapes of words (one more stands for the end of a text), branches of each level, bits of the feature hash of a level.
SHAPES, WAYS, FEATURE_BITS = 1024, 16, 16
#: Parts of the history that each level sees: 0 to 2 the last, second and third last word, 3 the last two.
LEVELS = ((0, 1, 2, 3), (0, 1), (0,))
#: Bytes of text in a block at most, unless one text alone is longer; tokens in a gradient step.
BLOCK_BYTES, STEP_TOKENS = 8 << 20, 16384
#: Rounds of an epoch: each takes another part of the blocks, together they take all.
ROUNDS, RATE = 3, 0.15
#: Sums of weights are held within this bound, so no exponential overflows or vanishes.
BOUND = 40.0
#: Squares that a task adds to a row it has seen a few times.
FEW = 10.0
#: Tasks that train at most, and slices in which parameters travel: what a task that averages a slice gets is bounded.
TRAINERS, SLICES = 1024, 256
#: Sums over tasks are made in two steps, of so many groups at first.
GROUPS = 64
ENCODED = "kind string, k1 long, k2 long, a binary, b binary, c binary, d binary, e binary"
END_HASH = np.uint64(0x9E3779B97F4A7C15)
BRANCHES = np.ones(WAYS, np.float32)


def shape(word: bytes) -> bytes:
    """Short words are their own shape; of longer ones the ends decide."""
    return word if len(word) <= 3 else b"~" + word[-3:]


def _words(batch: pa.RecordBatch):
    """Codes of all tokens, tokens of each text, hashes and shapes of the codes; codes are in the order of the hashes."""
    texts = lower_ascii(batch.column(2))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.binary_length(flat).to_numpy() > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, names), np.uint64, len(names))
    shapes = np.fromiter((digest(shape(w)) for w in names), np.uint64, len(names)) % np.uint64(SHAPES)
    hashes, shapes = np.append(hashes, END_HASH), np.append(shapes, SHAPES).astype(np.uint16)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    counts = np.bincount(text[full], minlength=len(texts))
    codes = np.insert(rank[coded.indices.to_numpy()], np.cumsum(counts), rank[-1])
    return codes, counts + 1, hashes[order], shapes[order]


def _encode(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (SHAPES + 1) ** 2
        pairs = np.zeros(kinds, np.int64)
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(2)).to_numpy().astype(np.int64))
            first = 0
            while first < whole.num_rows:
                before = size[first - 1] if first else 0
                after = max(first + 1, int(np.searchsorted(size, before + BLOCK_BYTES, "right")))
                batch = whole.slice(first, after - first)
                first = after
                codes, counts, hashes, shapes = _words(batch)
                held = np.array(batch.column(1).to_pylist(), bool)
                learnt = ~np.repeat(held, counts)
                n = np.bincount(codes[learnt], minlength=len(hashes)).astype(np.uint32)
                s = shapes[codes].astype(np.int64)
                inside = learnt[1:] & (s[:-1] != SHAPES)
                pairs += np.bincount((s[:-1] * (SHAPES + 1) + s[1:])[inside], minlength=kinds)
                ids = np.array([0 if x is None else x for x in batch.column(0).to_pylist()], "<i8")
                missing = np.array([x is None for x in batch.column(0).to_pylist()], bool)
                yield _row("B", block, 0, ids.tobytes() + missing.tobytes() + held.tobytes(), counts.astype("<i4").tobytes(), pack(codes.astype("<i4").tobytes()), (hashes >> np.uint64(32)).astype("<u4").tobytes(), shapes.astype("<u2").tobytes())
                edges = np.searchsorted(hashes, (np.arange(ranges + 1, dtype=object) * 2**64 // ranges)[:-1].astype(np.uint64)).tolist() + [len(hashes)]
                for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    if a < b:
                        yield _row("S", r, block, hashes[a:b].tobytes(), n[a:b].tobytes(), shapes[a:b].tobytes())
                block += 1
        if pairs.any():
            for k, own in enumerate(pairs.reshape(SHAPES + 1, -1)):
                if own.any():
                    yield _row("P", k, TaskContext.get().partitionId(), pack(own.astype("<i8").tobytes()))

    return run


def _row(kind: str, k1: int, k2: int, *data: bytes) -> pa.RecordBatch:
    columns = [pa.array([kind]), pa.array([k1], pa.int64()), pa.array([k2], pa.int64())]
    columns += [pa.array([data[i] if i < len(data) else None], pa.binary()) for i in range(5)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "k1", "k2", "a", "b", "c", "d", "e"])


def _merged(group: pa.Table) -> pa.Table:
    """Sums the counts of a range of hashes over the blocks: the sums for each block, and sums by shape and bucket."""
    hashes = [np.frombuffer(x, np.uint64) for x in group.column("a").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("b").to_pylist()])
    shapes = np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("c").to_pylist()])
    distinct, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=n).astype(np.int64)
    known = total > 0
    own = shapes[first][known].astype(np.int64) * WAYS + bucket(distinct[known] >> np.uint64(32))
    cells = (SHAPES + 1) * WAYS
    sums = np.concatenate([np.bincount(own, weights=total[known], minlength=cells), np.bincount(own, minlength=cells)])
    ends = np.cumsum([0, *map(len, hashes)])
    blocks = [*group.column("k2").to_pylist(), None]
    pack = zstandard.ZstdCompressor(level=1).compress
    each = [pack(total[at[a:b]].astype("<i8").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
    k = group.column("k1")[0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array([k] * len(blocks), pa.int64()), "counts": pa.array([*each, None], pa.binary()), "sums": pa.array([None] * len(each) + [pack(sums.astype("<i8").tobytes())], pa.binary())})


def _sums_merged(group: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    total = sum(np.frombuffer(unpack(x), "<i8") for x in group.column("sums").to_pylist())
    return pa.table({"sums": pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def _pairs_merged(group: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    total = sum(np.frombuffer(unpack(x), "<i8") for x in group.column("a").to_pylist())
    return pa.table({"k1": group.column("k1").slice(0, 1), "a": pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def shape_tree(pairs: np.ndarray, sums: np.ndarray, vectors: int = 12) -> np.ndarray:
    """Class and subclass of each shape: clusters of the leading singular directions of what follows and precedes it, each dealt into parts of equal weight."""
    both = pairs + pairs.T + 1e-3
    degree = both.sum(1)
    scale = 1 / np.sqrt(degree)
    _, vec = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    points = vec[:, -vectors:] * scale[:, None] * np.sqrt(degree.sum())
    points = points / np.maximum(1e-9, np.linalg.norm(points, axis=1))[:, None]
    weight = sums.astype(float) + 1e-6
    centres = points[[int(weight.argmax())]]
    for _ in range(1, WAYS):
        far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, points[int((far * weight).argmax())]])
    for _ in range(25):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(WAYS):
            if weight[own == c].sum() > 0:
                centres[c] = np.average(points[own == c], axis=0, weights=weight[own == c])
    part, load = np.zeros(len(own), np.int64), np.zeros((WAYS, WAYS))
    for x in np.argsort(-weight, kind="stable"):
        part[x] = load[own[x]].argmin()
        load[own[x], part[x]] += weight[x]
    return np.stack([own, part])


def bucket(hashes: np.ndarray) -> np.ndarray:
    """The branch of the last level, from the upper half of a word's hash."""
    return (hashes & hashes.dtype.type(WAYS - 1)).astype(np.int64)


def paths(tree: np.ndarray, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The branches of each word, a row for each level."""
    return np.stack([tree[0][shapes], tree[1][shapes], bucket(hashes)])


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - FEATURE_BITS)).astype(np.uint16)


def features(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """For each level, the rows of its table that each token's features name: one for each part of the history and one for the bias.

    hashes: 32 bits of each word's hash; own: the branches of each token. What a level sees is hashed together with the branches above it.
    """
    n = len(codes)
    word = hashes[codes] | np.uint32(1)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    back = []
    for k in (1, 2, 3):
        w = np.zeros(n, np.uint32)
        w[k:] = word[:-k] if k < n else word[:0]
        w[place < k] = 0
        back.append(w)
    odd = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    both = back[0] * np.uint32(0x165667B1) + back[1] * np.uint32(0xD3A2646D) ^ (back[1] >> np.uint32(3))
    seen = [w * o for w, o in zip([*back, both], odd, strict=True)]
    found, above = [], np.zeros(n, np.uint32)
    for k, parts in enumerate(LEVELS):
        salt = (above + np.uint32(1)) * np.uint32(0x9E3779B9)
        found.append(np.stack([*[_mixed(seen[i] ^ salt) for i in parts], _mixed(salt)]))
        above = above * np.uint32(WAYS) + own[k].astype(np.uint32) + np.uint32(1)
    return found


def weights(table: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The sum of the features' weights for each branch, a row for each token."""
    logits = table.take(f[0], axis=0)
    for row in f[1:]:
        logits += table.take(row, axis=0)
    return np.clip(logits, -BOUND, BOUND, out=logits)


def log_chances(table: np.ndarray, f: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Natural log of P(own branch | features) for each token."""
    logits = weights(table, f)
    return logits[np.arange(len(own)), own] - np.log(np.exp(logits) @ BRANCHES)


def descend(table: np.ndarray, squares: np.ndarray, f: np.ndarray, own: np.ndarray) -> None:
    """One gradient step, in place, on the rows that the tokens' features name; each row has one step length."""
    slope = weights(table, f)
    np.exp(slope, out=slope)
    slope *= (1 / (slope @ BRANCHES))[:, None]
    slope[np.arange(len(own)), own] -= 1
    flat = f.ravel()
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    rows = ranked[starts].astype(np.intp)
    step = np.add.reduceat(slope.take(order % len(own), axis=0), starts, axis=0)
    sums = squares.take(rows) + np.einsum("ij,ij->i", step, step) / WAYS
    squares[rows] = sums
    step *= (RATE / (np.sqrt(sums) + 1e-6))[:, None]
    table[rows] = table.take(rows, axis=0) - step


def _block(batch: pa.RecordBatch, r: int):
    at = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
    counts = np.frombuffer(at["b"], "<i4")
    n = len(counts)
    ids, missing, held = np.frombuffer(at["a"][: 8 * n], "<i8"), np.frombuffer(at["a"][8 * n : 9 * n], bool), np.frombuffer(at["a"][9 * n :], bool)
    codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(at["c"]), "<i4")
    return ids, missing, held, counts, codes, np.frombuffer(at["d"], "<u4"), np.frombuffer(at["e"], "<u2")


def trained(tables: np.ndarray, squares: np.ndarray, blocks: Iterator, tree: np.ndarray) -> int:
    """Takes the gradient steps of all blocks, in place, and returns the number of tokens learnt from."""
    seen = 0
    for _, _, held, counts, codes, hashes, shapes in blocks:
        learnt = np.flatnonzero(~np.repeat(held, counts))
        own = paths(tree, hashes, shapes)[:, codes]
        f = features(hashes, codes, counts, own)
        for at in range(0, len(learnt), STEP_TOKENS):
            some = learnt[at : at + STEP_TOKENS]
            for k in range(len(LEVELS)):
                descend(tables[k], squares[k], f[k][:, some], own[k][some])
        seen += len(learnt)
    return seen


def slices(before: tuple, after: tuple) -> Iterator[tuple[int, bytes, bytes]]:
    """What a task changed: slices of its steps in half precision, and of what it added to the squares."""
    steps, added = ((x - y).reshape(-1, *x.shape[2:]) for x, y in zip(after, before, strict=True))
    for k, (t, q) in enumerate(zip(np.split(steps.astype(np.float16), SLICES), np.split(added, SLICES), strict=True)):
        yield k, t.tobytes(), q.tobytes()


def merged_slices(steps: list[bytes], added: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' changes of a slice as one change.

    Of a row that each task has learnt well the mean step is taken, weighted by the squares that the tasks added; of one that each saw a few times
    only, steps go on as they would in one task, by the root of the number of tasks. FEW squares are the middle between the two.
    """
    mean = weight = squares = 0
    for t, q in zip(steps, added, strict=True):
        q = np.frombuffer(q, np.float32).astype(float)
        mean = mean + q[:, None] * np.frombuffer(t, np.float16).reshape(len(q), WAYS)
        weight, squares = weight + q, squares + q * q
    some = np.maximum(weight, 1e-30)
    typical, tasks = squares / some, weight * weight / np.maximum(squares, 1e-30)
    onward = 1 + (np.sqrt(np.maximum(tasks, 1)) - 1) * FEW / (FEW + typical)
    return (mean / some[:, None] * onward[:, None]).astype(np.float32), weight.astype(np.float32)


def _gradients(sent, tree: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tuple(x.copy() for x in sent.value)
        if trained(*own, (_block(batch, r) for batch in batches for r in range(batch.num_rows)), tree):
            for k, t, q in slices(sent.value, own):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t], pa.binary()), pa.array([q], pa.binary())], names=["slice", "t", "q"])

    return run


def _averaged(group: pa.Table) -> pa.Table:
    t, q = merged_slices(group.column("t").to_pylist(), group.column("q").to_pylist())
    return pa.table({"slice": group.column("slice").slice(0, 1), "t": pa.array([t.tobytes()], pa.binary()), "q": pa.array([q.tobytes()], pa.binary())})


def leaf(own: np.ndarray) -> np.ndarray:
    """The number of the bucket that branches lead to."""
    return (own[0] * WAYS + own[1]) * WAYS + own[2]


def bucket_mass(tree: np.ndarray, learnt: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of each bucket's sum of smoothed counts, its unknown word's included; from tokens and words by shape and bucket."""
    at = leaf(np.stack(np.broadcast_arrays(tree[0][:, None], tree[1][:, None], np.arange(WAYS))))
    return np.log10(np.bincount(at.ravel(), weights=(learnt + 0.5 * kinds).ravel(), minlength=WAYS ** len(LEVELS)) + 0.5)


def text_scores(tables: np.ndarray, tree: np.ndarray, mass: np.ndarray, smooth: np.ndarray, block: tuple) -> np.ndarray:
    """log10 of the model's chance of each token of a block; smooth: log10 of each code's smoothed count, mass: of each bucket's sum of these."""
    _, _, _, counts, codes, hashes, shapes = block
    own = paths(tree, hashes, shapes)[:, codes]
    f, chance = features(hashes, codes, counts, own), np.zeros(len(codes))
    for at in range(0, len(codes), STEP_TOKENS):
        some = slice(at, at + STEP_TOKENS)
        for k in range(len(LEVELS)):
            chance[some] += log_chances(tables[k], f[k][:, some], own[k][some])
    return smooth[codes] - mass[leaf(own)] + chance / np.log(10)


def _scored(sent, tree: np.ndarray, mass: np.ndarray, total: int, kinds: int):
    base = np.log10(total + 0.5 * (kinds + 1))

    def run(key, blocks: pa.Table, sums: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        parts = sorted(zip(sums.column("range").to_pylist(), sums.column("counts").to_pylist(), strict=True))
        c = np.concatenate([np.frombuffer(unpack(x), "<i8") for _, x in parts]) if parts else np.zeros(0)
        smooth = np.log10(c + 0.5)
        out = []
        for batch in blocks.to_batches():
            for r in range(batch.num_rows):
                block = _block(batch, r)
                ids, missing, held, counts, codes, _, _ = block
                starts = np.cumsum(counts) - counts
                sum_of = lambda x, starts=starts: np.add.reduceat(x, starts)
                columns = [pa.array(ids, mask=missing), pa.array(held), pa.array(counts, pa.int64()), pa.array(sum_of((c[codes] > 0).astype(np.int64))), pa.array(sum_of(smooth[codes]) - counts * base), pa.array(sum_of(text_scores(sent.value[0], tree, mass, smooth, block)))]
                out.append(pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    return run


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text).

    Learns from the rows that held_out doesn't select (null counts as not selected) and scores all. Tokens are words between
    ASCII white space, A-Z lower-cased, and one end. base_score is the sum of smoothed unigram chances. An unknown word is its
    bucket's unknown word in the model, the one unknown word in the base. Null texts are empty and hold just the end. A null id is kept; repeated rows are scored each;
    an empty table gives no rows; if nothing is learnt, all words are unknown. For counts, words are told
    apart by 64 bits of their hashes, in the history by 31.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_or_empty(text_col).alias("text"))
    encoded, _ = stored(rows.mapInArrow(_encode(shuffle_width(spark)), ENCODED), "lm-blocks")
    blocks = encoded.where("kind = 'B'").select("k1", "a", "b", "c", "d", "e")
    merged, _ = stored(encoded.where("kind = 'S'").select("k1", "k2", "a", "b", "c").groupBy("k1").applyInArrow(_merged, "block long, range long, counts binary, sums binary"), "lm-counts")
    sums = np.zeros(2 * (SHAPES + 1) * WAYS, np.int64)
    group = F.pmod("range", F.lit(GROUPS)).alias("group")
    for r in merged.where("sums is not null").select(group, "sums").groupBy("group").applyInArrow(_sums_merged, "sums binary").collect():
        sums += np.frombuffer(zstandard.decompress(r.sums), "<i8")
    learnt, kinds_in = sums.reshape(2, SHAPES + 1, WAYS)
    pairs = np.zeros((SHAPES + 1, SHAPES + 1))
    some = encoded.where("kind = 'P'").select("k1", "a", F.pmod("k2", F.lit(GROUPS)).alias("group")).groupBy("k1", "group").applyInArrow(_pairs_merged, "k1 long, a binary")
    for r in some.groupBy("k1").applyInArrow(_pairs_merged, "k1 long, a binary").collect():
        pairs[r.k1] = np.frombuffer(zstandard.decompress(r.a), "<i8")
    tree = shape_tree(pairs, learnt.sum(1))
    mass = bucket_mass(tree, learnt, kinds_in)
    total, kinds = int(learnt.sum()), int(kinds_in.sum())

    tables, squares = np.zeros((len(LEVELS), 1 << FEATURE_BITS, WAYS), np.float32), np.zeros((len(LEVELS), 1 << FEATURE_BITS), np.float32)
    part = F.pmod(F.xxhash64("k1"), F.lit(ROUNDS))
    with small_batches(spark, 1):
        for k in range(ROUNDS):
            sent = spark.sparkContext.broadcast((tables, squares))
            own = blocks.where(part == k).coalesce(TRAINERS).mapInArrow(_gradients(sent, tree), "slice int, t binary, q binary")
            for r in own.groupBy("slice").applyInArrow(_averaged, "slice int, t binary, q binary").collect():
                t, q = (np.split(x.reshape(-1, *x.shape[2:]), SLICES)[r.slice] for x in (tables, squares))
                t += np.frombuffer(r.t, np.float32).reshape(t.shape)
                q += np.frombuffer(r.q, np.float32)
            sent.unpersist()
        counted = merged.where("block is not null").select(F.col("block").alias("k1"), "range", "counts")
        sent = spark.sparkContext.broadcast((tables,))
        scored = blocks.groupBy("k1").cogroup(counted.groupBy("k1")).applyInArrow(_scored(sent, tree, mass, total, kinds), SCORES)
        scored, _ = stored(scored, "lm-scores")
        sent.unpersist()
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
