"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of shingles. Hashed darts fall at rate one on the region weight x rank of every element;
those below the element's weight and below a rank bound are kept, each belongs to one coordinate of the signature, and the
earliest of a coordinate is its value: two documents agree in a coordinate with the chance of their weighted Jaccard similarity.

Documents with equal shingle sets are one set. Sets that share a band are first compared with the bucket's representative, the set
that shares most places with others, and components follow from the verified links. In a further round each component of a bucket sends one member to one of the bucket's largest
component, which joins dense groups with few comparisons. Last, sets that are still apart in a bucket meet by a prefix filter: shingles are
ordered from rare to frequent; of a pair of the least similarity the larger set's first (1 - t) share and the smaller one's first (1 - t) / (1 + t) have a
shingle in common. What meets by length and by place is verified exactly, so no pair of different components remains untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, own_name, ship, stored, text_or_empty, tidy, with_groups, with_payloads, without_ids
from .topk_search import small_batches

SHINGLE, SIMILARITY = 5, 0.8
#: The chance that a pair of the least similarity shares no band is MISS at most; a signature has about COORDINATES values.
MISS, COORDINATES, MOST_ROWS = 7e-6, 150, 5
#: Rounds at most in which components of a bucket meet its largest one; they end when a round links less than one pair in GAIN.
ROUNDS, GAIN = 4, 20
#: Counters that shingles are counted in to order them by frequency; any order is right, a good one lets few pairs meet.
COUNTERS = 1 << 20
#: Places (elements x rank cells) and bytes of text that are handled at once.
CELLS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 4 << 20
EMPTY = np.uint64(2**64 - 1)
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, i + 1, dtype=float))) for i in range(18)])


def banding(least: float) -> tuple[int, int]:
    """Bands and rows for a least similarity: the most rows for which few enough bands keep the chance of a miss; (30, 5) at 0.8."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    for rows in range(MOST_ROWS, 0, -1):
        bands = 1 if least == 1 else int(np.ceil(np.log(MISS) / np.log1p(-(least**rows))))
        if bands * rows <= COORDINATES or rows == 1:
            return bands, rows
    raise AssertionError


def darts_for(k: int) -> int:
    """Darts of a document, expected: then one of k coordinates stays empty with a chance of 5 % in all, and the document gets more."""
    return int(k * (np.log(k) + 3))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES, darts: int | None = None) -> np.ndarray:
    """A row of k values for each of docs weighted sets; (doc, element, weight) are sorted by doc, elements distinct within it."""
    found = np.full((docs, k), EMPTY)
    mass = np.bincount(doc, weights=weight, minlength=docs)
    bound = (darts or darts_for(k)) / np.maximum(mass, 1e-12)
    open_ = mass > 0
    while open_.any():
        own = np.flatnonzero(open_[doc])
        cells = np.ceil(weight[own]).astype(np.int64) * np.ceil(bound[doc[own]]).astype(np.int64)
        ends = np.cumsum(cells)
        cuts = np.searchsorted(ends, np.arange(CELLS_AT_ONCE, ends[-1], CELLS_AT_ONCE))
        for part in np.split(own, np.unique(cuts)):
            _throw(found, doc[part], element[part], weight[part], bound, k)
        open_ &= (found == EMPTY).any(1)
        bound[open_] *= 2
    return found


def _throw(found: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> None:
    slabs, ranks = np.ceil(weight).astype(np.int64), np.ceil(bound[doc]).astype(np.int64)
    cells = slabs * ranks
    of = np.repeat(np.arange(len(doc)), cells)
    within = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    slab, rank = within // ranks[of], within % ranks[of]
    seed = mixed(element[of] + slab.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(rank.astype(np.uint64) + np.uint64(1)))
    count = np.searchsorted(_POISSON, _unit(seed), "right")
    dart = np.repeat(np.arange(len(of)), count)
    nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
    h = mixed(seed[dart] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    of = of[dart]
    at = rank[dart] + (h >> np.uint64(40)) * (1.0 / (1 << 24))
    keep = at < bound[doc[of]]
    if (weight != slabs).any():
        keep &= slab[dart] + _unit(mixed(h)) < weight[of]
    of, h, at = of[keep], h[keep], at[keep]
    coordinate = (h & np.uint64(0xFFFFF)) % np.uint64(k)
    value = (at * 65536).astype(np.uint64) << np.uint64(32) | mixed(h + np.uint64(7)) >> np.uint64(32)
    np.minimum.at(found.reshape(-1), doc[of] * k + coordinate.astype(np.int64), value)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), distinct and sorted within each text.

    Words are what stands between white space, A-Z lower-cased; a text of fewer words than size is one shingle of all its words.
    """
    lists = pc.ascii_split_whitespace(lower_ascii(texts))
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.binary_length(flat).to_numpy() > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[coded.indices.to_numpy()]
    counts = np.bincount(text[full], minlength=len(texts))
    n = np.maximum(counts - size + 1, 1)
    of = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(counts) - counts, n)
    last = np.repeat(np.cumsum(counts), n)
    words = np.append(words, np.zeros(size, np.uint64))
    hashed = np.full(len(of), 0x243F6A8885A308D3, np.uint64)
    for k in range(size):
        there = place + k < last
        hashed = np.where(there, mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(place + k, len(words) - 1)]), hashed)
    order = np.lexsort((hashed, of))
    of, hashed = of[order], hashed[order]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1])))[: len(of)]
    return of[first], hashed[first], np.diff(np.append(first, len(of)))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(size, before + BYTES_AT_ONCE, "right")))
        yield batch.slice(first, after - first)
        first = after


def _set_key(hashed: np.ndarray, counts: np.ndarray, counted: bool) -> bytes:
    return xxhash.xxh3_128_digest(hashed.tobytes() + (counts.astype("<i8").tobytes() if counted else b""))


def _tokens(data: bytes, counted: bool) -> np.ndarray:
    """The distinct tokens of a stored set; a shingle that counts several times is as many tokens."""
    x = np.frombuffer(data, np.uint64)
    if not counted:
        return x
    x, times = x[: len(x) // 2], x[len(x) // 2 :].astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return mixed(np.repeat(x, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _frequencies(counted: bool):
    """counter, n: how often a task's tokens fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                np.add.at(n, (_tokens(data, counted) % np.uint64(COUNTERS)).astype(np.int64), 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["counter", "n"])

    return run


def prefixes(tokens: np.ndarray, often: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The first tokens of a set from rare to frequent, as many as it needs where it is the larger one of a pair, and how many it needs as the smaller one.

    A pair of at least least has a token in common among the larger set's first n - ceil(least n) + 1 and the smaller one's first
    n - ceil(2 least / (1 + least) n) + 1.
    """
    n = len(tokens)
    order = np.lexsort((tokens, often[(tokens % np.uint64(COUNTERS)).astype(np.int64)]))
    whole = n - int(np.ceil(least * n - 1e-9)) + 1
    own = n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
    return tokens[order[: min(n, whole)]], min(n, own)


def _prefixed(sent, least: float, counted: bool):
    """node, own, apart, n, token, place, early (among the first of the smaller set) of sets (node, own, apart, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(sent.value, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = _tokens(batch.column(3)[i].as_py(), counted)
                first, own = prefixes(tokens, often, least)
                k = len(first)
                row = [pa.array([batch.column(c)[i].as_py()] * k, batch.column(c).type) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*row, pa.array(np.full(k, len(tokens))), pa.array(first.view(np.int64)), pa.array(np.arange(k)), pa.array(np.arange(k) < own)], names=["node", "own", "apart", "n", "token", "place", "early"])

    return run


PREFIXED = "node long, own long, apart boolean, n long, token long, place long, early boolean"


def _meeting(sets: DataFrame, data: DataFrame, least: float, counted: bool) -> DataFrame:
    """x, y of sets (node, own, apart) of different own, one of them apart, whose similarity may be at least least; data: node, data."""
    spark = sets.sparkSession
    with small_batches(spark, 500):
        often = np.zeros(COUNTERS, np.int64)
        for r in data.select("data").mapInArrow(tidy(_frequencies(counted)), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
            often[r.counter] = r.n
        sent = spark.sparkContext.broadcast(often.tobytes())
        rows, _ = stored(sets.join(data, "node").select("node", "own", "apart", "data").mapInArrow(tidy(_prefixed(sent, least, counted)), PREFIXED), "prefixes")
    early = rows.where("early").select("token", *[F.col(c).alias(c + "_b") for c in ("node", "own", "apart", "n", "place")])
    smaller = (F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("node_b") < F.col("node")))
    # at the first token in common, all others lie behind it in both sets
    able = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= least / (1 + least) * (F.col("n") + F.col("n_b")) - 1e-6
    met = rows.join(early, "token").where(smaller & (F.col("own") != F.col("own_b")) & (F.col("apart") | F.col("apart_b")) & (F.col("n_b") >= least * F.col("n") - 1e-6) & able)
    return met.select(F.least("node", "node_b").alias("x"), F.greatest("node", "node_b").alias("y")).distinct()


def _signed(counted: bool, size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                n = batch.num_rows
                of, hashed, counts = shingles(batch.column(1), size)
                ends = np.searchsorted(of, np.arange(n + 1))
                weight = counts.astype(float) if counted else np.ones(len(of))
                signature = dart_signatures(of, hashed, weight, n, bands * rows).reshape(n, bands, rows)
                band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)) + np.uint64(0xA0761D6478BD642F)
                for r in range(rows):
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
                banded = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(band.reshape(-1).view(np.int64)))
                keys = [_set_key(hashed[a:b], counts[a:b], counted) for a, b in zip(ends, ends[1:], strict=False)]
                mass = np.bincount(of, weights=weight, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(mass), banded], names=["id", "key", "n", "bands"])

    return run


def _sets_of(counted: bool, size: int):
    """The shingles of the texts that represent a set; a text of another set with the same id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                of, hashed, counts = shingles(batch.column(2), size)
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
                data = []
                for key, a, b in zip(batch.column(1).to_pylist(), ends, ends[1:], strict=False):
                    whole_ = hashed[a:b].tobytes() + (counts[a:b].astype("<i8").tobytes() if counted else b"")
                    data.append(whole_ if xxhash.xxh3_128_digest(whole_) == key else None)
                rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["node", "data"])
                yield rows.filter(pc.is_valid(rows.column("data")))

    return run


def similarity(a: bytes, b: bytes, counted: bool = False) -> float:
    """Jaccard similarity of two stored shingle sets, weighted by counts if counted."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not counted:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    (x, m), (y, n) = ((z[: len(z) // 2], z[len(z) // 2 :].astype(np.int64)) for z in (x, y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _linked(least: float, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(a, b, counted) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (x, y) connect each node with; nodes without links are left out.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, until none changes. The few nodes that
    have more than a thousandth of the links are told to all tasks.
    """
    spark = links.sparkSession
    both, _ = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "links")
    total = both.count()
    degrees, _ = stored(both.groupBy("y").agg(F.count("*").alias("links")), "degrees")
    labels, path = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        told, middle_told = stored(labels.withColumnRenamed("node", "y").join(degrees, "y"), "labels")
        near = with_groups(both, told, "y", "links", total).select(F.col("x").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("new"))
        least, middle = stored(least, "labels")
        of = least.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = least.join(of, "new").join(labels.withColumnRenamed("label", "old"), "node")
        now, after = stored(jumped.select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("old")).alias("changed")), "labels")
        discard(spark, path, middle, middle_told)
        path = after
        if now.where("changed").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


def _data_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame, counted: bool, size: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """node, data (the set's shingles) of nodes, and the path where they are; docs are read for these sets only."""
    need = sets.join(nodes.distinct(), "node", "left_semi").select("node", "key", F.col("rep").alias("rep_id_"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_"), text_or_empty(text_col).alias("text_")).join(need, F.col("doc_").eqNullSafe(F.col("rep_id_")))
    return stored(texts.select("node", "key", "text_").mapInArrow(tidy(_sets_of(counted, size)), "node long, data binary").dropDuplicates(["node"]), "shingles")


def _verified(pairs: DataFrame, data: DataFrame, least: float, counted: bool) -> DataFrame:
    """Those (x, y) of pairs whose similarity is at least least; data: node, data."""
    with small_batches(pairs.sparkSession, 500):
        rows = with_payloads(pairs, data, "node", "data", {"x": "a", "y": "b"}).select("x", "y", "a", "b")
        return stored(rows.mapInArrow(tidy(_linked(least, counted)), "x long, y long"), "near-links")[0]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE, counted: bool = False, report: dict | None = None) -> DataFrame:
    """id, key, class_id, class_size, links: one row for each row of docs.

    Documents are linked if the Jaccard similarity of their shingle sets (of their shingle counts, if counted) is at least
    least; the bands follow from it, so that a link is missed with a chance of MISS at most. Classes are the components of the links and named by their smallest id.
    links tells how many verified links the document's set has: enough to connect its class, not all. Null texts equal empty ones; texts without words form one
    class; a null id takes part and names a class only if the class has no other; repeated rows are members each; an
    empty table gives no rows. Other columns are not read. report gets the number of pairs that the last step verifies.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    signed, _ = stored(rows.mapInArrow(tidy(_signed(counted, size, *banding(least))), "id long, key binary, n long, bands array<long>"), "signatures")
    total = signed.count()
    first = [F.first(c).alias(c) for c in ("n", "bands")]
    sets = signed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("members"), *first)
    sets, _ = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    data_of = lambda nodes: _data_of(nodes, sets, docs, counted, size, id_col, text_col)
    ends = lambda pairs: pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))

    bands, _ = stored(sets.select("node", "n", F.explode("bands").alias("band")), "bands")
    placed = bands.count()
    # the representative of a bucket is the set that shares most places with others: the original of its copies, if there is one;
    # a bucket that holds many sets is told to all tasks, so none is dealt to one of them
    sizes, _ = stored(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared, _ = stored(with_groups(bands, sizes, "band", "size", placed), "shared")
    places, _ = stored(shared.groupBy("node").agg(F.sum("size").alias("places")), "places")
    order = F.struct("places", F.xxhash64("node").alias("h"), "node", "n")
    buckets = shared.join(places, "node").groupBy("band").agg(F.max(order).alias("rep"), F.first("size").alias("size"))
    buckets, _ = stored(buckets.select("band", "size", F.col("rep.node").alias("rep_node"), F.col("rep.n").alias("rep_n")), "buckets")
    members, _ = stored(with_groups(shared.drop("size"), buckets, "band", "size", placed), "members")
    near_size = F.least("n", "rep_n") >= least * F.greatest("n", "rep_n")
    pairs = members.where((F.col("node") != F.col("rep_node")) & near_size)
    pairs, _ = stored(pairs.select(F.col("node").alias("x"), F.col("rep_node").alias("y")).distinct(), "pairs")
    data, path = data_of(ends(pairs))
    links = _verified(pairs, data, least, counted)
    discard(spark, path)
    labels = components(links)
    of = lambda c, d: labels.select(F.col("node").alias(c), F.col("label").alias(d))
    with_own = lambda rows: rows.join(of("node", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))

    # only buckets with several components matter from here on
    several = lambda told: told.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size")).where("low <> high").select("band", "size")
    told = with_own(members.select("band", "node", "n"))
    apart, _ = stored(several(told), "several")
    members, _ = stored(with_groups(told, apart, "band", "size", placed).select("band", "node", "n"), "apart")
    for k in range(ROUNDS):
        parts = with_own(members).groupBy("band", "own").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "band", F.lit(k)).alias("h"), "node", "n")).alias("one"))
        parts, _ = stored(parts, "parts")
        main = parts.groupBy("band").agg(F.max(F.struct("size", "own", "one")).alias("main"), F.count("*").alias("parts"))
        main, _ = stored(main, "mains")
        met = with_groups(parts, main, "band", "parts", parts.count()).where("own <> main.own").select("one.node", "one.n", F.col("main.one.node").alias("node_b"), F.col("main.one.n").alias("n_b"))
        met = met.where(F.least("n", "n_b") >= least * F.greatest("n", "n_b")).select(F.least("node", "node_b").alias("x"), F.greatest("node", "node_b").alias("y")).distinct()
        met, _ = stored(met, "pairs")
        tested, linked = met.count(), 0
        if tested:
            data, path = data_of(ends(met))
            found = _verified(met, data, least, counted)
            discard(spark, path)
            linked = found.count()
        if linked:
            links = links.unionByName(found)
            labels = components(links)
        if linked * GAIN < tested or not tested:
            break

    # what is still apart from the largest component of a bucket, against all sets of such buckets
    told, _ = stored(with_own(members), "told")
    parts = told.groupBy("band", "own").agg(F.count("*").alias("size"))
    main = parts.groupBy("band").agg(F.max(F.struct("size", "own")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("size")).where("parts > 1")
    main, _ = stored(main.select("band", "size", F.col("main.own").alias("main_own")), "mains")
    inside = with_groups(told, main, "band", "size", placed).groupBy("node").agg(F.first("own").alias("own"), F.max(F.col("own") != F.col("main_own")).alias("apart"))
    inside, _ = stored(inside, "inside")
    tested = 0
    if not inside.isEmpty():
        data, path = data_of(inside.select("node"))
        met, _ = stored(_meeting(inside, data, least, counted), "pairs")
        tested = met.count()
        if tested:
            links = links.unionByName(_verified(met, data, least, counted))
            labels = components(links)
        discard(spark, path)
    if report is not None:
        report["last_pairs"] = tested

    degree = ends(links.distinct()).groupBy("node").agg(F.count("*").alias("links"))
    named = sets.join(labels, "node", "left").join(degree, "node", "left").select("key", "rep", "members", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    named, _ = stored(named, "named")
    groups = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("members").alias("class_size"), F.count("*").alias("sets"))
    groups, _ = stored(groups, "classes")
    known = with_groups(named, groups, "label", "sets", named.count())
    known, _ = stored(known.select("key", "members", "class_id", "class_size", "links"), "known")
    return with_groups(signed.select("id", "key"), known, "key", "members", total).select("id", "key", "class_id", "class_size", "links")


def _keyed(size: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, hashed, counts = shingles(batch.column(batch.num_columns - 1), size)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            keys = [_set_key(hashed[a:b], counts[a:b], False) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], names=[*batch.schema.names[:-1], name])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their class, with all their columns, whatever these are called; of rows that share an id and a set one stays.

    Null texts equal empty ones; texts of any length are read whole; a null id stays only where its class has no other; an empty table gives no
    rows. Texts aren't shuffled where the ids that go are few enough to be broadcast.
    """
    found, _ = stored(classes(docs, id_col, text_col).select("id", "key", F.col("id").eqNullSafe(F.col("class_id")).alias("names")), "near-decided")
    ids, _ = stored(found.groupBy("id").agg(F.count("*").alias("rows"), F.count_if("names").alias("stay")), "near-ids")
    stay = without_ids(docs, ids.where("stay = 0").select("id"), id_col)
    repeated = ids.where("stay > 0 and rows > 1").select("id")
    if repeated.isEmpty():
        return stay
    # rows that share an id are told apart by their sets
    again_id, text, key, kept_id, kept_key = (own_name(x) for x in ("again", "text", "key", "kept_id", "kept_key"))
    own = F.col(id_col).cast("long")
    again = stay.join(repeated.withColumnRenamed("id", again_id), own.eqNullSafe(F.col(again_id)), "left_semi").withColumn(text, text_or_empty(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {key} binary"
    kept = found.where("names").select(F.col("id").alias(kept_id), F.col("key").alias(kept_key))
    keyed = again.mapInArrow(_keyed(SHINGLE, key), schema)
    keyed = keyed.join(kept, own.eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return without_ids(stay, repeated, id_col).unionByName(keyed.dropDuplicates([id_col, key]).drop(key))
