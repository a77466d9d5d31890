"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are split into parts; a part holds one list of partial scores for each query. Phase 1 gathers each
list's best entries and scores those vectors exactly: the k-th of these scores, tau, is a safe cutoff. Phase 2 sends tau to all
parts, which give every entry of at least their share of it: a vector that no part gives scores below tau. Phase 3 drops
what can't reach tau and scores the rest exactly. A part's share is in proportion to the root of its width, as partial scores spread by that:
the threshold is uniform in units of each list's spread. One wide part beside a narrow one lets far fewer entries pass than equal ones.

Equal vectors are one candidate that carries its k + 1 smallest ids; more can't be among the best k of any query.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, shuffle_width, stored

#: Widths of the parts, in proportion; shares of tau are counted in WHOLE.
SPLIT, WHOLE = (7, 1), 1000
#: Entries of each list that phase 1 resolves; the more, the closer tau comes to the k-th score and the fewer entries pass it. A block of few gives as many.
LIST = 128
BLOCK, QUERY_BLOCK = 4096, 512
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BLOCKS = "block long, part int, ids binary, data binary"


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Rows that hold a whole block go to Python few at a time."""
    before = spark.conf.get(ROWS_PER_BATCH)
    spark.conf.set(ROWS_PER_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(ROWS_PER_BATCH, before)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v, the floors of 256 * x; vectors that are null or hold a null or non-finite component are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


def widths_and_shares(most: int, split: tuple[int, ...] = SPLIT) -> tuple[list[int], list[int]]:
    """The widths of the parts of most dimensions, empty ones left out, and their shares of tau, which add up to WHOLE."""
    ends = [round(most * sum(split[: i + 1]) / sum(split)) for i in range(len(split))]
    widths = [w for w in np.diff([0, *ends]).tolist() if w] or [1]
    roots = np.sqrt(widths)
    shares = np.floor(WHOLE * roots / roots.sum()).astype(int).tolist()
    return widths, [WHOLE - sum(shares[1:]), *shares[1:]]


def _blocks(widths: list[int], size: int):
    """Packs (cid, v) rows into blocks of at most size rows, one row for each part of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                ids, v = some.column(0).to_numpy(), some.column(1)
                lengths = v.value_lengths().to_numpy()
                matrix = np.zeros((len(ids), sum(widths)))
                row = np.repeat(np.arange(len(ids)), lengths)
                within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                matrix[row, within] = v.flatten().to_numpy()
                for g, (end, width) in enumerate(zip(np.cumsum(widths), widths, strict=True)):
                    own = np.ascontiguousarray(matrix[:, end - width : end])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first], pa.int64()), pa.array([g], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())],
                        names=["block", "part", "ids", "data"],
                    )
                first += 1

    return run


def _partial(k: int | None):
    """Scores of query blocks against blocks, by part: the best k of each query, or those of at least cut if k is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                qids, ids = (np.frombuffer(at[c][r].as_py(), "<i8") for c in ("qids", "ids"))
                q, v = (np.frombuffer(at[c][r].as_py(), np.float64) for c in ("qdata", "data"))
                q, v = q.reshape(len(qids), -1), v.reshape(len(ids), -1)
                bound = (np.abs(q).sum(1).max(initial=0)) * np.abs(v).max(initial=0)
                if bound < 2**53:
                    scores = (q @ v.T).astype(np.int64)
                elif bound < 2**63:
                    scores = q.astype(np.int64) @ v.astype(np.int64).T
                else:
                    raise OverflowError("inner products beyond 64 bits")
                if k is None:
                    cut = dict(zip(at["cut"][r].as_py()[0::2], at["cut"][r].as_py()[1::2], strict=True))
                    # partial >= tau * share / WHOLE, in whole numbers
                    share = at["share"][r].as_py()
                    least = np.array([-(-cut[i] * share // WHOLE) if i in cut else -(2**63) for i in qids.tolist()])
                    qi, vi = np.nonzero(scores >= least[:, None])
                else:
                    n = min(k, len(ids))
                    vi = np.argpartition(-scores, n - 1, axis=1)[:, :n].ravel()
                    qi = np.repeat(np.arange(len(qids)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[qi]), pa.array(ids[vi]), pa.array(np.full(len(qi), at["part"][r].as_py(), np.int32)), pa.array(scores[qi, vi])],
                    names=["qid", "cid", "part", "partial"],
                )

    return run


PARTIAL = "qid long, cid long, part int, partial long"


def search(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", split: tuple[int, ...] = SPLIT, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors by inner product, ties to smaller ids.

    queries is a condition on the column ``id`` that selects the rows of vectors that are queries; a query's own row is
    no candidate of it, an equal row is. Vectors that are null, hold a null or a non-finite component or have a null id take no part; missing trailing
    components count as 0. Fewer than k rows are all given; an empty table gives none. Scores beyond 64 bits raise an error.
    Rows that share an id are candidates each, with their own vectors, and a query's own row is the one with its vector.
    report gets the number of pairs of queries and vectors, and of the entries that phase 2 sends.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vec_col).withColumn("key", F.sha2(F.array_join("v", ","), 256))
    rows, _ = stored(rows, "topk-rows")
    by_id = Window.partitionBy("key").orderBy("id", F.lit(0))
    first = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    classes = first.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("members"))
    classes, _ = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "topk-classes")
    asked = rows.where(queries).select("id", "key").join(classes.select("key", "cid").hint("merge"), "key").select(F.col("id").alias("query_id"), F.col("cid").alias("qid"))
    asked, _ = stored(asked, "topk-asked")
    asking = classes.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")

    most = classes.agg(F.max(F.size("v"))).first()[0]
    widths, shares = widths_and_shares(most or 1, split)
    parts = len(widths)
    blocks, _ = stored(classes.select("cid", "v").mapInArrow(_blocks(widths, BLOCK), BLOCKS), "topk-blocks")
    number = max(1, blocks.where("part = 0").count())
    # query blocks are repeated for each bucket, of which there are no more than blocks; what is repeated is never broadcast, as it would pass the driver
    buckets = min(shuffle_width(spark), number)
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))
    q_rows, _ = stored(asking.select("cid", "v").mapInArrow(_blocks(widths, QUERY_BLOCK), BLOCKS), "topk-queries")
    q_blocks = q_rows.select(F.col("block").alias("qblock"), "part", F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))

    n = k + 1
    each = max(n, -(-LIST // number))
    with small_batches(spark, 8):
        lists, _ = stored(q_blocks.hint("merge").join(blocks, ["bucket", "part"]).mapInArrow(_partial(each), PARTIAL), "topk-lists")
    best = Window.partitionBy("qid", "part").orderBy(F.desc("partial"), "cid")
    seen = lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(n, LIST)).select("qid", "cid").distinct()
    known, _ = stored(_resolved(seen, classes), "topk-known")
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    tau = known.withColumn("n", F.row_number().over(top)).where(F.col("n") == n).select("qid", F.col("score").alias("tau"))
    # a query without n candidates has no cutoff: every entry is sent
    members = q_rows.where("part = 0").select(F.col("block").alias("qblock"), "ids").mapInArrow(_ids_of, "qblock long, qid long")
    cuts = members.join(tau, "qid").groupBy("qblock").agg(F.flatten(F.collect_list(F.array("qid", "tau"))).alias("cut"))
    share_of = F.get(F.lit(shares), F.col("part"))
    with small_batches(spark, 8):
        told = q_blocks.join(cuts, "qblock", "left").withColumn("cut", F.coalesce("cut", F.array().cast("array<bigint>"))).withColumn("share", share_of)
        sent, _ = stored(told.hint("merge").join(blocks, ["bucket", "part"]).mapInArrow(_partial(None), PARTIAL), "topk-sent")
    if report is not None:
        report["pairs"], report["sent"] = classes.count() * asked.select("qid").distinct().count(), sent.count()
    sums = sent.groupBy("qid", "cid").agg(F.sum("partial").alias("sum"), F.count("*").alias("got"), F.sum(share_of).alias("share")).join(tau, "qid", "left")
    # what wasn't sent is below its share of tau
    wide = lambda c: F.col(c).cast("decimal(24,0)")
    able = sums.where(F.col("tau").isNull() | (wide("sum") * WHOLE >= wide("tau") * F.col("share")))
    able, _ = stored(able.select("qid", "cid", F.when(F.col("got") == parts, F.col("sum")).alias("score")), "topk-able")
    exact = able.where("score is not null").unionByName(_resolved(able.where("score is null").select("qid", "cid"), classes))

    found = exact.join(classes.select("cid", "members"), "cid").select("qid", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    # one entry of the query's own id with its own score is its own row
    own = F.expr("array_position(transform(list, x -> x.vec_id = query_id and x.score = own), true)")
    given = asked.join(lists, "qid").join(classes.select(F.col("cid").alias("qid"), F.expr("aggregate(v, 0L, (a, x) -> a + x * x)").alias("own")), "qid").withColumn("at", own)
    given = given.select("query_id", F.expr(f"slice(filter(list, (x, i) -> i + 1 != at), 1, {k})").alias("list"))
    given = given.select("query_id", F.posexplode("list").alias("i", "x"))
    return given.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["qblock", "qid"])


def _resolved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """qid, cid, score: exact inner products of (qid, cid) pairs. Vectors are not broadcast, so they don't pass the driver."""
    q = classes.select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    both = pairs.join(q.hint("merge"), "qid").join(classes.select("cid", "v").hint("merge"), "cid")
    score = F.expr("aggregate(zip_with(q, v, (x, y) -> coalesce(x * y, 0L)), 0L, (a, x) -> a + x)")
    return both.select("qid", "cid", score.alias("score"))
