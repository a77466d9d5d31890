"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row for each
digest, anti-joined with the index by sort-merge (the index side needs no shuffle) and appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, exists, new_path, own_name, shuffle_width, stored, text_or_empty, with_groups, without_ids

#: A digest is hot if it holds more than one row in HOT_SHARE; there are fewer than HOT_SHARE such digests.
HOT_SHARE = 1000


class DigestIndex:
    """Digests seen so far with the row that stands for each, at ``path``; reopened by its path under any session.

    The number of buckets is written beside the data when the index is made. Opening reads it, whatever the session's shuffle
    width; another number asked for, or a table of the catalogue that says otherwise, is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        told = f"{path}/_index"
        if not exists(spark, told):
            spark.createDataFrame([(buckets or max(8, shuffle_width(spark)),)], "buckets int").coalesce(1).write.mode("overwrite").json(told)
        self.buckets = spark.read.schema("buckets int").json(told).first().buckets
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING, group_size BIGINT)
                USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"""
        )
        known = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        if int(known["Num Buckets"]) != self.buckets:
            raise ValueError(f"the catalogue gives {known['Num Buckets']} buckets for {path}, the index has {self.buckets}")
        spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Appends those rows of groups whose digest the index doesn't hold."""
        new = groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        new.select(*self.read().columns).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def forget(self) -> None:
        """Takes the table out of the catalogue; the index stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n_points and the SHA-256 of the text without ASCII white space; null counts as empty."""
    text = text_or_empty(text_col)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.length(text).alias("n_points"),
        F.unhex(F.sha2(F.regexp_replace(text, ASCII_SPACE + "+", ""), 256)).alias("digest"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Decides every row of docs and appends the new digests to the index.

    Returns row, id, keep_id, group_size (of the batch that brought the digest), kept, digest; one row
    for each row of docs, dropped ones too. Of equal texts within a batch the one with the most code points, then
    the smallest id stays; a text that the index held before is dropped in favour of the earlier row. Null texts equal
    empty ones; a null id loses ties; of fully equal rows (same id and text) one is kept; an empty table gives
    no rows. Only id_col and text_col are read, so other columns may have any name.

    batch names the rows: giving a name again, as after a run that failed half-way, decides them as the first time and
    appends what is still missing. Without a name each call is a batch of its own.
    """
    spark = docs.sparkSession
    facts, _ = stored(digests(docs, id_col, text_col), "digests")
    total = facts.count()
    batch = batch or hashlib.sha256(new_path(spark, "batch").encode()).hexdigest()[:16]
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("no"), "id", "row"))
    groups = facts.groupBy("digest").agg(first.alias("first"), F.count("*").alias("members"))
    groups = groups.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.lit(batch).alias("batch"), "members")
    groups, _ = stored(groups, "digest-groups")
    index.append_new(groups.withColumn("group_size", F.col("members")))
    held = index.read().select("digest", F.col("keep_id").alias("held_id"), F.col("batch").alias("held_batch"), F.col("group_size").alias("held_size"))
    own = F.col("held_batch") == F.col("batch")
    told = groups.hint("merge").join(held, "digest").select(
        "digest", F.when(own, F.col("keep_id")).otherwise(F.col("held_id")).alias("keep_id"), F.when(own, F.col("keep_row")).alias("keep_row"),
        F.when(own, F.col("members")).otherwise(F.col("held_size")).alias("group_size"), "members",
    )
    told, _ = stored(told, "digest-told")
    # a digest that many rows have isn't dealt to one task: those are few and go to all
    joined = with_groups(facts, told, "digest", "members", total, HOT_SHARE)
    return joined.select("row", "id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), "digest")


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called; of rows with equal id and text one stays.

    Null texts equal empty ones, ties go to the longest original text and then the smallest id, a null id loses them; an empty table gives no
    rows. Texts aren't shuffled where the ids that go are few enough to be broadcast. Rows that share an id are told apart by their digests.
    """
    decided, _ = stored(deduplicate(docs, index, id_col, text_col, batch).select("id", "digest", "kept"), "decided")
    ids, _ = stored(decided.groupBy("id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay")), "decided-ids")
    stay = without_ids(docs, ids.where("stay = 0").select("id"), id_col)
    mixed = ids.where("stay > 0 and stay < rows").select("id")
    if mixed.isEmpty():
        return stay
    kept_id, kept_digest, digest, nth = (own_name(x) for x in ("kept_id", "kept_digest", "digest", "nth"))
    keys = decided.join(mixed, decided["id"].eqNullSafe(mixed["id"]), "left_semi").where("kept").select(F.col("id").alias(kept_id), F.col("digest").alias(kept_digest))
    text = F.regexp_replace(text_or_empty(text_col), ASCII_SPACE + "+", "")
    marked = stay.withColumn(digest, F.unhex(F.sha2(text, 256)))
    first = marked.join(keys, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    longest = Window.partitionBy(id_col, digest).orderBy(F.desc(F.length(text_or_empty(text_col))))
    first = first.withColumn(nth, F.row_number().over(longest)).where(F.col(nth) == 1).drop(digest, nth)
    return without_ids(stay, mixed, id_col).unionByName(first)
