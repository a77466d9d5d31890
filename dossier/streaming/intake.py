"""Incremental intake with Structured Streaming: new content only, each once across runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import with_text_rule
from ..materialize import materialised
from ..plans import pipelines as P
from ..sources.state import exists
from .seen import SeenIndex

Work = Callable[[DataFrame, int], "DataFrame | dict[str, DataFrame]"]


def take_batch(rows: DataFrame, batch: int, fingerprint: str, store: str, index: SeenIndex, work: Work) -> None:
    """Works on the rows whose content no other batch has brought, writes what comes of it and remembers every content, whatever work makes of it.

    A table goes to store/batch=N, a dict of tables to store/<name>/batch=N each, in order; all are overwritten, and contents of the batch itself
    don't count as seen: a batch that is repeated after a failure leaves one copy in each table. Rows with a null fingerprint are
    never known.
    """
    asked = rows.select(F.col(fingerprint).cast("string").alias("fingerprint"))
    known = index.lookup(asked, batch).withColumnRenamed("fingerprint", "known_content_")
    one = rows.dropDuplicates([fingerprint])
    fresh = one.join(known, one[fingerprint].cast("string") == F.col("known_content_"), "left_anti")
    made = work(fresh, batch)
    for name, table in made.items() if isinstance(made, dict) else [("", made)]:
        table.write.mode("overwrite").parquet("/".join(x for x in (store, name, f"batch={batch}") if x))
    index.add(asked, batch)


def take_in(spark: SparkSession, source: str, schema: str, fingerprint: str, store: str, checkpoint: str, work: Work | None = None, seen: str | None = None, files: int = 1) -> None:
    """Runs one pass over the new files below source: appends rows of new content, after work(rows, batch), to store by batch.

    What was seen is kept in an index of its own at seen (store + "-seen" if not given): contents that work leaves out aren't worked on again, and
    a micro-batch reads filters and the pages of contents that come again, not the store. It takes in up to so many files.
    """
    index = SeenIndex(spark, seen or f"{store}-seen")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    handle = lambda rows, batch: take_batch(rows, batch, fingerprint, store, index, work or (lambda fresh, _: fresh))
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def text_rules(recognized: DataFrame, version: str) -> DataFrame:
    """sha256, text_rule (null if no rule holds) of the texts of a version; of several texts of a content the least one counts.

    Rules are worked out where texts are read. Texts are only compared, and so shuffled, where those of a content tell different rules.
    """
    valid = recognized.where((F.col("version") == version) & F.col("text").isNotNull()).select("sha256", "text")
    told = with_text_rule(valid, F.col("text")).select("sha256", F.coalesce("text_rule", F.lit("")).alias("rule"))
    told = materialised(told.groupBy("sha256").agg(F.min("rule").alias("rule"), F.max("rule").alias("last")))
    rules, open_ = told.where("rule = last").select("sha256", F.nullif("rule", F.lit("")).alias("text_rule")), told.where("rule <> last")
    if open_.isEmpty():
        return rules
    least = valid.join(open_, "sha256", "left_semi").groupBy("sha256").agg(F.min("text").alias("text"))
    return rules.unionByName(with_text_rule(least, F.col("text")).select("sha256", "text_rule"))


def route_work(store: str, inbox: DataFrame, recognized: DataFrame, version: str, replacing: DataFrame | None = None) -> Work:
    """The work of routing input files (file_id, batch, name, sha256) of micro-batches: routes, gate and log.

    Texts come from recognized (sha256, version, text); the inbox is the given one (name, sha256) and what earlier micro-batches routed. gate has the verdict on
    each input batch, refused ones too, log a row with the counters of the micro-batch; it is written last, so a micro-batch without a
    log row isn't done. Texts are read once, when this is called: micro-batches read the rule that each text tells.
    """
    rules = materialised(text_rules(recognized, version))

    def work(rows: DataFrame, batch: int) -> dict[str, DataFrame]:
        spark = rows.sparkSession
        files = materialised(rows.join(rules, "sha256", "left"))
        there = inbox.select("name", "sha256")
        if exists(spark, f"{store}/routes"):
            before = spark.read.option("basePath", f"{store}/routes").parquet(f"{store}/routes").where((F.col("batch") != batch) & (F.col("action") == "routed"))
            there = there.unionByName(before.select(F.element_at(F.split("target", "/"), -1).alias("name"), "sha256"))
        routes, gate = P.route_inputs(files, there, replacing)
        counted = P.route_counters(routes).withColumn("files", F.lit(files.count()))
        refused = gate.agg(F.count_if(~F.col("accepted")).alias("batches_refused"), F.count("*").alias("batches"))
        named = lambda t: t.withColumnRenamed("batch", "input_batch")
        return {"routes": named(routes), "gate": named(gate), "log": counted.join(refused, F.lit(True))}

    return work
