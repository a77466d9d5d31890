"""What the operators share: the shared folder, written intermediate tables, shipping of this package."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deleting these and nothing else makes two texts comparable (op3) or separates tokens (op1).
ASCII_SPACE = r"[\x20\x09-\x0D]"

#: Ids that are broadcast at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_own_folder: str | None = None
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session with a local master may leave it unset; it gets a temporary one."""
    global _own_folder
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="dossier-")
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' import path, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="dossier-ship-"), "dossier_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def tidy(run):
    """run over batches, which gives freed memory back when its task ends: workers live on beside the executor's heap."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with the one row of groups that has their key; no key lands in one task whole.

    Keys with more than total / share of the rows are fewer than share, whatever the input: they are broadcast. The rest is
    joined by a shuffle. Rows without a group drop out.
    """
    hot = F.broadcast(groups.where(F.col(size) > total // share))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(F.col(size) <= total // share), key))


def own_name(name: str) -> str:
    """A column name that no caller's table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows less those whose id_col is in ids (id), nulls too; rows are shuffled only if the ids are too many to be broadcast."""
    gone = own_name("gone")
    ids, _ = stored(ids.select(F.col("id").alias(gone)), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, F.col(id_col).cast("long").eqNullSafe(F.col(gone)), "left_anti")


def with_payloads(rows: DataFrame, data: DataFrame, key: str, payload: str, sides: dict[str, str], strip: int = 64) -> DataFrame:
    """rows with the payload that data has for their value of each column in sides, under the name given there.

    A payload is sent once for each strip of at most about that many rows, so no key's rows meet in one task and no payload is
    repeated by row in a shuffle of its own side.
    """
    hashed = F.xxhash64(*rows.columns)
    copies = {}
    for side in sides:
        parts, _ = stored(rows.groupBy(side).agg(F.ceil(F.count("*") / strip).alias("parts_" + side)), "parts")
        every = F.sequence(F.lit(0).cast("long"), F.col("parts_" + side) - 1)
        copies[side] = data.select(F.col(key).alias(side), F.col(payload).alias(sides[side])).join(parts, side).withColumn("strip_" + side, F.explode(every)).drop("parts_" + side)
        rows = with_groups(rows, parts, side, "parts_" + side, parts.agg(F.sum("parts_" + side)).first()[0] or 0)
    dealt, _ = stored(rows.select("*", *[F.pmod(hashed, "parts_" + side).alias("strip_" + side) for side in sides]).drop(*["parts_" + side for side in sides]), "dealt")
    for side in sides:
        dealt = dealt.join(copies[side], [side, "strip_" + side])
    return dealt.drop(*["strip_" + side for side in sides])


def lower_ascii(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, as large strings."""
    texts = texts.cast(pa.large_string())
    if len(texts) and (texts.offset or np.frombuffer(texts.buffers()[1], np.int64, 1)[0]):  # ascii_lower misplaces the offsets of a slice
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.ascii_lower(texts)


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with group (the number of their keys in ascending order), rank (their number in order among these) and total (how many these are).

    All count from 0, nulls come first. Rows are dealt out by ranges of keys and order, so a key with many rows spans several ranges and no
    task sorts or counts it whole; order should tell rows apart as far as possible, since rows that are equal in it share a range.
    """
    spark = rows.sparkSession
    by = [*keys, *order]
    dealt = rows.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id())
    placed, _ = stored(dealt.withColumn("part", F.shiftright("seq", 33)), "ranked")
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    counts = placed.groupBy("part", *named).agg(F.min("seq").alias("low"), F.count("*").alias("n")).withColumnRenamed("part", "of_part")
    own = Window.partitionBy(*[f"key{i}" for i in range(len(keys))])
    before = own.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"), F.min("low").over(own).alias("start"))
    # a group starts in one range: its number is that of the groups that start in earlier ranges, and earlier in its own
    starts = counts.where("low = start").select(F.col("of_part").alias("at"), "low", F.row_number().over(Window.partitionBy("of_part").orderBy("low")).alias("nth"))
    earlier = starts.groupBy("at").count().select("at", F.coalesce(F.sum("count").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups"))
    groups = starts.join(earlier, "at").select(F.col("low").alias("start"), (F.col("groups") + F.col("nth") - 1).alias("group"))
    told, _ = stored(counts.join(groups, "start"), "ranked-groups")
    same = F.col("part") == F.col("of_part")
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(told[f"key{i}"])
    return placed.join(told, same).select(*[placed[c] for c in rows.columns], "group", (F.col("seq") - F.col("low") + F.col("before")).alias("rank"), "total")
