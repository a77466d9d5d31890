"""Cutting plans at tables that several branches read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of an action are removed when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: (folder, table) of what was materialised within the innermost call of settled.
_MADE: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("made", default=None)
Tables = TypeVar("Tables", DataFrame, tuple, dict)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session (spark.checkpoint.dir). Only a local master may leave it unset; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="dossier-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, an action's shuffle files are removed when it ends, as what it wrote is read from its files."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def materialised(df: DataFrame) -> DataFrame:
    """df, worked out once, written to the checkpoint folder and read again: later plans start there, whatever executors are lost."""
    path = new_folder(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    made = _MADE.get()
    if made is not None:
        made.append((path, table))
    return table


def settled(work: Callable[[], Tables]) -> Tables:
    """What work gives, a table or a tuple or dict of them, materialised; all other tables that were materialised on the way are removed.

    A job of several steps so needs the disk of its longest step, not of all of them. Nothing else that work made may be read afterwards.
    """
    outer, own = _MADE.get(), []
    token = _MADE.set(own)
    try:
        given = work()
        each = given if isinstance(given, (tuple, dict)) else (given,)
        each = list(each.values() if isinstance(each, dict) else each)
        place = {id(table): path for path, table in own}
        kept = [table if id(table) in place else materialised(table) for table in each]
        place = {id(table): path for path, table in own}
    except BaseException:
        for path, table in own:
            _remove(table.sparkSession, path)
        raise
    finally:
        _MADE.reset(token)
    stays = {place[id(table)] for table in kept}
    for path, table in own:
        if path not in stays:
            _remove(table.sparkSession, path)
        elif outer is not None:
            outer.append((path, table))
    return dict(zip(given, kept, strict=True)) if isinstance(given, dict) else tuple(kept) if isinstance(given, tuple) else kept[0]


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
