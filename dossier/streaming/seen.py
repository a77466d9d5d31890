"""A memory of contents seen so far, which a micro-batch asks without reading the store.

Fingerprints lie in segments, by bucket of their hash and sorted within it. Each segment has a Bloom filter for each bucket. A batch tests its fingerprints against
the filters of their buckets; only those that a filter knows are looked up, in their buckets' files, whose pages are skipped by
their least and greatest fingerprint. A batch adds a segment; segments of a size are merged, so there are few and each fingerprint is rewritten
a logarithmic number of times. Which segments count is a revision of a StateStore, so a batch that fails half-way leaves nothing behind.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import StateStore, create_whole, exists, read_file, remove

#: Bits of a filter for each fingerprint, hashes for each; a filter errs less than once in a thousand. Segments of a size that are merged.
BITS, HASHES, MERGED = 16, 8, 4
#: Rows of a page in a segment's files; a lookup reads the pages whose range has a fingerprint.
PAGE_ROWS = 256
#: Fingerprints that a lookup names in its filter, so that pages are skipped; more are joined with their buckets.
NAMED = 1000
FILTERS = "bucket int, bits binary"
SEGMENT = "fingerprint string, batch long, bucket int"


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each fingerprint, from two hashes."""
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (h1.astype(np.uint64)[None, :] + k * (h2.astype(np.uint64) | np.uint64(1))[None, :]) % np.uint64(bits)


def _filter_of(groups: pa.Table) -> pa.Table:
    """The filter of one bucket's fingerprints (bucket, h1, h2)."""
    bits = max(64, 1 << math.ceil(math.log2(max(1, groups.num_rows) * BITS)))
    found = np.zeros(bits, bool)
    found[_places(groups["h1"].to_numpy().view(np.uint64), groups["h2"].to_numpy().view(np.uint64), bits).ravel()] = True
    return pa.table({"bucket": groups["bucket"].slice(0, 1), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})


def _known(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """Those asked (fingerprint, bucket, h1, h2) that a filter of their bucket knows."""
    hit = np.zeros(asked.num_rows, bool)
    if asked.num_rows:
        h1, h2 = asked["h1"].to_numpy().view(np.uint64), asked["h2"].to_numpy().view(np.uint64)
        for data in filters["bits"].to_pylist():
            bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
            hit |= bits[_places(h1, h2, len(bits))].all(0)
    return asked.select(["fingerprint", "bucket"]).filter(pa.array(hit))


class SeenIndex:
    """Fingerprints (strings) with the batch that brought them, below a folder; the number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        told = f"{self.folder}/index.json"
        if not exists(spark, told):
            create_whole(spark, told, json.dumps({"buckets": buckets}))
        self.buckets = json.loads(read_file(spark, told))["buckets"]
        self.store = StateStore(spark, f"{self.folder}/state")

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(self.buckets)).cast("int")
        return rows.withColumn("bucket", bucket)

    @staticmethod
    def _hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"h1": F.xxhash64("fingerprint", F.lit(1)), "h2": F.xxhash64("fingerprint", F.lit(2))})

    def segments(self) -> list[dict]:
        return self.store.told()["note"].get("segments", [])

    def lookup(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """fingerprint: those of rows that were seen before, in another batch than the given one."""
        segments = self.segments()
        asked = self._placed(rows.select("fingerprint").where("fingerprint is not null").distinct())
        if not segments:
            return asked.select("fingerprint").limit(0)
        filters = self.spark.read.schema(FILTERS).parquet(*[s["filters"] for s in segments])
        known = self._hashed(asked).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_known, "fingerprint string, bucket int")
        path = f"{self.folder}/asked-{batch}"
        known.write.mode("overwrite").parquet(path)
        known = self.spark.read.schema("fingerprint string, bucket int").parquet(path)
        some = known.limit(NAMED + 1).collect()
        if not some:
            return asked.select("fingerprint").limit(0)
        # a scan for each segment: the bucket is a folder, so other buckets are never listed
        wanted = sorted({r.bucket for r in (known.select("bucket").distinct().collect() if len(some) > NAMED else some)})
        found = None
        for s in segments:
            own = self.spark.read.schema(SEGMENT).parquet(s["path"]).where(F.col("bucket").isin(wanted))
            own = own.where(F.col("fingerprint").isin([r.fingerprint for r in some])) if len(some) <= NAMED else own.join(known.select("fingerprint"), "fingerprint", "left_semi")
            found = own if found is None else found.unionByName(own)
        return (found if batch is None else found.where(F.col("batch") != batch)).select("fingerprint").distinct()

    def add(self, rows: DataFrame, batch: int) -> None:
        """Remembers the fingerprints of rows as brought by the batch; a batch that was added before is left as it is."""
        told = self.store.told()
        held = told["note"].get("segments", [])
        if any(batch in s["batches"] for s in held):
            return
        new = self._placed(rows.select("fingerprint").where("fingerprint is not null").distinct().withColumn("batch", F.lit(batch).cast("long")))
        segments = [*held, self._write(new, [batch])]
        gone: list[dict] = []
        while True:
            # the newest segments of a level are merged into one of the next
            tail = [s for s in segments if s["level"] == segments[-1]["level"]]
            if len(tail) < MERGED:
                break
            each = [self.spark.read.schema(SEGMENT).parquet(s["path"]) for s in tail]
            merged = self._write(reduce(DataFrame.unionByName, each), sorted(b for s in tail for b in s["batches"]), tail[-1]["level"] + 1)
            segments = [*segments[: -len(tail)], merged]
            gone += tail
        self.store.publish(told["revision"], {}, {"segments": segments})
        for s in gone:
            remove(self.spark, s["path"])
            remove(self.spark, s["filters"])

    def _write(self, rows: DataFrame, batches: list[int], level: int = 0) -> dict:
        name = f"{level}-{batches[0]}-{batches[-1]}-{self.store.revision()}"
        path, filters = f"{self.folder}/segments/{name}", f"{self.folder}/filters/{name}"
        placed = rows.repartition("bucket").sortWithinPartitions("bucket", "fingerprint")
        placed.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("bucket").parquet(path)
        back = self.spark.read.schema(SEGMENT).parquet(path)
        self._hashed(back).select("bucket", "h1", "h2").groupBy("bucket").applyInArrow(_filter_of, FILTERS).write.mode("overwrite").parquet(filters)
        return {"path": path, "filters": filters, "batches": batches, "level": level}
