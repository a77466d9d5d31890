"""Files and nested JSON as sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import RevisionTaken, create_whole, exists, names_in, read_file

SCHEMA_VERSION = 1
#: Bytes that are hashed at once; files of one folder that a task reads.
CHUNK, FILES_A_TASK = 1 << 20, 100
FILE = "struct<position: bigint, name: string, size: bigint>"
DATASET = f"schema_version int, dataset_revision bigint, case_id bigint, materials map<string, array<{FILE}>>"


def _evidence_source():
    """The data source of evidence files; made in a function, so that it travels to executors by value."""
    import hashlib

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, folder: str | None, files: list[str]):
            self.folder, self.files = folder, files

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.uri, self.recursive = options["path"], options.get("recursive", "false") == "true"
            self.suffixes = {x.lower() for x in options.get("suffixes", "").split(",") if x}

        def opened(self):
            return fs.FileSystem.from_uri(self.uri)

        def wanted(self, info) -> bool:
            return info.type == fs.FileType.File and not info.base_name.startswith("~$") and (not self.suffixes or info.base_name.lower().endswith(tuple(self.suffixes)))

        def partitions(self):
            """Files of the folder itself in runs; each folder in it is listed by a task."""
            store, top = self.opened()
            infos = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
            files = sorted(i.path for i in infos if self.wanted(i))
            runs = [Part(None, files[k : k + FILES_A_TASK]) for k in range(0, len(files), FILES_A_TASK)]
            folders = sorted(i.path for i in infos if i.type == fs.FileType.Directory) if self.recursive else []
            return [*runs, *[Part(f, []) for f in folders]] or [Part(None, [])]

        def read(self, part):
            store, _ = self.opened()
            found = store.get_file_info(part.files) if part.files else []
            if part.folder is not None:
                found = store.get_file_info(fs.FileSelector(part.folder, recursive=True))
            for info in found:
                if not self.wanted(info):
                    continue
                digest = hashlib.sha256()
                with store.open_input_stream(info.path) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                yield info.path, info.base_name, info.size, info.mtime, digest.hexdigest()

    class EvidenceFiles(DataSource):
        @classmethod
        def name(cls):
            return "evidence_files"

        def schema(self):
            return "path string, name string, size bigint, modified timestamp, sha256 string"

        def reader(self, schema):
            return Reader(self.options)

    return EvidenceFiles


def scan_evidence_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """path, name, size, modified, sha256 of the files in folder (and below it, if recursive) with one of the suffixes, in any case; all without suffixes.

    Temporary ~$ names are left out, a missing folder has no files. Contents are read in chunks and never held in a row, so files may be of any size.
    Folders in the folder are listed by tasks. The folder is a path or a URI of a store that Arrow reads; of others
    (such as viewfs) Spark reads whole files, of up to 2 GB each.
    """
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(folder)
    except (ValueError, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        named = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).where(~F.col("name").startswith("~$"))
        if suffixes:
            named = named.where(F.lower("name").rlike("(" + "|".join(rf"\Q{s.lower()}\E" for s in suffixes) + ")$"))
        return named.select("path", "name", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    spark.dataSource.register(_evidence_source())
    return spark.read.format("evidence_files").option("recursive", str(recursive).lower()).option("suffixes", ",".join(suffixes)).load(folder)


def save_revision(cases: DataFrame, folder: str, revision: int) -> str:
    """Writes nested cases as JSON lines to a new folder of the revision; a reader that is told of it later never sees half of it."""
    path = f"{folder}/revision={revision}-{uuid.uuid4().hex}"
    cases.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("dataset_revision", F.lit(revision).cast("long")).write.json(path)
    return path


def publish(spark: SparkSession, folder: str, revision: int, path: str) -> None:
    """Says where a revision lies, once it is written whole; RevisionTaken if another writer has published the revision before."""
    told = json.dumps({"schema_version": SCHEMA_VERSION, "revision": revision, "path": path})
    if not create_whole(spark, f"{folder}/pointers/{revision:012d}.json", told):
        raise RevisionTaken(f"revision {revision} of {folder} is published already")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Nested cases of the latest published revision; no rows if nothing is published, an error if it has another schema version."""
    told = [n for n in names_in(spark, f"{folder}/pointers") if n.endswith(".json") and not n.startswith(".")]
    if not told:
        return spark.createDataFrame([], DATASET)
    last = json.loads(read_file(spark, f"{folder}/pointers/{told[-1]}"))
    if last["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {last['schema_version']} at {folder}, not {SCHEMA_VERSION}")
    return load_revision(spark, last["path"])


def load_revision(spark: SparkSession, path: str) -> DataFrame:
    """Nested cases; a missing dataset has no rows. Another schema version, or none, is an error whatever columns are selected: it is asked of
    every row in a filter, which column pruning keeps."""
    if not exists(spark, path):
        return spark.createDataFrame([], DATASET)
    rows = spark.read.schema(DATASET).json(path)
    wrong = F.raise_error(F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))
    return rows.where(F.when(F.col("schema_version") == SCHEMA_VERSION, F.lit(True)).otherwise(wrong.cast("boolean")))


def load_recognized_text(rows: DataFrame, version: str) -> DataFrame:
    """Valid entries of the text cache: the right version and a text, which may be empty."""
    return rows.where((F.col("version") == version) & F.col("text").isNotNull())


def load_prior_matches(spark: SparkSession, path: str, version: str) -> DataFrame:
    """key, names of an earlier match table in CSV of that version; the last row of a key wins; missing columns are an error."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {"key", "names", "row_no", "version"} - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return rows.where(F.col("version") == version).groupBy("key").agg(F.max_by("names", F.col("row_no").cast("long")).alias("names"))


def load_manual_overrides(rows: DataFrame, column: str) -> DataFrame:
    """ord, image, pdf, valid: entries of JSON lists of {image, pdf}; a blank member makes an entry invalid."""
    entries = rows.select("ord", F.explode(F.from_json(column, "array<struct<image: string, pdf: string>>")).alias("e"))
    ok = (F.trim(F.coalesce("e.image", F.lit(""))) != "") & (F.trim(F.coalesce("e.pdf", F.lit(""))) != "")
    return entries.select("ord", "e.image", "e.pdf", ok.alias("valid"))
