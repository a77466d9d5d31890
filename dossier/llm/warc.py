"""WARC archives with an index: written once, then read by coalesced byte ranges.

Every record is a gzip member of its own. Writing gives an index row for each record (file, offset, length, URL, digest);
reading selects index rows, sorts them by file and offset, joins neighbouring ranges into one read and parses the members.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, ship, stored, text_or_empty

#: Payloads of fewer bytes are always written in full.
LEAST_REVISITED = 0
#: An archive file is closed at this size; a read covers READ bytes at most and skips gaps of up to GAP bytes.
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
#: Bytes that a task reads, about; index rows say nothing about them, so the number of tasks is set and not left to their size.
TASK_BYTES, MOST_TASKS = 2 * READ_BYTES, 100_000
LEVEL = 1
#: A payload is hot if more than one row in HOT_SHARE has it; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
DATE = "2020-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
NAME = "urn:dossier:page:"


def decisions(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_REVISITED) -> DataFrame:
    """page_id, sha, refers_to of the rows that repeat a payload; the row with the largest id holds it."""
    payload = text_or_empty(payload_col)
    facts = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n"))
    facts, _ = stored(facts, "payloads")
    groups = facts.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    groups, _ = stored(groups, "payload-groups")
    hot = F.broadcast(groups.where(F.col("rows") > facts.count() // HOT_SHARE))
    joined = facts.join(hot, "sha").unionByName(facts.join(hot.select("sha"), "sha", "left_anti").join(groups, "sha"))
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # an attempt that is repeated writes other files; the index names those of the one that counts
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    payload = html.encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    record = _record(page_id, url, payload, digest, refers_to, revisit)
                    out.write(record)
                    index.append((name, at, len(record), page_id, url, digest, "revisit" if revisit else "response", refers_to))
                    at += len(record)
                if index:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                    names = ["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISITED) -> DataFrame:
    """Writes a record for each row of pages below folder and returns the stored index.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a response and the others revisit it;
    rows that are equal in id and payload are responses each. A null payload is empty, a null url gives no target, a null id
    loses ties; an empty table gives an empty index. Only the three columns are read.
    """
    ship(pages.sparkSession)
    payload = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    again = decisions(pages, id_col, payload_col, least).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.unhex(F.sha1("html")) == F.col("again_sha"))
    decided = rows.join(again, same, "left").select("page_id", "url", "html", "refers_to", F.col("again_sha").isNotNull().alias("revisit"))
    index, _ = stored(decided.mapInArrow(_write(folder), INDEX), "warc-index")
    return index


def parse(record: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """page_id, url, payload (None for a revisit), payload bytes, digest, record type, refers_to of a plain record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda field: int(x) if (x := fields[field].removeprefix("<" + NAME).removesuffix(">")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), None if revisit else payload, size, digest, fields["WARC-Type"], number("WARC-Refers-To") if revisit else None


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads (file, offset, length, the records in it)."""
    now: tuple[str, int, int, list] | None = None
    for file, offset, length in places:
        if now and now[0] == file and offset - (now[1] + now[2]) <= GAP_BYTES and offset + length - now[1] <= READ_BYTES:
            now = (file, now[1], offset + length - now[1], [*now[3], (offset, length)])
            continue
        if now:
            yield now
        now = (file, offset, length, [(offset, length)])
    if now:
        yield now


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start, size, own in ranges(list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))):
                with store.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(size, start)
                found = []
                for offset, length in own:
                    record = parse(zlib.decompress(data[offset - start : offset - start + length], wbits=31))
                    payload, digest = record[2], record[4]
                    if payload is not None and (len(payload) != record[3] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{file} at {offset}: the payload doesn't match its record")
                    found.append(record)
                page_id, url, payload, size_, digest, kind, refers_to = zip(*found, strict=True)
                columns = [pa.array(page_id, pa.int64()), pa.array(url, pa.string()), pa.array(size_, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers_to, pa.int64())]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    columns.append(pa.array(payload, pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the given index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    One row for each index row, repeated ones too, in no order; an empty index gives none. A revisit's payload is null. A
    record that the index misplaces or whose payload doesn't match its digest is an error.
    """
    ship(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-total // TASK_BYTES)))
    place = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return place.mapInArrow(_read(folder, with_payload), schema + ", payload binary" * with_payload)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
