"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from labelled training texts. A text is compressed
with every dictionary, in pieces that start afresh; the smallest sum of sizes names the language, and a narrow lead over the
next is a rejection. What a dictionary saves is bounded, so the lead over one long stream would shrink with its length; the
sum over pieces of one size keeps it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

UNKNOWN = "und"
#: Training texts for each language at most (expected number), and characters cut from each of them: the
#: bound on what the driver gathers. A dictionary holds DICTIONARY_BYTES at most.
TEXTS_PER_LANGUAGE, SLICE_CHARS, DICTIONARY_BYTES = 600, 400, 112 * 1024
LEVEL = 7
#: More labels than this are an error: each has a dictionary on the driver and in the tasks.
MOST_LANGUAGES = 500
#: Bytes that are compressed at once; together the pieces are the whole text.
PIECE_BYTES = 16 << 10
#: A text is rejected if the best size is not below the second by this share of it.
MIN_MARGIN = 0.002


def _packers(dictionaries: dict[str, bytes]) -> list[tuple[str, Callable[[bytes], bytes]]]:
    packers = []
    for name, data in dictionaries.items():
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        packers.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False).compress))
    return packers


def _size(pack: Callable[[bytes], bytes], data: bytes) -> int:
    return sum(len(pack(data[at : at + PIECE_BYTES])) for at in range(0, len(data), PIECE_BYTES))


def _joined(found: dict[str, list[str]]) -> dict[str, bytes]:
    return {lang: "\n".join(texts).encode()[-DICTIONARY_BYTES:] for lang, texts in found.items() if texts}


def _confirmed(found: dict[str, list[str]]) -> dict[str, list[str]]:
    """The texts that dictionaries of the other half of the sample give to their own language: wrong labels go."""
    kept: dict[str, list[str]] = {lang: [] for lang in found}
    for half in (0, 1):
        packers = _packers(_joined({lang: texts[1 - half :: 2] for lang, texts in found.items()}))
        for lang, texts in found.items():
            for text in texts[half::2]:
                sizes = {name: len(pack(text.encode())) for name, pack in packers}
                if lang not in sizes or sizes[lang] == min(sizes.values()):
                    kept[lang].append(text)
    return {lang: kept[lang] or texts for lang, texts in found.items()}


def learn(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw-content dictionaries by language, the most frequent first, from a bounded sample of the labelled rows that training selects.

    The sample of a language is what a hash of the id selects at the rate TEXTS_PER_LANGUAGE / rows of the language, one
    slice of SLICE_CHARS from a hashed place of each text. Texts that contradict their label are left out. Rows with null text or language
    are no training rows; repeated rows are one. Without training rows, so for an empty table, the result is empty; more than MOST_LANGUAGES labels are an error.
    """
    rows = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return {}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    rate = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(TEXTS_PER_LANGUAGE / n))])
    chance = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.lit(1), F.length("t") - SLICE_CHARS + 1)).cast("int") + 1
    picked = rows.where(chance < rate[F.col("l")]).select("l", "i", F.lower(F.substring("t", place, F.lit(SLICE_CHARS))).alias("t"))
    found: dict[str, list[str]] = {lang: [] for lang in sorted(sizes, key=lambda lang: (-sizes[lang], lang))}
    for r in picked.distinct().orderBy("l", F.xxhash64("i"), "t").collect():
        found[r.l].append(r.t)
    return _joined(_confirmed(found))


def _classify(dictionaries: dict[str, bytes], min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packers = list(dictionaries), [pack for _, pack in _packers(dictionaries)]
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not names or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                data = text.lower().encode()
                sizes = [_size(pack, data) for pack in packers]
                best = min(range(len(names)), key=sizes.__getitem__)
                rest = min((s for k, s in enumerate(sizes) if k != best), default=len(data) + 16)
                margin = max(0.0, (rest - sizes[best]) / rest)
                langs.append(names[best])
                scores.append(margin)
                rejected.append(margin < min_margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["id", "lang_pred", "score", "rejected"],
            )

    return run


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", id_col: str = "doc_id", min_margin: float = MIN_MARGIN) -> DataFrame:
    """id, lang_pred, score (the relative lead of the smallest over the next size, 0 to 1), rejected.

    Whole texts are compressed, lower-cased, in pieces of PIECE_BYTES. A null, empty or letterless text, or having no dictionary at all,
    gives ``und`` with score 0, rejected. Equal sizes go to the language that comes first among the dictionaries. One row for each
    row of docs, repeated ones too; an empty table gives none; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_classify(dictionaries, min_margin)), "id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, whatever these are named.

    Null, empty and letterless texts and ties of sizes are rejected; without dictionaries all rows are. Repeated rows
    share their fate, a text's length has no say in it, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    run = _classify(dictionaries, min_margin)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["id", "text"])
            for told in run(iter([texts])):
                yield batch.filter(pa.compute.invert(told.column("rejected")))

    return docs.mapInArrow(tidy(keep), docs.schema)
