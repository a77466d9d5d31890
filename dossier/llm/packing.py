"""Packing documents into token windows by best-fit decreasing.

Documents are tokenised whole; one longer than a window is first cut into full windows and a rest. Best-fit decreasing depends
only on how many pieces have each length, of which there are at most as many as a window has tokens. So the driver plans
for the whole corpus from that histogram: a segment tree indexed by remaining capacity finds the tightest open windows, and all
pieces of one length that fit windows of one capacity are placed in one step. Pieces then look up their windows by length and rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, own_name, ship, stored, text_or_empty, tidy

WINDOW = 4096
END_ID = 2
#: Words that a worker remembers at most, and bytes of text that it handles at once.
REMEMBERED, BYTES_AT_ONCE = 300_000, 8_000_000
#: Pieces of one length that are ranked in one task, about.
RANKED_AT_ONCE = 2_000


#: Between an ASCII letter or digit and such a mark the tokenizer always cuts.
MARKS = r"([0-9A-Za-z])([.,!?;:])"
#: A word of these letters is one word to the tokenizer, too.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORDS_AT_ONCE = 2000


class _Words:
    """Token ids of the words between ASCII white space, which never share a token; each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.ids.append(ids.astype(np.uint32))
        self.ends.append(self.ends[-1][-1] + ends)

    def _add_each(self, words: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.fromiter((i for x in lists for i in x), np.uint32), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))

    def __call__(self, words: list[str]) -> np.ndarray:
        """The number of each word, by which flat() knows it."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if LETTERS.fullmatch(w)]
        for at in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[at : at + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self._add(some, ids, ends)
            else:
                self._add_each(some)
        if rest := [w for w in new if not LETTERS.fullmatch(w)]:
            self._add_each(rest)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each begins."""
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        return self.ids[0], self.ends[0]


_known: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    """One for each worker, kept from task to task."""
    if path not in _known:
        _known[path] = _Words(path)
    return _known[path]


def token_ids(texts: pa.Array, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other and the number of each text, without end ids."""
    texts = texts.cast(pa.large_string())
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the special tokens are told apart by case
        texts = lower_ascii(texts)
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARKS, r"\1 \2"))
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.binary_length(flat).to_numpy() > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    number = words(coded.dictionary.to_pylist())
    ids, begin = words.flat()
    codes = coded.indices.to_numpy()
    starts, sizes = begin[number][codes], (begin[number + 1] - begin[number])[codes]
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
    return ids[place], np.bincount(text[full], weights=sizes, minlength=len(texts)).astype(np.int64)


def _cut(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(1)).to_numpy())
            total = int(size[-1]) if len(size) else 0
            marks = np.unique(np.minimum(np.searchsorted(size, np.arange(BYTES_AT_ONCE, total, BYTES_AT_ONCE)) + 1, len(size)))
            for a, b in zip([0, *marks], [*marks, len(size)], strict=True):
                batch = whole.slice(int(a), int(b - a))
                if not batch.num_rows:
                    continue
                ids, counts = token_ids(batch.column(1), words)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                ends = np.cumsum(counts)
                pieces = -(-counts // window)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, counts[doc] - start)
                first = (ends - counts)[doc] + start
                own = [ids[f : f + n] for f, n in zip(first.tolist(), length.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in own], pa.int64())
                columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(counts[doc])]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens (and ids): each document's ids and the end id, cut into full windows and a rest.

    A null or empty text is its end id alone; a text of any length is encoded whole, in runs of words; repeated rows are cut each; an empty table gives no
    pieces. Other columns aren't read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(_cut(tokenizer, window, end_id, with_ids)), "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first window, offset): best-fit decreasing over counts of lengths."""
    top = 1 << window.bit_length()
    tree = [False] * (2 * top)
    open_at: dict[int, list[tuple[int, int]]] = {}

    def mark(capacity: int, some: bool) -> None:
        i = top + capacity
        tree[i] = some
        while i > 1:
            i //= 2
            tree[i] = tree[2 * i] or tree[2 * i + 1]

    def tightest(least: int) -> int | None:
        """The smallest capacity of at least least that an open window has."""
        i = top + least
        while not tree[i]:
            while i & 1:
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < top:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - top

    steps, windows = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tightest(length)
            fresh = capacity is None
            capacity = window if fresh else capacity
            each = capacity // length  # a window that has taken one stays the tightest while it holds another
            if fresh:
                first, n = windows, -(-left // each)
                windows += n
            else:
                first, n = open_at[capacity].pop()
                if not open_at[capacity]:
                    mark(capacity, False)
            full, more = min(n, left // each), 0
            if full < n:
                more = left - full * each
            for at, some, times in ((first, full, each), (first + full, 1 if more else 0, more)):
                for k in range(times if some else 0):
                    steps.append((length, rank, some, at, window - capacity + k * length))
                    rank, left = rank + some, left - some
                if some and (rest := capacity - times * length):
                    open_at.setdefault(rest, []).append((at, some))
                    mark(rest, True)
            if unused := n - full - (1 if more else 0):
                open_at.setdefault(capacity, []).append((first + n - unused, unused))
                mark(capacity, True)
    return steps


def _placed(steps: np.ndarray, names: list[str], rank: str):
    """steps: the plan's columns, sorted by length and first rank."""
    key = steps[0] << 44 | steps[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            at = np.searchsorted(key, length << 44 | nth, "right") - 1
            sequence = steps[3][at] + nth - steps[1][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(steps[4][at])], names=[*names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of cut (as from pieces) with sequence_id and offset.

    Windows are filled gaplessly from offset 0, in the order of decreasing lengths; no piece is divided further. Pieces of
    one length are interchangeable and go by id, start, checksum. An empty document is one piece, its end id; a null id is
    packed as any other; repeated rows are packed each; an empty table gives no rows.
    """
    ship(cut.sparkSession)
    cut, _ = stored(cut, "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(sorted(plan(histogram, window)), np.int64).reshape(-1, 5).T.copy()
    # only a length that many pieces have is dealt to several groups: at most window lengths, or total / RANKED_AT_ONCE
    many = {length: -(-n // RANKED_AT_ONCE) for length, n in histogram.items() if n > RANKED_AT_ONCE}
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.try_element_at(F.map_from_arrays(F.lit(list(many)), F.lit(list(many.values()))), F.col("length").cast("int")), F.lit(1))
    salt, n, ahead, rank = (own_name(x) for x in ("salt", "n", "ahead", "rank"))
    salted = cut.withColumn(salt, F.pmod(F.xxhash64("id", "start"), salts))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes, _ = stored(sizes.select("length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead)), "ranks")
    own = Window.partitionBy("length", salt).orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn(rank, F.row_number().over(own).cast("long") - 1).join(sizes, ["length", salt])
    ranked = ranked.select(*cut.columns, (F.col(rank) + F.col(ahead)).alias(rank))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(_placed(steps, cut.columns, rank), schema + ", sequence_id long, offset long")
