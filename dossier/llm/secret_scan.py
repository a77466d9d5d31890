"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must hold. Documents are
indexed in shards (an Arrow batch of a partition): the postings of the rules' trigrams are built in one pass over the bytes,
the queries intersect and unite postings, and only candidates meet the expression. A rule without mandatory trigrams
scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser as P

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, ship, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least min_chars characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    min_chars: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=16),
    # the runs of [0-9a-f]+ that reach 32 characters
    Rule("hex", r"[0-9a-f]{32,}", min_chars=32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
#: A query is a trigram, ("and", ...), ("or", ...) or None, which holds everywhere.
MAX_STRINGS = 64
#: Bytes of text whose trigrams are looked up at once.
WINDOW = 1 << 22


def _strings(node) -> set[str] | None:
    """All strings that a parsed sequence can match, lower-cased; None if they are too many."""
    found = {""}
    for op, arg in node:
        if op is K.LITERAL:
            some = {chr(arg).lower()}
        elif op is K.IN and all(x[0] is K.LITERAL for x in arg):
            some = {chr(x[1]).lower() for x in arg}
        elif op is K.SUBPATTERN:
            some = _strings(arg[3])
        elif op is K.BRANCH:
            each = [_strings(x) for x in arg[1]]
            some = None if None in each else set().union(*each)
        elif op is K.MAX_REPEAT and arg[1] <= 4 and (one := _strings(arg[2])) is not None and len(one) ** arg[1] <= MAX_STRINGS:
            some = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        else:
            some = None
        if some is None or len(found) * len(some) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in some}
    return found


def _all_of(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _one_of(parts):
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _held(strings: set[str]):
    """The query for: one of these strings occurs."""
    strings = {s for s in strings if not any(t in s for t in strings if t != s)}
    return _one_of([_all_of(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def _query(node):
    parts, run = [], {""}

    def flush():
        nonlocal run
        if run != {""}:
            parts.append(_held(run))
        run = {""}

    for item in node:
        some = _strings([item])
        if some is not None and len(run) * len(some) <= MAX_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        flush()
        op, arg = item
        if op is K.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is K.BRANCH:
            parts.append(_one_of([_query(x) for x in arg[1]]))
        elif op is K.MAX_REPEAT and arg[0] > 0:
            parts.append(_query(arg[2]))
        elif some is not None:
            run = some
    flush()
    return _all_of(parts)


def trigram_query(rule: Rule):
    """The trigrams, lower-cased, that every text with a match of the rule holds."""
    return _query(P.parse(rule.pattern))


def trigrams_of(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1:]))


def postings(texts: pa.Array, trigrams: list[str]) -> dict[str, np.ndarray]:
    """For each trigram the sorted places of the texts that hold it, in either case of ASCII letters."""
    low = lower_ascii(texts)
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] else np.zeros(0, np.uint8)
    number = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(trigrams):
        a, b, c = t.encode()
        number[a << 16 | b << 8 | c] = k + 1
    found = []
    for at in range(int(ends[0]), int(ends[-1]) - 2, WINDOW):
        part = data[at : min(at + WINDOW + 2, int(ends[-1]))].astype(np.uint32)
        hit = number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
        where = np.flatnonzero(hit)
        text = np.searchsorted(ends, where + at, "right") - 1
        whole = where + at + 3 <= ends[text + 1]
        found.append(np.unique(hit[where][whole].astype(np.int64) * len(low) + text[whole]))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    parts = np.searchsorted(both, np.arange(1, len(trigrams) + 2) * len(low))
    return {t: both[parts[k] : parts[k + 1]] % max(len(low), 1) for k, t in enumerate(trigrams)}


def matching(query, lists: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The places that satisfy the query."""
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        return lists[query]
    some = [matching(q, lists, n) for q in query[1:]]
    join = np.intersect1d if query[0] == "and" else np.union1d
    for x in some[1:]:
        some[0] = join(some[0], x)
    return some[0]


def spans_of(rule: Rule, text: str, pattern: re.Pattern | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in (pattern or rule.compiled()).finditer(text) if len(m.group(rule.group)) >= rule.min_chars]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        patterns = [r.compiled() for r in rules]
        trigrams = sorted(set().union(*map(trigrams_of, queries)))
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1)
            lists = postings(texts, trigrams)
            spans: list[list[tuple]] = [[] for _ in range(len(texts))]
            for k, rule in enumerate(rules):
                for i in matching(queries[k], lists, len(texts)).tolist():
                    spans[i] += [(start, k, end) for start, end in spans_of(rule, texts[i].as_py(), patterns[k])]
            sizes = np.cumsum([0, *map(len, spans)])
            flat = [x for own in spans for x in sorted(own)]
            items = pa.StructArray.from_arrays(
                [pa.array([rules[k].kind for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())],
                names=["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)], names=["id", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end>> (code points, end exclusive, by start, then order of the rules).

    Spans are each rule's leftmost non-overlapping matches in the whole text, less those whose group is too short; spans of
    different rules may overlap. One row for each row of docs, repeated ones too, with an empty array where nothing is found;
    null counts as the empty text; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scan(tuple(rules)), "id long, spans array<struct<kind:string,start:long,end:long>>")
