"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at a place; dynamic programming carries the best
score and its number of pieces. Ties go to the piece that starts first, and a character without a piece of its own may be
unknown at the lowest score less a penalty: the rules of the unigram tokenizer. Unknown characters count as their UTF-8 bytes (byte fallback).

No piece holds a word start after another character, so the best path of a text is the best paths of its words, and each distinct word is worked out once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers at most.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, less control, unknown and byte pieces."""

    scores: dict[str, float]

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids})


class Counting:
    """Piece counts and best scores under a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        scores = vocabulary.scores
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.cache: dict[str, tuple[int, float]] = {}

    def path(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path of a text whose spaces are marked."""
        size = len(text)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        done, known, unknown = 0, self.known, self.unknown
        score = None
        for end, (length, own) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            while done < end:  # the place before is settled; a character without a piece may be unknown
                if done and (score is None or (text[done - 1] not in known and best[done - 1] + unknown > score)):
                    score, count = best[done - 1] + unknown, pieces[done - 1] + len(text[done - 1].encode("utf-8", "surrogatepass"))
                if done:
                    best[done], pieces[done] = score, count
                done += 1
                score = None
            start = end - length
            if score is None or best[start] + own > score:  # the longest comes first
                score, count = best[start] + own, pieces[start] + 1
        while done <= size:
            if done and (score is None or (text[done - 1] not in known and best[done - 1] + unknown > score)):
                score, count = best[done - 1] + unknown, pieces[done - 1] + len(text[done - 1].encode("utf-8", "surrogatepass"))
            if done:
                best[done], pieces[done] = score, count
            done += 1
            score = None
        return pieces[size], best[size]

    def word(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            found = self.cache[word] = self.path(word)
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; an empty one has none. A space goes before the text, and white space is kept."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.path(marked)
        parts = marked[1:].split(SPACE)
        if "" in parts:  # a run of spaces belongs to the word after it
            joined, run = [], ""
            for part in parts:
                if part:
                    joined.append(run + part)
                    run = ""
                else:
                    run += SPACE
            parts = [*joined, run[:-1]] if run else joined
        n, score = 0, 0.0
        for part, times in Counter(parts).items():
            own = self.word(SPACE + part)
            n += times * own[0]
            score += times * own[1]
        return n, score


def _counted(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(vocabulary)
        for batch in batches:
            found = [counting.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["id", "n_tokens", "score"])

    return run


def count(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and score (of the best path): one row for each row of docs, repeated ones too.

    Whole texts are counted. Null counts as empty, which has no tokens and score 0; an empty table gives no rows; other columns
    are not read. Scores are summed in double precision.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_counted(vocabulary), "id long, n_tokens long, score double")
