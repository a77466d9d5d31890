"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by cell (source, language, topic); the cells' weights are raked in turn to the target share of each
source, language and topic until they fit all three. A document is sampled with the ratio of its cell's weight to the cell's observed share,
scaled so that the largest is 1; a hash of its id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, own_name, stored, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Targets where none are given: shares proportional to the observed share to this power.
TEMPER = 0.8
ROUNDS = 12
#: Rounds after which the cells are written, which cuts the plan.
ROUNDS_AT_ONCE = 3
#: Cells that are broadcast at most; more are joined by a shuffle.
BROADCAST_CELLS = 50_000
NULL_NAME = "(null)"
#: Bounds of the topics: code points to a figure in data, code points of short and long texts.
FIGURES, SHORT, LONG = 25, 400, 8000
SALT = "mixing-1"


def topic(text_col: str = "text") -> Column:
    """A topic from the form of the text, for callers without one of their own: blank, data, shout, short, long or prose.

    data has a digit, bar, tab or semicolon for FIGURES code points or fewer; in a shout every third one is a capital.
    """
    text = text_or_empty(text_col)
    size = F.length(text)
    return (
        F.when(~text.rlike(r"[\p{L}\p{N}|;]"), "blank")
        .when(F.regexp_count(text, F.lit(r"[\p{N}|\t;]")) * FIGURES >= size, "data")
        .when(F.regexp_count(text, F.lit(r"\p{Lu}")) * 3 >= size, "shout")
        .when(size < SHORT, "short")
        .when(size > LONG, "long")
        .otherwise("prose")
    )


def _cell(docs: DataFrame, text_col: str, topic_of: Column | None) -> list[Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_NAME))
    return [name("source").alias("source"), name("lang").alias("lang"), (topic(text_col) if topic_of is None else topic_of).alias("topic")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """id, source, lang, topic and n_tokens (words between ASCII white space); null names are a name of their own."""
    tokens = F.regexp_count(text_or_empty(text_col), F.lit("[^" + ASCII_SPACE[1:] + "+")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), *_cell(docs, text_col, topic_of), tokens.alias("n_tokens"))


def _target(rows: DataFrame, dimension: str, given: dict[str, float] | None) -> DataFrame:
    """rows with target, the share of the value of dimension."""
    if given is None:
        root = F.pow(F.col("in_value").cast("double"), F.lit(TEMPER))
        total = rows.groupBy(dimension).agg(F.sum("tokens").alias("in_value")).agg(F.sum(root)).first()[0] or 1.0
        sums = rows.withColumn("in_value", F.sum("tokens").over(Window.partitionBy(dimension)))
        return sums.withColumn("target_" + dimension, root / total).drop("in_value")
    shares = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    return rows.withColumn("target_" + dimension, F.coalesce(shares[F.col(dimension)], F.lit(0.0)) / sum(given.values()))


def raked(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, tokens, weight (shares that fit the targets) and probability, from features.

    targets gives shares by dimension and value; a dimension without them gets tempered shares, a value that a given
    dimension doesn't name gets 0. A cell whose tokens or targets are 0 has probability 0, but where all tokens are 0, 1.
    """
    targets = targets or {}
    cells, _ = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    for dimension in DIMENSIONS:
        cells = _target(cells, dimension, targets.get(dimension))
    cells, _ = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for done in range(0, rounds, ROUNDS_AT_ONCE):
        for _ in range(min(ROUNDS_AT_ONCE, rounds - done)):
            for dimension in DIMENSIONS:
                held = F.sum("weight").over(Window.partitionBy(dimension))
                cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col("target_" + dimension) / held).otherwise(F.lit(0.0)))
        cells, _ = stored(cells, "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / (F.col("tokens") / total)).otherwise(F.lit(0.0)))
    most = cells.agg(F.max("ratio")).first()[0] or 0.0
    cells = cells.withColumn("probability", F.round(F.col("ratio") / most, 9) if most > 0 else F.lit(1.0))
    return cells.select(*DIMENSIONS, "tokens", F.round("weight", 9).alias("weight"), "probability")


def _chance(column: str) -> Column:
    """A number of [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    cells, _ = stored(cells, "raked")
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return rows.join(cells, list(DIMENSIONS))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """id, source, lang, topic, n_tokens, weight, probability, sampled: one row for each row of docs.

    Rows of one id share their fate; a null id is hashed as the empty string; null texts have no tokens; null sources and
    languages form a group named (null); an empty table gives no rows.
    """
    rows, _ = stored(features(docs, id_col, text_col, topic_of), "features")
    both = _with_cells(rows, raked(rows, targets))
    return both.select("id", *DIMENSIONS, "n_tokens", "weight", "probability", (_chance("id") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """The sampled rows of docs, with all their columns, whatever these are named; needs no shuffle of the texts.

    Rows of one id and cell share their fate, repeated ones too. Null texts, sources, languages and ids count as in mix; an
    empty table gives no rows. source and lang have to exist; a null constant does where a table has none.
    """
    cells = raked(features(docs, id_col, text_col, topic_of), targets)
    of_cell, probability = [own_name(d) for d in DIMENSIONS], own_name("probability")
    cells, _ = stored(cells.select(*[F.col(d).alias(c) for d, c in zip(DIMENSIONS, of_cell, strict=True)], F.col("probability").alias(probability)), "raked")
    keys = _cell(docs, text_col, topic_of)
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    on = [key == F.col(c) for c, key in zip(of_cell, keys, strict=True)]
    return docs.join(cells, on).where(_chance(id_col) < F.col(probability)).select(*[docs[c] for c in docs.columns])
