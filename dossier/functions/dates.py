"""Dates in recognised text as Column expressions; an impossible date is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_digits, normalize_whitespace

# Separators within a date in running text and in a range, marks between the dates of a range, labels.
IN_TEXT, IN_RANGE, BETWEEN = "./．~-—–－", "./．", "~～-—–－至到"
START_LABEL, END_LABEL, LABEL_TAILS, COLONS = "施工开始", "施工结束", ("时间", "日期"), ":："


def one_of(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "[]^-\\" else c for c in characters) + "]"


def written(separators: str, year_may_lack: bool = False) -> str:
    """A pattern of a date with groups for year, month and day; after the first two stands their own sign or a separator."""
    closed = lambda number, sign: rf"({number})\s*(?:{sign}|{one_of(separators)})\s*"
    year = closed(r"\d{4}", "年")
    return (f"(?:{year})?" if year_may_lack else year) + closed(r"\d{1,2}", "月") + r"(\d{1,2})\s*日?"


def alone(pattern: str) -> str:
    """The pattern where no further digit touches it."""
    return rf"(?<!\d){pattern}(?!\d)"


def labelled(label: str) -> str:
    return rf"{label}(?:{'|'.join(LABEL_TAILS)})?\s*{one_of(COLONS)}?\s*{TOKEN}"


TOKEN, COMPACT = alone(written(IN_TEXT)), alone(r"(20\d{2})(\d{2})(\d{2})")
START, END = labelled(START_LABEL), labelled(END_LABEL)
SINGLE = written(IN_RANGE)
RANGE = rf"{SINGLE}\s*{one_of(BETWEEN)}+\s*{written(IN_RANGE, year_may_lack=True)}"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.when(year != "", F.concat_ws("-", year, month, day)), "yyyy-M-d")


def first_date(text: Column, pattern: str, at: int = 1) -> Column:
    return _date(*[F.regexp_extract(text, pattern, i) for i in range(at, at + 3)])


def date_range(raw: Column) -> Column:
    """struct(start, end, days): a range whose second year may be left out, or a single date of one day, or nulls."""
    text = normalize_whitespace(normalize_digits(raw))
    return _range_of(F.regexp_extract(text, RANGE, 0), F.regexp_extract(text, SINGLE, 0))


def with_date_range(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with date_range of a column. Each step is a projection of its own, so a text is searched once for either form, and its parts are read from what was found."""
    plain = rows.withColumn("plain_", normalize_whitespace(normalize_digits(F.col(column))))
    cut = plain.withColumn("range_", F.regexp_extract("plain_", RANGE, 0))
    cut = cut.withColumn("single_", F.when(F.col("range_") == "", F.regexp_extract("plain_", SINGLE, 0)).otherwise("")).drop("plain_")
    # numbers in their order: a range has six, or five where its second year is left out
    parts = cut.withColumn("parts_", F.regexp_extract_all(F.when(F.col("range_") != "", F.col("range_")).otherwise(F.col("single_")), F.lit(r"\d+"), F.lit(0)))
    at = lambda i: F.try_element_at("parts_", F.lit(i))
    ranged = F.col("range_") != ""
    dated = parts.withColumns({"first_": _date(at(1), at(2), at(3)), "last_": F.when(ranged, _date(F.when(F.size("parts_") == 6, at(4)).otherwise(at(1)), at(-2), at(-1)))})
    told = F.struct(F.col("first_").alias("start"), F.when(ranged, F.col("last_")).otherwise(F.col("first_")).alias("end"), _days(ranged, F.col("first_"), F.col("last_")).alias("days"))
    return dated.withColumn(name, told).drop("range_", "single_", "parts_", "first_", "last_")


def _days(ranged: Column, start: Column, end: Column) -> Column:
    return F.when(ranged, F.datediff(end, start) + 1).otherwise(F.when(start.isNotNull(), 1))


def _range_of(found: Column, single: Column) -> Column:
    year, end_year = F.regexp_extract(found, RANGE, 1), F.regexp_extract(found, RANGE, 4)
    start = F.when(found != "", first_date(found, RANGE)).otherwise(first_date(single, SINGLE))
    end = _date(F.when(end_year != "", end_year).otherwise(year), F.regexp_extract(found, RANGE, 5), F.regexp_extract(found, RANGE, 6))
    return F.struct(start.alias("start"), F.when(found != "", end).otherwise(start).alias("end"), _days(found != "", start, end).alias("days"))


def date_token(raw: Column) -> Column:
    """The first date in any separator style, else the first compact one."""
    text = normalize_digits(raw)
    return F.when(text.rlike(TOKEN), first_date(text, TOKEN)).otherwise(first_date(text, COMPACT))


def all_dates(raw: Column) -> Column:
    """The distinct valid dates of a text, in both styles, ascending."""
    return _dates_of(_date_pieces(normalize_digits(raw)))


def _date_pieces(text: Column) -> Column:
    """The distinct pieces of a text that look like a date of either style."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (TOKEN, COMPACT)]))


def _dates_of(pieces: Column) -> Column:
    """The distinct valid dates of pieces, ascending; no compact date stands in a piece with separators."""
    dated = F.transform(pieces, lambda x: F.coalesce(first_date(x, TOKEN), first_date(x, COMPACT)))
    return F.array_sort(F.array_distinct(F.filter(dated, lambda d: d.isNotNull())))


def with_dates(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with what dates_agree asks of a text: labelled (both labelled dates stand in it), doc_start, doc_end, dates (all of them; null where labelled)."""
    plain = rows.withColumn("digits_", normalize_digits(F.col(text_col)))
    # each label is looked for once; its parts are read from the short piece that was found
    cut = plain.withColumns({"start_": F.regexp_extract("digits_", START, 0), "end_": F.regexp_extract("digits_", END, 0)})
    labelled_ = (F.col("start_") != "") & (F.col("end_") != "")
    # other dates are searched only where they count
    cut = cut.withColumn("found_", F.when(~labelled_, _date_pieces(F.col("digits_")))).drop("digits_")
    told = {"labelled": labelled_, "doc_start": first_date(F.col("start_"), START), "doc_end": first_date(F.col("end_"), END), "dates": _dates_of(F.col("found_"))}
    return cut.withColumns(told).drop("start_", "end_", "found_")


def dates_agree(start: Column, end: Column) -> Column:
    """On rows with_dates: labelled dates must equal the expected ones; where one is missing both must occur anywhere."""
    exact = (F.col("doc_start") == start) & (F.col("doc_end") == end)
    anywhere = F.array_contains("dates", start) & F.array_contains("dates", end)
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), F.when(F.col("labelled"), exact).otherwise(anywhere)), F.lit(False))


def date_delta(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def date_points(delta: Column, most: int) -> Column:
    """Points for closeness in steps of 0, 3, 7, 14 and 31 days; none for an unknown difference."""
    steps = ((0, 0), (3, 2), (7, 4), (14, 7), (31, 10))
    points = F.when(delta.isNull(), 0)
    for days, less in steps:
        points = points.when(delta <= days, max(0, most - less))
    return points.otherwise(0)
