"""Text normalisation and labelled-field extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace knows it.
WHITE = r"(?U)[\s\x1c-\x1f]+"
# Dashes and waves that become ~, full-width brackets and commas that become ASCII.
MATCH_FROM, MATCH_TO = "～—–－-（），、", "~~~~~(),,"
FULL_WIDTH, DIGITS = "０１２３４５６７８９", "0123456789"
FIELD_EDGES = "~:：-—"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; null to the empty string."""
    return F.btrim(F.regexp_replace(blank(c), WHITE, " "))


def normalize_match_text(c: Column) -> Column:
    """The form in which texts are compared: no white space, lower case, dashes to ~, ASCII brackets and commas."""
    return F.translate(F.lower(F.regexp_replace(blank(c), WHITE, "")), MATCH_FROM, MATCH_TO)


def normalize_ocr_text(c: Column) -> Column:
    """As normalize_match_text, and an i before a digit and not after a letter is read as l."""
    return ocr_form(normalize_match_text(c))


def ocr_form(normalised: Column) -> Column:
    """normalize_ocr_text of a text in match form."""
    return F.regexp_replace(normalised, r"(?<![a-z])i(?=\d)", "l")


def normalize_digits(c: Column) -> Column:
    return F.translate(blank(c), FULL_WIDTH, DIGITS)


def count_cjk_chars(c: Column) -> Column:
    """Characters of U+4E00 to U+9FFF."""
    return F.regexp_count(blank(c), F.lit("[\\u4e00-\\u9fff]"))


def best_text(plain: Column, recognised: Column, least: int = 10) -> Column:
    """The embedded text if it has enough CJK characters, else the recognised one, else the embedded one after all."""
    return F.when(count_cjk_chars(plain) >= least, blank(plain)).when(normalize_whitespace(recognised) != "", recognised).otherwise(blank(plain))


#: An item of a bracketed list: in single quotes, in double quotes, or plain.
ITEM = r"""\s*'(?:[^']|'')*'|\s*"(?:[^"\\]|\\.)*"|[^,]+"""
QUOTE = "'"


def split_name_list(c: Column) -> Column:
    """Names between commas or semicolons of either width, or the items of a bracketed list, quoted or plain."""
    raw = F.trim(blank(c))
    single = lambda x: F.replace(F.substring(x, 2, F.length(x) - 2), F.lit(QUOTE * 2), F.lit(QUOTE))
    double = lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)), x)
    bare = lambda x: F.when(x.startswith(QUOTE), single(x)).when(x.startswith('"'), double(x)).otherwise(x)
    listed = F.transform(F.regexp_extract_all(F.substring(raw, 2, F.length(raw) - 2), F.lit(ITEM), F.lit(0)), lambda x: normalize_whitespace(bare(F.trim(x))))
    items = F.transform(F.split(raw, "[,，；;]"), lambda x: normalize_whitespace(x))
    return F.filter(F.when(raw.startswith("[") & raw.endswith("]"), listed).otherwise(items), lambda x: x != "")


def sanitize_filename(c: Column) -> Column:
    cleaned = F.regexp_replace(F.btrim(blank(c)), r'[\\/:*?"<>|]+', "-")
    return F.btrim(normalize_whitespace(cleaned), F.lit(". "))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    name = F.regexp_extract(blank(path), r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(blank(path), r"[^/\\](\.[^./\\]+)$", 1))


def manual_match_key(path: Column) -> Column:
    """What of a file's stem counts in manual overrides: ASCII letters and digits and CJK characters, lower case."""
    return F.lower(F.regexp_replace(normalize_digits(stem(path)), "[^0-9A-Za-z\\u4e00-\\u9fff]+", ""))


def cut_between(text: Column, start: str, end: str) -> Column:
    """The shortest text between two labels as it stands; empty if either label is missing."""
    first = F.position(F.lit(start), text)
    last = F.position(F.lit(end), text, first + len(start))
    return F.when((first > 0) & (last > 0), F.substring(text, first + len(start), last - first - len(start))).otherwise(F.lit(""))


def capture_between(text: Column, start: str, end: str) -> Column:
    """As cut_between, white space normalised."""
    return normalize_whitespace(cut_between(blank(text), start, end))


def labelled_field(normalised: Column, label: str, ends: tuple[str, ...]) -> Column:
    """From a label to the nearest of the end labels or the end, in a text in match form."""
    first = F.position(F.lit(label), normalised)
    value = first + len(label)
    hits = [F.when(F.position(F.lit(e), normalised, value) > 0, F.position(F.lit(e), normalised, value)) for e in ends]
    last = F.least(*hits, F.length(normalised) + 1) if hits else F.length(normalised) + 1
    return F.when(first > 0, F.btrim(F.substring(normalised, value, last - value), F.lit(FIELD_EDGES))).otherwise(F.lit(""))


def relative_href(path: Column) -> Column:
    """A path as a link: backslashes turned, empty and . parts dropped, each part percent-encoded."""
    parts = F.filter(F.split(F.replace(blank(path), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    quoted = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(parts, quoted), "/")


def joined_nonblank(*parts: Column, separator: str = "\n") -> Column:
    return F.array_join(F.filter(F.array(*[F.btrim(blank(p)) for p in parts]), lambda x: x != ""), separator)


def leaves_root(path: Column) -> Column:
    """True if a path is absolute or climbs above its root."""
    raw = F.replace(blank(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a.d + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a.low, a.d + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return raw.startswith("/") | (depth.low < 0)
