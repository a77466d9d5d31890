"""Identifiers and names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, normalize_digits, normalize_match_text, sanitize_filename, stem, suffix

#: The namespace of identifiers of this library.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "record-evidence-linkage")
# Parts of canonical file names.
FORM_SUFFIX = "_质保作业申请单"
APPROVAL_TITLE = "工程类-主体质保施工"
NUMBER_LABEL, NUMBER_DIGITS = "_编号：", 12
ROLE_LABELS = {
    "signed_application": "手签",
    "worker_list": "施工人员名单",
    "confined_space": "有限空间申请",
    "high_altitude": "高处作业申请",
    "special_work": "专项作业材料",
}
#: A canonical approval's name; the group is its number.
APPROVAL_NAME = rf"(?i)^{APPROVAL_TITLE}{NUMBER_LABEL}(\d{{{NUMBER_DIGITS}}})\.pdf$"


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version-5 UUID of a name: SHA-1 over namespace and name with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(blank(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def parsed_case_name(name: Column) -> Column:
    """struct(date, content) of a name date_content_suffix; nulls if it isn't one."""
    pattern = rf"^(\d{{4}}-\d{{2}}-\d{{2}})_(.+){FORM_SUFFIX}$"
    hit = blank(name).rlike(pattern)
    return F.struct(F.when(hit, F.try_to_date(F.regexp_extract(name, pattern, 1), "yyyy-MM-dd")).alias("date"), F.when(hit, F.regexp_extract(name, pattern, 2)).alias("content"))


def case_name(start: Column, content: Column) -> Column:
    """date_content_suffix; an error if either is missing."""
    made = F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("_"), sanitize_filename(content), F.lit(FORM_SUFFIX))
    return F.when(start.isNotNull() & (F.btrim(blank(content)) != ""), made).otherwise(F.raise_error(F.lit("a case name needs a start date and a content")))


def material_name(case: Column, role: Column, index: Column, file: Column) -> Column:
    """case name, label of the role, two-digit index (more digits from 100) and the file's suffix."""
    labels = F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])
    number = F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.concat(case, F.lit("_"), F.coalesce(labels[role], role), F.lit("_"), number, suffix(file))


def number_from_name(file: Column) -> Column:
    """A stem of 12 digits, or the first 12 digits of a stem that speaks of a number."""
    name = normalize_digits(stem(file))
    return F.when(name.rlike(r"^\d{12}$"), name).when(name.contains("编号"), F.regexp_extract(F.regexp_replace(name, r"\D", ""), r"\d{12}", 0)).otherwise("")


def number_from_text(text: Column) -> Column:
    """The labelled number of a text that carries the title."""
    compact = F.regexp_replace(normalize_digits(text), r"(?U)\s+", "")
    found = F.regexp_extract(compact, r"申请编号[:：](\d{12})", 1)
    return F.when(normalize_match_text(normalize_digits(text)).contains(APPROVAL_TITLE.replace("-", "~")), found).otherwise("")


def application_no(file: Column, text: Column) -> Column:
    """From a canonical file name, else from the text, else from the digits of the name."""
    canonical = F.regexp_extract(normalize_digits(file), APPROVAL_NAME, 1)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (canonical, number_from_text(text), number_from_name(file))], F.lit(""))


def with_application_no(rows: DataFrame, file: str, text: str) -> DataFrame:
    """rows with application_no. Each step is a projection of its own: a text is normalised once, and for its title only where a number was found."""
    steps = rows.withColumn("canonical_", F.regexp_extract(normalize_digits(F.col(file)), APPROVAL_NAME, 1))
    steps = steps.withColumn("digits_", F.when(F.col("canonical_") == "", normalize_digits(F.col(text))))
    steps = steps.withColumn("found_", F.regexp_extract(F.regexp_replace("digits_", r"(?U)\s+", ""), r"申请编号[:：](\d{12})", 1))
    titled = normalize_match_text(F.col("digits_")).contains(APPROVAL_TITLE.replace("-", "~"))
    steps = steps.withColumn("told_", F.when(F.col("found_") != "", F.when(titled, F.col("found_"))))
    number = F.when(F.col("canonical_") != "", F.col("canonical_")).when(F.col("told_").isNotNull(), F.col("told_")).otherwise(number_from_name(F.col(file)))
    return steps.withColumn("application_no", F.coalesce(number, F.lit(""))).drop("canonical_", "digits_", "found_", "told_")


def is_canonical_name(file: Column) -> Column:
    return normalize_digits(file).rlike(APPROVAL_NAME)
