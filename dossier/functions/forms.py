"""The fields of a work form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import checkbox_state, selected_options
from .dates import with_date_range
from .text import cut_between, normalize_whitespace

# The labels before and after each field, and those of the tick boxes.
FIELDS = (
    ("project", "项目名称：", "质保单位（盖章）："),
    ("unit", "质保单位（盖章）：", "分包单位："),
    ("subunit", "分包单位：", "质保负责人："),
    ("manager", "质保负责人：", "联系电话："),
    ("manager_phone", "联系电话：", "施工区域："),
    ("area", "施工区域：", "施工日期："),
    ("content", "施工内容：", "施工负责人："),
    ("foreman", "施工负责人：", "联系电话："),
)
DATES = ("施工日期：", "施工内容：")
FOREMAN_SECTION, PHONE = ("施工内容：", "一、影响、改动消防设备设施"), r"联系电话：\s*(\d+)"
BOXES = (("fire_equipment", "一、影响、改动消防设备设施"), ("exits", "二、影响、堵塞应急疏散通道"))
SEPARATOR = "、"
BUSINESS = (*[name for name, _, _ in FIELDS[:6]], "start_date", "end_date", "days", *[name for name, _, _ in FIELDS[6:]], "foreman_phone", *[name for name, _ in BOXES], "hazard")


def with_form_fields(forms: DataFrame, text_col: str = "form_text", tokens_col: str = "tokens") -> DataFrame:
    """forms with the fifteen business fields in place of the text and the tokens.

    Labelled fields come from the text, the foreman's phone from its own section, tick boxes (yes, no or empty) and the chosen hazards from the tokens
    (array<struct<type, value>>). Missing fields are empty, missing dates null. Each step is a projection of its own, so
    that a text is normalised and cut once.
    """
    rest = [c for c in forms.columns if c not in (text_col, tokens_col)]
    plain = forms.withColumn("form_", normalize_whitespace(F.col(text_col)))
    between = {name: F.btrim(cut_between(F.col("form_"), start, end)) for name, start, end in (*FIELDS, ("dates_", *DATES), ("section_", *FOREMAN_SECTION))}
    boxes = {name: checkbox_state(F.col(tokens_col), label) for name, label in BOXES}
    cut = plain.select(*rest, *[c.alias(name) for name, c in (between | boxes).items()], F.array_join(selected_options(F.col(tokens_col)), SEPARATOR).alias("hazard"))
    dated = with_date_range(cut, "dates_", "when_").withColumn("foreman_phone", F.regexp_extract("section_", PHONE, 1))
    return dated.withColumns({"start_date": F.col("when_.start"), "end_date": F.col("when_.end"), "days": F.col("when_.days")}).select(*rest, *BUSINESS)
