"""Rules that give texts, names and token lists a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import one_of
from .ids import APPROVAL_NAME
from .text import blank, normalize_digits, normalize_match_text, stem, suffix

# Keywords of the rules, and marks that count as ticked.
IMAGES = (".jpg", ".jpeg", ".png")
TICKS = "☑☒✓✔√■●◆⊠▣▩◉x×"
BETWEEN, MOST_BETWEEN = "：:;；,、[](){}【】□☐○◇", 3
SAID = ("已勾选", "是")
WORK_TYPES = ("动火作业", "有限空间作业", "5米以上高处作业", "危大工程", "配电室接电")
CHECKED = "0052"
STOPS = ("一、", "二、", "三、", "会投工程部意见：", "分公司工程部意见：")
BASE_ROLES = ("word", "signed_application", "worker_list", "safety_agreement")
LIST_COLUMNS = ("姓名", "性别", "电话")
# Each kind of text: words that name it, options that are ticked on it.
TEXT_ROLES = (
    ("worker_list", ("工人名单", "人员名单"), ()),
    ("signed_application", ("质保作业申请单", "质保申请单"), ()),
    ("confined_space", ("有限空间作业申请",), ("有限空间作业",)),
    ("high_altitude", ("高处作业申请", "高空作业申请"), ("5米以上高处作业", "5米以上高空作业")),
    ("special_work", ("动火作业申请", "危大工程专项方案", "配电室接电申请"), ("动火作业", "危大工程", "配电室接电")),
)
# What of a file name behind the case name tells its role.
NAME_ROLES = (("worker_list", ("工人名单", "人员名单")), ("confined_space", ("有限空间",)), ("high_altitude", ("高处", "高空")))
TITLE, SHORT_TITLE, NUMBER_LABELS = "工程类主体质保施工", "主体质保施工", ("申请编号", "审批编号")
HAZARDS = (("有限空间", "confined_space"), ("高处", "high_altitude"), ("动火", "special_work"), ("危大工程", "special_work"), ("配电室", "special_work"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def option_is_checked(text: Column, option: str) -> Column:
    """The option, at most three separators or empty boxes, then a tick; or a word that says so."""
    t = normalize_match_text(text)
    ticked = rf"{one_of(BETWEEN)}{{0,{MOST_BETWEEN}}}{one_of(TICKS)}"
    return t.rlike(rf"\Q{option}\E(?:{ticked}|{one_of(BETWEEN[:2])}?(?:{'|'.join(SAID)}))")


def text_role(text: Column) -> Column:
    """The kind of evidence a recognised text is, by the first rule that holds; null if none does."""
    t = normalize_match_text(text)
    columns = F.lit(True)
    for word in LIST_COLUMNS:
        columns = columns & t.contains(word)
    role = None
    for name, words, options in TEXT_ROLES:
        rule = contains_any(t, words)
        for option in options:
            rule = rule | option_is_checked(text, option)
        rule = rule | columns if name == "worker_list" else rule
        role = F.when(rule, name) if role is None else role.when(rule, name)
    return role


def material_role(file: Column, case: Column) -> Column:
    """The role of a file whose stem begins with the case name, from what follows it."""
    rest = F.ltrim(F.substring(stem(file), F.length(case) + 1, F.lit(1 << 20)), F.lit("_"))
    role = F.when((rest == "") & suffix(file).isin(*IMAGES), "signed_application")
    for name, words in NAME_ROLES:
        role = role.when(contains_any(rest, words), name)
    return F.when(stem(file).startswith(case), role.when(rest != "", "special_work"))


def approval_kind(file: Column, text: Column) -> Column:
    """struct(is_approval, rule): the name's number, the name's title, the text's title, or a title with a number label."""
    return _approval(F.coalesce(_name_rule(file), _text_rule(normalize_match_text(text))))


def with_approval_kind(rows: DataFrame, file: Column, text: Column, name: str = "kind") -> DataFrame:
    """rows with approval_kind; each step is a projection of its own, so a text is normalised once, and only where the name tells nothing."""
    named = rows.withColumn("name_rule_", _name_rule(file))
    read = named.withColumn("match_text_", F.when(F.col("name_rule_").isNull(), normalize_match_text(text)))
    ruled = read.withColumn("rule_", F.coalesce("name_rule_", _text_rule(F.col("match_text_")))).drop("name_rule_", "match_text_")
    return ruled.withColumn(name, _approval(F.col("rule_"))).drop("rule_")


def with_text_rule(rows: DataFrame, text: Column, name: str = "text_rule") -> DataFrame:
    """rows with the rule by which a text alone is an approval's, null if none holds.

    A text is normalised once, and only if it has every character of the short title, which both titles hold; normalising brings none of them into being.
    """
    may = F.lit(True)
    for char in dict.fromkeys(SHORT_TITLE):
        may = may & text.contains(char)
    return rows.withColumn("match_text_", F.when(may, normalize_match_text(text))).withColumn(name, _text_rule(F.col("match_text_"))).drop("match_text_")


def approval_by(file: Column, text_rule: Column) -> Column:
    """approval_kind of a file whose text's rule is known."""
    return _approval(F.coalesce(_name_rule(file), text_rule))


def _name_rule(file: Column) -> Column:
    name = normalize_match_text(stem(file))
    return F.when(normalize_digits(file).rlike(APPROVAL_NAME), "name_number").when(name.contains(TITLE), "name_title")


def _text_rule(t: Column) -> Column:
    return F.when(t.contains(TITLE), "text_title").when(t.contains(SHORT_TITLE) & contains_any(t, NUMBER_LABELS), "text_title_and_number")


def _approval(rule: Column) -> Column:
    return F.struct(rule.isNotNull().alias("is_approval"), F.coalesce(rule, F.lit("none")).alias("rule"))


def required_roles(hazard: Column) -> Column:
    """The base roles and those that the hazard text implies, without repetition."""
    implied = [F.when(blank(hazard).contains(word), role) for word, role in HAZARDS]
    return F.array_distinct(F.array_compact(F.array(*[F.lit(r) for r in BASE_ROLES], *implied)))


def checkbox_state(tokens: Column, label: str, checked: str = CHECKED, stops: tuple[str, ...] = STOPS) -> Column:
    """yes, no or empty: of the first text token with the label, the next two symbols before a stop marker.

    tokens: array<struct<type, value>>, type text or sym. One walk whose state is a number: 0 looks for the label, 1 for the first symbol, 2 and 3
    for the second (the first wasn't or was checked); 4 is yes, 5 no and 6 neither.
    """

    def step(state: Column, t: Column) -> Column:
        text, symbol, on = t.type == "text", t.type == "sym", t.value == checked
        return (
            F.when(state >= 4, state)
            .when(state == 0, F.when(text & t.value.contains(label), 1).otherwise(0))
            .when(symbol, F.when(state == 3, 4).when(state == 1, F.when(on, 3).otherwise(2)).when(on, 5).otherwise(6))
            .when(text & contains_any(t.value, stops), 6)
            .otherwise(state)
        )

    return F.coalesce(F.aggregate(tokens, F.lit(0), step, lambda s: F.when(s == 4, "yes").when(s == 5, "no").otherwise("")), F.lit(""))


def selected_options(tokens: Column, options: tuple[str, ...] = WORK_TYPES, checked: str = CHECKED) -> Column:
    """The options, in their fixed order, whose next symbol comes before another option and is checked.

    One walk: an option is looked for only behind the place where the one before was found, so the state is the number of options found, whether the
    last of them waits for its symbol, and the checked ones as bits.
    """
    listed = F.array(*[F.lit(o) for o in options])
    start = F.struct(F.lit(0).alias("found"), F.lit(False).alias("waits"), F.lit(0).alias("bits"))

    def step(state: Column, t: Column) -> Column:
        text = t.type == "text"
        here = text & F.coalesce(F.contains(t.value, F.get(listed, state.found)), F.lit(False))
        told = (t.type == "sym") | (text & contains_any(t.value, options))
        on = state.waits & (t.type == "sym") & (t.value == checked)
        bits = F.when(on, state.bits.bitwiseOR(F.call_function("shiftleft", F.lit(1), state.found - 1))).otherwise(state.bits)
        return F.struct(F.when(here, state.found + 1).otherwise(state.found).alias("found"), (here | (state.waits & ~told)).alias("waits"), bits.alias("bits"))

    picked = lambda s: F.filter(listed, lambda _, i: s.bits.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    return F.aggregate(tokens, start, step, picked)


def hazard_review(implied: Column, present: Column) -> Column:
    """struct(missing, unexpected, verdict): roles that texts imply against roles on file."""
    missing, unexpected = F.array_except(implied, present), F.array_except(present, implied)
    verdict = F.when(F.size(missing) > 0, "missing").when(F.size(unexpected) == 0, "consistent").when(F.size(implied) == 0, "unexpected").otherwise("consistent_with_extras")
    return F.struct(missing.alias("missing"), unexpected.alias("unexpected"), verdict.alias("verdict"))
