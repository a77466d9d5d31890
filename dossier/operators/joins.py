"""Joins that link documents, files and cases."""

from __future__ import annotations

import difflib
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.dates import with_dates
from ..functions.text import labelled_field, normalize_match_text, normalize_ocr_text, ocr_form, split_name_list
from ..materialize import materialised, new_folder
from .ranks import rank_within

#: Characters of keys that are sent to every task at once.
AUTOMATON_CHARS = 4_000_000
#: Files and cases of a block of one date, and the most tasks that blocks are dealt to.
DATE_SIDE, DATE_TASKS = 2_000, 10_000
# Labels that end the content field, and the acceptance rule of fuzzy matches.
CONTENT_ENDS = ("施工负责人", "影响改动消防", "影响堵塞", "危险作业", "附件", "审批记录")
FUZZY_LEAST, FUZZY_LEAD = 0.60, 0.15


def _matched(sent):
    """(id, text) batches as (id, key): an automaton of all keys reads each text once."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        keys = sent.value
        automaton = ahocorasick.Automaton()
        for k, key in enumerate(keys):
            automaton.add_word(key, k)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                own = {k for _, k in automaton.iter(text)}
                rows += [r] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([keys[k] for k in hits], pa.string())], names=[batch.schema.names[0], "key"])

    return run


def containment_pairs(texts: DataFrame, id_col: str, text_col: str, keys: DataFrame, key_col: str, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(id_col, key) for each distinct non-empty key and each text that contains it; a null id, text or key matches nothing.

    Keys are sent to every task, which reads each text once and shuffles none. Keys of more than most_chars characters in all are dealt to
    shards by their hash, each of about so many; shards are sent in turn, and texts are read once for each. So neither driver nor task
    holds more than a shard, and no part of a key or text is a key of a shuffle that texts could have in common.
    """
    spark = texts.sparkSession
    keys = materialised(keys.select(F.col(key_col).alias("key")).where("key <> ''").distinct())
    rows = texts.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("text_")).where("text_ <> ''")
    schema = StructType([texts.schema[id_col], StructField("key", StringType())])
    chars = keys.agg(F.sum(F.length("key"))).first()[0]
    if not chars:
        return spark.createDataFrame([], schema)
    shards = -(-chars // most_chars)
    if shards == 1:
        return rows.mapInArrow(_matched(spark.sparkContext.broadcast([r.key for r in keys.collect()])), schema).distinct()
    rows, found = materialised(rows), new_folder(spark, "hits")
    for shard in range(shards):
        own = [r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).collect()]
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)
        rows.mapInArrow(_matched(sent), schema).write.mode("append").parquet(found)
        sent.destroy()
    return spark.read.schema(schema).parquet(found).distinct()


def _keys_in(own: list[tuple[str, str, object]], kept: list[str], every: bool):
    """Batches of texts as their kept columns with a key of each kind: one row for each combination of the keys that a row's texts hold.

    own: (text column, name of the key, the keys sent). The automata read each row's texts once. With every, a kind of which a row holds no key counts as null.
    """
    none = [None] if every else []

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        made = []
        for _, _, sent in own:
            automaton = ahocorasick.Automaton()
            for k, key in enumerate(sent.value):
                automaton.add_word(key, k)
            automaton.make_automaton()
            made.append((automaton, pa.array(sent.value, pa.string())))
        for batch in batches:
            rows, hits = [], [[] for _ in own]
            for r, texts in enumerate(zip(*[batch.column(text).to_pylist() for text, _, _ in own], strict=True)):
                found = [(sorted({k for _, k in automaton.iter(t)}) if t and len(keys) else []) or none for (automaton, keys), t in zip(made, texts, strict=True)]
                for combined in product(*found):
                    rows.append(r)
                    for column, k in zip(hits, combined, strict=True):
                        column.append(k)
            told = batch.select(kept).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*told.columns, *[keys.take(pa.array(h, pa.int64())) for (_, keys), h in zip(made, hits, strict=True)]], names=[*kept, *[name for _, name, _ in own]])

    return run


def with_held_keys(texts: DataFrame, id_col: str, held: list[tuple[str, DataFrame, str]], kept: list[str], most_chars: int = AUTOMATON_CHARS, every: bool = False) -> DataFrame:
    """(id_col, kept, the key columns): a row for each combination of keys that the texts of a row hold; held: (text column, keys, key column) for each kind.
    With every, no row is left out: of a kind of which it holds no key, the key is null.

    If all keys fit a task (see containment_pairs), texts are read once, neither written nor shuffled; else each kind is looked up by itself and joined by id.
    """
    spark, named = texts.sparkSession, F.col(id_col).isNotNull()
    texts = texts.withColumns({text: F.when(named, F.col(text)) for text, _, _ in held}) if every else texts.where(named)
    distinct = [materialised(keys.select(F.col(key).alias("key")).where("key <> ''").distinct()) for _, keys, key in held]
    chars = [keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0] for keys in distinct]
    columns = [id_col, *kept]
    schema = StructType([*[texts.schema[c] for c in columns], *[StructField(key, StringType()) for _, _, key in held]])
    if not all(chars) and not every:
        return spark.createDataFrame([], schema)
    if sum(chars) <= most_chars:
        own = [(text, key, spark.sparkContext.broadcast([r.key for r in keys.collect()])) for (text, _, key), keys in zip(held, distinct, strict=True)]
        return texts.select(*columns, *[text for text, _, _ in held]).mapInArrow(_keys_in(own, columns, every), schema)
    texts = materialised(texts)
    found = texts.select(*columns)
    for (text, _, key), keys in zip(held, distinct, strict=True):
        found = found.join(containment_pairs(texts, id_col, text, keys, "key", most_chars).withColumnRenamed("key", key), id_col, "left" if every else "inner")
    return found.select(*schema.names)


#: Cases that agree in these are one class: whatever document one of them is a candidate of, all are.
CLASS = ["area_key", "content_key", "start_date", "end_date"]


def case_classes(cases: DataFrame, tie: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(classes, members) of cases (case_id, which tells them apart, and CLASS); those with an empty key are left out.

    classes: class_id (the least case_id), CLASS, members (their number), first (the least by tie, then case_id: struct(tie, case_id));
    members: class_id, tie, case_id.
    """
    keyed = cases.where("area_key <> '' and content_key <> ''").select(F.col(tie).alias("tie"), "case_id", *CLASS)
    classes = materialised(keyed.groupBy(*CLASS).agg(F.min("case_id").alias("class_id"), F.count("*").alias("members"), F.min(F.struct("tie", "case_id")).alias("first")))
    named = classes.select("class_id", *[F.col(c).alias("class_" + c) for c in CLASS])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col("class_" + c)), CLASS, F.lit(True))
    return classes, materialised(keyed.join(named, same).select("class_id", "tie", "case_id"))


def document_keys(documents: DataFrame) -> DataFrame:
    """doc_id, text with the forms that containment compares, text_key and content_key, and with the text's dates."""
    keyed = documents.withColumn("t_", normalize_match_text(F.col("text"))).withColumn("text_key", ocr_form(F.col("t_")))
    return with_dates(keyed.withColumn("content_key", labelled_field(F.col("t_"), "施工内容", CONTENT_ENDS)).drop("t_"), "text")


def case_keys(cases: DataFrame) -> DataFrame:
    return cases.withColumn("area_key", normalize_ocr_text(F.col("area"))).withColumn("content_key", normalize_match_text(F.col("content")))


def strict_class_links(documents: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members): doc_id, class_id, members (the class's number of cases) of every match, and class_id, case_id of every case.

    Area in the text, content in the content field, and dates as labelled or both present. Documents meet classes by equality on keys and dates, so
    neither documents nor cases that are copies of each other multiply before the caller asks for pairs.
    """
    classes, members = case_classes(materialised(case_keys(cases).select("case_id", *CLASS)))
    return links_of_classes(documents, classes), members.select("class_id", "case_id")


def links_of_classes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The links of strict_class_links for classes that are at hand already, as of cases that several batches of documents meet."""
    dated = classes.where("start_date is not null and end_date is not null").select("class_id", "members", *CLASS)
    labelled = F.coalesce("labelled", F.lit(False))
    docs = document_keys(documents).select("doc_id", "text_key", F.col("content_key").alias("content_field"), labelled.alias("labelled"), "doc_start", "doc_end", F.when(~labelled, F.col("dates")).alias("dates"))
    found = with_held_keys(docs, "doc_id", [("text_key", dated, "area_key"), ("content_field", dated, "content_key")], ["labelled", "doc_start", "doc_end", "dates"])
    found = materialised(found)  # no text among it
    told = found.where("labelled").withColumns({"start_date": F.col("doc_start"), "end_date": F.col("doc_end")}).join(dated, CLASS)
    loose = found.where("not labelled").withColumn("start_date", F.explode(F.array_distinct("dates"))).join(dated, CLASS[:3]).where(F.array_contains("dates", F.col("end_date")))
    return told.select("doc_id", "class_id", "members").unionByName(loose.select("doc_id", "class_id", "members"))


def strict_containment_join(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """doc_id, case_id: area in the text, content in the content field, and dates as labelled or both present."""
    links, members = strict_class_links(documents, cases)
    return links.join(members, "class_id").select("doc_id", "case_id")


def longest_key_match(pairs: DataFrame, id_col: str) -> DataFrame:
    """The longest key of each document, the first in order among equals."""
    best = Window.partitionBy(id_col).orderBy(F.desc(F.length("key")), "key")
    return pairs.withColumn("n_", F.row_number().over(best)).where("n_ = 1").drop("n_")


def matched_name_list(pairs: DataFrame, id_col: str, order_col: str, name_col: str, separator: str = "；") -> DataFrame:
    """One row for each id: the names of its matches in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(name_col).alias("n"))))
    return pairs.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x.n), separator).alias("names"))


def class_sets(links: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, classes: the classes (class_id) of each id in order."""
    return materialised(links.groupBy(id_col).agg(F.array_sort(F.collect_set("class_id")).alias("classes")))


def matched_name_list_of_classes(links: DataFrame, id_col: str, members: DataFrame, order_col: str, name_col: str, separator: str = "；") -> DataFrame:
    """matched_name_list of links (id_col, class_id) and members (class_id, order_col, name_col): a list is made once for each set of classes."""
    sets = class_sets(links, id_col)
    each = sets.select("classes").distinct().withColumn("class_id", F.explode("classes")).join(members, "class_id")
    return sets.join(matched_name_list(each, "classes", order_col, name_col, separator), "classes").select(id_col, "names")


def unique_match_resolution(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, case_id (if there is exactly one), candidates, reason: linked, no_candidate or several_candidates.

    pairs: doc_id, case_id, or the links of strict_class_links, whose class_id is the only case where members is 1.
    """
    by_class = "members" in pairs.columns
    number, only = (F.sum("members"), F.min("class_id")) if by_class else (F.count("*"), F.min("case_id"))
    counts = pairs.groupBy("doc_id").agg(number.alias("candidates"), only.alias("only"))
    n = F.coalesce("candidates", F.lit(0))
    reason = F.when(n == 1, "linked").when(n == 0, "no_candidate").otherwise("several_candidates")
    return documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.when(n == 1, F.col("only")).alias("case_id"), n.cast("long").alias("candidates"), reason.alias("reason"))


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; order matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ratio_bound(a: Column | str, b: Column | str, a_chars: Column | str, b_chars: Column | str) -> Column:
    """At least the ratio of two texts: matched characters are common ones, counted with repetition. a_chars, b_chars: maps of characters to counts."""
    common = F.aggregate(F.map_entries(a_chars), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at(b_chars, e["key"]), F.lit(0))))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def _with_counts(texts: DataFrame, column: str) -> DataFrame:
    """texts (column) with chars, the map of their characters to counts."""
    chars = F.filter(F.split(column, ""), lambda c: c != "")
    return texts.withColumn("chars", F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.size(F.filter(chars, lambda x: x == c))))))


def _rated(pairs: DataFrame) -> DataFrame:
    """content_key, image, ratio for each distinct pair of texts."""
    return materialised(pairs.select("content_key", "image").distinct().withColumn("ratio", gestalt_ratio("content_key", "image")))


def fuzzy_margin_join(documents: DataFrame, cases: DataFrame, report: dict | None = None) -> DataFrame:
    """doc_id, case_id (if one is chosen), reason, best, runner_up.

    Candidates share area and dates. A content that contains the other is a ratio of 1: one such case is taken; of several
    the only one that lacks the role; otherwise the best ratio of at least FUZZY_LEAST that leads by FUZZY_LEAD.
    documents: doc_id, text, and role where it differs by document; cases: case_id, area, content, start_date, end_date, and role_missing, or missing
    (roles) where documents have a role. best is the best ratio, 0 below FUZZY_LEAST; runner_up the next one, 0 if it trails by FUZZY_LEAD or more
    (beside a contained content only other contained ones count).

    Ratios are worked out in Python for distinct pairs of contents that can matter only: not for documents with a contained content or whose
    bounds by common characters are all below FUZZY_LEAST, nor for pairs whose bound trails FUZZY_LEAST, or the ratio of the document's most
    promising case, by FUZZY_LEAD or more. report gets the numbers of distinct pairs and of those rated.
    """
    by_role = "role" in documents.columns
    keyed = case_keys(cases).where("content_key <> ''")
    lacking = "missing" if by_role else "role_missing"
    keyed = materialised(keyed.select("case_id", lacking, "area_key", "content_key", "start_date", "end_date"))
    docs = document_keys(documents).withColumnRenamed("content_key", "image")
    # no text among it but the content field; both branches below read it. Filtered behind the pass: a filter before it would have each text normalised again
    texts = with_held_keys(docs, "doc_id", [("text_key", keyed, "area_key")], ["labelled", "doc_start", "doc_end", "dates", "image", *(["role"] if by_role else [])])
    texts = materialised(texts.where("image <> ''"))
    # documents meet the cases of their area and dates only: labelled dates are joined on, of others each start and then the end
    told = texts.where("labelled").withColumns({"start_date": F.col("doc_start"), "end_date": F.col("doc_end")}).join(keyed, ["area_key", "start_date", "end_date"])
    loose = texts.where("not labelled").withColumn("start_date", F.explode("dates")).join(keyed, ["area_key", "start_date"]).where(F.array_contains("dates", F.col("end_date")))
    lacks = F.array_contains("missing", F.col("role")) if by_role else F.col("role_missing")
    columns = ["doc_id", "case_id", lacks.alias("role_missing"), "content_key", "image"]
    # a case whose area stands in a text twice, written differently, is one candidate
    exact = F.contains("image", "content_key") | F.contains("content_key", "image")
    found = materialised(told.select(*columns).unionByName(loose.select(*columns)).distinct().withColumn("exact", exact))
    settled = found.where("exact").select("doc_id").distinct()
    open_ = materialised(found.join(settled, "doc_id", "left_anti"))

    pairs = open_.select("content_key", "image").distinct()
    contents = _with_counts(pairs.select("content_key").distinct(), "content_key").withColumnRenamed("chars", "content_chars")
    images = _with_counts(pairs.select("image").distinct(), "image").withColumnRenamed("chars", "image_chars")
    bound = ratio_bound("content_key", "image", "content_chars", "image_chars")
    # a hair of room, as the bound and the ratio are rounded apart
    bounds = pairs.join(contents, "content_key").join(images, "image").select("content_key", "image", (bound + 1e-9).alias("bound"))
    hopeful = open_.join(bounds.where(F.col("bound") > FUZZY_LEAST - FUZZY_LEAD), ["content_key", "image"])
    hopeful = materialised(hopeful.join(hopeful.where(F.col("bound") >= FUZZY_LEAST).select("doc_id").distinct(), "doc_id", "left_semi"))
    first = _rated(hopeful.groupBy("doc_id").agg(F.max(F.struct("bound", "content_key", "image")).alias("m")).select("m.*"))
    reached = hopeful.join(first, ["content_key", "image"]).groupBy("doc_id").agg(F.max("ratio").alias("reached"))
    rest = hopeful.join(reached, "doc_id", "left").where(F.col("bound") > F.coalesce("reached", F.lit(0.0)) - FUZZY_LEAD).join(first, ["content_key", "image"], "left_anti")
    ratios = first.unionByName(_rated(rest))
    if report is not None:
        report["pairs"], report["rated"] = found.where("not exact").select("content_key", "image").distinct().count(), ratios.count()

    rated = found.join(ratios, ["content_key", "image"], "left")
    rated = rated.withColumn("ratio", F.when(F.col("exact"), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))))
    of = Window.partitionBy("doc_id")
    order = of.orderBy(F.desc("ratio"), F.desc("role_missing"), F.desc("case_id"))
    rated = rated.withColumn("n", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("ratio").over(order), F.lit(0.0)))
    rated = rated.withColumn("exact_n", F.count_if(F.col("exact")).over(of)).withColumn("lacking_n", F.count_if(F.col("exact") & F.col("role_missing")).over(of))
    best = F.when(F.col("ratio") >= FUZZY_LEAST, F.col("ratio")).otherwise(0.0)
    runner_up = F.when((F.col("best") > 0) & (F.col("best") - F.col("next") < FUZZY_LEAD), F.col("next")).otherwise(0.0)
    reason = (
        F.when(F.col("exact_n") == 1, "exact")
        .when((F.col("exact_n") > 1) & (F.col("lacking_n") == 1), "exact_only_missing")
        .when(F.col("exact_n") > 1, "several_exact")
        .when((F.col("best") > 0) & (F.col("best") - F.col("next") >= FUZZY_LEAD), "fuzzy")
        .otherwise("not_unique")
    )
    top = rated.where("n = 1").withColumn("best", best).withColumn("runner_up", runner_up).withColumn("reason", reason)
    chosen = F.when(F.col("reason").isin("exact", "exact_only_missing", "fuzzy"), F.col("case_id"))
    return top.select("doc_id", chosen.alias("case_id"), "reason", "best", "runner_up")


def prior_match_lookup(rows: DataFrame, prior: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their earlier match, rows without one); of a repeated key the last earlier row counts."""
    last = prior.groupBy(*keys).agg(F.max_by("names", "row_no").alias("names"))
    return rows.join(last, keys), rows.join(last, keys, "left_anti")


def recognized_text_lookup(files: DataFrame, recognized: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(files with text, files to recognise) by content hash; an empty text is a hit, another version or a null text isn't."""
    valid = recognized.where((F.col("version") == version) & F.col("text").isNotNull()).groupBy("sha256").agg(F.min("text").alias("text"))
    return files.join(valid, "sha256"), files.join(valid, "sha256", "left_anti")


def canonicalize_names(lists: DataFrame, names: DataFrame, number: Column, prefix: str) -> DataFrame:
    """row_id, names: each name of a list replaced by the one that stands for its number: the last canonical one, else the first seen.

    lists: row_id, names as split_name_list takes them; names: name, ord; number: a Column over ``name``; canonical names start with prefix.
    """
    known = names.withColumn("number", number).where("number <> ''").withColumn("canonical_", F.col("name").startswith(prefix))
    last = F.max_by(F.when(F.col("canonical_"), F.col("name")), F.when(F.col("canonical_"), F.col("ord")))
    standing = known.groupBy("number").agg(F.coalesce(last, F.min_by("name", "ord")).alias("stands"))
    each = lists.select("row_id", F.posexplode(split_name_list(F.col("names"))).alias("pos", "name")).withColumn("number", number)
    each = each.join(standing, "number", "left").withColumn("name", F.coalesce("stands", "name"))
    return matched_name_list(each, "row_id", "pos", "name")


def manual_override_join(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with target overwritten: by exact name first, then by normalised key; the first override wins.

    rows: row_id, name, name_key, target; overrides: ord, name, name_key, target.
    """
    o = overrides.select("ord", F.col("name").alias("o_name"), F.col("name_key").alias("o_key"), F.col("target").alias("o_target"))
    exact = rows.join(o, F.col("name") == F.col("o_name")).select("row_id", F.lit(0).alias("priority"), "ord", "o_target")
    keyed = rows.join(o, (F.col("name_key") == F.col("o_key")) & (F.col("name_key") != "")).select("row_id", F.lit(1).alias("priority"), "ord", "o_target")
    best = exact.unionByName(keyed).groupBy("row_id").agg(F.min_by("o_target", F.struct("priority", "ord")).alias("o_target"))
    return rows.join(best, "row_id", "left").withColumn("target", F.coalesce("o_target", "target")).drop("o_target")


def file_index_lookup(wanted: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """wanted (row_id, name) with path: the first file of that name, else of its stem with the first suffix that exists."""
    index = files.groupBy("name").agg(F.min("path").alias("path"))
    base = F.regexp_replace("name", r"\.[^.]+$", "")
    options = F.array(F.struct(F.lit(0).alias("p"), F.col("name").alias("n")), *[F.struct(F.lit(i + 1).alias("p"), F.concat(base, F.lit(s)).alias("n")) for i, s in enumerate(suffixes)])
    each = wanted.select("row_id", F.explode(options).alias("o")).select("row_id", "o.p", F.col("o.n").alias("name"))
    best = each.join(index, "name").groupBy("row_id").agg(F.min_by("path", "p").alias("path"))
    return wanted.join(best, "row_id", "left")


def duplicate_key_join(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming_id, case_id with equal dates, content and area; a missing member matches nothing."""
    def keyed(rows: DataFrame, name: str) -> DataFrame:
        area, content = normalize_match_text(F.col("area")), normalize_match_text(F.col("content"))
        return rows.select(F.col("case_id").alias(name), "start_date", "end_date", F.nullif(area, F.lit("")).alias("area_key"), F.nullif(content, F.lit("")).alias("content_key"))

    return keyed(incoming, "incoming_id").join(keyed(existing, "case_id"), ["start_date", "end_date", "area_key", "content_key"]).select("incoming_id", "case_id")


def stem_prefix_join(files: DataFrame, cases: DataFrame) -> DataFrame:
    """file_id, case_id, rest: the case whose name is the longest underscore prefix of the stem; each file once."""
    parts = F.split("stem", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    each = files.select("file_id", "stem", F.explode(prefixes).alias("case_name"))
    order = Window.partitionBy("file_id").orderBy(F.desc(F.length("case_name")), "case_id")
    best = each.join(cases.select("case_id", "case_name"), "case_name").withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("file_id", "case_id", F.ltrim(F.substring("stem", F.length("case_name") + 1, F.lit(1 << 20)), F.lit("_")).alias("rest"))


def date_pairs(files: DataFrame, cases: DataFrame, side: int = DATE_SIDE) -> DataFrame:
    """file_id, case_id of every file (file_id, file_date) and case (case_id, start_date) of its date.

    The pairs of a date are the product of its files and cases. Each date is cut into a grid of blocks of about side files and side cases, and blocks are
    dealt out by number, so no task makes the pairs of a whole date and what a block repeats is a small part of its pairs.
    """
    files, cases = materialised(files.select("file_id", "file_date")), materialised(cases.select("case_id", "start_date"))
    counted = lambda rows, day, name: rows.groupBy(F.col(day).alias("day")).agg(F.ceil(F.count("*") / side).cast("int").alias(name))
    grid = materialised(counted(files, "file_date", "across").join(counted(cases, "start_date", "down"), "day"))
    blocks = grid.agg(F.sum(F.col("across").cast("long") * F.col("down"))).first()[0] or 0
    width = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, DATE_TASKS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = files.select("file_id", F.col("file_date").alias("day")).join(grid, "day").withColumn("x", own("file_id", "across")).withColumn("y", every("down"))
    right = cases.select("case_id", F.col("start_date").alias("day")).join(grid, "day").withColumn("y", own("case_id", "down")).withColumn("x", every("across"))
    block = ["day", "x", "y"]
    return left.select("file_id", *block).repartition(width, *block).join(right.select("case_id", *block).repartition(width, *block), block).select("file_id", "case_id")


def prefix_or_date_join(files: DataFrame, prefixed: DataFrame, cases: DataFrame) -> DataFrame:
    """file_id, case_id, how: the prefix hits if there are any, else all cases that start on the file's date."""
    by_date = date_pairs(files.join(prefixed, "file_id", "left_anti"), cases)
    return prefixed.select("file_id", "case_id", F.lit("prefix").alias("how")).unionByName(by_date.select("file_id", "case_id", F.lit("date").alias("how")))


def ordinal_zip_join(files: DataFrame, cases: DataFrame) -> DataFrame:
    """batch, file_id, case_id: files and cases of a batch paired in order if there are as many of both; no task holds a batch."""
    counted = lambda rows, name: rows.groupBy("batch").agg(F.count("*").alias(name))
    even = materialised(counted(files, "n").join(counted(cases, "m"), "batch").where("n = m").select("batch"))
    left = rank_within(files.join(even, "batch", "left_semi").select("batch", "file_id"), ["batch"], ["file_id"], "rn")
    right = rank_within(cases.join(even, "batch", "left_semi").select("batch", "case_id"), ["batch"], ["case_id"], "rn")
    return left.join(right, ["batch", "rn"]).select("batch", "file_id", "case_id")


def identical_group_zip(files: DataFrame, cases: DataFrame) -> DataFrame:
    """batch, file_id, case_id: of a batch, the smallest content hash held by as many files as the batch has cases."""
    groups = files.groupBy("batch", "sha256").agg(F.count("*").alias("n"))
    pools = cases.groupBy("batch").agg(F.count("*").alias("m"))
    winner = groups.join(pools, "batch").where("n = m").groupBy("batch").agg(F.min("sha256").alias("sha256"))
    return ordinal_zip_join(files.join(winner, ["batch", "sha256"], "left_semi"), cases)


def replacement_only(incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """batch, replacement_only: every incoming record of the batch matches an existing case."""
    hit = matches.select(F.col("incoming_id").alias("case_id")).distinct().withColumn("hit", F.lit(True))
    return incoming.join(hit, "case_id", "left").groupBy("batch").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("replacement_only"))


def known_file_antijoin(files: DataFrame, hashes: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose content hash and path are both unknown; a null hash or path is never known."""
    return files.join(hashes.select("sha256").distinct(), "sha256", "left_anti").join(paths.select("path").distinct(), "path", "left_anti")


def inventory_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, difference: only_left, only_right or changed; path, size, sha256 on both sides."""
    a = left.select("path", F.struct("size", "sha256").alias("a"))
    b = right.select("path", F.struct("size", "sha256").alias("b"))
    kind = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", kind.alias("difference")).where("difference is not null")


def diff_samples(differences: DataFrame, k: int = 5) -> DataFrame:
    """The first k paths of each class of difference."""
    order = Window.partitionBy("difference").orderBy("path")
    return differences.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def link_integrity(links: DataFrame, inventory: DataFrame) -> DataFrame:
    """row_id, path, problem of links that leave the root or whose target isn't in the inventory."""
    from ..functions.text import leaves_root

    outside = links.where(leaves_root(F.col("path"))).select("row_id", "path", F.lit("outside").alias("problem"))
    inside = links.where(~leaves_root(F.col("path")))
    return outside.unionByName(inside.join(inventory.select("path").distinct(), "path", "left_anti").select("row_id", "path", F.lit("missing").alias("problem")))


def view_integrity(views: DataFrame, cases: DataFrame, expected: list[str]) -> DataFrame:
    """view, problem: expected views that lack rows, views nobody expects, and a whole view ("all") of another number of rows than cases.

    views: view, row_id; cases: case_id.
    """
    counts = views.groupBy("view").agg(F.count("*").alias("rows"))
    wanted = views.sparkSession.createDataFrame([(v,) for v in expected], "view string")
    missing = wanted.join(counts, "view", "left_anti").select("view", F.lit("view_missing").alias("problem"))
    unknown = counts.join(wanted, "view", "left_anti").select("view", F.lit("view_unexpected").alias("problem"))
    number = counts.where("view = 'all'").join(cases.agg(F.count("*").alias("cases")), F.col("rows") != F.col("cases")).select("view", F.lit("row_count_differs").alias("problem"))
    return missing.unionByName(unknown).unionByName(number)
