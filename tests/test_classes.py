"""Cases and documents that are copies meet once, by class, and give what pairs would give."""

import datetime
import os
import re

from pyspark.sql import functions as F

from dossier.materialize import shared_folder
from dossier.operators import joins as J
from dossier.operators import review as R
from dossier.plans import pipelines as P

DAY = datetime.date(2024, 5, 1)
CASES = "case_id long, case_name string, area string, content string, start_date date, end_date date"


def rows(spark):
    def text(start):
        return f"施工区域：A1 施工开始时间：2024年5月{start}日 施工结束时间：2024年5月9日 施工内容：paint及清理 施工负责人：甲"

    copies = [(i, f"n{i}", "A1", "paint", DAY, DAY.replace(day=9)) for i in range(1, 6)]
    others = [(6, "n6", "A1", "paint", DAY.replace(day=3), DAY.replace(day=9)), (7, "n7", "A1", "paint", None, None), (8, "n8", "B2", "paint", DAY, DAY)]
    docs = [(d, text(1 if d < 4 else 3)) for d in range(1, 7)] + [(7, "A1 2024-05-01 2024-05-09 施工内容：paint"), (8, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(copies + others, CASES)


def got(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_strict_links_name_classes_once(spark):
    docs, cases = rows(spark)
    links, members = J.strict_class_links(docs, cases)
    assert got(links, "doc_id", "class_id", "members") == [(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 6, 1), (5, 6, 1), (6, 6, 1), (7, 1, 5)]
    pairs = J.strict_containment_join(docs, cases)
    assert got(pairs, "doc_id", "case_id") == sorted([(d, c) for d in (1, 2, 3, 7) for c in range(1, 6)] + [(d, 6) for d in (4, 5, 6)])
    assert got(J.unique_match_resolution(docs, links), "doc_id", "candidates", "reason") == got(J.unique_match_resolution(docs, pairs), "doc_id", "candidates", "reason")


def test_best_candidates_equal_those_of_pairs(spark):
    docs, cases = rows(spark)
    gone = [(1, 1), (1, 2), (2, 3), (4, 6), (4, 1), (5, 8), (6, 99), *[(3, c) for c in range(1, 8)]]
    for rejected in (None, spark.createDataFrame(gone, "doc_id long, case_id long")):
        best, flags = R.best_candidates(docs, cases, rejected)
        want = R.top_candidate(R.relaxed_candidates(docs, cases, rejected)[0])
        assert got(best.na.fill(-1), *want.columns) == got(want.na.fill(-1), *want.columns)
        named, _ = R.best_candidates(docs, cases, rejected, "case_name")
        assert got(named, "doc_id", "case_name") == got(want, "doc_id", F.concat(F.lit("n"), F.col("case_id").cast("string")))
    assert got(best, "doc_id", "case_id", "candidates")[:3] == [(1, 3, 5), (2, 1, 6), (4, 2, 5)]
    assert {(r.doc_id, r.strict) for r in flags.collect()} >= {(1, 7), (8, 0)}


def test_a_rule_rejects_what_its_table_does(spark):
    docs, cases = rows(spark)
    pairs, _ = R.relaxed_candidates(docs, cases)
    rule = (F.col("doc_id") + F.col("case_id")) % 3 == 0
    assert got(R.relaxed_candidates(docs, cases, rule)[0], "doc_id", "case_id") == got(R.relaxed_candidates(docs, cases, pairs.where(rule))[0], "doc_id", "case_id")


def test_excluded_pairs_by_their_ids_and_by_review_id(spark):
    docs, cases = rows(spark)
    docs = docs.withColumn("doc_id", F.concat(F.lit("h"), F.col("doc_id").cast("string")))
    told = spark.createDataFrame([("h1", 2, "exclude"), ("h2", 3, "confirm"), ("h4", 6, "exclude")], "sha256 string, case_id long, decision string")
    told = told.withColumn("review_id", R.review_id(F.col("sha256"), F.col("case_id")))
    mixed = told.withColumn("sha256", F.when(F.col("case_id") == 2, F.col("sha256")))
    for history in (told, told.select("review_id", "decision"), mixed):
        assert got(R.excluded_pairs(docs, cases, history), "doc_id", "case_id") == [("h1", 2), ("h4", 6)]


def test_names_are_listed_once_for_a_set_of_classes(spark):
    docs, cases = rows(spark)
    links, members = R.relaxed_classes(docs, cases)
    assert links.count() == 7 and members.count() == 8
    listed = J.matched_name_list_of_classes(links, "doc_id", members.withColumn("name", F.col("case_id").cast("string")), "case_id", "name")
    pairs = R.relaxed_candidates(docs, cases)[0].withColumn("name", F.col("case_id").cast("string"))
    assert got(listed, "doc_id", "names") == got(J.matched_name_list(pairs, "doc_id", "case_id", "name"), "doc_id", "names")


def test_what_patterns_and_classes_give_is_not_shuffled_by_confidence(spark):
    day = F.expr("date_add(date'2024-01-01', cast(id % 90 as int))")
    cases = spark.range(90).select(F.col("id").alias("case_id"), F.lit("A1").alias("area"), F.lit("paint").alias("content"), day.alias("start_date"), F.expr("date_add(date'2024-06-01', cast(id % 7 as int))").alias("end_date"))
    told = F.date_format(day, "yyyy年M月d日")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("施工区域：A1 施工开始时间："), told, F.lit(" 施工结束时间：2024年6月4日 施工内容：paint 施工负责人：甲")).alias("text"))
    best, _ = R.best_candidates(docs, cases)
    # neither levels of confidence nor rated rows are keys or values of a shuffle
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*confidence", best._jdf.queryExecution().executedPlan().toString())
    want = R.top_candidate(R.relaxed_candidates(docs, cases)[0])
    assert got(best.na.fill(-1), *want.columns) == got(want.na.fill(-1), *want.columns)


def test_a_cell_is_dealt_out_in_blocks(spark):
    classes = spark.range(30).selectExpr("0L as cell_id", "id as number", "if(id % 4 = 0, 2L, 1L) as members", "struct(id as tie, id as case_id) as first", "date_add(date'2024-01-01', cast(id % 12 as int)) as start_date", "date'2024-02-01' as end_date")
    asked = spark.range(25).selectExpr("id as pattern_id", "0L as cell_id", "if(id = 9, null, date_add(date'2024-01-01', cast(id as int))) as doc_start", "date'2024-02-02' as doc_end", "if(id = 24, sequence(0L, 29L), array(id)) as out")
    whole, blocks = (R._best_two(asked, classes, ["pattern_id"], side) for side in (1000, 3))
    columns = ["pattern_id", "best", "runner_up", "candidates"]
    assert got(whole, *columns) == got(blocks, *columns) and whole.count() == 24
    pairs = R._with_confidence(asked.join(classes, "cell_id").where("not array_contains(out, number)"))
    for p in (0, 5, 9, 23):
        rows = sorted((-r.confidence, r.number, r.members) for r in pairs.where(F.col("pattern_id") == p).collect())
        each = [c for c, _, n in rows for _ in range(n)]
        r = whole.where(F.col("pattern_id") == p).first()
        assert (r.best.lead, r.best.first.case_id, r.runner_up, r.candidates) == (rows[0][0], rows[0][1], -each[1], len(each))


def test_review_goes_by_numbers_and_leaves_few_tables(spark):
    docs, cases = rows(spark)
    files = docs.where("text is not null").select(F.concat(F.lit("_inbox/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.sha2("text", 256).alias("sha256"), "text")
    files = files.unionByName(spark.createDataFrame([("_inbox/9", "9.pdf", "odd", "nothing")], files.schema))
    first, third = (files.where(f"path = '_inbox/{i}'").first().sha256 for i in (1, 4))
    told = spark.createDataFrame([(first, 1, "exclude"), (first, 2, "exclude"), (third, 6, "exclude")], "sha256 string, case_id long, decision string")
    history = told.withColumn("review_id", R.review_id(F.col("sha256"), F.col("case_id")))
    previous = spark.createDataFrame([(first, 3), (first, 1), (third, 5)], "sha256 string, case_id long").withColumn("review_id", R.review_id(F.col("sha256"), F.col("case_id"))).withColumns({"decision": F.lit("confirm"), "note": F.col("case_id").cast("string")}).drop("case_id")
    previous = previous.unionByName(spark.createDataFrame([("odd", "x", "trash", "seen")], "sha256 string, review_id string, decision string, note string"))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = P.build_review(files, cases, history, previous)
    assert got(found, "path", "case_id", "decision", "note") == [("_inbox/1", 3, "confirm", "3"), ("_inbox/4", 1, "pending", ""), ("_inbox/7", 1, "pending", ""), ("_inbox/9", None, "trash", "seen")]
    assert got(found.where("path = '_inbox/1'"), "review_id") == got(previous.where("note = '3'"), "review_id")
    assert got(found.where("path = '_inbox/9'"), "reason", "sha256") == [("no_content_match", "odd")]
    # the contents, the proposals, the flags and the earlier decisions
    assert len(set(os.listdir(folder)) - before) == 4
    assert not re.search(r"hashpartitioning\([^)]*(sha256|review_id)", found._jdf.queryExecution().executedPlan().toString())
