"""Texts are normalised and searched once, and give what the plain column functions give."""

from pyspark.sql import functions as F

from dossier.functions import classify, dates, ids


def test_date_ranges_by_steps(spark):
    texts = ["2024年5月1日~2024年5月9日", "2024.5.1至6.2", "2024/12/31 - 1/2", "2024年2月30日", "2024年5月7日", "２０２４年５月７日", "12024年5月1日~5月3日9", "", None, "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    told = dates.with_date_range(rows, "raw", "r")
    assert told.columns == ["i", "raw", "r"]
    got = {r.i: tuple(str(x) for x in r.r) for r in told.collect()}
    assert got[0] == ("2024-05-01", "2024-05-09", "9") and got[1] == ("2024-05-01", "2024-06-02", "33") and got[4] == got[5] == ("2024-05-07", "2024-05-07", "1")
    assert got[3] == got[7] == got[8] == got[9] == ("None", "None", "None")
    assert told.where(~F.col("r").eqNullSafe(dates.date_range(F.col("raw")))).isEmpty()


def test_approval_kind_by_steps(spark):
    rows = spark.createDataFrame([("工程类-主体质保施工_编号：123456789012.PDF", None), ("工程类主体质保施工 2.pdf", "x"), ("a.pdf", "工程类 主体质保施工"), ("a.pdf", "主体质保施工 申请编号：1"), ("a.pdf", "主体质保施工"), ("a.pdf", None), (None, None)], "file string, text string")
    told = classify.with_approval_kind(rows, F.col("file"), F.col("text"))
    assert told.columns == ["file", "text", "kind"]
    assert [r.kind.rule for r in told.collect()] == ["name_number", "name_title", "text_title", "text_title_and_number", "none", "none", "none"]
    assert told.where(F.col("kind") != classify.approval_kind(F.col("file"), F.col("text"))).isEmpty()


def test_application_numbers_by_steps(spark):
    title, n = "工程类-主体质保施工", "123456789012"
    names = [f"{title}_编号：{n}.pdf", "a.pdf", f"{n}.pdf", "编号 1234567890123.pdf", "", None]
    texts = [f"{title} 申请编号：2" + n[1:], f"工程类 -主体质保施工 申请 编号: {n}", f"{title} 申请编号：123", f"申请编号：{n}", "工程类—主体质保施工 申请编号：１２３４５６７８９０１２", "", None]
    rows = spark.createDataFrame([(f, t) for f in names for t in texts], "file string, body string")
    told = ids.with_application_no(rows, "file", "body")
    assert told.columns == ["file", "body", "application_no"]
    assert told.where(~F.col("application_no").eqNullSafe(ids.application_no(F.col("file"), F.col("body")))).isEmpty()
    assert {r.application_no for r in told.collect()} >= {n, "2" + n[1:], ""}


def test_other_dates_are_searched_where_a_text_has_no_labelled_ones(spark):
    texts = ["施工开始时间：2024年5月1日 施工结束时间：2024年5月9日", "施工开始时间：2024年5月1日 2024-05-09", None]
    told = dates.with_dates(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert [r.labelled for r in told] == [True, False, False]
    assert told[0].dates is None and [str(d) for d in told[1].dates] == ["2024-05-01", "2024-05-09"] and told[2].dates == []


def test_rules_of_texts_are_read_once_for_a_stream(spark, tmp_path):
    from dossier.streaming import intake

    texts = [("h1", "v", "工程类主体 质保\n施工"), ("h2", "v", "主体质保施工 申请编号：1"), ("h3", "v", "主体质保施工"), ("h4", "old", "工程类主体质保施工"), ("h5", "v", None), ("h6", "v", "b"), ("h6", "v", "工程类主体质保施工"), ("h7", "v", "工程类主体质保施工"), ("h7", "v", "工程类主体质保施工 x")]
    recognized = spark.createDataFrame(texts, "sha256 string, version string, text string")
    told = intake.text_rules(recognized, "v")
    assert sorted((r.sha256, r.text_rule) for r in told.collect()) == [("h1", "text_title"), ("h2", "text_title_and_number"), ("h3", None), ("h6", None), ("h7", "text_title")]
    assert TITLES == [(r.rule or "none") for r in classify.with_text_rule(recognized.where("sha256 in ('h1', 'h2', 'h3')").orderBy("sha256"), F.col("text"), "rule").collect()]

    folder = str(tmp_path / "recognized")
    recognized.write.parquet(folder)
    work = intake.route_work(f"file://{tmp_path}/store", spark.createDataFrame([], "name string, sha256 string"), spark.read.schema(recognized.schema).parquet(folder), "v")
    files = spark.createDataFrame([(1, 1, "x.pdf", "h1"), (2, 1, "y.pdf", "h3"), (3, 1, "z.pdf", "none"), (4, 1, "m.jpg", "h2")], "file_id long, batch long, name string, sha256 string")
    made = work(files, 0)
    assert sorted((r.file_id, r.kind, r.reason, r.method) for r in made["routes"].collect()) == [(1, "approval", "text_title", "text"), (2, "material", "none", "text"), (3, "material", "none", "text"), (4, "material", "material", "")]
    for table in made.values():
        assert folder not in str(table.inputFiles())
        assert "text#" not in table._jdf.queryExecution().optimizedPlan().toString()


TITLES = ["text_title", "text_title_and_number", "none"]
