"""Steps that several queries share: cases as Spark reads them, keys found in one pass."""

from pyspark.sql import functions as F


def test_cases_are_the_views_rows_and_shuffle_line_items_once(spark):
    from dossier.views import VIEWS, views

    (own,) = views(spark, "/root/testdata/sf0.001", "v_cases")
    stated = spark.sql(VIEWS["v_cases"])
    assert own.columns == stated.columns and own.count() == stated.count() > 0
    assert own.exceptAll(stated).isEmpty() and stated.exceptAll(own).isEmpty()
    scans = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#") and rows._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#")
    assert scans(own) < scans(stated)


def test_several_views_of_cases_start_from_cases_worked_out_once(spark):
    from dossier.views import views

    for rows in views(spark, "/root/testdata/sf0.001", "v_approvals", "v_cases"):
        assert "l_orderkey" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_held_keys_are_found_in_one_pass_without_a_shuffle(spark):
    from dossier.operators.joins import with_held_keys

    texts = spark.createDataFrame([(1, "north hall", "paint wall"), (2, "north", None), (3, "hall", "wall"), (None, "north", "wall"), (4, "", "wall")], "doc_id long, place string, work string")
    areas = spark.createDataFrame([("north",), ("hall",), ("",), (None,), ("north",)], "a string")
    contents = spark.createDataFrame([("paint",), ("wall",), ("all",)], "c string")
    ask = lambda **x: with_held_keys(texts, "doc_id", [("place", areas, "a"), ("work", contents, "c")], [], **x)
    expected = {(1, a, c) for a in ("north", "hall") for c in ("paint", "wall", "all")} | {(3, "hall", "wall"), (3, "hall", "all")}
    found = [tuple(r) for r in ask().collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert "Exchange" not in ask()._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in ask(most_chars=6).collect()} == expected
    none = with_held_keys(texts, "doc_id", [("place", areas.where(F.lit(False)), "a"), ("work", contents, "c")], [])
    assert none.isEmpty() and none.columns == ["doc_id", "a", "c"]


def test_held_keys_of_every_row(spark):
    from dossier.operators.joins import with_held_keys

    texts = spark.createDataFrame([(1, "north hall", "paint"), (2, "north", None), (3, "x", "paint"), (None, "north", "paint"), (5, "", "x")], "doc_id long, place string, work string")
    areas, contents = spark.createDataFrame([("north",), ("hall",), ("",)], "a string"), spark.createDataFrame([("paint",)], "c string")
    ask = lambda c=contents, **x: {tuple(r) for r in with_held_keys(texts, "doc_id", [("place", areas, "a"), ("work", c, "c")], [], every=True, **x).collect()}
    expected = {(1, "north", "paint"), (1, "hall", "paint"), (2, "north", None), (3, None, "paint"), (None, None, None), (5, None, None)}
    assert ask() == ask(most_chars=6) == expected
    assert ask(contents.where("false")) == {(i, a, None) for i, a, _ in expected}


def test_candidates_write_no_text(spark, monkeypatch):
    """Documents' texts are read where their keys are found; only keys and dates are written."""
    from dossier import materialize
    from dossier.operators import joins, review

    written = []
    monkeypatch.setattr(joins, "materialised", lambda t: written.append(t.columns) or materialize.materialised(t))
    monkeypatch.setattr(review, "materialised", lambda t: written.append(t.columns) or materialize.materialised(t))
    text = "施工区域：north 施工开始时间：2024年5月1日 施工结束时间：2024年5月2日 施工内容：paint及清理 施工负责人：甲"
    docs = spark.createDataFrame([(1, text), (2, "施工内容：paint 施工负责人：甲"), (3, "north"), (4, None)], "doc_id long, text string")
    cases = spark.sql("select 7L as case_id, 'north' as area, 'paint' as content, date'2024-05-01' as start_date, date'2024-05-03' as end_date")
    pairs, flags = review.relaxed_candidates(docs, cases)
    assert [tuple(r) for r in pairs.select("doc_id", "case_id", "start_delta", "end_delta").collect()] == [(1, 7, 0, 1)]
    assert sorted(tuple(r) for r in flags.select("doc_id", "any_area", "any_content", "strict").collect()) == [(1, True, True, 1), (2, False, True, 0), (3, True, False, 0), (4, False, False, 0)]
    assert written and not {"text_key", "content_field", "text_", "text"} & {c for columns in written for c in columns}


def test_settled_keeps_what_is_given_only(spark):
    import os

    from dossier.materialize import materialised, settled, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("table-")}
    before = tables()

    def inner():
        first = materialised(spark.range(10))
        return first.where("id > 6"), materialised(first.groupBy((F.col("id") % 2).alias("k")).count())

    def work():
        rest, counts = settled(inner)
        return {"rest": rest, "n": rest.join(counts, rest.id == F.col("count"), "left")}

    told = settled(work)
    assert len(tables() - before) == 2
    assert sorted(r.id for r in told["rest"].collect()) == [7, 8, 9] and told["n"].count() == 3
