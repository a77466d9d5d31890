"""Rules on literal cases."""

import datetime
import hashlib
import random
import uuid

from pyspark.sql import functions as F

from dossier.functions import classify, dates, ids, text
from dossier.operators import evidence as E
from dossier.operators import joins as J
from dossier.operators import review as R
from dossier.plans import pipelines as P
from dossier.sources import files as S


def values(spark, column, *rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("t"))).collect()]


def test_match_text(spark):
    assert values(spark, text.normalize_match_text, " L3 －（a，B、c）　", None, "") == ["l3~(a,b,c)", "", ""]
    assert values(spark, text.normalize_ocr_text, "i3M1层", "i5i6", "hi5") == ["l3m1层", "l5l6", "hi5"]
    assert values(spark, text.split_name_list, "a，b; ;c", '["x", " y "]', "") == [["a", "b", "c"], ["x", "y"], []]
    assert values(spark, text.split_name_list, "[a, b]", "['it''s', \"x, y\", z]", "[]") == [["a", "b"], ["it's", "x, y", "z"], []]
    assert values(spark, text.leaves_root, "a/../b", "../b", "/a", "a\\..\\..\\b") == [False, True, True, True]


def test_dates(spark):
    assert values(spark, lambda c: dates.date_range(c).days, "2026年7月4日～7月6日", "2026.7.4", "2026年2月30日", "none") == [3, 1, None, None]
    assert values(spark, dates.date_token, "2026-7-4", "x20260704", "2026-2-30") == [datetime.date(2026, 7, 4), datetime.date(2026, 7, 4), None]


def test_checked_options(spark):
    assert values(spark, lambda c: classify.option_is_checked(c, "有限空间作业"), "有限空间作业☑", "有限空间作业□√", "有限空间作业□ 高处☑", "有限空间作业：已勾选") == [True, True, False, True]
    assert values(spark, classify.text_role, "高空作业☒", "高空作业申请", "5米以上高空作业☒", "动火作业：已勾选", "质保作业申请单", "") == [None, "high_altitude", "high_altitude", "special_work", "signed_application", None]


def test_box_states(spark):
    """Each letter is a token: L the label, S a stop, w another word, 1 a checked symbol, 0 another, n a symbol without value, - null."""
    tokens = {"L": ("text", "一、影响"), "S": ("text", "二、其他"), "w": ("text", "是"), "1": ("sym", classify.CHECKED), "0": ("sym", "00A3"), "n": ("sym", None), "-": None}
    cases = {"L10": "yes", "L01": "no", "L00": "", "Lw1w0": "yes", "11L01": "no", "L1S0": "", "L1": "", "LS10": "", "w10": "", "": "", "L011": "no", "L001": "", "L11": "yes", "Ln1": "no", "L-1-0": "yes", "L0L1": ""}
    rows = [(k, [tokens[x] for x in k]) for k in cases] + [("none", None)]
    frame = spark.createDataFrame(rows, "k string, t array<struct<type: string, value: string>>")
    assert {r.k: r.s for r in frame.select("k", classify.checkbox_state(F.col("t"), "一、影响").alias("s")).collect()} == {**cases, "none": ""}


def test_uuid5(spark):
    names = ["", "a", "维修冷塔", "x" * 300]
    assert values(spark, ids.uuid5, *names) == [str(uuid.uuid5(ids.NAMESPACE, n)) for n in names]


def test_confidence(spark):
    approvals = spark.createDataFrame([(1, "施工区域：A区 施工开始时间：2026年7月25日 施工结束时间：2026年7月26日 施工内容：维修冷塔及清理 施工负责人：甲")], "doc_id long, text string")
    d = datetime.date
    rows = [(1, "A区", "维修冷塔", d(2026, 7, 24), d(2026, 7, 26)), (2, "A区", "维修冷塔", d(2025, 1, 1), d(2025, 1, 2)), (3, "B区", "维修冷塔", d(2026, 7, 25), d(2026, 7, 26))]
    cases = spark.createDataFrame(rows, "case_id long, area string, content string, start_date date, end_date date")
    best = R.build_review(approvals, cases).first()
    assert (best.case_id, best.candidate_confidence, best.runner_up, best.gap, best.candidates) == (1, 98, 80, 18, 2)
    assert R.build_review(approvals, cases.where("case_id = 3")).first().reason == "no_area_match"


def test_fuzzy_margin(spark):
    form = "施工区域：A区 施工开始时间：2026年7月24日 施工结束时间：2026年7月24日 施工内容：{} 施工负责人：甲"
    docs = spark.createDataFrame([(1, form.format("维修水塔"))], "doc_id long, text string")
    day = datetime.date(2026, 7, 24)
    make = lambda *contents: spark.createDataFrame([(i, "A区", c, day, day, True) for i, c in enumerate(contents)], "case_id long, area string, content string, start_date date, end_date date, role_missing boolean")
    one = J.fuzzy_margin_join(docs, make("维修冷塔")).first()
    assert (one.case_id, one.reason, one.best) == (0, "fuzzy", 0.75)
    assert J.fuzzy_margin_join(docs, make("维修冷塔", "维修热塔")).first().reason == "not_unique"


def test_zip_needs_equal_counts(spark):
    files = spark.createDataFrame([("b", i, "h") for i in range(4)], "batch string, file_id long, sha256 string")
    cases = spark.createDataFrame([("b", 10 + i) for i in range(4)], "batch string, case_id long")
    assert J.identical_group_zip(files, cases).count() == 4
    assert J.identical_group_zip(files, cases.where("case_id < 13")).count() == 0


def test_next_free_suffix_skips_taken(spark):
    new = spark.createDataFrame([(i, "n") for i in range(4)], "row_id long, base string")
    taken = spark.createDataFrame([("n",), ("n_03",)], "name string")
    assert [r.name for r in E.next_free_suffix(new, taken).orderBy("row_id").collect()] == ["n_02", "n_04", "n_05", "n_06"]


def test_containment_equals_nested_loop(spark):
    texts = spark.createDataFrame([(1, "cold ring saw"), (2, "old rin"), (3, ""), (4, "éé ab")], "id long, text string")
    keys = spark.createDataFrame([("old ring",), ("ab",), ("",), ("é",), ("ring saw",)], "key string")
    found = {tuple(r) for r in J.containment_pairs(texts, "id", "text", keys, "key").collect()}
    assert found == {(1, "old ring"), (1, "ring saw"), (4, "ab"), (4, "é")}
    # more keys than are sent at once: shards in turn
    assert {tuple(r) for r in J.containment_pairs(texts, "id", "text", keys, "key", most_chars=6).collect()} == found


def test_last_canonical_name_stands(spark):
    lists = spark.createDataFrame([(1, "a 1；b 2；c")], "row_id long, names string")
    names = spark.createDataFrame([("a 1", 1), ("k 1", 2), ("k x1", 3), ("b 2", 4), ("d 2", 5)], "name string, ord int")
    found = J.canonicalize_names(lists, names, F.regexp_extract("name", r"(\d)$", 1), "k").first()
    assert found.names == "k x1；b 2；c"


def test_list_gate(spark):
    rows = [("a", "form", False), ("a", "list", False), ("b", "form", True), ("c", "form", False), ("d", "form", True), ("d", "list", True), ("d", "list", True), ("e", "other", False)]
    gate = {r.batch: r.accepted for r in E.batch_count_gate(spark.createDataFrame(rows, "batch string, kind string, replaces boolean")).collect()}
    assert gate == {"a": True, "b": True, "c": False, "d": False, "e": True}


def test_images_go_to_batch_content_and_similar_case(spark):
    form = "施工区域：A区 施工开始时间：2026年7月24日 施工结束时间：2026年7月24日 施工内容：{} 施工负责人：甲"
    images = spark.createDataFrame([(1, "b1", "anything"), (2, "b2", "新建水管 现场"), (3, None, form.format("维修水塔")), (4, None, "nothing")], "doc_id long, batch string, text string")
    day = datetime.date(2026, 7, 24)
    cases = spark.createDataFrame([(10, "A区", "维修冷塔", day, day, True)], "case_id long, area string, content string, start_date date, end_date date, role_missing boolean")
    batch = spark.createDataFrame([("b1", 20), ("b2", 21), ("b2", 22)], "batch string, case_id long")
    created = spark.createDataFrame([(30, "新建水管"), (31, "x")], "case_id long, content string")
    found = {(r.doc_id, r.case_id, r.stage) for r in P.assign_images(images, batch, created.where("case_id = 30"), cases).collect()}
    assert found == {(1, 20, "batch"), (2, 30, "content"), (3, 10, "fuzzy")}


def test_recent_images_are_named_after_their_case(spark):
    day = datetime.date(2026, 7, 24)
    cases = spark.createDataFrame([(1, "n1", "冷塔", day), (2, "n2", "维修冷塔", day), (3, "n3", "老塔", datetime.date(2020, 1, 1))], "case_id long, case_name string, content string, start_date date")
    images = spark.createDataFrame([(1, "x.JPG", "维修冷塔"), (2, "y.jpg", "维修冷塔 工人名单"), (3, "z.jpg", "老塔"), (4, "w.jpg", "工人名单")], "doc_id long, name string, text string")
    found = {r.doc_id: (r.case_id, r.target, r.action) for r in P.rename_images(images, cases, F.lit("2026-07-24").cast("date")).collect()}
    assert found == {1: (2, "n2.jpg", "rename"), 2: (2, "n2_工人名单.jpg", "rename"), 3: (None, None, "unmatched"), 4: (None, "w_工人名单.jpg", "rename")}


def test_ratio_equals_difflib_on_long_texts(spark):
    import difflib
    import random

    r = random.Random(2)
    pairs = [("".join(r.choice("abcd ") for _ in range(n)), "".join(r.choice("abcd ") for _ in range(n + 20))) for n in (0, 5, 150, 250, 400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = [x.ratio for x in rows.select("i", J.gestalt_ratio("a", "b").alias("ratio")).orderBy("i").collect()]
    assert found == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_blank_approval_fields_are_filled(spark):
    cases = spark.createDataFrame([(1, "", "x"), (2, "12", ""), (3, "13", "y")], "case_id long, number string, source string")
    keep = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "case_id long, keep_id long")
    found = {r.case_id: (r.number, r.source) for r in E.filled_approvals(cases, keep, ["number", "source"]).collect()}
    assert found == {1: ("12", "x"), 3: ("13", "y")}


def test_sharded_keys_have_no_hot_task(spark):
    """A gram that every text and key has is no key of any shuffle: texts are read where they are, once for each shard."""
    texts = spark.range(4000).repartition(8).selectExpr("id", "concat('common ', id, ' common ', id % 7) as text")
    keys = spark.range(300).selectExpr("concat('common ', id * 13) as key")
    want = {(i, f"common {k * 13}") for i in range(4000) for k in range(300) if f"common {k * 13}" in f"common {i} common {i % 7}"}
    assert {tuple(r) for r in J.containment_pairs(texts, "id", "text", keys, "key", most_chars=1000).collect()} == want


def test_free_names_of_hot_and_other_bases(spark, monkeypatch):
    r = random.Random(3)
    new = [(i, f"b{r.randrange(3) if i % 4 else 0}") for i in range(300)]
    taken = sorted({f"b{r.randrange(4)}" + (f"_{r.randrange(2, 90):02d}" if r.random() < 0.9 else "") for _ in range(80)})
    want, used = {}, set(taken)
    for i, base in new:
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base}_{n:02d}"
        used.add(name)
        want[i] = name
    frames = spark.createDataFrame(new, "row_id long, base string"), spark.createDataFrame([(x,) for x in taken], "name string")
    for most in (10**6, 150, 0):
        monkeypatch.setattr(E, "HOT_BASE", most)
        assert {x.row_id: x.name for x in E.next_free_suffix(*frames).collect()} == want


def test_scan_hashes_files_of_any_size(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    files = {"x.DOCX": b"one", "~$x.docx": b"temporary", "y.txt": b"other", "a/z.docx": b"", "a/b/w.jpg": b"deep" * 1_000_000, "a/b/~$t.jpg": b"t"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    big = tmp_path / "a" / "big.docx"
    with open(big, "wb") as out:
        out.truncate((1 << 31) + 5)
    scan = lambda *a, **k: {r.name: (r.size, r.sha256) for r in S.scan_evidence_files(spark, *a, **k).collect()}
    digest = lambda b: (len(b), hashlib.sha256(b).hexdigest())
    assert scan(str(tmp_path), (".docx", ".jpg")) == {"x.DOCX": digest(b"one")}
    zeros = hashlib.sha256()
    for _ in range(1 << 11):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    assert scan(f"file://{tmp_path}", (".docx", ".jpg"), recursive=True) == {"x.DOCX": digest(b"one"), "z.docx": digest(b""), "w.jpg": digest(b"deep" * 1_000_000), "big.docx": ((1 << 31) + 5, zeros.hexdigest())}
    assert set(scan(str(tmp_path))) == {"x.DOCX", "y.txt"} and scan(str(tmp_path / "nowhere")) == {}
    (row,) = S.scan_evidence_files(spark, str(tmp_path), (".txt",)).collect()
    assert abs(row.modified.timestamp() - (tmp_path / "y.txt").stat().st_mtime) < 1 and row.path.endswith("/y.txt")


def test_no_single_batch_means_content_or_similarity(spark):
    """assign_images against plain rules on whole tables: the only case of the batch, else the only content that the text holds."""
    from dossier.functions.text import normalize_match_text
    from dossier.queries_link import _perturbed

    docs, cases = _perturbed(spark, "/root/testdata/sf0.001")
    images = docs.withColumn("batch", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    batch = (F.col("case_id") - F.when(F.col("case_id") % 3 == 0, 0).otherwise(F.col("case_id") % 2)).alias("batch")
    batches, created = cases.select(batch, "case_id"), cases.select("case_id", "content")
    got = {(x.doc_id, x.case_id, x.stage) for x in P.assign_images(images, batches, created, cases).collect()}
    members, contents = {}, {}
    for x in batches.collect():
        members.setdefault(x.batch, set()).add(x.case_id)
    for x in created.withColumn("k", normalize_match_text(F.col("content"))).collect():
        contents.setdefault(x.k, set()).add(x.case_id)
    want, left = set(), []
    for x in images.withColumn("t", normalize_match_text(F.col("text"))).collect():
        own = members.get(x.batch, set())
        held = set().union(*(c for k, c in contents.items() if k and k in x.t))
        if x.batch is not None and len(own) == 1:
            want.add((x.doc_id, min(own), "batch"))
        elif len(held) == 1:
            want.add((x.doc_id, min(held), "content"))
        else:
            left.append((x.doc_id, x.text))
    rest = J.fuzzy_margin_join(spark.createDataFrame(left, "doc_id long, text string"), cases).where("case_id is not null").collect()
    assert got == want | {(x.doc_id, x.case_id, "fuzzy") for x in rest}
    assert len({stage for _, _, stage in got}) >= 2
