"""Archive runs over published state, duplicates, routing in streams and the memory of contents, on literal cases."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from dossier.operators import evidence as E
from dossier.operators import joins as J
from dossier.plans import pipelines as P
from dossier.queries_link import _perturbed
from dossier.sources import files as S
from dossier.sources.state import RevisionTaken, StateStore
from dossier.streaming.intake import route_work, take_batch, take_in
from dossier.streaming.seen import PAGE_ROWS, SeenIndex

DAY = datetime.date(2026, 7, 24)
CASE = "case_id string, case_name string, status string, area string, content string, start_date date, end_date date, contact string, hazard string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture()
def state(spark):
    """Cases c1 (complete but for an approval) and c2, its poorer duplicate; c3 without a worker list; c4 terminated."""
    cases = [("c1", "2026-07-24_冷塔_质保作业申请单", "open", "A区", "冷塔", DAY, DAY, "甲", ""), ("c2", "2026-07-24_冷塔_质保作业申请单_02", "open", " a区", "冷 塔", DAY, DAY, "乙", ""),
             ("c3", "2026-07-20_水泵_质保作业申请单", "open", "B区", "水泵", datetime.date(2026, 7, 20), DAY, "丙", ""), ("c4", "old", "terminated", "C区", "门", DAY, DAY, "丁", "")]
    evidence = [("c1", r, f"{r}.jpg", f"h-{r}", False) for r in ("word", "signed_application", "worker_list", "safety_agreement")] + [("c2", "word", "w.docx", "h-word", False), ("c2", "special_work", "s.jpg", "h-special", False), ("c3", "word", "w.docx", "h3", False)]
    inbox = [("i1", "2026-07-20_x_人员名单.jpg", "h-late", datetime.date(2026, 7, 20))]
    return {
        "cases": spark.createDataFrame(cases, CASE), "evidence": spark.createDataFrame(evidence, P.STATE["evidence"]), "inbox": spark.createDataFrame(inbox, P.STATE["inbox"]),
        "approvals": spark.createDataFrame([("c1", "", ""), ("c2", "000000000002", "manual")], P.STATE["approvals"]),
    }


@pytest.fixture()
def inputs(spark):
    """b1: two new forms with their worker lists and material; b2: a lone form, refused; b3: approvals."""
    approval = "工程类-主体质保施工 申请编号：000000000777 施工区域：B区 施工开始时间：2026年7月20日 施工结束时间：2026年7月24日 施工内容：水泵 施工负责人：甲"
    files = [
        ("f1", "b1", "甲单.docx", "", "n1", DAY), ("f2", "b1", "乙单.docx", "", "n2", DAY), ("l1", "b1", "1工人名单.jpg", "", "n3", DAY), ("l2", "b1", "2工人名单.jpg", "", "n4", DAY),
        ("m1", "b1", "甲单.jpg", "", "n5", DAY), ("m2", "b1", "扫描.jpg", "动火作业申请 施工内容：焊接", "n6", DAY), ("m3", "b1", "无关.jpg", "nothing", "n7", DAY),
        ("f3", "b2", "丙单.docx", "", "n8", DAY), ("a1", "b3", "工程类主体质保施工.pdf", approval, "n9", DAY), ("a2", "b3", "x.pdf", "工程类主体质保施工 施工区域：Q区", "n10", DAY),
    ]
    forms = [("f1", "n1", "D区", "焊接", DAY, DAY, "戊", ""), ("f2", "n2", "E区", "刷漆", DAY, DAY, "己", ""), ("f3", "n8", "F区", "搬运", DAY, DAY, "庚", "")]
    return (
        spark.createDataFrame(files, "file_id string, batch string, name string, text string, sha256 string, modified date"),
        spark.createDataFrame(forms, "form_id string, sha256 string, area string, content string, start_date date, end_date date, contact string, hazard string"),
    )


def test_a_run_changes_every_table_once(spark, state, inputs, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    with pytest.raises(ValueError, match="no cases"):
        P.run_archive(store, *inputs, "v", "template")
    assert store.publish(0, state, {"dataset_revision": 4}) == 1
    done = P.run_archive(store, *inputs, "v", "template")
    weld, paint = "2026-07-24_焊接_质保作业申请单", "2026-07-24_刷漆_质保作业申请单"
    assert rows(done["cases"], "case_name", "status", F.array_join("missing", ",")) == [
        ("2026-07-20_水泵_质保作业申请单", "approved", "signed_application,safety_agreement"), ("2026-07-24_冷塔_质保作业申请单", "approved", ""),
        (paint, "materials_incomplete", "signed_application"), (weld, "materials_ready", ""), ("old", "terminated", "word,signed_application,worker_list,safety_agreement"),
    ]
    names = {r.case_id: r.case_name for r in done["cases"].collect()}
    held = sorted((names[r.case_id], r.role, r.sha256, r.derived) for r in done["evidence"].collect())
    pump, tower = "2026-07-20_水泵_质保作业申请单", "2026-07-24_冷塔_质保作业申请单"
    assert held == sorted([
        (pump, "word", "h3", False), (pump, "approval_pdf", "n9", False), (pump, "worker_list", "h-late", False),
        *[(tower, r, f"h-{r}", False) for r in ("word", "signed_application", "worker_list", "safety_agreement")], (tower, "special_work", "h-special", False),
        # lists go to cases by name: 刷漆 comes before 焊接
        (paint, "word", "n2", False), (paint, "safety_agreement", "template", True), (paint, "worker_list", "n3", False),
        (weld, "word", "n1", False), (weld, "safety_agreement", "template", True), (weld, "worker_list", "n4", False), (weld, "signed_application", "n5", False), (weld, "special_work", "n6", False),
    ])
    assert sorted((names[r.case_id], r.application_no, r.match_source) for r in done["approvals"].collect()) == [(pump, "000000000777", "content_recognition"), (tower, "000000000002", "manual")]
    assert rows(done["inbox"], "file_id") == [("m3",)] and rows(done["unmatched"], "file_id", "path") == [("a2", "_inbox/x.pdf")]
    assert rows(done["reviews"], "sha256", "reason") == [("n10", "no_content_match")]
    assert {r.sha256 for r in done["recognized"].collect()} == {f"n{i}" for i in range(1, 11)}
    assert rows(done["routes"], "file_id", "kind") == sorted([(f, "approval" if f[0] == "a" else "material") for f in ("f1", "f2", "l1", "l2", "m1", "m2", "m3", "a1", "a2")])
    assert done["run"].first().asDict(True) == {"revision": 5, "counters": {"approvals_ingested": 1, "batches_refused": 1, "cases_inserted": 2, "duplicates_removed": 1, "files_routed": 9, "materials_archived": 2, "worker_lists_archived": 2, "worker_lists_copied": 1}}
    assert len(rows(done["changes"].where("action = 'route_input'"), "source")) == 9 and len(rows(done["changes"].where("action = 'copy'"), "target")) == 2

    # the same inputs again: only the refused batch comes again, nothing changes
    again = P.run_archive(store, *inputs, "v", "template")
    assert again["run"].first().asDict(True) == {"revision": 5, "counters": {"batches_refused": 1}}
    for name in ("cases", "evidence", "approvals", "inbox", "unmatched", "recognized", "history", "reviews", "routes", "changes"):
        columns = sorted(done[name].columns)
        assert rows(again[name], *columns) == rows(done[name], *columns), name
    revision, published = store.read()
    assert revision == 3 and rows(published["runs"], "revision") == [(5,), (5,)] and store.told()["note"] == {"dataset_revision": 5}
    assert store.read(1)[1]["cases"].count() == 4


def test_duplicates_are_merged_with_their_approvals(spark, state):
    cases, evidence, approvals, changes = P.merge_duplicate_cases(state["cases"], state["evidence"], state["approvals"])
    assert rows(cases, "case_id", "status") == [("c1", "approved"), ("c3", "materials_incomplete"), ("c4", "terminated")]
    assert rows(approvals, "case_id", "application_no", "match_source") == [("c1", "000000000002", "manual")]
    assert rows(evidence.where("case_id = 'c1'"), "role") == [("safety_agreement",), ("signed_application",), ("special_work",), ("word",), ("worker_list",)]
    assert rows(changes, "action", "target") == [("merge_evidence", "c1"), ("remove_duplicate_case", "c1")]


def test_identical_worker_lists_go_to_cases_that_lack_one(spark):
    cases = spark.createDataFrame([(f"c{i}", f"n{i}", ["worker_list"], "A", "x", DAY, DAY) for i in range(4)], "case_id string, case_name string, missing array<string>, area string, content string, start_date date, end_date date")
    touched = spark.createDataFrame([(f"c{i}", f"n{i}", "b", f"form{i}.docx", f"content{i}", False) for i in range(2)], "case_id string, case_name string, batch string, form string, content string, fresh boolean")
    pool = spark.createDataFrame([("p2", "b", "2.jpg", "same", DAY), ("p1", "b", "1.jpg", "same", DAY), ("q1", None, "3.jpg", "other", DAY), ("q2", None, "4.jpg", "other", DAY)], "file_id string, batch string, name string, sha256 string, modified date")
    texts = spark.createDataFrame([("same", "施工人员名单"), ("other", "施工人员名单")], "sha256 string, text string")
    none = spark.createDataFrame([], P.STATE["evidence"])
    found = P.claim_materials(pool, touched, cases, none, texts)
    assert rows(found, "file_id", "case_id", "role", "stage") == [("p1", "c0", "worker_list", "identical"), ("p2", "c1", "worker_list", "identical"), ("q1", "c2", "worker_list", "identical"), ("q2", "c3", "worker_list", "identical")]


def test_one_of_two_writers_publishes(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s")
    table = lambda x: {"t": spark.createDataFrame([(x,)], "x int")}
    assert store.revision() == 0 and store.read(schemas={"t": table(0)["t"].schema})[1]["t"].count() == 0
    store.publish(0, table(1) | {"other": table(7)["t"]})
    outcomes = []

    def write(x):
        try:
            outcomes.append((x, store.publish(1, table(x))))
        except RevisionTaken:
            outcomes.append((x, None))

    writers = [threading.Thread(target=write, args=(x,)) for x in (2, 3)]
    [w.start() for w in writers], [w.join() for w in writers]
    (winner,) = [x for x, revision in outcomes if revision == 2]
    assert [revision for _, revision in outcomes].count(None) == 1
    revision, tables = store.read()
    assert revision == 2 and tables["t"].first().x == winner and tables["other"].first().x == 7
    # nothing of the loser is left behind
    assert len(list((tmp_path / "s" / "tables").glob("t-*"))) == 2


def test_dataset_versions_and_writers(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    cases = spark.createDataFrame([(1, {"word": [(1, "a", 2)]})], f"case_id long, materials map<string, array<{S.FILE}>>")
    assert S.published(spark, folder).count() == 0 == S.load_revision(spark, f"{folder}/nothing").count()
    first, second = S.save_revision(cases, folder, 1), S.save_revision(cases.limit(0), folder, 1)
    S.publish(spark, folder, 1, first)
    with pytest.raises(RevisionTaken):
        S.publish(spark, folder, 1, second)
    assert S.published(spark, folder).select("case_id").collect() == [(1,)]
    cases.withColumns({"schema_version": F.lit(99), "dataset_revision": F.lit(1)}).write.json(f"{folder}/wrong")
    for columns in (["case_id"], ["schema_version"], ["materials"]):
        with pytest.raises(Exception, match="schema version 99"):
            S.load_revision(spark, f"{folder}/wrong").select(*columns).collect()
    with pytest.raises(Exception, match="schema version 99"):
        S.load_revision(spark, f"{folder}/wrong").count()


def rows_read(spark, run):
    """The input records of all stages of run."""
    status = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    ids = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)

    def total():
        bus.waitUntilEmpty(10_000)
        found = ids()
        return sum(found.apply(i).inputRecords() for i in range(found.size()))

    before = total()
    run()
    return total() - before


def test_lookups_dont_read_the_store(spark, tmp_path):
    index = SeenIndex(spark, f"file://{tmp_path}/seen", buckets=4)
    some = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    for batch in range(9):
        index.add(some(1000 * batch, 1000 * batch + 1000), batch)
        read = rows_read(spark, lambda: index.lookup(some(10**6, 10**6 + 20)).collect())
        # what is asked, a filter for each bucket and segment, and a page for each fingerprint that a filter knows wrongly; not the store's 9,000 rows
        wrong = spark.read.parquet(f"{index.folder}/asked-None").count()
        assert wrong <= 2 and read <= 20 + wrong + len(index.segments()) * (4 + wrong * PAGE_ROWS)
    assert len(index.segments()) == 3 and sum(len(s["batches"]) for s in index.segments()) == 9
    assert index.lookup(some(500, 600)).count() == 100 and index.lookup(some(500, 600), 0).count() == 0
    assert index.lookup(some(8990, 9010)).count() == 10
    index.add(some(0, 5), 0)
    assert sum(len(s["batches"]) for s in index.segments()) == 9


def test_contents_that_work_leaves_out_are_worked_on_once(spark, tmp_path):
    source, store, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "store", "check"))
    seen = []

    def work(fresh, batch):
        seen.append(sorted(r.h for r in fresh.collect()))
        return fresh.where("h = 'linked'")

    docs = lambda *h: spark.createDataFrame([(x,) for x in h], "h string").coalesce(1).write.mode("append").parquet(source)
    docs("linked", "unlinked", "linked")
    take_in(spark, source, "h string", "h", store, checkpoint, work)
    docs("unlinked", "new")
    take_in(spark, source, "h string", "h", store, checkpoint, work)
    assert seen == [["linked", "unlinked"], ["new"]]
    assert [r.h for r in spark.read.parquet(store).collect()] == ["linked"]


def test_a_repeated_batch_leaves_one_copy_in_each_table(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    index = SeenIndex(spark, f"{store}-seen", 2)
    inbox = spark.createDataFrame([("held.pdf", "h9")], "name string, sha256 string")
    recognized = spark.createDataFrame([("h1", "v", "工程类主体质保施工"), ("h2", "v", "other")], "sha256 string, version string, text string")
    files = [(1, 1, "x.pdf", "h1"), (2, 1, "held.pdf", "h2"), (3, 2, "form.docx", "h3"), (4, 1, "y.pdf", "h4")]
    batch = spark.createDataFrame(files, "file_id long, batch long, name string, sha256 string")
    work = route_work(store, inbox, recognized, "v")
    for _ in range(2):
        take_batch(batch, 0, "sha256", store, index, work)
    later = spark.createDataFrame([(5, 3, "x.pdf", "h5"), (6, 3, "z.pdf", "h1")], batch.schema)
    take_batch(later, 1, "sha256", store, index, work)
    assert rows(spark.read.parquet(f"{store}/routes"), "batch", "file_id", "kind", "action", "target") == [
        (0, 1, "approval", "routed", "_inbox/x.pdf"), (0, 2, "material", "routed", "_inbox/held_02.pdf"), (0, 4, "material", "routed", "_inbox/y.pdf"), (1, 5, "material", "routed", "_inbox/x_02.pdf"),
    ]
    assert rows(spark.read.parquet(f"{store}/gate"), "batch", "input_batch", "accepted") == [(0, 1, True), (0, 2, False), (1, 3, True)]
    assert rows(spark.read.parquet(f"{store}/log"), "batch", "files", "files_routed", "batches_refused", "batches") == [(0, 4, 3, 1, 2), (1, 1, 1, 0, 1)]


def plain_margin(docs, cases):
    """fuzzy_margin_join without any bound: every candidate is rated."""
    import difflib

    keyed = [r.asDict() for r in J.case_keys(cases).collect() if r.content_key]
    by_start = {}
    for c in keyed:
        by_start.setdefault(c["start_date"], []).append(c)
    found, rated = {}, set()
    for d in J.document_keys(docs).collect():
        if not d.content_key:
            continue
        starts = {d.doc_start} if d.labelled else set(d.dates)
        options = []
        for c in (c for s in starts for c in by_start.get(s, ())):
            if c["area_key"] and c["area_key"] in d.text_key and (c["end_date"] == d.doc_end if d.labelled else c["end_date"] in d.dates):
                a, b = c["content_key"], d.content_key
                exact = a in b or b in a
                if not exact:
                    rated.add((a, b))
                options.append((exact, 1.0 if exact else difflib.SequenceMatcher(None, a, b).ratio(), c["role_missing"], c["case_id"]))
        if not options:
            continue
        whole = [o for o in options if o[0]]
        if whole:
            options = [(e, r if e else 0.0, m, i) for e, r, m, i in options]
        options.sort(key=lambda o: (o[1], o[2], o[3]), reverse=True)
        best, after = options[0], options[1][1] if len(options) > 1 else 0.0
        top = best[1] if best[1] >= 0.6 else 0.0
        after = after if top and top - after < 0.15 else 0.0
        lacking = sum(o[2] for o in whole)
        reason = "exact" if len(whole) == 1 else "exact_only_missing" if whole and lacking == 1 else "several_exact" if whole else "fuzzy" if top and not after else "not_unique"
        found[d.doc_id] = (best[3] if reason in ("exact", "exact_only_missing", "fuzzy") else None, reason, round(top, 12), round(after, 12))
    return found, len(rated)


def test_fuzzy_margin_against_a_plain_version_on_whole_tables(spark):
    docs, cases = _perturbed(spark, "/root/testdata/sf0.001")
    report = {}
    got = {r.doc_id: (r.case_id, r.reason, round(r.best, 12), round(r.runner_up, 12)) for r in J.fuzzy_margin_join(docs, cases, report).collect()}
    want, pairs = plain_margin(docs, cases)
    assert got == want and len({w[1] for w in want.values()}) >= 2
    assert report["pairs"] == pairs and report["rated"] < pairs


def test_counters_are_observed(spark):
    rows_ = spark.createDataFrame([("error",), ("error",), ("warning",)], "severity string")
    written, counters = E.counted(rows_, E.audit_counters())
    assert counters == {"errors": 2, "warnings": 1} and written.count() == 3
    told = {r.name: r.n for r in E.audit_summary(spark.createDataFrame([("open",), (None,)], "status string"), counters).collect()}
    assert told == {"status:open": 1, "status:unknown": 1, "errors": 2, "warnings": 1, "valid": 0}


def test_first_and_best_of_a_key_keep_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 9, "c")], "key int, first int, `n_` string")
    assert rows(E.first_per_key(table, F.col("key"), "first"), "key", "first", "n_") == [(1, 3, "b"), (None, 9, "c")]
    scored = spark.createDataFrame([(1, 10, (1, 2)), (1, 11, (1, 3)), (1, 12, (1, 3)), (None, 13, (9, 9))], "k int, id int, score struct<a:int,b:int>")
    assert rows(E.retain_best_duplicate(scored, ["k"], "score", "id"), "id", "keep") == [(10, 11), (11, 11), (12, 11), (13, None)]


def test_a_growing_table_writes_new_rows_only_and_a_run_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    import os

    from dossier.materialize import materialised, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("table-")}
    store = StateStore(spark, f"file://{tmp_path}/g")
    some = lambda n: spark.range(n).select(F.col("id").cast("string").alias("case_id"))
    store.publish(0, {"cases": some(1), "runs": spark.createDataFrame([(1, {})], P.STATE["runs"])})

    def run(state, inputs, forms, revision, version, agreement):
        passing = materialised(inputs)
        one = spark.createDataFrame([(revision + 1, {"n": 1})], P.STATE["runs"])
        none = {name: spark.createDataFrame([], schema) for name, schema in P.STATE.items() if schema}
        return none | {"cases": passing, "reviews": passing, "recognized": spark.createDataFrame([(str(revision), "v", "t")], P.STATE["recognized"]), "runs": one, "run": one, "links": passing.limit(0), "routed": passing.limit(0)}

    monkeypatch.setattr(P, "_run_tables", run)
    before = tables()
    for n in (2, 3):
        told = P.run_archive(store, some(n), None, "v", "t")
        assert told["cases"].count() == n and told["run"].first()["revision"] == n - 1
    assert len(tables() - before) == 6  # links, routed and run of two runs
    assert rows(store.read()[1]["runs"], "revision") == [(1,), (1,), (2,)] and rows(store.read()[1]["recognized"], "sha256") == [("0",), ("1",)]
    assert rows(store.read(2)[1]["recognized"], "sha256") == [("0",)] and store.read(2)[1]["runs"].count() == 2
    written = [x for x in os.listdir(tmp_path / "g/tables") if x.startswith("routes-")]
    assert len(written) == 1  # no new routes, so the table is named again

    def failing(*_):
        materialised(some(9))
        raise RevisionTaken("x")

    monkeypatch.setattr(P, "_run_tables", failing)
    left = tables()
    with pytest.raises(RevisionTaken):
        P.run_archive(store, some(1), None, "v", "t")
    assert tables() == left
