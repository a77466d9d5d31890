"""Cases, their evidence, status and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..materialize import materialised
from .ranks import rank_within

#: Rows of a base name that one task numbers at most.
HOT_BASE = 100_000
ROLES = ("word", "signed_application", "worker_list", "safety_agreement", "confined_space", "high_altitude", "special_work")


def status(current: Column, approved: Column, missing: Column) -> Column:
    """terminated stays; an approval wins; else incomplete or ready."""
    return F.when(current == "terminated", "terminated").when(approved, "approved").when(F.size(missing) > 0, "materials_incomplete").otherwise("materials_ready")


def missing_roles_and_status(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, missing, status; cases: case_id, status, required, approvals; evidence: case_id, role."""
    present = evidence.groupBy("case_id").agg(F.collect_set("role").alias("present"))
    missing = F.array_except("required", F.coalesce("present", F.array().cast("array<string>")))
    joined = cases.join(present, "case_id", "left").withColumn("missing", missing)
    return joined.select("case_id", "missing", status(F.col("status"), F.col("approvals") > 0, F.col("missing")).alias("status"))


def completeness(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, score: required roles present, approved, approval files, filled roles, distinct files, -missing, original name.

    Structs compare member by member. cases: case_id, case_name, status, required; evidence: case_id, role, file_key, approval.
    """
    facts = evidence.groupBy("case_id").agg(
        F.collect_set(F.when(~F.col("approval"), F.col("role"))).alias("roles"),
        F.count_if("approval").alias("approvals"),
        F.count_distinct(F.nullif("file_key", F.lit(""))).alias("files"),
    )
    none = F.array().cast("array<string>")
    joined = cases.join(facts, "case_id", "left").withColumn("roles", F.coalesce("roles", none)).fillna({"approvals": 0, "files": 0})
    present = F.size(F.array_intersect("required", "roles"))
    numbered = F.col("case_name").rlike(r"^.*_\d{2}$")
    score = F.struct(
        present.alias("required_present"),
        ((F.col("approvals") > 0) | (F.col("status") == "approved")).cast("int").alias("approved"),
        F.col("approvals").alias("approval_files"),
        F.size("roles").alias("filled_roles"),
        F.col("files").alias("file_keys"),
        (present - F.size("required")).alias("minus_missing"),
        (~numbered).cast("int").alias("original_name"),
    )
    return joined.select("case_id", score.alias("score"))


def duplicate_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys, all members present, that more than one row has, with their number of rows."""
    return rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")


def retain_best_duplicate(rows: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """rows with keep: the position of the best score of their key, the first among equals; null where a member of the key is null.

    score is a struct of numbers, compared member by member. One hash aggregate finds the best of each key, so no group is sorted or held by a task.
    """
    worst = [-F.col(f"{score}.{f.name}") for f in rows.schema[score].dataType.fields]
    best = rows.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*[w.alias(f"s{i}") for i, w in enumerate(worst)], F.col(position).alias("at"))).alias("best"))
    return rows.join(best.select(*key, F.col("best.at").alias("keep")), key, "left")


def first_per_key(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """The row of each key that is first by position; one hash aggregate, columns may have any name."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(whole, F.col(position))).toDF("key", "first").select("first.*")


def fingerprint_groups(files: DataFrame) -> DataFrame:
    """sha256, files, first_id: one row for each content."""
    return files.groupBy("sha256").agg(F.count("*").alias("files"), F.min("file_id").alias("first_id"))


def filled_approvals(cases: DataFrame, retained: DataFrame, fields: list[str]) -> DataFrame:
    """case_id and fields of the retained cases: their own values, and where blank those of the removed case with the smallest id that has one."""
    value = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    order = F.struct(F.col("case_id") != F.col("keep_id"), "case_id")
    filled = [F.coalesce(F.min_by(F.col(c), F.when(value(c).isNotNull(), order)).cast("string"), F.lit("")).alias(c) for c in fields]
    return cases.join(retained, "case_id").groupBy(F.col("keep_id").alias("kept_")).agg(*filled).withColumnRenamed("kept_", "case_id")


def merge_unique_evidence(evidence: DataFrame, retained: DataFrame) -> DataFrame:
    """Evidence under the retained cases, once for each content; the retained case's own row comes first.

    evidence: case_id, file_id, sha256; retained: case_id, keep_id.
    """
    placed = evidence.join(retained, "case_id").groupBy(F.col("keep_id").alias("kept"), "sha256").agg(F.min(F.struct((F.col("case_id") != F.col("keep_id")).alias("moved"), "file_id")).alias("first"))
    return placed.select(F.col("kept").alias("case_id"), "first.file_id", "sha256", "first.moved")


def role_sequence(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (case_id, role, name) with index: numbered by name in a case and role, going on after the existing ones."""
    order = Window.partitionBy("case_id", "role").orderBy("name")
    counts = existing.groupBy("case_id", "role").agg(F.count("*").alias("before"))
    joined = files.withColumn("n_", F.row_number().over(order)).join(counts, ["case_id", "role"], "left")
    return joined.select("case_id", "role", "name", (F.col("n_") + F.coalesce("before", F.lit(0))).cast("long").alias("index"))


def next_free_suffix(newcomers: DataFrame, taken: DataFrame) -> DataFrame:
    """newcomers (row_id, base) with name: the base if nobody has it, else base_02, base_03 and so on, leaving out taken ones.

    The n-th newcomer of a base gets the n-th free number. Below the i-th taken number t lie t - i free ones, so the n-th free
    number is n and as many more as taken numbers have fewer than n free ones below them. All counts are ranks, so the
    work is linear and no base is held by one task.
    """
    split = r"^(.*)_(\d{2,})$"
    number = F.regexp_extract("name", split, 2)
    used = taken.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("number")).unionByName(
        taken.where(number != "").select(F.regexp_extract("name", split, 1).alias("base"), number.cast("long").alias("number")).where("number >= 2")
    )
    no_row = F.lit(None).cast(newcomers.schema["row_id"].dataType)
    both = newcomers.select("base", F.lit(None).cast("long").alias("number"), F.lit(0).alias("is_taken"), "row_id")
    both = materialised(both.unionByName(used.join(newcomers.select("base").distinct(), "base", "left_semi").distinct().select("base", "number", F.lit(1).alias("is_taken"), no_row.alias("row_id"))))
    hot = materialised(both.groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BASE).select("base"))
    # one shuffle by base serves all ranks; bases that many rows have are ranked by ranges
    own = Window.partitionBy("base", "is_taken").orderBy("number", "row_id")
    cold = both.join(hot, "base", "left_anti").withColumn("i", F.row_number().over(own)).withColumn("place", F.when(F.col("is_taken") == 1, F.col("number") - F.col("i")).otherwise(F.col("i")))
    pick = cold.withColumn("pick", F.row_number().over(Window.partitionBy("base").orderBy("place", "is_taken"))).where("is_taken = 0").select("base", "row_id", F.col("pick").cast("long").alias("pick"))
    if not hot.isEmpty():
        rest = both.join(F.broadcast(hot), "base", "left_semi")
        ranked = rank_within(rest.where("is_taken = 1"), ["base"], ["number"], "i").withColumn("place", F.col("number") - F.col("i")).drop("i")
        ranked = rank_within(rest.where("is_taken = 0"), ["base"], ["row_id"], "place").unionByName(ranked)
        pick = pick.unionByName(rank_within(ranked, ["base"], ["place", "is_taken"], "pick").where("is_taken = 0").select("base", "row_id", "pick"))
    tail = F.when(F.col("pick") < 100, F.lpad(F.col("pick").cast("string"), 2, "0")).otherwise(F.col("pick").cast("string"))
    return pick.select("row_id", "base", F.when(F.col("pick") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), tail)).alias("name"))


def batch_count_gate(batches: DataFrame) -> DataFrame:
    """batch, forms, lists, accepted: as many lists as forms, or no list and only forms that replace existing ones.

    batches: batch, kind (form, list or another), replaces.
    """
    agg = batches.groupBy("batch").agg(F.count_if(F.col("kind") == "form").alias("forms"), F.count_if(F.col("kind") == "list").alias("lists"), F.count_if((F.col("kind") == "form") & ~F.col("replaces")).alias("new"))
    accepted = (F.col("forms") == F.col("lists")) | ((F.col("lists") == 0) & (F.col("forms") > 0) & (F.col("new") == 0))
    return agg.select("batch", "forms", "lists", accepted.alias("accepted"))


def flatten_evidence(cases: DataFrame) -> DataFrame:
    """case_id, role, file fields: every role's files and the approvals of nested cases."""
    files = cases.select("case_id", F.explode(F.map_entries("materials")).alias("e")).select("case_id", F.col("e.key").alias("role"), F.explode("e.value").alias("f"))
    approvals = cases.select("case_id", F.lit("approval_pdf").alias("role"), F.explode("approvals").alias("f"))
    return files.unionByName(approvals).select("case_id", "role", "f.*")


def nest_evidence(evidence: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """case_id, materials: a map with a key for each role, empty arrays included; files in the order of their positions."""
    files = F.array_sort(F.collect_list(F.struct("position", "name", "size")))
    own = evidence.groupBy("case_id", "role").agg(files.alias("files"))
    own = own.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "files"))).alias("own"))
    empty = F.array().cast("array<struct<position:bigint,name:string,size:bigint>>")
    entries = F.array(*[F.struct(F.lit(r).alias("key"), F.coalesce(F.try_element_at("own", F.lit(r)), empty).alias("value")) for r in roles])
    return own.select("case_id", F.map_from_entries(entries).alias("materials"))


def file_links(files: Column) -> Column:
    """Array of {text, href, path}: the text falls back to the base name; blank paths are left out."""
    from ..functions.text import relative_href

    base = lambda p: F.regexp_extract(p, r"([^/]*)$", 1)
    return F.transform(
        F.filter(files, lambda f: F.coalesce(f["path"], F.lit("")) != ""),
        lambda f: F.struct(F.coalesce(F.nullif(f["name"], F.lit("")), base(f["path"])).alias("text"), relative_href(f["path"]).alias("href"), f["path"].alias("path")),
    )


def dataset_audit(cases: DataFrame, evidence: DataFrame, inventory: DataFrame) -> DataFrame:
    """subject, severity, issue: ids missing or repeated, paths outside, files missing or of another size or hash, blank hashes.

    cases: case_id; evidence: case_id, file_id, path, size, sha256; inventory: path, size, sha256.
    """
    from ..functions.text import leaves_root

    def repeated(rows: DataFrame, name: str, kind: str) -> DataFrame:
        n = rows.groupBy(name).agg(F.count("*").alias("n"))
        issue = F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", f"{kind}_id_missing").when(F.col("n") > 1, f"{kind}_id_repeated")
        return n.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("subject"), F.lit("error").alias("severity"), issue.alias("issue")).where("issue is not null")

    actual = inventory.select("path", F.col("size").alias("a_size"), F.col("sha256").alias("a_sha"))
    joined = evidence.join(actual, "path", "left")
    outside, gone = leaves_root(F.col("path")), F.col("a_size").isNull()
    unhashed = F.coalesce("sha256", F.lit("")) == ""
    issues = F.array_compact(F.array(
        F.when(outside, "error:outside"),
        F.when(~outside & gone, "error:file_missing"),
        F.when(~outside & ~gone & (F.col("size") != F.col("a_size")), "error:size_differs"),
        F.when(~outside & ~gone & ~unhashed & (F.col("sha256") != F.col("a_sha")), "error:hash_differs"),
        F.when(unhashed, "warning:hash_absent"),
    ))
    files = joined.select(F.col("file_id").cast("string").alias("subject"), F.explode(issues).alias("x"))
    files = files.select("subject", F.split_part("x", F.lit(":"), F.lit(1)).alias("severity"), F.split_part("x", F.lit(":"), F.lit(2)).alias("issue"))
    return repeated(cases, "case_id", "case").unionByName(repeated(evidence, "file_id", "file")).unionByName(files)


def reclassify_evidence(evidence: DataFrame, recognized: DataFrame, role_of: Column, inventory: DataFrame | None = None) -> DataFrame:
    """file_id, role, new_role, outcome: unchanged, moved, text_missing, or reference_removed where the file of a new role is gone.

    role_of is a Column over ``text``; an empty text is missing. With an inventory (sha256) files that it lacks are gone.
    """
    joined = evidence.join(recognized, "sha256", "left").withColumn("new_role", role_of)
    there = F.lit(True)
    if inventory is not None:
        joined = joined.join(inventory.select("sha256").distinct().withColumn("there_", F.lit(True)), "sha256", "left")
        there = F.coalesce("there_", F.lit(False))
    stays = F.col("new_role").isNull() | (F.col("new_role") == F.col("role"))
    outcome = F.when(F.coalesce("text", F.lit("")) == "", "text_missing").when(stays, "unchanged").when(there, "moved").otherwise("reference_removed")
    return joined.select("file_id", "role", F.when(outcome.isin("moved", "reference_removed"), F.col("new_role")).alias("new_role"), outcome.alias("outcome"))


def claimed_sources(files: DataFrame, claims: DataFrame, default_role: str) -> DataFrame:
    """file_id, role of files that no claim names."""
    return files.join(claims.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(default_role).alias("role"))


def retain_unmatched(unmatched: DataFrame, resolved: DataFrame) -> DataFrame:
    """Unmatched files less those resolved by content or by path."""
    return unmatched.join(resolved.select("sha256").distinct(), "sha256", "left_anti").join(resolved.select("path").distinct(), "path", "left_anti")


def append_once(history: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """history and those rows whose key it doesn't hold."""
    return history.unionByName(rows.dropDuplicates(key).join(history.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def recent_window_filter(cases: DataFrame, run: Column, before: int = 2, after: int = 14) -> DataFrame:
    """Cases that start within some days of the run and have a content to match by."""
    from ..functions.text import normalize_match_text

    return cases.where(F.col("start_date").between(F.date_sub(run, before), F.date_add(run, after)) & (normalize_match_text(F.col("content")) != ""))


def work_queues(cases: DataFrame) -> DataFrame:
    """case_id, queue: all, and missing_roles (not terminated), ready or approved; cases: case_id, status, missing."""
    lacking = (F.size("missing") > 0) & (F.col("status") != "terminated")
    queues = F.array_compact(F.array(F.lit("all"), F.when(lacking, "missing_roles"), F.when(F.col("status") == "materials_ready", "ready"), F.when(F.col("status") == "approved", "approved")))
    return cases.select("case_id", F.explode(queues).alias("queue"))


def view_search(rows: DataFrame, cells: list[str], asked: str) -> DataFrame:
    """Rows of which a cell holds the asked text in either case; cells are strings or arrays of links (text, href, path); a blank question keeps all."""
    question = F.lower(F.trim(F.lit(asked)))
    hit = F.lit(not asked.strip())
    for cell in cells:
        if rows.schema[cell].dataType.typeName() == "array":
            hit = hit | F.exists(F.coalesce(F.col(cell), F.array().cast(rows.schema[cell].dataType)), lambda x: F.contains(F.lower(F.coalesce(x["text"], F.lit(""))), question))
        else:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(cell).cast("string"), F.lit(""))), question)
    return rows.where(hit)


def open_cases(cases: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Cases that are neither terminated nor approved, and without an approval file where evidence is given."""
    live = cases.where(~F.col("status").isin("terminated", "approved"))
    return live if evidence is None else live.join(evidence.where("role = 'approval_pdf'").select("case_id"), "case_id", "left_anti")


def undated_images(files: DataFrame, name: str) -> DataFrame:
    """Images whose name doesn't begin with a date."""
    from ..functions.classify import IMAGES
    from ..functions.text import suffix

    return files.where(suffix(F.col(name)).isin(*IMAGES) & ~F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}"))


def direct_children(files: DataFrame, path: Column, folder: str, kind: str) -> DataFrame:
    """Files of a kind that lie in the folder itself."""
    from ..functions.text import suffix

    return files.where(path.rlike(rf"^\Q{folder}\E/[^/]+$") & (suffix(path) == kind))


def contains_hash(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """case_id, holds: whether any evidence of the case has a known content."""
    hits = known.select("sha256").distinct().withColumn("known_", F.lit(True))
    return evidence.join(hits, "sha256", "left").groupBy("case_id").agg(F.bool_or(F.coalesce("known_", F.lit(False))).alias("holds"))


def existing_files(evidence: DataFrame, inventory: DataFrame) -> DataFrame:
    """Evidence (path and others) that lies inside the root and in the inventory (path)."""
    from ..functions.text import leaves_root

    return evidence.where(~leaves_root(F.col("path"))).join(inventory.select("path").distinct(), "path", "left_semi")


def first_path(*paths: Column) -> Column:
    """The first path that isn't blank."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in paths])


def summary_metrics(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: cases in all, approved, pending and incomplete; review rows pending, decided and unresolved. reviews: decision, case_id."""
    n = lambda x: F.count_if(F.col("status") == x)
    own = cases.agg(F.count("*").alias("total"), n("approved").alias("approved"), n("materials_ready").alias("pending"), n("materials_incomplete").alias("incomplete"))
    found, waits = F.col("case_id").isNotNull(), F.col("decision") == "pending"
    told = reviews.agg(F.count_if(found & waits).alias("reviews_pending"), F.count_if(~waits).alias("reviews_decided"), F.count_if(~found).alias("reviews_unresolved"))
    return own.join(told, F.lit(True))


def counted(rows: DataFrame, counters: list[Column]) -> tuple[DataFrame, dict]:
    """(rows, written once; counters by name), the counters observed in the pass that writes the rows."""
    seen = Observation()
    written = materialised(rows.observe(seen, *counters))
    return written, seen.get


def reclassified_counters() -> list[Column]:
    """Counters of reclassified evidence: checked, moved, references removed (the file is gone), texts missing."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return [F.count(F.lit(1)).alias("checked"), n("moved").alias("moved"), n("reference_removed").alias("removed"), n("text_missing").alias("text_missing")]


def audit_counters() -> list[Column]:
    """Counters of an audit's issues."""
    return [F.count_if(F.col("severity") == x).alias(x + "s") for x in ("error", "warning")]


def audit_summary(cases: DataFrame, counters: dict) -> DataFrame:
    """name, n of an audit: cases by status, errors and warnings (from audit_counters), and valid (1 without errors)."""
    histogram = cases.groupBy(F.concat(F.lit("status:"), F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))).alias("name")).agg(F.count("*").alias("n"))
    told = {"errors": counters["errors"], "warnings": counters["warnings"], "valid": int(counters["errors"] == 0)}
    return histogram.unionByName(cases.sparkSession.createDataFrame(list(told.items()), "name string, n long"))


# What a status and a role are called.
STATUS_TEXT = {"approved": "已审批", "materials_ready": "待审批", "materials_incomplete": "材料不全", "needs_review": "待审核", "terminated": "已终止"}
ROLE_TEXT = {"word": "申请单", "signed_application": "手签", "worker_list": "施工人员名单", "safety_agreement": "安全协议", "confined_space": "有限空间申请", "high_altitude": "高处作业申请", "special_work": "专项作业材料"}


def hazard_roles(hazard: Column, fire: Column, exits: Column) -> Column:
    """Roles that the chosen hazards and both tick boxes ask for."""
    from ..functions.text import blank

    h = blank(hazard)
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(h, w))
    special = (blank(fire) == "yes") | (blank(exits) == "yes") | has("动火", "危大工程", "配电室接电")
    return F.array_compact(F.array(F.when(has("有限空间"), "confined_space"), F.when(has("高处", "高空"), "high_altitude"), F.when(special, "special_work")))


def summary_rows(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The view of all cases: case_id, sixteen cells and a tone.

    cases: case_id, status, missing and the business fields; evidence: case_id, role, position, name, path. Cells: status with what is missing, project,
    units, manager, area, both dates, content, foreman, the hazards against the roles on file, and links to the form, the
    signed form, worker lists, hazard papers, agreements and approvals. A terminated case has that tone whatever its papers say.
    """
    from ..functions.classify import hazard_review
    from ..functions.text import blank, joined_nonblank

    text = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c], c)
    groups = {"word": ["word"], "signed": ["signed_application"], "workers": ["worker_list"], "papers": ["confined_space", "high_altitude", "special_work"], "agreement": ["safety_agreement"], "approval": ["approval_pdf"]}
    place = {role: i for i, role in enumerate(ROLES)}
    entry = lambda roles: F.when(F.col("role").isin(*roles), F.struct(F.coalesce(F.create_map(*[F.lit(x) for p in place.items() for x in p])[F.col("role")], F.lit(0)).alias("o"), "position", "name", "path"))
    listed = evidence.groupBy("case_id").agg(*[F.array_sort(F.collect_list(entry(roles))).alias(k) for k, roles in groups.items()], F.collect_set("role").alias("present"))
    joined = cases.join(listed, "case_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    special = F.array_intersect(F.array(*[F.lit(r) for r in groups["papers"]]), F.col("present"))
    judged = joined.withColumn("review_", hazard_review(hazard_roles(F.col("hazard"), F.col("fire_equipment"), F.col("exits")), special))
    lacks = F.array_join(F.transform("missing", lambda r: text(ROLE_TEXT, r)), "、")
    names = lambda c: F.array_join(F.transform(c, lambda r: text(ROLE_TEXT, r)), "、")
    verdict = F.concat_ws("：", F.col("review_.verdict"), F.nullif(F.concat_ws("；", F.nullif(names(F.col("review_.missing")), F.lit("")), F.nullif(names(F.col("review_.unexpected")), F.lit(""))), F.lit("")))
    tone = F.when(F.col("status") == "terminated", "terminated").when(F.col("status") == "approved", "success").when(F.col("status") == "materials_ready", "info").when(F.col("status") == "materials_incomplete", "warning").otherwise("")
    unit = lambda label, c: F.when(F.btrim(blank(F.col(c))) != "", F.concat(F.lit(label + "："), F.btrim(blank(F.col(c)))))
    return judged.select(
        "case_id", F.concat(text(STATUS_TEXT, F.col("status")), F.lit("；\n"), F.when(F.size("missing") > 0, F.concat(F.lit("缺少："), lacks)).otherwise("材料完整")).alias("status_text"),
        blank(F.col("project")).alias("project"), joined_nonblank(unit("质保", "unit"), unit("分包", "subunit"), separator="；\n").alias("units"), joined_nonblank(F.col("manager"), F.col("manager_phone")).alias("manager"),
        "area", "start_date", "end_date", "content", joined_nonblank(F.col("foreman"), F.col("foreman_phone")).alias("foreman"), verdict.alias("hazards"),
        *[file_links(F.coalesce(k, F.array().cast(listed.schema[k].dataType))).alias(k) for k in groups], tone.alias("tone"),
    )


def flat_summary(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(23 columns for each record, notes) of the flat table: the business fields, whether form and folder can be opened, names, path, state.

    records: the business fields, form_path, image_path, folder_path, names, old_name, new_name, state. notes: item, value.
    """
    from ..functions.forms import BUSINESS
    from ..functions.text import blank

    opens = lambda c, word: F.when(blank(F.col(c)) != "", word).otherwise("")
    image = F.regexp_extract(blank(F.col("image_path")), r"([^/]*)$", 1)
    rows = records.select(*BUSINESS, opens("form_path", "打开文件").alias("form"), image.alias("image"), opens("folder_path", "打开目录").alias("folder"), blank(F.col("names")).alias("names"), "old_name", "new_name", F.col("form_path").alias("path"), "state")
    count = records.agg(F.count("*").alias("records"), F.count_if(F.col("state") == "renamed").alias("renamed"))
    notes = count.select(F.explode(F.create_map(F.lit("records"), "records", F.lit("renamed"), "renamed")).alias("item", "value"))
    return rows, notes
