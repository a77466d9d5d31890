"""Queries of the text, date, name and classification functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import classify, dates, forms, ids, text
from .operators.review import with_approval_fields
from .views import views, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# Match form and its reading of confusable characters, in SQL.
MATCH = r"translate(lower(regexp_replace(coalesce({0}, ''), '\s+', '', 'g')), '～—–－-（），、', '~~~~~(),,')"
OCR = r"regexp_replace(regexp_replace({0}, '(^|[^a-z])i([0-9])', '\1l\2', 'g'), '(^|[^a-z])i([0-9])', '\1l\2', 'g')"


def sql_match(x: str) -> str:
    return MATCH.format(x)


def sql_ocr(x: str) -> str:
    return OCR.format(MATCH.format(x))


def sql_uuid(h: str) -> str:
    """The version-5 UUID of a SHA-1 in hex."""
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', cast(('0x' || substr({h}, 17, 1))::int % 4 + 1 as int), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def sql_name_hash(name: str) -> str:
    return f"sha1(unhex('{ids.NAMESPACE.hex}') || encode({name}))"


def sql_field(t: str, label: str, ends: tuple[str, ...]) -> str:
    """The labelled field of a text in match form."""
    at = f"(strpos({t}, '{label}') + {len(label)})"
    rest = f"substr({t}, {at})"
    hits = ", ".join(f"case when strpos({rest}, '{e}') > 0 then strpos({rest}, '{e}') end" for e in ends)
    return f"(case when strpos({t}, '{label}') > 0 then trim(substr({rest}, 1, coalesce(least({hits}), length({rest}) + 1) - 1), '~:：-—') else '' end)"


SPACED = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


@query(f"select doc_id, sha256({SPACED.format('text')}) as h, length({SPACED.format('text')}) as n from documents")
def normalize_whitespace(spark, sf_dir):
    (d,) = views(spark, sf_dir, "documents")
    t = text.normalize_whitespace(F.col("text"))
    return d.select("doc_id", F.sha2(t, 256).alias("h"), F.length(t).cast("long").alias("n"))


@query(f"select doc_id, sha256({sql_match('text')}) as h from documents")
def normalize_match_text(spark, sf_dir):
    (d,) = views(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.normalize_match_text(F.col("text")), 256).alias("h"))


@query(f"select doc_id, {sql_ocr('text')} as key from v_approvals")
def normalize_ocr_text(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    return a.select("doc_id", text.normalize_ocr_text(F.col("text")).alias("key"))


@query("select case_id, translate(translate(cast(case_id as varchar), '0123456789', '０１２３４５６７８９'), '０１２３４５６７８９', '0123456789') || '-' || area as key from v_cases")
def normalize_digits(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    wide = F.translate(F.col("case_id").cast("string"), text.DIGITS, text.FULL_WIDTH)
    return c.select("case_id", F.concat(text.normalize_digits(wide), F.lit("-"), "area").alias("key"))


@query("""select doc_id, cast(length(regexp_replace(text, '[^一-鿿]', '', 'g')) as bigint) as n,
  case when length(regexp_replace(text, '[^一-鿿]', '', 'g')) >= 10 then 'plain' else 'recognised' end as source from v_approvals""")
def count_cjk_chars(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    source = F.when(text.best_text(F.col("text"), F.lit("ocr")) == F.col("text"), "plain").otherwise("recognised")
    return a.select("doc_id", text.count_cjk_chars(F.col("text")).cast("long").alias("n"), source.alias("source"))


@query("""select conv_id, string_agg(role, '|' order by turn) as names from conversations group by conv_id""")
def split_name_list(spark, sf_dir):
    (c,) = views(spark, sf_dir, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    plain = F.array_join(F.transform(listed, lambda x: x.role), " ； ,")
    quoted = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: F.when(x.turn % 2 == 0, x.role).otherwise(F.concat(F.lit("' "), x.role, F.lit("'")))), ", "), F.lit("]"))
    joined = c.groupBy("conv_id").agg(F.when(F.col("conv_id") % 2 == 0, plain).otherwise(quoted).alias("names"))
    return joined.select("conv_id", F.array_join(text.split_name_list(F.col("names")), "|").alias("names"))


@query(r"""select page_id, trim(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', '-', 'g'), '\s+', ' ', 'g')), '. ') as name from pages""")
def sanitize_filename(spark, sf_dir):
    (p,) = views(spark, sf_dir, "pages")
    return p.select("page_id", text.sanitize_filename(F.col("url")).alias("name"))


@query(r"""with s as (select page_id, regexp_extract(url, '([^/\\]*)$', 1) as n from pages)
select page_id, lower(regexp_replace(case when regexp_matches(n, '^.+\.[^.]+$') then regexp_extract(n, '^(.+)\.[^.]+$', 1) else n end, '[^0-9A-Za-z一-鿿]+', '', 'g')) as key from s""")
def manual_match_key(spark, sf_dir):
    (p,) = views(spark, sf_dir, "pages")
    return p.select("page_id", text.manual_match_key(F.col("url")).alias("key"))


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages""")
def capture_between(spark, sf_dir):
    (p,) = views(spark, sf_dir, "pages")
    return p.select("page_id", text.capture_between(F.col("html"), "<title>", "</title>").alias("title"))


ENDS = ("施工负责人", "影响改动消防", "影响堵塞", "危险作业", "附件", "审批记录")


@query(f"select doc_id, {sql_field(sql_match('text'), '施工内容', ENDS)} as content, {sql_field(sql_match('text'), '施工区域', ('施工开始时间', '施工开始日期'))} as area from v_approvals")
def extract_labelled_field(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    a, t = a.withColumn("t", text.normalize_match_text(F.col("text"))), F.col("t")
    return a.select("doc_id", text.labelled_field(t, "施工内容", ENDS).alias("content"), text.labelled_field(t, "施工区域", ("施工开始时间", "施工开始日期")).alias("area"))


def form_tokens(text_col: str = "form_text"):
    """The token list of a rendered form, its boxes ticked by the length of the text."""
    n = F.length(text_col)
    word = lambda value: F.struct(F.lit("text").alias("type"), F.lit(value).alias("value"))
    box = lambda on: F.struct(F.lit("sym").alias("type"), F.when(on, classify.CHECKED).otherwise("00A3").alias("value"))
    return F.array(
        word(forms.BOXES[0][1]), box(n % 3 == 0), word("是"), box(n % 3 == 1), word(forms.BOXES[1][1]), box(n % 2 == 0), word("是"), box(n % 2 == 1),
        word("三、危险作业：动火作业"), box(n % 5 == 0), word("有限空间作业"), box(n % 7 < 3), word("会投工程部意见："),
    )


def _cap(x: str, a: str, b: str) -> str:
    return rf"trim(regexp_replace(regexp_extract({x}, '(?s){a}\s*(.*?)\s*{b}', 1), '\s+', ' ', 'g'))"


@query(f"""select doc_id, {sql_field(sql_match('text'), '施工区域', ('施工开始时间', '施工开始日期'))} as area, cast(regexp_replace(regexp_extract(text, '施工开始时间：(\\d+年\\d+月\\d+)', 1), '[年月]', '-', 'g') as date) as doc_start,
 cast(regexp_replace(regexp_extract(text, '施工结束时间：(\\d+年\\d+月\\d+)', 1), '[年月]', '-', 'g') as date) as doc_end, {sql_field(sql_match('text'), '施工内容', ENDS)} as content from v_approvals""")
def approval_fields(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    return with_approval_fields(a).drop("text")


@query(rf"""select case_id, {_cap('form_text', '项目名称：', '质保单位（盖章）：')} as project, {_cap('form_text', '质保单位（盖章）：', '分包单位：')} as unit,
 {_cap('form_text', '分包单位：', '质保负责人：')} as subunit, {_cap('form_text', '质保负责人：', '联系电话：')} as manager, {_cap('form_text', '联系电话：', '施工区域：')} as manager_phone,
 {_cap('form_text', '施工区域：', '施工日期：')} as area, {_cap('form_text', '施工内容：', '施工负责人：')} as content, {_cap('form_text', '施工负责人：', '联系电话：')} as foreman,
 regexp_extract(form_text, '施工内容：.*联系电话：\s*(\d+)', 1) as foreman_phone,
 cast(regexp_replace(regexp_extract(form_text, '(\d+年\d+月\d+)日~', 1), '[年月]', '-', 'g') as date) as start_date,
 cast(regexp_replace(regexp_extract(form_text, '~(\d+年\d+月\d+)日', 1), '[年月]', '-', 'g') as date) as end_date,
 cast(cast(regexp_replace(regexp_extract(form_text, '~(\d+年\d+月\d+)日', 1), '[年月]', '-', 'g') as date) - cast(regexp_replace(regexp_extract(form_text, '(\d+年\d+月\d+)日~', 1), '[年月]', '-', 'g') as date) + 1 as integer) as days,
 case when length(form_text) % 3 = 0 then 'yes' when length(form_text) % 3 = 1 then 'no' else '' end as fire_equipment,
 case when length(form_text) % 2 = 0 then 'yes' else 'no' end as exits,
 concat_ws('、', case when length(form_text) % 5 = 0 then '动火作业' end, case when length(form_text) % 7 < 3 then '有限空间作业' end) as hazard
 from v_forms""")
def form_fields(spark, sf_dir):
    (f,) = views(spark, sf_dir, "v_forms")
    return forms.with_form_fields(f.withColumn("tokens", form_tokens()))


@query("""select case_id, case when case_id % 3 = 0 then cast(strftime(start_date, '%Y-%m-%d') as date) else start_date end as start_date, end_date, area, content from v_cases""")
def case_values(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    named = c.withColumn("case_name", ids.case_name(F.col("start_date"), F.col("content")))
    blanked = named.withColumn("content", F.when(F.col("case_id") % 2 == 0, "").otherwise(F.col("content"))).withColumn("start_date", F.when(F.col("case_id") % 3 != 0, F.col("start_date")))
    parts = ids.parsed_case_name(F.col("case_name"))
    return blanked.select("case_id", F.coalesce("start_date", parts.date).alias("start_date"), "end_date", "area", F.coalesce(F.nullif("content", F.lit("")), parts.content).alias("content"))


@query("select case_id, start_date as name_date, content as name_content from v_cases")
def parse_case_name(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    parts = ids.parsed_case_name(ids.case_name(F.col("start_date"), F.col("content")))
    return c.select("case_id", parts.date.alias("name_date"), parts.content.alias("name_content"))


@query("select case_id, strftime(start_date, '%Y-%m-%d') || '_' || content || '_质保作业申请单' as case_name from v_cases")
def build_case_name(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    return c.select("case_id", ids.case_name(F.col("start_date"), F.col("content")).alias("case_name"))


@query("select case_id, position, 'case_' || case_id || '_' || role || '_' || lpad(cast(position + 1 as varchar), cast(greatest(2, length(cast(position + 1 as varchar))) as integer), '0') || '.txt' as name from v_evidence")
def build_material_name(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_evidence")
    return e.select("case_id", "position", ids.material_name(F.concat(F.lit("case_"), F.col("case_id").cast("string")), F.col("role"), F.col("position") + 1, F.col("name")).alias("name"))


@query("""select doc_id, case when doc_id % 3 = 0 then lpad(cast(doc_id + 1 as varchar), 12, '0') else lpad(cast(doc_id as varchar), 12, '0') end as number from v_approvals""")
def extract_application_no(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    other = F.lpad((F.col("doc_id") + 1).cast("string"), 12, "0")
    own = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(ids.APPROVAL_TITLE + "_编号："), other, F.lit(".pdf"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("编号 "), F.substring(own, 1, 6), F.lit("-"), F.substring(own, 7, 6), F.lit(".pdf"))).otherwise("scan.pdf")
    content = F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("text"))
    return a.select("doc_id", ids.application_no(file, content).alias("number"))


@query("""select page_id, array_to_string(list_transform(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda x: x not in ('', '.')), lambda x: url_encode(x)), '/') as href from pages""")
def relative_href(spark, sf_dir):
    (p,) = views(spark, sf_dir, "pages")
    return p.select("page_id", text.relative_href(F.col("url")).alias("href"))


@query("select c_custkey, concat_ws(chr(10), nullif(trim(c_name), ''), case when c_custkey % 2 = 0 then cast(c_nationkey as varchar) end) as contact, coalesce('unit: ' || nullif(trim(c_name), ''), '') as unit from customer")
def contact_and_unit_text(spark, sf_dir):
    (c,) = views(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string"))
    unit = F.concat(F.lit("unit: "), F.nullif(F.btrim(text.blank(F.col("c_name"))), F.lit("")))
    return c.select("c_custkey", text.joined_nonblank(F.col("c_name"), number).alias("contact"), text.joined_nonblank(unit, separator="；\n").alias("unit"))


@query(f"""with h as (select case_id, {sql_name_hash("'case:' || case_id")} as h from v_cases) select case_id, {sql_uuid('h')} as id from h""")
def stable_ids(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    return c.select("case_id", ids.uuid5(F.concat(F.lit("case:"), F.col("case_id").cast("string"))).alias("id"))


@query(r"""with x as (select page_id, case page_id % 4 when 0 then 'a/../b/' when 1 then 'a/../../b/' when 2 then '/abs/' else './x\y/' end || coalesce(regexp_replace(url, '^[a-z]+://', ''), '') as path from pages),
y as (select page_id, replace(path, chr(92), '/') as path, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p not in ('', '.')) as parts from x),
z as (select page_id, path, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: case when p = '..' then -1 else 1 end))) as depths from y)
select page_id, starts_with(path, '/') or coalesce(list_min(depths), 0) < 0 as outside from z""")
def path_scope_check(spark, sf_dir):
    (p,) = views(spark, sf_dir, "pages")
    front = F.when(F.col("page_id") % 4 == 0, "a/../b/").when(F.col("page_id") % 4 == 1, "a/../../b/").when(F.col("page_id") % 4 == 2, "/abs/").otherwise("./x\\y/")
    path = F.concat(front, F.regexp_replace(text.blank(F.col("url")), "^[a-z]+://", ""))
    return p.select("page_id", text.leaves_root(path).alias("outside"))


@query("select case_id, start_date as s, case when case_id % 5 = 0 then start_date else end_date end as e, cast(case when case_id % 5 = 0 then 1 else end_date - start_date + 1 end as integer) as days from v_cases")
def parse_date_range(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    cjk = lambda d: F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    dotted = lambda d: F.concat(F.year(d).cast("string"), F.lit("."), F.month(d).cast("string"), F.lit(" ． "), F.dayofmonth(d).cast("string"))
    raw = F.when(F.col("case_id") % 5 == 0, cjk(F.col("start_date"))).when(F.col("case_id") % 2 == 0, F.concat(cjk(F.col("start_date")), F.lit(" 至 "), cjk(F.col("end_date")))).otherwise(F.concat(dotted(F.col("start_date")), F.lit("～"), dotted(F.col("end_date"))))
    r = dates.date_range(raw)
    return c.select("case_id", r.start.alias("s"), r.end.alias("e"), r.days.alias("days"))


@query("select case_id, case when case_id % 7 = 3 then null else start_date end as d from v_cases")
def normalize_date_token(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    d = F.col("start_date")
    raw = F.when(F.col("case_id") % 7 == 3, "2026-2-30 then").when(F.col("case_id") % 3 == 0, F.date_format(d, "'x'yyyy/M/d y")).when(F.col("case_id") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy年M月d日"))
    return c.select("case_id", dates.date_token(raw).alias("d"))


@query(r"""with t as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '\d{4}年\d{1,2}月\d{1,2}日'), lambda x: cast(regexp_replace(regexp_replace(x, '[年月]', '-', 'g'), '日', '') as date))) as ds from v_approvals)
select doc_id, array_to_string(list_sort(list_transform(ds, lambda d: cast(d as varchar))), ',') as dates from t""")
def extract_all_dates(spark, sf_dir):
    (a,) = views(spark, sf_dir, "v_approvals")
    return a.select("doc_id", F.array_join(F.transform(dates.all_dates(F.col("text")), lambda d: d.cast("string")), ",").alias("dates"))


@query("""select a.doc_id, c.start_date + cast(c.case_id % 40 as int) = c.start_date as match from v_approvals a join v_cases c on c.case_id = a.doc_id""")
def construction_dates_match(spark, sf_dir):
    a, c = views(spark, sf_dir, "v_approvals", "v_cases")
    both = dates.with_dates(a, "text").join(c, F.col("doc_id") == F.col("case_id"))
    return both.select("doc_id", dates.dates_agree(F.col("start_date"), F.col("end_date")).alias("match"))


_P = "case when d is null then 0 when d <= 0 then {0} when d <= 3 then {0} - 2 when d <= 7 then greatest(0, {0} - 4) when d <= 14 then greatest(0, {0} - 7) when d <= 31 then greatest(0, {0} - 10) else 0 end"


@query(f"""with x as (select case_id, cast(abs(end_date - start_date) as integer) as d from v_cases)
select case_id, d as delta, cast({_P.format(12)} as integer) as start_points, cast({_P.format(8)} as integer) as end_points from x""")
def date_delta_points(spark, sf_dir):
    (c,) = views(spark, sf_dir, "v_cases")
    d = dates.date_delta(F.col("start_date"), F.col("end_date"))
    return c.select("case_id", d.alias("delta"), dates.date_points(d, 12).alias("start_points"), dates.date_points(d, 8).alias("end_points"))


_NAMES = "array('.jpg', '_施工人员名单.jpg', '_有限空间申请.png', '_高处.png', '_其他.pdf', '.pdf')"


@query("""select case_id, position, case (case_id + position) % 6 when 0 then 'signed_application' when 1 then 'worker_list' when 2 then 'confined_space' when 3 then 'high_altitude' when 4 then 'special_work' end as role from v_evidence""")
def material_role_from_name(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_evidence")
    case = F.concat(F.lit("case_"), F.col("case_id").cast("string"))
    file = F.concat(case, F.element_at(F.expr(_NAMES), ((F.col("case_id") + F.col("position")) % 6 + 1).cast("int")))
    return e.select("case_id", "position", classify.material_role(file, case).alias("role"))


_LINES = "array('姓名 张 性别 男 电话 1', '质保作业申请单', '有限空间作业□☑', '高空作业申请', '动火作业：已勾选', '有限空间作业□ 高处', 'nothing')"


@query("""select doc_id, case doc_id % 7 when 0 then 'worker_list' when 1 then 'signed_application' when 2 then 'confined_space' when 3 then 'high_altitude' when 4 then 'special_work' end as role from documents""")
def classify_text_role(spark, sf_dir):
    (d,) = views(spark, sf_dir, "documents")
    line = F.concat("text", F.lit(" "), F.element_at(F.expr(_LINES), (F.col("doc_id") % 7 + 1).cast("int")))
    return d.select("doc_id", classify.text_role(line).alias("role"))


@query(r"""select doc_id, doc_id % 7 = 2 or regexp_matches(text, '有限空间作业[□：]{0,3}[☑√]') as confined, doc_id % 7 = 4 or regexp_matches(text, '动火作业[□：]{0,3}[☑√]') as hot_work from documents""")
def option_is_checked(spark, sf_dir):
    (d,) = views(spark, sf_dir, "documents")
    line = F.concat("text", F.lit(" "), F.element_at(F.expr(_LINES), (F.col("doc_id") % 7 + 1).cast("int")))
    return d.select("doc_id", classify.option_is_checked(line, "有限空间作业").alias("confined"), classify.option_is_checked(line, "动火作业").alias("hot_work"))


def _tokens(c):
    """Token lists from conversations: a turn's role is a text token, a symbol follows, checked on even lengths."""
    rows = c.select("conv_id", F.col("turn"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("text").alias("type"), F.col("role").alias("value")), F.struct(F.lit(1).alias("k"), F.lit("sym").alias("type"), F.when(F.length("text") % 2 == 0, "0052").otherwise("00A3").alias("value")))).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("t.k").alias("k"), F.col("t.type").alias("type"), F.col("t.value").alias("value"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x.type.alias("type"), x.value.alias("value"))).alias("tokens"))


@query("""with f as (select conv_id, min(case when role = 'user' then turn end) as at from conversations group by conv_id),
s as (select c.conv_id, c.turn, length(c.text) % 2 = 0 as on_, row_number() over (partition by c.conv_id order by turn) as n from conversations c join f on f.conv_id = c.conv_id and c.turn >= f.at),
x as (select conv_id, max(case when n = 1 then on_ end) as a, max(case when n = 2 then on_ end) as b, count(*) as k from s group by conv_id)
select f.conv_id, case when x.k is null or x.k < 2 then '' when a then 'yes' when b then 'no' else '' end as state from f left join x on x.conv_id = f.conv_id""")
def checkbox_state(spark, sf_dir):
    (c,) = views(spark, sf_dir, "conversations")
    return _tokens(c).select("conv_id", classify.checkbox_state(F.col("tokens"), "user").alias("state"))


@query("""with o as (select conv_id, min(case when role = 'system' then turn end) as s from conversations group by conv_id),
u as (select o.conv_id, o.s, (select min(turn) from conversations c where c.conv_id = o.conv_id and c.role = 'user' and o.s is not null and turn > o.s) as u1,
  (select min(turn) from conversations c where c.conv_id = o.conv_id and c.role = 'user') as u0 from o),
p as (select u.conv_id, s, case when s is null then null else u1 end as u from u),
q as (select p.*, (select min(turn) from conversations c where c.conv_id = p.conv_id and c.role = 'assistant' and p.u is not null and turn > p.u) as a from p)
select q.conv_id, concat_ws('、',
  case when exists (select 1 from conversations c where c.conv_id = q.conv_id and c.turn = q.s and c.role = 'system' and length(c.text) % 2 = 0) then 'system' end,
  case when exists (select 1 from conversations c where c.conv_id = q.conv_id and c.turn = q.u and c.role = 'user' and length(c.text) % 2 = 0) then 'user' end,
  case when exists (select 1 from conversations c where c.conv_id = q.conv_id and c.turn = q.a and c.role = 'assistant' and length(c.text) % 2 = 0) then 'assistant' end) as picked from q""")
def selected_options(spark, sf_dir):
    (c,) = views(spark, sf_dir, "conversations")
    return _tokens(c).select("conv_id", F.array_join(classify.selected_options(F.col("tokens"), ("system", "user", "assistant")), "、").alias("picked"))


@query("""select doc_id, true as is_approval, case doc_id % 4 when 0 then 'name_number' when 1 then 'name_title' else 'text_title_and_number' end as rule from v_approvals
union all select doc_id, false, 'none' from documents""")
def classify_approval(spark, sf_dir):
    a, d = views(spark, sf_dir, "v_approvals", "documents")
    file = F.when(F.col("doc_id") % 4 == 0, "工程类-主体质保施工_编号：123456789012.PDF").when(F.col("doc_id") % 4 == 1, "工程类主体质保施工 2.pdf").otherwise("scan.pdf")
    both = a.select("doc_id", file.alias("file"), "text").unionByName(d.select("doc_id", F.lit("x.pdf").alias("file"), "text"))
    return classify.with_approval_kind(both, F.col("file"), F.col("text")).select("doc_id", "kind.is_approval", "kind.rule")


@query("""select p_partkey, 'word,signed_application,worker_list,safety_agreement' || case when p_partkey % 3 = 0 then ',confined_space' else '' end || case when p_partkey % 3 = 1 then ',special_work' else '' end as roles from part""")
def required_roles(spark, sf_dir):
    (p,) = views(spark, sf_dir, "part")
    hazard = F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, "有限空间作业").when(F.col("p_partkey") % 3 == 1, "动火作业、危大工程").otherwise(""))
    return p.select("p_partkey", F.array_join(classify.required_roles(hazard), ",").alias("roles"))


@query("""with r as (select conv_id, max(case when role = 'system' then 1 else 0 end) as s, max(case when role = 'user' then 1 else 0 end) as u, max(case when role = 'assistant' then 1 else 0 end) as a from conversations group by conv_id)
select conv_id, concat_ws(',', case when s = 0 then 'system' end, case when u = 0 then 'user' end) as missing, case when a = 1 then 'assistant' else '' end as unexpected,
 case when s = 0 or u = 0 then 'missing' when a = 0 then 'consistent' else 'consistent_with_extras' end as verdict from r""")
def hazard_evidence_review(spark, sf_dir):
    (c,) = views(spark, sf_dir, "conversations")
    r = classify.hazard_review(F.array(F.lit("system"), F.lit("user")), F.col("present"))
    present = c.where(F.col("role").isin("system", "user", "assistant")).groupBy("conv_id").agg(F.collect_set("role").alias("present"))
    return present.select("conv_id", F.array_join(r.missing, ",").alias("missing"), F.array_join(r.unexpected, ",").alias("unexpected"), r.verdict.alias("verdict"))
