"""Views over the given tables that stand for cases, forms, approvals and evidence.

The statements run in Spark SQL and, as common table expressions, in the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .materialize import new_folder

TABLES = ("nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_cases": """with f as (select l_orderkey, min(l_linenumber) as ln, cast(min(l_shipdate) as date) as s, cast(max(l_shipdate) as date) as e
           from lineitem group by l_orderkey),
     g as (select f.l_orderkey, f.s, f.e, min(l.l_partkey) as pk
           from f join lineitem l on l.l_orderkey = f.l_orderkey and l.l_linenumber = f.ln
           group by f.l_orderkey, f.s, f.e)
select o.o_orderkey as case_id,
       n.n_name || '-L' || cast(o.o_custkey % 5 as varchar(10)) as area,
       p.p_name as content, g.s as start_date, g.e as end_date,
       case when o.o_orderkey % 11 = 5 then 'terminated'
            when o.o_orderkey % 7 = 0 then 'approved' else 'open' end as status,
       c.c_name as contact, p.p_type as hazard
from orders o join g on g.l_orderkey = o.o_orderkey
join customer c on c.c_custkey = o.o_custkey
join nation n on n.n_nationkey = c.c_nationkey
join part p on p.p_partkey = g.pk""",
    "v_approvals": """with a as (select case_id as doc_id,
       case when case_id % 50 = 23 then 'NOWHERE' when case_id % 20 = 3 then replace(area, '-L', '-i') else area end as area,
       case when case_id % 50 = 13 then 'unlisted work' else content end as content,
       start_date + cast(case_id % 40 as int) as s, end_date as e
     from v_cases)
select doc_id,
  '工程类-主体质保施工 申请编号：' || lpad(cast(doc_id as varchar(20)), 12, '0') || ' 施工区域：' || area ||
  ' 施工开始时间：' || cast(year(s) as varchar(4)) || '年' || cast(month(s) as varchar(2)) || '月' || cast(day(s) as varchar(2)) || '日' ||
  ' 施工结束时间：' || cast(year(e) as varchar(4)) || '年' || cast(month(e) as varchar(2)) || '月' || cast(day(e) as varchar(2)) || '日' ||
  ' 施工内容：' || content || '及现场清理 施工负责人：甲' as text
from a""",
    "v_forms": """select case_id, '项目名称：P' || cast(case_id % 9 as varchar(10)) || ' 质保单位（盖章）：' || contact || ' 分包单位： 质保负责人：' || contact ||
  ' 联系电话：' || lpad(cast(case_id as varchar(20)), 11, '1') || ' 施工区域：' || area || ' 施工日期：' ||
  cast(year(start_date) as varchar(4)) || '年' || cast(month(start_date) as varchar(2)) || '月' || cast(day(start_date) as varchar(2)) || '日~' ||
  cast(year(end_date) as varchar(4)) || '年' || cast(month(end_date) as varchar(2)) || '月' || cast(day(end_date) as varchar(2)) || '日 施工内容：' ||
  content || ' 施工负责人：乙 联系电话：' || lpad(cast(case_id as varchar(20)), 11, '2') || ' 一、影响、改动消防设备设施' as form_text
from v_cases""",
    "v_evidence": """select conv_id as case_id, role, turn as position, 'case_' || cast(conv_id as varchar(10)) || '_' || role || '_' || cast(turn as varchar(10)) || '.txt' as name,
  text, length(text) as size from conversations""",
    "v_case_status": """select case_id, max(case when role = 'system' then 1 else 0 end) as has_system,
  max(case when role = 'user' then 1 else 0 end) as has_user,
  max(case when role = 'assistant' then 1 else 0 end) as has_assistant, count(*) as files,
  case when case_id % 11 = 5 then 'terminated' when case_id % 7 = 0 then 'approved'
       when count(distinct role) < 3 then 'materials_incomplete' else 'materials_ready' end as status
from v_evidence group by case_id""",
}

#: What Spark reads in place of v_cases' first two steps: the same rows with one shuffle of the line items, which are not joined with their own aggregate.
#: The part is that of the least line number, of several the least one that isn't null.
_FIRST_LINES = """with g as (select l_orderkey, cast(min(l_shipdate) as date) as s, cast(max(l_shipdate) as date) as e,
           min(struct(l_linenumber, l_partkey is null as lacks, l_partkey)) filter (where l_linenumber is not null).l_partkey as pk
           from lineitem group by l_orderkey)
"""
#: Views made of cases: where several are asked for, cases are worked out once and read again, from files that are a task's work each.
_OF_CASES, _FILE_ROWS = ("v_cases", "v_approvals", "v_forms"), 100_000
SPARK_VIEWS = VIEWS | {"v_cases": _FIRST_LINES + VIEWS["v_cases"][VIEWS["v_cases"].index("select o.o_orderkey") :]}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views or tables over the Parquet files below sf_dir."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, statement in SPARK_VIEWS.items():
        rows = spark.sql(statement)
        if name == "v_cases" and sum(n in _OF_CASES for n in names) > 1:
            path = new_folder(spark, name)
            rows.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
        rows.createOrReplaceTempView(name)
    return [spark.table(name) for name in names]


def with_views(sql: str) -> str:
    """sql with the views in front that it names."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in used:
                need(VIEWS[name])
                used.append(name)

    need(sql)
    if not used:
        return sql
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    rest = sql.strip()
    return f"with {ctes}, {rest[5:]}" if rest.lower().startswith("with ") else f"with {ctes} {rest}"
