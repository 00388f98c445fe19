"""Queries: answer consistency (parsing, tolerant comparison, summary)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions import answers as A
from stepwise.functions.text import py_strip_sql
from stepwise.operators import answers as AN
from stepwise.plans.fixtures import fixture, read_table, with_fixtures
from stepwise.plans.registry import register, rounded
from stepwise.session import scratch_path, written
from stepwise.sources.records import read_report, write_records, write_report


def _sides(spark, sf):
    fa = fixture(spark, sf, "f_answer")
    return fa.where("side = 'p'").select("id", "answer"), fa.where("side = 'g'").select("id", "answer")


def _blank_sql(c):
    return f"({c} is null or length({py_strip_sql(c)}) = 0)"


_RECORDS = f"""
, p as (select id, answer from f_answer where side = 'p' and id is not null),
g as (select id, answer from f_answer where side = 'g' and id is not null),
j as (select coalesce(p.id, g.id) as id, p.answer as pred_answer, g.answer as gt_answer,
             p.id is not null as inp, g.id is not null as ing from p full outer join g on p.id = g.id),
s as (select *, case when inp and not ing then 'only_in_pred' when ing and not inp then 'only_in_gt'
                     when {_blank_sql('pred_answer')} then 'pred_missing_answer'
                     when {_blank_sql('gt_answer')} then 'gt_missing_answer' else 'compared' end as status from j),
v as (select *, case when status = 'compared' then {A.simple_number_sql('pred_answer')} end as pv,
                case when status = 'compared' then {A.simple_number_sql('gt_answer')} end as gv,
                {A.strip_wrappers_sql('pred_answer')} as pn, {A.strip_wrappers_sql('gt_answer')} as gn from s),
r as (select id, pred_answer, gt_answer, status,
             case when status <> 'compared' then false
                  when pv is not null and gv is not null then {A.values_close_sql('pv', 'gv')}
                  else pn = gn end as match,
             case status when 'only_in_pred' then 'id only exists in prediction file'
                         when 'only_in_gt' then 'id only exists in ground-truth file'
                         when 'pred_missing_answer' then 'prediction answer missing'
                         when 'gt_missing_answer' then 'ground-truth answer missing'
                         else case when pv is not null and gv is not null then 'numeric compare'
                                   else 'string fallback: ''' || pn || ''' vs ''' || gn || '''' end end as reason,
             case when status = 'compared' and pv is not null and gv is not null then pv end as pred_value,
             case when status = 'compared' and pv is not null and gv is not null then gv end as gt_value
      from v)
"""


@register("answer_records", with_fixtures(_RECORDS + """
select id, pred_answer, gt_answer, status, match, reason, round(pred_value, 6) as pred_value, round(gt_value, 6) as gt_value from r
""", "f_answer"))
def q_answer_records(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(AN.compare_answers(p, g))


@register("answer_summary", with_fixtures(_RECORDS + """
select (select count(*) from f_answer where side = 'p') as pred_samples,
       (select count(*) from f_answer where side = 'g') as gt_samples,
       count(*) filter (where status in ('compared', 'pred_missing_answer', 'gt_missing_answer')) as id_overlap,
       count(*) filter (where status = 'only_in_pred') as only_in_pred,
       count(*) filter (where status = 'only_in_gt') as only_in_gt,
       count(*) filter (where status = 'pred_missing_answer') as pred_missing_answer,
       count(*) filter (where status = 'gt_missing_answer') as gt_missing_answer,
       count(*) filter (where status = 'compared') as comparable_samples,
       count(*) filter (where status = 'compared' and match) as matched_samples,
       round(coalesce(count(*) filter (where status = 'compared' and match) / nullif(count(*) filter (where status = 'compared'), 0), 0.0), 6) as accuracy,
       1e-9 as abs_tol, 1e-9 as rel_tol
from r
""", "f_answer"))
def q_answer_summary(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(AN.answer_summary(AN.compare_answers(p, g), p, g), 12)


@register("answer_report", with_fixtures(_RECORDS + """
select id, pred_answer, gt_answer, status, match, reason, round(pred_value, 6) as pred_value, round(gt_value, 6) as gt_value from r
where status <> 'compared' or not match
""", "f_answer"))
def q_answer_report(spark, sf):
    """A report written as one version and read back; a version without a marker is not seen."""
    p, g = _sides(spark, sf)
    records = written(rounded(AN.compare_answers(p, g)), "answer-records")
    path = scratch_path(spark, "report")
    wrong = records.where("status <> 'compared' or not match")
    write_report(AN.answer_summary(records, p, g), records, path, wrong=wrong)
    write_records(records, f"{path}/versions/broken-off/wrong")
    return read_report(spark, path, "wrong", schema=records.schema)


@register("answer_id_sets", with_fixtures("""
, p as (select distinct id from f_answer where side = 'p' and id is not null),
g as (select distinct id from f_answer where side = 'g' and id is not null)
select coalesce(p.id, g.id) as id,
       case when p.id is not null and g.id is not null then 'both' when p.id is not null then 'only_pred' else 'only_gt' end as membership
from p full outer join g on p.id = g.id
""", "f_answer"))
def q_answer_id_sets(spark, sf):
    p, g = _sides(spark, sf)
    return AN.id_sets(p, g)


@register("gt_answer_map", with_fixtures(f"""
select id, {py_strip_sql('answer')} as answer from f_answer where side = 'g' and id is not null and answer is not null
""", "f_answer"))
def q_gt_answer_map(spark, sf):
    _, g = _sides(spark, sf)
    return AN.gold_answer_map(g)


@register("answer_expr_values", with_fixtures(f"""
select expr, round(value, 6) as value from (select distinct expr, value from f_expr) x
union all
select distinct {A.strip_wrappers_sql('answer')}, cast(null as double) from f_answer
where not {_blank_sql('answer')} and {A.simple_number_sql('answer')} is null
""", "f_answer", "f_expr"))
def q_answer_expr_values(spark, sf):
    """Distinct answers that are no plain numbers, with their value as expressions."""
    texts = fixture(spark, sf, "f_answer").select("answer").unionByName(fixture(spark, sf, "f_expr").select("answer"))
    return rounded(AN.unresolved_expression_values(texts.where(F.col("answer").isNotNull())))


@register("answer_expr_records", with_fixtures("""
select id, 'compared' as status, k = 7 or value is not null as match,
       round(case when k <> 7 then value end, 6) as pred_value, round(case when k <> 7 then value end, 6) as gt_value
from f_expr
""", "f_expr"))
def q_answer_expr_records(spark, sf):
    """Expressions compared with an equivalent notation; where there is no value, their texts are."""
    fe = fixture(spark, sf, "f_expr")
    out = AN.compare_answers(fe.select("id", "answer"), fe.select("id", F.col("same").alias("answer")))
    return rounded(out.select("id", "status", "match", "pred_value", "gt_value"))


_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]


@register("dedup_last", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) as l_quantity,
       round(l_extendedprice, 6) as l_extendedprice, l_returnflag, l_linestatus
from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber
                           order by """ + ", ".join(f"{c} desc" for c in _LI_ORDER) + """) = 1
""")
def q_dedup_last(spark, sf):
    li = read_table(spark, sf, "lineitem")
    keyed = li.select(F.struct("l_orderkey", "l_linenumber").alias("k"),
                      F.struct(*_LI_ORDER).alias("ord"),
                      "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    kept = AN.keep_last(keyed, "k", "ord")
    return rounded(kept.select("k.l_orderkey", "k.l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                               "l_extendedprice", "l_returnflag", "l_linestatus"))
