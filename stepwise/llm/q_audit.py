"""Queries of the filter audit, the secret scan and hard-negative mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import filter_audit, hard_negatives, secret_scan
from stepwise.llm.common import table


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = filter_audit.standard_filters(F.col("text"))
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters)
    return filter_audit.audit(masks, list(filters))


OP11_SQL = r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
      from labels group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(words) < 100 then 1 else 0 end
         + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
         + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
         + case when t.doc_id > first_id then 16 else 0 end as mask
  from t left join l on t.doc_id = l.doc_id),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from f a join f b on b.bit <> a.bit join f c on c.bit not in (a.bit, b.bit) join f d on d.bit not in (a.bit, b.bit, c.bit)
  join f e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
s as (
  select filter_order, step::int as step, f.bit,
         coalesce((select sum(g.bit) from f g where position(g.letter in filter_order) < step), 0)::int as before
  from o, range(1, 6) r(step) join f on f.letter = substr(filter_order, step::int, 1)),
x as (
  select part, filter_order, step, bit,
         sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
         sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
         sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
         sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
         sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
         sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from x
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secret_scan.scan(docs)
    counts = [secret_scan.count_of(F.col("base_spans"), k.name).alias(f"n_{k.name}") for k in secret_scan.BASE]
    return rows.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"),
                       secret_scan.listed(F.col("spans")).alias("spans"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_matches(name: str, pattern: str, group: int) -> str:
    """Matches with their places: the lengths of the gaps and matches before, by window sums."""
    p = _sql_text(pattern)
    return f"""
{name}_m as (
  select doc_id, unnest(regexp_extract_all(text, {p})) as m, unnest(regexp_extract_all(text, {p}, {group})) as v,
         unnest(list_slice(string_split_regex(text, {p}), 1, len(regexp_extract_all(text, {p})))) as gap,
         generate_subscripts(regexp_extract_all(text, {p}), 1) as i
  from d),
{name} as (
  select doc_id, v, i, m, (sum(length(gap) + length(m)) over (partition by doc_id order by i))::bigint as stop from {name}_m)"""


def _op12_sql() -> str:
    parts = ["d as (select doc_id, coalesce(text, '') as text from documents)"]
    spans = []
    patterns = {"assign": secret_scan.ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}  # as stated; short matches are dropped
    for rank, k in enumerate(secret_scan.BASE):
        parts.append(_sql_matches(k.name, patterns[k.name], k.group))
        spans.append(f"select doc_id, stop - length(m) as start, {rank} as rank, stop, '{k.name}' as kind from {k.name} where length(v) >= {k.least}")
    parts.append(f"b as ({' union all '.join(spans)})")
    parts.append(_sql_matches("run", secret_scan.CANDIDATES, 3))
    parts.append(f"open_ as (select doc_id, i, v, stop - length(m) as pos from run where v <> '' and not regexp_matches(v, {_sql_text(secret_scan.ALLOW)}))")
    done = "false"
    more = []
    for rank, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        whole = f"regexp_matches(v, '^{c.alphabet}{{{c.window},}}$')"
        table_ = secret_scan.entropy_table(c.window)
        parts.append(f"""
{c.name}_w as (select doc_id, i, pos, v, unnest(range(0, length(v) - {c.window - 1})) as w from open_ where {whole} and not ({done})),
{c.name}_k as (select doc_id, i, pos, w, unnest(string_split(substr(v, w + 1, {c.window}), '')) as ch from {c.name}_w),
{c.name}_n as (select doc_id, i, pos, w, ch, count(*) as n from {c.name}_k group by all),
{c.name}_h as (select doc_id, i, pos, w from {c.name}_n group by all having sum(({table_})[n + 1]) <= {secret_scan.entropy_limit(c.window, c.bits)}),
{c.name}_g as (select *, case when w - lag(w) over (partition by doc_id, i order by w) <= {c.window} then 0 else 1 end as fresh from {c.name}_h),
{c.name}_s as (select *, sum(fresh) over (partition by doc_id, i order by w) as g from {c.name}_g)""")
        more.append(f"select doc_id, min(pos + w) as start, {rank} as rank, max(pos + w) + {c.window} as stop, '{c.name}' as kind "
                    f"from {c.name}_s group by doc_id, i, g")
        done = f"{done} or {whole}"
    parts.append(f"e as (select * from b union all {' union all '.join(more)})")
    line = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
    counts = ", ".join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in secret_scan.BASE)
    parts.append(f"bs as (select doc_id, {counts}, {line} as listed from b group by doc_id)")
    parts.append(f"es as (select doc_id, {line} as listed from e group by doc_id)")
    zeros = ", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in secret_scan.BASE)
    return (f"with {', '.join(parts)} select d.doc_id, {zeros}, sha256(coalesce(bs.listed, '')) as base_sha256, "
            "coalesce(es.listed, '') as spans from d left join bs on d.doc_id = bs.doc_id left join es on d.doc_id = es.doc_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, id, score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id))::int as rank,
       s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify rank <= 3
"""

QUERIES = {"op11_filter_audit": op11_filter_audit, "op12_secret_scan": op12_secret_scan, "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op11_filter_audit": OP11_SQL, "op12_secret_scan": _op12_sql(), "op13_hard_negatives": OP13_SQL}
