"""Stand-in inputs derived from the driver's tables.

The evaluation sets the jobs were written for are not shipped, so each
fixture below derives an input of the right shape from the TPC-H-ish tables.
The text is a ``str.format`` template whose fields are table names: Spark
receives the tables as DataFrame arguments of ``spark.sql`` (no global
views are registered), the DuckDB oracle receives the bare view names.
Literal braces are doubled.

The fixtures read whole tables: no id subsets or row caps.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

FIXTURE_SQL: dict[str, str] = {}

# one row per step; question = first user turn; a question without steps has one row with null step_index and step
FIXTURE_SQL["f_chain"] = """
select q.conv_id as id, s.step_index, q.text as question, s.step
from (select conv_id, min(turn) as t0 from {conversations} where role = 'user' group by conv_id) f
join {conversations} q on q.conv_id = f.conv_id and q.turn = f.t0
left join (
  select c.conv_id, cast(row_number() over (partition by c.conv_id order by c.turn) - 1 as int) as step_index, c.text as step
  from {conversations} c
  join (select conv_id, min(turn) as t0 from {conversations} where role = 'user' group by conv_id) g on c.conv_id = g.conv_id
  where c.turn <> g.t0 and c.role <> 'system') s on s.conv_id = q.conv_id
"""

# scored steps with missing scores (source key is not unique, hence distinct)
FIXTURE_SQL["f_step"] = """
select orig_id, step_index,
       case when (orig_id + step_index) % 17 = 0 then null
            else cast((orig_id * 7 + step_index * 3) % 9 as double) / 8 end as avg_score
from (select distinct l_orderkey as orig_id, l_linenumber - 1 as step_index from {lineitem}) v
"""

# -1 means no error
FIXTURE_SQL["f_gold"] = """
select o_orderkey as id, case when o_orderkey % 3 = 0 then -1 else cast(o_orderkey % 7 as int) end as label
from {orders}
"""

# eight generations per step, some unparsable, some in variant spelling
FIXTURE_SQL["f_vote"] = """
select orig_id, step_index, gen_idx,
       case when (orig_id + step_index * 3 + gen_idx * 5) % 11 = 0 then 'no verdict given'
            when (orig_id + gen_idx) % 13 = 0 then 'VERIFICATION: is  the step correct (Yes/No)? no'
            when (orig_id + gen_idx) % 5 = 0 then 'Verification: Is the step correct (Yes/No)? Yes. Verification: Is the step correct (Yes/No)? No'
            when (orig_id + step_index + gen_idx) % 2 = 0 then 'Verification: Is the step correct (Yes/No)? Yes'
            else 'Verification: Is the step correct(Yes/No)? No' end as output
from (select orig_id, step_index, <<series 0 7>> as gen_idx
      from (select distinct l_orderkey as orig_id, l_linenumber - 1 as step_index from {lineitem}) d) v
"""

# reward hits 0.5 exactly for discount 0.05
FIXTURE_SQL["f_prm"] = """
select l_orderkey as original_id, l_linenumber as step_id, min(l_linestatus) = 'O' as is_error,
       min(l_returnflag) as classification, min(l_discount) * 10 as reward
from {lineitem} group by l_orderkey, l_linenumber
"""

# predictions (side = 'p') and gold (side = 'g') in mixed notations; chr(92) is a backslash
FIXTURE_SQL["f_answer"] = """
select 'p' as side, o_orderkey as id,
       case o_orderkey % 6 when 0 then cast(o_orderkey % 20 as string)
            when 1 then concat('$', cast(o_orderkey % 20 as string), '$')
            when 2 then concat(chr(92), 'frac{{', cast(o_orderkey % 9 as string), '}}{{4}}')
            when 3 then concat('x = ', cast(o_orderkey % 20 as string), '.')
            when 4 then case o_orderkey % 4 when 0 then '' else concat('case ', cast(o_orderkey % 3 as string)) end
            else concat(case when o_orderkey % 4 = 1 then 'x = y = ' else '' end, cast(o_orderkey % 20 as string), '%') end as answer
from {orders} where o_orderkey % 10 <> 0
union all
select 'g', o_orderkey,
       case when o_orderkey % 6 = 2 then concat(cast(o_orderkey % 9 as string), '/4')
            when o_orderkey % 11 = 0 then null
            when o_orderkey % 6 = 4 and o_orderkey % 4 <> 0 then concat('case ', cast(o_orderkey % 2 as string))
            when o_orderkey % 6 = 5 then concat(cast((o_orderkey % 20) as string), 'e-2')
            else cast(o_orderkey % 20 as string) end
from {orders} where o_orderkey % 7 <> 0 or o_orderkey % 10 = 0
"""

# answers that are arithmetic expressions, an equivalent notation, the text left after normalising, and the value
FIXTURE_SQL["f_expr"] = """
select id, k,
       case k when 0 then concat(a, '*sqrt(', b, ')') when 1 then concat('$', a, '^2$') when 2 then concat('pi/', d)
              when 3 then concat('(', a, '+', b, ')/(', c, '-2)') when 4 then concat('-', a, '**2+', b) when 5 then concat('2^-', c, '^2')
              when 6 then concat(chr(92), 'frac{{', chr(92), 'frac{{', a, '}}{{', d, '}}}}{{', d, '}}') else concat(a, 'x+', b) end as answer,
       case k when 0 then concat('sqrt( ', b, ' ) * ', a) when 1 then concat(a, ' * ', a) when 2 then concat('2*pi/(', d, '+', d, ')')
              when 3 then concat('(', b, '--', a, ')/-(2-', c, ')') when 4 then concat(b, '-', a, '*', a) when 5 then concat('1/2^(', c, '*', c, ')')
              when 6 then concat(a, '/', d, '/', d) else concat(a, 'x+', b) end as same,
       case k when 0 then concat(a, '*sqrt(', b, ')') when 1 then concat(a, '^2') when 2 then concat('pi/', d)
              when 3 then concat('(', a, '+', b, ')/(', c, '-2)') when 4 then concat('-', a, '**2+', b) when 5 then concat('2^-', c, '^2')
              when 6 then concat('((', a, ')/(', d, '))/(', d, ')') else concat(a, 'x+', b) end as expr,
       case k when 0 then na * sqrt(cast(nb as double)) when 1 then cast(na * na as double) when 2 then pi() / nd
              when 3 then case when nc <> 2 then cast(na + nb as double) / (nc - 2) end when 4 then cast(nb - na * na as double)
              when 5 then power(cast(2 as double), -nc * nc) when 6 then cast(na as double) / nd / nd end as value
from (select id, k, na, nb, nc, nd, cast(na as string) as a, cast(nb as string) as b, cast(nc as string) as c, cast(nd as string) as d
      from (select o_orderkey as id, o_orderkey % 8 as k, o_custkey % 20 as na, o_custkey % 7 as nb, o_custkey % 3 as nc, o_custkey % 9 + 1 as nd
            from {orders}) n) t
"""

# generator (side = 'g') and discriminator (side = 'd') as raw JSON; answer may be absent, null or set
FIXTURE_SQL["f_buffer"] = """
select 'g' as side, o_orderkey as id,
       concat('{{"id":', cast(o_orderkey as string), ',"problem":"P', cast(o_orderkey as string), '","steps":[]',
              case o_orderkey % 4 when 0 then ',"answer":null' when 1 then concat(',"answer":"', cast(o_orderkey % 9 as string), '"') else '' end, '}}') as raw
from {orders} where o_orderkey % 6 <> 0
union all
select 'd', o_orderkey,
       concat('{{"id":', cast(o_orderkey as string), ',"problem":"D', cast(o_orderkey as string), '"',
              case when o_orderkey % 8 = 3 then ',"answer":"7"' else '' end,
              case when o_orderkey % 3 = 0 then ',"candidates":[]' else ',"candidates":["a","b"]' end, '}}')
from {orders} where o_orderkey % 5 <> 0 or o_orderkey % 6 = 0
"""

# eight candidates per sample with tied rewards and zero, one or two boxed answers
FIXTURE_SQL["f_cand"] = """
select c_custkey as id, idx as candidate_idx, cast((c_custkey * 5 + idx * 3) % 4 as double) / 4 as reward,
       concat('so we get ', case (c_custkey + idx) % 3 when 0 then concat(chr(92), 'boxed{{', cast(c_custkey % 12 as string), '}}')
            when 1 then concat(chr(92), 'boxed{{', chr(92), 'frac{{1}}{{', cast(idx + 2 as string), '}}}}') else 'nothing' end,
            case when c_custkey % 7 = 0 then concat(' or ', chr(92), 'boxed{{0}}') else '' end) as candidate
from (select c_custkey, <<series 0 7>> as idx from {customer}) g
"""

# four log-probability columns, batches of uneven size; the /16 keeps the two rank-based losses distinct
FIXTURE_SQL["f_pairlogp"] = """
select l_orderkey * 10 + l_linenumber as pair_id, l_orderkey % 64 as batch_id,
       -min(l_quantity) / 10 as chosen_logps, -min(l_quantity) / 10 - min(l_discount) * 20 + 1 as rejected_logps,
       -min(l_quantity) / 10 - min(l_tax) * 5 as ref_chosen_logps, -min(l_quantity) / 16 - 0.25e0 as ref_rejected_logps
from {lineitem} group by l_orderkey, l_linenumber
"""

# token-level log-probabilities, ragged lengths, prompt tokens outside the loss
FIXTURE_SQL["f_toklogp"] = """
select pair_id, side, pos, (pair_id + pos * 3) % 50 as token_id,
       -cast((pair_id * 7 + pos * 3 + side) % 17 as double) / 16 as logp,
       -cast((pair_id + pos) % 5 as double) / 8 as lse2, pos >= 2 + pair_id % 3 as in_loss
from (select pair_id, side, <<series 0 11>> as pos
      from (select o_orderkey as pair_id, <<series 0 1>> as side from {orders}) s) p
where pos < 6 + (pair_id + side * 3) % 7
"""

# user turn followed by an assistant turn
FIXTURE_SQL["f_sft"] = """
select conv_id, turn, instruction, output
from (select conv_id, turn, role, text as instruction,
             lead(role) over (partition by conv_id order by turn) as next_role,
             lead(text) over (partition by conv_id order by turn) as output from {conversations}) x
where role = 'user' and next_role = 'assistant'
"""

# good document vs poor document of the same language, aligned by rank
FIXTURE_SQL["f_pref"] = """
select case when c.n_good >= c.n_poor then c.doc_id else r.doc_id end as pair_id,
       c.lang as prompt, c.text as chosen, r.text as rejected
from (select d.doc_id, d.lang, d.text, row_number() over (partition by d.lang order by d.doc_id) as rk, n_good, n_poor
      from {documents} d join {labels} l on d.doc_id = l.doc_id join (
           select e.lang, count(case when m.quality = 1 then 1 end) as n_good, count(case when m.quality = 0 then 1 end) as n_poor
           from {documents} e join {labels} m on e.doc_id = m.doc_id group by e.lang) n on d.lang = n.lang
      where l.quality = 1 and n_good > 0 and n_poor > 0) c
join (select d.doc_id, d.lang, d.text, row_number() over (partition by d.lang order by d.doc_id) as rk
      from {documents} d join {labels} l on d.doc_id = l.doc_id where l.quality = 0) r
  on c.lang = r.lang and (c.rk - 1) % least(c.n_good, c.n_poor) = (r.rk - 1) % least(c.n_good, c.n_poor)
"""

_FIELD = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")
# A fixed number of copies of each row: a generator in the select list
# (never a cross join).  Spark: explode(sequence(a, b)) (int); DuckDB: unnest(range(a, b + 1)) cast to int.
_SERIES = re.compile(r"<<series (\d+) (\d+)>>")


def _series(template: str, dialect: str) -> str:
    if dialect == "spark":
        return _SERIES.sub(lambda m: f"explode(sequence({m.group(1)}, {m.group(2)}))", template)
    return _SERIES.sub(lambda m: f"cast(unnest(range({m.group(1)}, {int(m.group(2)) + 1})) as integer)", template)


def tables_of(template: str) -> list[str]:
    return sorted(set(_FIELD.findall(template)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, template: str, **frames: DataFrame) -> DataFrame:
    """Run a template in Spark; table fields resolve to parquet scans."""
    args = {}
    for t in tables_of(template):
        args[t] = frames[t] if t in frames else read_table(spark, sf_dir, t)
    return spark.sql(_series(template, "spark"), **args)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in FIXTURE_BUILDERS:
        return FIXTURE_BUILDERS[name](spark, sf_dir)
    return spark_sql(spark, sf_dir, FIXTURE_SQL[name])


def _f_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-pref without one task per language: keys are ranked and paired, texts join last.

    The smaller class of a language is used again and again until each
    document of the larger one has its pair.
    """
    from pyspark.sql import functions as F

    from stepwise.operators.ordering import row_number_within
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    lab = docs.drop("text").join(labels, "doc_id")
    sizes = lab.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("n_good"),
                                    F.count_if(F.col("quality") == 0).alias("n_poor")).where("n_good > 0 and n_poor > 0")
    ranked = (row_number_within(lab, ["lang", "quality"], ["doc_id"], "rk").join(sizes, "lang")
              .withColumn("slot", (F.col("rk") - 1) % F.least("n_good", "n_poor")))
    good = ranked.where("quality = 1").select("lang", "slot", "n_good", "n_poor", F.col("doc_id").alias("good_id"))
    poor = ranked.where("quality = 0").select("lang", "slot", F.col("doc_id").alias("poor_id"))
    pair = F.when(F.col("n_good") >= F.col("n_poor"), F.col("good_id")).otherwise(F.col("poor_id"))
    return (good.join(poor, ["lang", "slot"]).select(pair.alias("pair_id"), F.col("lang").alias("prompt"), "good_id", "poor_id")
            .join(docs.select(F.col("doc_id").alias("good_id"), F.col("text").alias("chosen")), "good_id")
            .join(docs.select(F.col("doc_id").alias("poor_id"), F.col("text").alias("rejected")), "poor_id")
            .select("pair_id", "prompt", "chosen", "rejected"))


_STEPS = "select distinct l_orderkey as orig_id, l_linenumber - 1 as step_index from {lineitem}"
# source rows of a task that makes several rows, and texts, of each of them
ROWS_PER_TASK = 250_000


def _f_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-vote in partitions that hold their votes in memory, whatever the table's size.

    The keys alone are small, so the exchange of the distinct would be
    coalesced into a few tasks, each with eight texts per key; the number of
    tasks follows the table's rows instead.
    """
    n = max(spark.sparkContext.defaultParallelism, -(-read_table(spark, sf_dir, "lineitem").count() // ROWS_PER_TASK))
    steps = spark_sql(spark, sf_dir, _STEPS).repartition(n, "orig_id", "step_index")
    return spark_sql(spark, sf_dir, FIXTURE_SQL["f_vote"].replace(f"({_STEPS})", "{steps}"), steps=steps)


FIXTURE_BUILDERS = {"f_pref": _f_pref, "f_vote": _f_vote}


@lru_cache(maxsize=None)
def duck_fixture(name: str) -> str:
    tpl = FIXTURE_SQL[name]
    return _series(tpl, "duckdb").format(**{t: t for t in tables_of(tpl)})


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses (DuckDB text)."""
    ctes = ",\n".join(f"{n} as ({duck_fixture(n)})" for n in names)
    return f"with {ctes}\n{sql}"
