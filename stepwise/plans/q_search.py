"""Queries: best-of-N search buffers, selection and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions import answers as A
from stepwise.functions.text import py_strip_sql
from stepwise.operators import chains as C
from stepwise.operators import search as S
from stepwise.operators.answers import gold_answer_map
from stepwise.plans.fixtures import fixture, with_fixtures
from stepwise.plans.registry import register, rounded
from stepwise.session import scratch_path, written
from stepwise.sources.records import read_buffer


def _buffers(spark, sf):
    fb = S.parse_buffer(fixture(spark, sf, "f_buffer"))
    return fb.where("side = 'g'"), fb.where("side = 'd'")


def _merged(spark, sf):
    g, d = _buffers(spark, sf)
    return S.merge_buffers(g, d)


def _has(raw, key):
    return f"coalesce(list_contains(json_keys({raw}), '{key}'), false)"


_PARSED = f"""
, g as (select id, raw from f_buffer where side = 'g'),
d as (select id, raw from f_buffer where side = 'd'),
j as (select coalesce(g.id, d.id) as id, g.raw as graw, d.raw as draw from g full outer join d on g.id = d.id),
m as (select id,
        case when {_has('graw', 'problem')} then json_extract_string(graw, '$.problem') else json_extract_string(draw, '$.problem') end as problem,
        cast(len(case when {_has('graw', 'steps')} then cast(json_extract(graw, '$.steps') as varchar[])
                      when {_has('draw', 'steps')} then cast(json_extract(draw, '$.steps') as varchar[])
                      else []::varchar[] end) as int) as n_steps,
        {_has('graw', 'answer')} or {_has('draw', 'answer')} as has_answer,
        case when {_has('graw', 'answer')} then json_extract_string(graw, '$.answer')
             when {_has('draw', 'answer')} then json_extract_string(draw, '$.answer') end as answer,
        case when {_has('draw', 'candidates')} then cast(len(cast(json_extract(draw, '$.candidates') as varchar[])) as int) end as n_candidates
      from j)
"""


@register("buffer_merge", with_fixtures(_PARSED + "select * from m", "f_buffer"))
def q_buffer_merge(spark, sf):
    m = _merged(spark, sf)
    return m.select("id", "problem", F.size("steps").alias("n_steps"), "has_answer", "answer",
                    F.when(F.col("has_candidates"), F.size("candidates")).alias("n_candidates"))


# ids repeat in both buffers, in the order of the file; some discriminator rows carry evaluations
_REPEATED = """
, r as (select side, id as ord, id % 1000 as id,
               case when side = 'd' and id % 2 = 0 then concat(left(raw, length(raw) - 1),
                    ',"candidate_evaluations":[{"candidate_idx":0,"reward":', cast(id % 5 as varchar), '.5,"analysis_labels":["Yes"],"analysis_outputs":[]}]}')
                    else raw end as raw
        from f_buffer),
l as (select * from r qualify row_number() over (partition by side, id order by ord desc) = 1),
"""


@register("buffer_merge_repeats", with_fixtures(_REPEATED + _PARSED.lstrip().removeprefix(",").replace("f_buffer", "l").replace(
    "end as n_candidates", f"""end as n_candidates,
        case when {_has('draw', 'candidate_evaluations')} then json_extract_string(draw, '$.candidate_evaluations[0].reward')::double end as first_reward""")
    + "select * from m", "f_buffer"))
def q_buffer_merge_repeats(spark, sf):
    """Buffers whose ids repeat, read from files: the last row of a side counts, evaluations stay."""
    fb = fixture(spark, sf, "f_buffer")
    more = F.concat(F.lit(',"candidate_evaluations":[{"candidate_idx":0,"reward":'), (F.col("id") % 5).cast("string"),
                    F.lit('.5,"analysis_labels":["Yes"],"analysis_outputs":[]}]}'))
    with_more = (F.col("side") == "d") & (F.col("id") % 2 == 0)
    rows = fb.withColumn("raw", F.when(with_more, F.concat(F.expr("left(raw, length(raw) - 1)"), more)).otherwise(F.col("raw")))
    rows = rows.withColumn("raw", F.regexp_replace("raw", r'"id":\d+', F.concat(F.lit('"id":'), (F.col("id") % 1000).cast("string"))))
    sides = []
    for side in ("g", "d"):
        path = scratch_path(spark, f"buffer-{side}")
        rows.where(F.col("side") == side).orderBy("id").select("raw").write.text(path)
        sides.append(S.parse_buffer(read_buffer(spark, path)))
    m = S.merge_buffers(*sides)
    return m.select("id", "problem", F.size("steps").alias("n_steps"), "has_answer", "answer",
                    F.when(F.col("has_candidates"), F.size("candidates")).alias("n_candidates"),
                    F.get("candidate_evaluations", F.lit(0))["reward"].alias("first_reward"))


@register("search_pending", with_fixtures(_PARSED + "select id, problem, n_steps from m where not has_answer", "f_buffer"))
def q_search_pending(spark, sf):
    return S.pending(_merged(spark, sf)).select("id", "problem", F.size("steps").alias("n_steps"))


_ANSWERED = f"""
, answered as (select distinct id from f_buffer where {_has('raw', 'answer')})
"""


@register("answered_ids", with_fixtures(_ANSWERED + "select id from answered", "f_buffer"))
def q_answered_ids(spark, sf):
    g, d = _buffers(spark, sf)
    return S.answered_ids(g, d)


@register("search_to_score", with_fixtures(_ANSWERED + """
select id, cast(json_array_length(raw, '$.candidates') as int) as n_candidates
from f_buffer where side = 'd' and coalesce(json_array_length(raw, '$.candidates'), 0) > 0
  and id not in (select id from answered)
""", "f_buffer"))
def q_search_to_score(spark, sf):
    g, d = _buffers(spark, sf)
    return S.to_score(g, d).select("id", F.size("candidates").alias("n_candidates"))


@register("buffer_reunite", with_fixtures(_PARSED + """
select id, 'skipped' as status from m where has_answer
union all
select id, 'pending' from m where not has_answer
""", "f_buffer"))
def q_buffer_reunite(spark, sf):
    m = written(_merged(spark, sf).select("id", "has_answer"), "merged")  # merged once, read by both sides
    skipped = m.where("has_answer").select("id", F.lit("skipped").alias("status"))
    todo = S.pending(m).select("id", F.lit("pending").alias("status"))
    return skipped.unionByName(todo)


@register("search_progress", with_fixtures(f"""
select side, count(*) as total, count(*) filter (where {_has('raw', 'answer')}) as answered,
       case when count(*) = 0 then 'empty' when count(*) filter (where {_has('raw', 'answer')}) = count(*) then 'done'
            else 'not_done' end as state
from f_buffer group by side
""", "f_buffer"))
def q_search_progress(spark, sf):
    fb = S.parse_buffer(fixture(spark, sf, "f_buffer"))
    return S.progress(fb, "side")


@register("search_profile", with_fixtures(_PARSED + """
select count(*) as samples, count(*) filter (where has_answer) as answered, count(*) filter (where not has_answer) as pending,
       count(*) filter (where not has_answer and coalesce(n_candidates, 0) > 0) as pending_with_candidates
from m
""", "f_buffer"))
def q_search_profile(spark, sf):
    m = _merged(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("samples"), F.count_if("has_answer").alias("answered"),
                 F.count_if(~F.col("has_answer")).alias("pending"),
                 F.count_if(~F.col("has_answer") & (F.coalesce(F.size("candidates"), F.lit(0)) > 0))
                 .alias("pending_with_candidates"))


@register("search_init", with_fixtures("""
select distinct id, question as problem, 0 as n_steps, false as has_answer from f_chain
""", "f_chain"))
def q_search_init(spark, sf):
    problems = fixture(spark, sf, "f_chain").select("id", F.col("question").alias("problem")).distinct()
    return S.init_buffer(problems).select("id", "problem", F.size("steps").alias("n_steps"), "has_answer")


@register("search_scored_semi", with_fixtures("""
select id, json_extract_string(raw, '$.problem') as problem from f_buffer
where side = 'g' and id in (select id from f_cand)
""", "f_buffer", "f_cand"))
def q_search_scored_semi(spark, sf):
    g, _ = _buffers(spark, sf)
    results = fixture(spark, sf, "f_cand").select("id")
    return g.join(results, "id", "left_semi").select("id", "problem")


def _results_and_arrays(spark, sf):
    fc = fixture(spark, sf, "f_cand")
    results = fc.select(F.col("id").alias("sample_id"), "candidate_idx", "reward")
    arrays = C.chains_from_rows(fc, "id", "candidate_idx", "candidate", carry=()).withColumnRenamed("steps", "candidates")
    return results, arrays


@register("candidate_evaluations", with_fixtures("""
select id as sample_id, count(*) as n_evaluations,
       string_agg(cast(candidate_idx as varchar) || ':' || cast(reward as varchar), ';' order by candidate_idx) as evals_text
from f_cand group by id
""", "f_cand"))
def q_candidate_evaluations(spark, sf):
    results, _ = _results_and_arrays(spark, sf)
    ev = S.evaluations_by_sample(results)
    text = F.array_join(F.transform("candidate_evaluations", lambda e: F.concat(
        e["candidate_idx"].cast("string"), F.lit(":"), e["reward"].cast("string"))), ";")
    return ev.select("sample_id", F.size("candidate_evaluations").cast("bigint").alias("n_evaluations"),
                     text.alias("evals_text"))


@register("best_of_n", with_fixtures(f"""
, b as (select * from f_cand qualify row_number() over (partition by id order by reward desc, candidate_idx) = 1),
x as (select *, {A.single_boxed_sql('candidate')} as ans from b)
select id, candidate_idx as best_idx, round(reward, 6) as best_reward, candidate as best_candidate,
       case when length(ans) > 0 then ans end as answer, coalesce(length(ans) > 0, false) as has_answer
from x
""", "f_cand"))
def q_best_of_n(spark, sf):
    results, arrays = _results_and_arrays(spark, sf)
    return rounded(S.best_candidates(results, arrays))


@register("extract_final_answers", with_fixtures(f"""
select id, candidate_idx, {A.single_boxed_sql('candidate')} as answer from f_cand
""", "f_cand"))
def q_extract_final_answers(spark, sf):
    fc = fixture(spark, sf, "f_cand")
    return fc.select("id", "candidate_idx", A.single_boxed(F.col("candidate")).alias("answer"))


@register("candidate_answer_check", with_fixtures(f"""
, c as (select id, candidate_idx, {A.single_boxed_sql('candidate')} as extracted from f_cand),
g as (select id, {py_strip_sql('answer')} as gold from f_answer where side = 'g' and id is not null and answer is not null)
select c.id, candidate_idx, extracted, gold, {A.light_normalise_sql('extracted')} = {A.light_normalise_sql('gold')} as match
from c join g on c.id = g.id where extracted is not null
""", "f_cand", "f_answer"))
def q_candidate_answer_check(spark, sf):
    fc = fixture(spark, sf, "f_cand").select("id", "candidate_idx", "candidate")
    gold = gold_answer_map(fixture(spark, sf, "f_answer").where("side = 'g'"))
    return S.candidate_answer_check(fc, gold).select("id", "candidate_idx", "extracted", "gold", "match")


@register("search_loop", with_fixtures("""
select distinct id, 3 as n_steps, true as has_answer, cast(id % 97 as varchar) as answer from f_chain
""", "f_chain"))
def q_search_loop(spark, sf):
    """Driver loop with the deterministic stubs: a boxed answer is offered in round 3 and wins every vote."""
    problems = fixture(spark, sf, "f_chain").select("id", F.col("question").alias("problem")).distinct()
    state = S.search_loop(spark, problems, S.stub_generator, S.stub_scorer)
    return state.select("id", F.size("steps").alias("n_steps"), "has_answer", "answer")


@register("score_steps_stub")
def q_score_steps_stub(spark, sf):
    """Caller-supplied scorer over every chain prefix (stub verifier), then voting."""
    ch = C.chains_from_rows(fixture(spark, sf, "f_chain"))
    states = ch.select("id", F.col("question").alias("problem"), F.array().cast("array<string>").alias("steps"),
                       F.col("steps").alias("candidates"))
    votes = S.score_candidates(states, S.stub_scorer)
    from stepwise.operators.votes import vote_candidates
    return rounded(vote_candidates(votes).select("sample_id", "candidate_idx", "reward", "n_votes"))
