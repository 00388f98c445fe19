"""Queries: chain expansion, prompt rendering, candidate arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions import templates as T
from stepwise.operators import chains as C
from stepwise.plans.fixtures import fixture, read_table, with_fixtures
from stepwise.plans.registry import register

_W_PREV = "over (partition by id order by step_index rows between unbounded preceding and 1 preceding)"
_NUM = "'Step ' || cast(step_index + 1 as varchar) || ': ' || step"
_PREV_NUM = f"string_agg({_NUM}, chr(10)) {_W_PREV}"


def _chains(spark, sf):
    return C.chains_from_rows(fixture(spark, sf, "f_chain"))


def _step_states(spark, sf):
    """Every chain prefix as a search state: earlier steps + the next step."""
    ch = _chains(spark, sf)
    ex = ch.select("id", F.col("question").alias("problem"), "steps",
                   F.posexplode("steps").alias("step_index", "candidate"))
    return ex.withColumn("steps", F.slice("steps", F.lit(1), F.col("step_index")))


@register("expand_steps", with_fixtures(f"""
select cast(id as varchar) || '-step' || cast(step_index as varchar) as id, id as orig_id, step_index,
       coalesce(question, '') as question, coalesce({_PREV_NUM}, '') as previous_steps, {_NUM} as now_step
from f_chain where step_index is not null
""", "f_chain"))
def q_expand_steps(spark, sf):
    return C.expand_steps(_chains(spark, sf)).select("id", "orig_id", "step_index", "question",
                                                     "previous_steps", "now_step")


@register("step_prefix_text", with_fixtures(f"""
select id, step_index, coalesce({_PREV_NUM}, '') as previous_steps from f_chain where step_index is not null
""", "f_chain"))
def q_step_prefix_text(spark, sf):
    ch = _chains(spark, sf)
    num = C.numbered(F.col("steps"))
    return (ch.select("id", num.alias("_num"), F.posexplode("steps").alias("step_index", "_s"))
              .select("id", F.col("step_index").cast("int").alias("step_index"),
                      C.prefix_text(F.col("_num"), F.col("step_index")).alias("previous_steps")))


def _classified_chains(spark, sf):
    ch = _chains(spark, sf)
    err = F.filter(F.transform("steps", lambda s, i: F.when(F.length(s) % 5 == 0, (i + 1).cast("int"))),
                   lambda x: x.isNotNull())
    cls = F.when(F.col("id") % 3 == 0, "redundancy").when(F.col("id") % 3 == 1, "circular")
    return ch.withColumn("error_steps", err).withColumn("classification", cls)


_CLASS_SQL = "case id % 3 when 0 then 'redundancy' when 1 then 'circular' else 'unclassified' end"


@register("split_steps", with_fixtures(f"""
select id as original_id, cast(step_index + 1 as int) as step_id, step as current_step,
       cast(step_index as int) as n_previous,
       coalesce(string_agg(step, chr(10)) {_W_PREV}, '') as previous_text,
       coalesce(length(step) % 5 = 0, false) as is_error, {_CLASS_SQL} as classification
from f_chain where step_index is not null
""", "f_chain"))
def q_split_steps(spark, sf):
    s = C.split_steps(_classified_chains(spark, sf))
    return s.select("original_id", "step_id", "current_step",
                    F.size("previous_steps").alias("n_previous"),
                    F.array_join("previous_steps", "\n").alias("previous_text"),
                    "is_error", "classification")


@register("running_history", """
select conv_id, turn,
       cast(count(*) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as int) as n_previous,
       coalesce(string_agg(text, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as history
from conversations
""")
def q_running_history(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return C.running_history(conv, "conv_id", "turn", "text").select("conv_id", "turn", "n_previous", "history")


_PB_PROMPT_SQL = ("concat_ws(chr(10), " + T.sql_literal(T.FIRST_ERROR_VERIFIER_TEXT) + ", '', "
                  "'Question: ' || coalesce(question, ''), '', 'Previous Steps: ' || coalesce(" + _PREV_NUM + ", ''), '', "
                  "'Now Step: ' || " + _NUM + ", '', " + T.sql_literal(T.FIRST_ERROR_REPLY_LINE) + ", '', "
                  + T.sql_literal(T.FIRST_ERROR_RESPONSE_TAIL) + ")")


@register("prompt_pb", with_fixtures(f"""
select cast(id as varchar) || '-step' || cast(step_index as varchar) as id, {_PB_PROMPT_SQL} as prompt from f_chain where step_index is not null
""", "f_chain"))
def q_prompt_pb(spark, sf):
    return C.render_first_error_prompt(C.expand_steps(_chains(spark, sf))).select("id", "prompt")


def _instruction_sql(template):
    return T.render_sql(template, question="question",
                        previous_steps=f"coalesce({_PREV_NUM}, 'None')", now_step=_NUM)


@register("prompt_prm", with_fixtures(f"""
select id as original_id, cast(step_index + 1 as int) as step_id,
       {T.sql_literal(T.INSTRUCTION_HEAD)} || {_instruction_sql(T.CLASSIFIED_VERIFIER_TEMPLATE)} || {T.sql_literal(T.RESPONSE_HEAD)} as prompt
from f_chain where step_index is not null
""", "f_chain"))
def q_prompt_prm(spark, sf):
    s = C.split_steps(_classified_chains(spark, sf))
    return C.render_classified_prompt(s).select("original_id", "step_id", "prompt")


@register("prompt_candidate", with_fixtures(f"""
select id, step_index,
       {T.sql_literal(T.CHAT_USER_HEAD)} || {_instruction_sql(T.CANDIDATE_VERIFIER_TEMPLATE)} || {T.sql_literal(T.CHAT_ASSISTANT_TAIL)} as prompt
from f_chain where step_index is not null
""", "f_chain"))
def q_prompt_candidate(spark, sf):
    return C.render_candidate_prompt(_step_states(spark, sf)).select(
        "id", F.col("step_index").cast("int").alias("step_index"), "prompt")


_POLICY_SQL = T.render_sql(T.POLICY_TEMPLATE, question="question",
                           previous_steps=f"coalesce(string_agg(step, chr(10) || chr(10)) {_W_PREV}, '')")


@register("prompt_policy", with_fixtures(f"""
select id, step_index, {_POLICY_SQL} || case when step_index > 0 then chr(10) || chr(10) else '' end as prompt
from f_chain where step_index is not null
""", "f_chain"))
def q_prompt_policy(spark, sf):
    return C.render_policy_prompt(_step_states(spark, sf)).select(
        "id", F.col("step_index").cast("int").alias("step_index"), "prompt")


@register("sft_text", with_fixtures(f"""
select conv_id, turn, {T.sql_literal(T.INSTRUCTION_HEAD)} || instruction || {T.sql_literal(T.RESPONSE_HEAD)} as prompt,
       {T.sql_literal(T.INSTRUCTION_HEAD)} || instruction || {T.sql_literal(T.RESPONSE_HEAD)} || output || '</s>' as text
from f_sft
""", "f_sft"))
def q_sft_text(spark, sf):
    return C.render_sft_text(fixture(spark, sf, "f_sft")).select("conv_id", "turn", "prompt", "text")


def _candidate_arrays(spark, sf):
    return (C.chains_from_rows(fixture(spark, sf, "f_cand"), "id", "candidate_idx", "candidate", carry=())
            .withColumnRenamed("steps", "candidates"))


@register("clean_candidates", with_fixtures("""
, s as (select id, candidate_idx, regexp_replace(candidate, '^[\\x{0009}-\\x{000d}\\x{001c}-\\x{0020}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}-\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\x{0009}-\\x{000d}\\x{001c}-\\x{0020}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}-\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') as c from f_cand)
select id, cast(count(*) filter (where c <> '') as int) as n_candidates,
       coalesce(string_agg(c, ' | ' order by candidate_idx) filter (where c <> ''), '') as candidates_text
from s group by id
""", "f_cand"))
def q_clean_candidates(spark, sf):
    c = C.clean_candidates(_candidate_arrays(spark, sf))
    return c.select("id", F.size("candidates").alias("n_candidates"),
                    F.array_join("candidates", " | ").alias("candidates_text"))


@register("candidate_preview", with_fixtures("""
select id, cast(count(*) as int) as candidate_count,
       string_agg(substr(candidate, 1, 80), ' | ' order by candidate_idx) filter (where candidate_idx < 3) as preview_text
from f_cand group by id
""", "f_cand"))
def q_candidate_preview(spark, sf):
    p = C.candidate_preview(_candidate_arrays(spark, sf))
    return p.select("id", "candidate_count", F.array_join("preview", " | ").alias("preview_text"))


@register("expand_candidates", with_fixtures("""
select id, candidate_idx, candidate from f_cand
""", "f_cand"))
def q_expand_candidates(spark, sf):
    return C.expand_candidates(_candidate_arrays(spark, sf)).select("id", "candidate_idx", "candidate")
