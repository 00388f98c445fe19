"""Queries: verdict parsing and vote aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions.text import py_strip_sql
from stepwise.functions.verdicts import first_verdict_score_sql, last_verdict_sql, verdict_reward_sql
from stepwise.operators import votes as V
from stepwise.plans.fixtures import fixture, with_fixtures
from stepwise.plans.registry import register, rounded


def _labels_text(col):
    return F.array_join(F.transform(col, lambda x: F.coalesce(x, F.lit("None"))), ",")


@register("votes_prm", with_fixtures(f"""
, l as (select orig_id, step_index, gen_idx, {last_verdict_sql('output')} as label from f_vote)
select orig_id, step_index, count(*) as n_votes, round(avg({verdict_reward_sql('label')}), 6) as reward,
       bool_or(label is null) as parse_failed,
       string_agg(coalesce(label, 'None'), ',' order by gen_idx) as labels_text
from l group by orig_id, step_index
""", "f_vote"))
def q_votes_prm(spark, sf):
    v = V.vote_counted(fixture(spark, sf, "f_vote"), ["orig_id", "step_index"])
    return rounded(v.select("orig_id", "step_index", "n_votes", "reward", "parse_failed",
                            _labels_text(F.col("verification_labels")).alias("labels_text")))


@register("votes_pb", with_fixtures(f"""
, s as (select orig_id, step_index, gen_idx, {first_verdict_score_sql('output')} as score from f_vote)
select orig_id, step_index, count(*) as n_outputs, count(score) as n_valid, round(avg(score), 6) as avg_score,
       string_agg(coalesce(cast(score as varchar), 'null'), ',' order by gen_idx) as scores_text
from s group by orig_id, step_index
""", "f_vote"))
def q_votes_pb(spark, sf):
    v = V.vote_excluding_unparsed(fixture(spark, sf, "f_vote"), ["orig_id", "step_index"])
    text = F.array_join(F.transform("scores", lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")
    return rounded(v.select("orig_id", "step_index", "n_outputs", "n_valid", "avg_score", text.alias("scores_text")))


@register("votes_candidate", with_fixtures(f"""
, l as (select orig_id as sample_id, step_index as candidate_idx, gen_idx,
               {last_verdict_sql(py_strip_sql('output'))} as label from f_vote)
select sample_id, candidate_idx, count(*) as n_votes, round(avg({verdict_reward_sql('label')}), 6) as reward,
       string_agg(coalesce(label, 'None'), ',' order by gen_idx) as labels_text
from l group by sample_id, candidate_idx
""", "f_vote"))
def q_votes_candidate(spark, sf):
    votes = fixture(spark, sf, "f_vote").withColumnRenamed("orig_id", "sample_id") \
        .withColumnRenamed("step_index", "candidate_idx")
    v = V.vote_candidates(votes)
    return rounded(v.select("sample_id", "candidate_idx", "n_votes", "reward",
                            _labels_text(F.col("analysis_labels")).alias("labels_text")))
