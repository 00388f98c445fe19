"""Queries: first-error and classified-step evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.operators import evaluate as ev
from stepwise.plans.fixtures import fixture, with_fixtures
from stepwise.plans.registry import register, rounded

_CHAINS = """
, chains as (
  select orig_id, min(case when avg_score <= 0.5 then step_index end) as fe,
         bool_or(avg_score is null) as miss, count(*) as n_steps, count(*) filter (where avg_score is null) as n_missing
  from f_step where orig_id is not null group by orig_id),
j as (
  select c.*, cast(coalesce(fe, -1) as int) as pred, (miss and fe is null) as ignored, g.label
  from chains c left join f_gold g on g.id = c.orig_id)
"""


@register("pb_summary", with_fixtures(_CHAINS + """
, k as (
  select count(*) filter (where not ignored and label is not null and label <> -1) as error_samples,
         count(*) filter (where not ignored and label is not null and label <> -1 and pred = label) as first_error_correct,
         count(*) filter (where not ignored and label = -1) as no_error_samples,
         count(*) filter (where not ignored and label = -1 and pred = -1) as no_error_correct,
         count(*) filter (where not ignored and label is not null) as valid_samples,
         count(*) filter (where ignored) as ignored_samples
  from j),
r as (
  select *, coalesce(first_error_correct / nullif(error_samples, 0), 0.0) as a1,
            coalesce(no_error_correct / nullif(no_error_samples, 0), 0.0) as a2 from k)
select error_samples, first_error_correct, no_error_samples, no_error_correct, valid_samples, ignored_samples,
       round(a1, 6) as first_error_accuracy, round(a2, 6) as no_error_accuracy,
       round(case when a1 + a2 > 0 then 2 * a1 * a2 / (a1 + a2) else 0.0 end, 6) as f1,
       error_samples - first_error_correct as wrong_error_samples,
       no_error_samples - no_error_correct as wrong_no_error_samples
from r
""", "f_step", "f_gold"))
def pb_summary(spark, sf):
    return rounded(ev.first_error_summary(fixture(spark, sf, "f_step"), fixture(spark, sf, "f_gold")))


@register("pb_first_error", with_fixtures("""
select orig_id, cast(coalesce(min(case when avg_score <= 0.5 then step_index end), -1) as int) as predicted_first_error_step,
       bool_or(avg_score is null) as has_missing_score,
       bool_or(avg_score is null) and min(case when avg_score <= 0.5 then step_index end) is null as ignored,
       count(*) as n_steps
from f_step where orig_id is not null group by orig_id
""", "f_step"))
def pb_first_error(spark, sf):
    return (ev.first_error_per_chain(fixture(spark, sf, "f_step"))
            .select("orig_id", "predicted_first_error_step", "has_missing_score", "ignored", "n_steps"))


@register("pb_ignored", with_fixtures(_CHAINS + """
select orig_id, 'missing_avg_score_without_detected_error' as reason, n_steps, n_missing from j where ignored
""", "f_step", "f_gold"))
def pb_ignored(spark, sf):
    return ev.ignored_chains(fixture(spark, sf, "f_step"))


@register("pb_wrong_samples", with_fixtures(_CHAINS + """
, lists as (
  select orig_id, string_agg(cast(step_index as varchar) || ':' || coalesce(cast(avg_score as varchar), 'null'), ';' order by step_index) as steps_text
  from f_step where orig_id is not null group by orig_id)
select j.orig_id, pred as predicted_first_error_step, label as true_first_error_step,
       case when label <> -1 then 'first_error_step_mismatch' else 'false_positive_error_detection' end as error_type,
       n_steps, steps_text
from j join lists l on l.orig_id = j.orig_id
where not ignored and label is not null and pred <> label
""", "f_step", "f_gold"))
def pb_wrong_samples(spark, sf):
    w = ev.first_error_wrong_samples(fixture(spark, sf, "f_step"), fixture(spark, sf, "f_gold"))
    text = F.array_join(F.transform("steps", lambda s: F.concat(
        s["step_index"].cast("string"), F.lit(":"),
        F.coalesce(s["avg_score"].cast("string"), F.lit("null")))), ";")
    return w.withColumn("steps_text", text).drop("steps")


@register("pb_profile", with_fixtures("""
, chains as (select orig_id, count(*) as n_steps, min(case when avg_score <= 0.5 then step_index end) as fe,
                    bool_or(avg_score is null) as miss from f_step group by orig_id),
j as (select c.*, g.id as gid from chains c full outer join f_gold g on g.id = c.orig_id)
select cast(coalesce(sum(n_steps), 0) as bigint) as step_rows,
       count(*) filter (where n_steps is not null and orig_id is not null) as chain_rows,
       count(gid) as label_map_size,
       count(*) filter (where n_steps is not null and orig_id is not null and not (miss and fe is null) and gid is not null) as valid_samples,
       count(*) filter (where n_steps is not null and orig_id is not null and miss and fe is null) as ignored_samples
from j
""", "f_step", "f_gold"))
def pb_profile(spark, sf):
    return ev.first_error_profile(fixture(spark, sf, "f_step"), fixture(spark, sf, "f_gold"))


_CONF_COLS = """
count(*) as total_samples,
count(*) filter (where not coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5)) as true_positives,
count(*) filter (where coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5)) as false_positives,
count(*) filter (where coalesce(is_error, false) and coalesce(reward, 0.5) < 0.5) as true_negatives,
count(*) filter (where not coalesce(is_error, false) and coalesce(reward, 0.5) < 0.5) as false_negatives
"""

_RATIOS = """
, r1 as (select *, coalesce((true_positives + true_negatives) / nullif(total_samples, 0), 0.0) as accuracy,
          coalesce(true_positives / nullif(true_positives + false_positives, 0), 0.0) as precision,
          coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0.0) as recall,
          coalesce(true_negatives / nullif(true_negatives + false_negatives, 0), 0.0) as negative_precision,
          coalesce(true_negatives / nullif(true_negatives + false_positives, 0), 0.0) as negative_recall from c),
r2 as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1_score,
          case when negative_precision + negative_recall > 0 then 2 * negative_precision * negative_recall / (negative_precision + negative_recall) else 0.0 end as negative_f1_score
       from r1)
"""

_RATIO_SELECT = """total_samples, true_positives, false_positives, true_negatives, false_negatives,
round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
round(f1_score, 6) as f1_score, round(negative_precision, 6) as negative_precision,
round(negative_recall, 6) as negative_recall, round(negative_f1_score, 6) as negative_f1_score,
round((f1_score + negative_f1_score) / 2, 6) as avg_f1"""


@register("prm_metrics_overall", with_fixtures(f"""
, c as (select {_CONF_COLS} from f_prm)
{_RATIOS}
select {_RATIO_SELECT} from r2
""", "f_prm"))
def prm_metrics_overall(spark, sf):
    return rounded(ev.confusion_metrics(fixture(spark, sf, "f_prm")))


@register("prm_metrics_by_class", with_fixtures(f"""
, base as (select coalesce(classification, 'unclassified') as classification, is_error, reward from f_prm),
c as (select case when grouping(classification) = 1 then 'overall' else 'class' end as scope,
             case when grouping(classification) = 0 then classification end as classification,
             {_CONF_COLS}
      from base group by grouping sets ((), (classification))),
ncls as (select count(*) as n, bool_or(classification <> 'unclassified') as other from c where scope = 'class')
{_RATIOS}
select scope, classification, {_RATIO_SELECT} from r2, ncls
where scope = 'overall' or n > 1 or other
""", "f_prm"))
def prm_metrics_by_class(spark, sf):
    return rounded(ev.confusion_metrics_by_class(fixture(spark, sf, "f_prm")))


@register("prm_judgments", with_fixtures("""
select cast(original_id as varchar) as original_id, step_id, coalesce(is_error, false) as is_error,
       round(coalesce(reward, 0.5), 6) as reward, coalesce(reward, 0.5) < 0.5 as predicted_error,
       case when not coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5) then 'TP'
            when coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5) then 'FP'
            when coalesce(is_error, false) and coalesce(reward, 0.5) < 0.5 then 'TN' else 'FN' end as judgment_type,
       case when not coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5) then 'Correctly predicted as error'
            when coalesce(is_error, false) and not (coalesce(reward, 0.5) < 0.5) then 'Incorrectly predicted as error (False Alarm)'
            when coalesce(is_error, false) and coalesce(reward, 0.5) < 0.5 then 'Correctly predicted as correct'
            else 'Incorrectly predicted as correct (Missed Error)' end as judgment_desc
from f_prm
""", "f_prm"))
def prm_judgments(spark, sf):
    return rounded(ev.step_judgments(fixture(spark, sf, "f_prm")))
