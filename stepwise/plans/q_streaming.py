"""Queries: streaming jobs over the ``events`` table (run to completion)."""

from __future__ import annotations

from stepwise.plans.registry import register, rounded
from stepwise.streaming import jobs as J

_HOUR = "cast(epoch(date_trunc('hour', ts)) as bigint)"


@register("stream_step_scores", """
select cast(event_id as varchar) as original_id, 1 as step_id, coalesce(event_type = 'error', false) as is_error,
       round(coalesce(value, 0.5), 6) as reward, coalesce(value, 0.5) < 0.5 as predicted_error,
       case when not coalesce(event_type = 'error', false) and not (coalesce(value, 0.5) < 0.5) then 'TP'
            when coalesce(event_type = 'error', false) and not (coalesce(value, 0.5) < 0.5) then 'FP'
            when coalesce(event_type = 'error', false) and coalesce(value, 0.5) < 0.5 then 'TN' else 'FN' end as judgment_type
from events
""")
def q_stream_step_scores(spark, sf):
    out = J.append_scores(spark, J.event_stream(spark, sf))
    return rounded(out.select("original_id", "step_id", "is_error", "reward", "predicted_error", "judgment_type"))


@register("stream_log_windows", f"""
select {_HOUR} as window_start, event_type, count(*) as n_events, round(avg(value), 6) as mean_value,
       count(*) filter (where event_type = 'error') as n_errors
from events group by {_HOUR}, event_type
""")
def q_stream_log_windows(spark, sf):
    return rounded(J.log_window_metrics(spark, J.event_stream(spark, sf)))


@register("stream_running_mean", f"""
, m as (select {_HOUR} as window_start, avg(value) as batch_mean from events group by {_HOUR})
select window_start, round(batch_mean, 6) as batch_mean,
       round(avg(batch_mean) over (order by window_start rows between unbounded preceding and current row), 6) as running_mean
from m
""".replace(", m as", "with m as", 1))
def q_stream_running_mean(spark, sf):
    return rounded(J.running_window_mean(spark, J.event_stream(spark, sf)))
