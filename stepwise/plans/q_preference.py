"""Queries: preference losses, rewards and batch metrics over logged log-probs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.operators import preference as P
from stepwise.plans.fixtures import fixture, with_fixtures
from stepwise.plans.registry import register, rounded

BETA = 0.1
CMCL_RUN = {"alpha": 1.0, "beta": 30.0, "gamma": 60.0, "tau": 1.0}


def _ls(x):
    return f"(-(greatest(-({x}), 0) + ln(1 + exp(-abs({x})))))"


def _sig(x):
    return f"(case when ({x}) >= 0 then 1 / (1 + exp(-({x}))) else exp({x}) / (1 + exp({x})) end)"


def _sp(x):
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


Z = "((chosen_logps - rejected_logps) - (ref_chosen_logps - ref_rejected_logps))"
CL, RL = "(chosen_logps - ref_chosen_logps)", "(rejected_logps - ref_rejected_logps)"
REW = f"round({BETA} * {CL}, 6) as chosen_reward, round({BETA} * {RL}, 6) as rejected_reward"


def _pairs(spark, sf):
    return fixture(spark, sf, "f_pairlogp")


def _out(df):
    return rounded(df.select("pair_id", "batch_id", "loss", "chosen_reward", "rejected_reward"))


def _row_loss(name, sql_loss, **kw):
    @register(name, with_fixtures(f"select pair_id, batch_id, round({sql_loss}, 6) as loss, {REW} from f_pairlogp",
                                  "f_pairlogp"))
    def q(spark, sf):
        return _out(P.preference_loss(_pairs(spark, sf), beta=BETA, **kw))
    q.__name__ = f"q_{name}"
    return q


_row_loss("loss_sigmoid", f"-{_ls(f'{BETA} * {Z}')}", loss_type="sigmoid")
_row_loss("loss_robust", f"(-{_ls(f'{BETA} * {Z}')} * 0.9 + {_ls(f'-{BETA} * {Z}')} * 0.1) / 0.8",
          loss_type="robust", label_smoothing=0.1)
_row_loss("loss_exo_pair", f"{_sig(f'{BETA} * {Z}')} * ({_ls(f'{BETA} * {Z}')} - ln(1 - 0.001)) + "
                           f"{_sig(f'-{BETA} * {Z}')} * ({_ls(f'-{BETA} * {Z}')} - ln(0.001))", loss_type="exo_pair")
_row_loss("loss_hinge", f"greatest(1 - {BETA} * {Z}, 0)", loss_type="hinge")
_row_loss("loss_ipo", f"pow({Z} - 1 / (2 * {BETA}), 2)", loss_type="ipo")
_row_loss("loss_sppo_hard", f"pow({CL} - 0.5 / {BETA}, 2) + pow({RL} + 0.5 / {BETA}, 2)", loss_type="sppo_hard")
_row_loss("loss_nca_pair", f"-{_ls(f'{CL} * {BETA}')} - 0.5 * {_ls(f'-{CL} * {BETA}')} - 0.5 * {_ls(f'-{RL} * {BETA}')}",
          loss_type="nca_pair")
_row_loss("loss_apo_zero", f"1 - {_sig(f'{BETA} * {CL}')} + {_sig(f'{BETA} * {RL}')}", loss_type="apo_zero")
_row_loss("loss_apo_down", f"{_sig(f'{BETA} * {CL}')} + 1 - {_sig(f'{BETA} * ({CL} - {RL})')}", loss_type="apo_down")
_U = f"({BETA} * {Z})"
_row_loss("loss_discopop", f"-{_ls(_U)} * (1 - {_sig(f'{_U} / 0.05')}) + exp(-{_U}) * {_sig(f'{_U} / 0.05')}",
          loss_type="discopop")
_row_loss("loss_cmcl", f"-1.0 * {CL} + 1.0 * {RL} + (30.0 / 2.0) * pow({CL}, 2) + (60.0 / 2.0) * pow({RL}, 2)",
          loss_type="cmcl", cmcl=CMCL_RUN)


@register("pref_logits", with_fixtures(f"""
select pair_id, batch_id, round({Z}, 6) as logits_reverse_kl,
       round({Z} - ({_sp(CL)} - {_sp(RL)}), 6) as logits_js,
       round((exp(least(-{RL}, 709.78)) - exp(least(-{CL}, 709.78))) / 1.0, 6) as logits_alpha
from f_pairlogp
""", "f_pairlogp"))
def q_pref_logits(spark, sf):
    df = _pairs(spark, sf)
    return rounded(df.select("pair_id", "batch_id", P.logits("reverse_kl").alias("logits_reverse_kl"),
                             P.logits("js_divergence").alias("logits_js"),
                             P.logits("alpha_divergence").alias("logits_alpha")))


@register("pref_rewards", with_fixtures(f"select pair_id, {REW} from f_pairlogp", "f_pairlogp"))
def q_pref_rewards(spark, sf):
    cr, rr = P.rewards(BETA)
    return rounded(_pairs(spark, sf).select("pair_id", cr.alias("chosen_reward"), rr.alias("rejected_reward")))


_RUNNING = f"""
, pb as (select batch_id, (sum({BETA} * {CL}) + sum({BETA} * {RL})) / (2 * count(*)) as batch_mean from f_pairlogp group by batch_id),
rm as (select batch_id, batch_mean, avg(batch_mean) over (order by batch_id rows between unbounded preceding and current row) as running_mean from pb)
"""


@register("running_reward_mean", with_fixtures(_RUNNING + """
select batch_id, round(batch_mean, 6) as batch_mean, round(running_mean, 6) as running_mean from rm
""", "f_pairlogp"))
def q_running_reward_mean(spark, sf):
    return rounded(P.running_reward_mean(_pairs(spark, sf), BETA))


@register("loss_bco_pair", with_fixtures(_RUNNING + f"""
select p.pair_id, p.batch_id,
       round(-{_ls(f'{BETA} * {CL} - rm.running_mean')} - {_ls(f'-({BETA} * {RL} - rm.running_mean)')}, 6) as loss, {REW}
from f_pairlogp p join rm on rm.batch_id = p.batch_id
""", "f_pairlogp"))
def q_loss_bco_pair(spark, sf):
    return _out(P.preference_loss(_pairs(spark, sf), "bco_pair", beta=BETA))


def _aot_sql(left, right):
    return f"""
, a as (select batch_id, pair_id, {left} as v, row_number() over (partition by batch_id order by {left}, pair_id) as k from f_pairlogp),
b as (select batch_id, {right} as v, row_number() over (partition by batch_id order by {right}, pair_id) as k from f_pairlogp),
l as (select a.pair_id, a.batch_id, -{_ls(f'{BETA} * (a.v - b.v)')} as loss from a join b on a.batch_id = b.batch_id and a.k = b.k)
select p.pair_id, p.batch_id, round(l.loss, 6) as loss, {REW} from f_pairlogp p join l on l.pair_id = p.pair_id and l.batch_id = p.batch_id
"""


@register("loss_aot_pair", with_fixtures(_aot_sql(CL, RL), "f_pairlogp"))
def q_loss_aot_pair(spark, sf):
    return _out(P.preference_loss(_pairs(spark, sf), "aot_pair", beta=BETA))


@register("loss_aot", with_fixtures(_aot_sql("(chosen_logps - rejected_logps)", "(ref_chosen_logps - ref_rejected_logps)"),
                                    "f_pairlogp"))
def q_loss_aot(spark, sf):
    return _out(P.preference_loss(_pairs(spark, sf), "aot", beta=BETA))


# token-level fixture: a pair's batch follows the same rule as the pair table (order key mod 64)
def _tokens(spark, sf):
    return fixture(spark, sf, "f_toklogp").withColumn("batch_id", F.col("pair_id") % 64)


_NLL = """
, nll as (select pair_id % 64 as batch_id, -avg(logp) as nll_loss, count(*) as n_tokens
          from f_toklogp where in_loss and side = 0 and token_id <> 0 group by pair_id % 64)
"""


@register("nll_chosen", with_fixtures(_NLL + "select batch_id, round(nll_loss, 6) as nll_loss, n_tokens from nll",
                                      "f_toklogp"))
def q_nll_chosen(spark, sf):
    return rounded(P.batch_nll(_tokens(spark, sf)))


@register("loss_sft", with_fixtures(_NLL + f"""
select p.pair_id, p.batch_id, round(nll.nll_loss, 6) as loss, {REW} from f_pairlogp p join nll on nll.batch_id = p.batch_id
""", "f_pairlogp", "f_toklogp"))
def q_loss_sft(spark, sf):
    return _out(P.preference_loss(_pairs(spark, sf), "sft", beta=BETA, batch_nll=P.batch_nll(_tokens(spark, sf))))


@register("loss_rpo", with_fixtures(_NLL + f"""
select p.pair_id, p.batch_id, round(-{_ls(f'{BETA} * {Z}')} + 0.5 * nll.nll_loss, 6) as loss, {REW}
from f_pairlogp p join nll on nll.batch_id = p.batch_id
""", "f_pairlogp", "f_toklogp"))
def q_loss_rpo(spark, sf):
    out = P.weighted_losses(_pairs(spark, sf), ["sigmoid"], rpo_alpha=0.5, batch_nll=P.batch_nll(_tokens(spark, sf)),
                            beta=BETA)
    return _out(out)


_WPO = """
, wt as (select pair_id,
                sum(case when in_loss and side = 0 then logp - lse2 end) / count(*) filter (where in_loss and side = 0) as w_chosen,
                sum(case when in_loss and side = 1 then logp - lse2 end) / count(*) filter (where in_loss and side = 1) as w_rejected
         from f_toklogp group by pair_id)
"""


@register("wpo_weights", with_fixtures(_WPO + """
select pair_id, round(w_chosen, 6) as w_chosen, round(w_rejected, 6) as w_rejected,
       round(least(exp(w_chosen + w_rejected), 1.0), 6) as policy_weight from wt
""", "f_toklogp"))
def q_wpo_weights(spark, sf):
    return rounded(P.policy_weights(fixture(spark, sf, "f_toklogp")))


@register("loss_wpo", with_fixtures(_WPO + f"""
select p.pair_id, p.batch_id, round(-{_ls(f'{BETA} * {Z}')} * least(exp(w_chosen + w_rejected), 1.0), 6) as loss, {REW}
from f_pairlogp p join wt on wt.pair_id = p.pair_id // 10
""", "f_pairlogp", "f_toklogp"))
def q_loss_wpo(spark, sf):
    pairs = _pairs(spark, sf).withColumn("order_key", (F.col("pair_id") / 10).cast("bigint"))
    w = P.policy_weights(fixture(spark, sf, "f_toklogp")).select(F.col("pair_id").alias("order_key"), "policy_weight")
    # the weight of a pair comes from its order's token table
    sig = P.preference_loss(pairs, "sigmoid", beta=BETA)
    out = sig.join(w, "order_key").withColumn("loss", F.col("loss") * F.col("policy_weight"))
    return _out(out)


@register("loss_multi", with_fixtures(f"""
select pair_id, batch_id,
       round(-{_ls(f'{BETA} * {Z}')} * 1.0 + (-1.0 * {CL} + 1.0 * {RL} + (30.0 / 2.0) * pow({CL}, 2) + (60.0 / 2.0) * pow({RL}, 2)) * 0.5, 6) as loss,
       round({BETA} * {CL} * 1.5, 6) as chosen_reward, round({BETA} * {RL} * 1.5, 6) as rejected_reward
from f_pairlogp
""", "f_pairlogp"))
def q_loss_multi(spark, sf):
    return _out(P.weighted_losses(_pairs(spark, sf), ["sigmoid", "cmcl"], [1.0, 0.5], beta=BETA, cmcl=CMCL_RUN))


_METRICS = f"""
, lm as (select pair_id, batch_id, chosen_logps, rejected_logps, -{_ls(f'{BETA} * {Z}')} as loss,
                {BETA} * {CL} as cr, {BETA} * {RL} as rr, pair_id % 10 as line from f_pairlogp)
"""
_METRIC_COLS = """round(avg(cr), 6) as {p}rewards_chosen, round(avg(rr), 6) as {p}rewards_rejected,
       round(avg(case when cr > rr then 1.0 else 0.0 end), 6) as {p}rewards_accuracies, round(avg(cr - rr), 6) as {p}rewards_margins,
       round(avg(chosen_logps), 6) as {p}logps_chosen, round(avg(rejected_logps), 6) as {p}logps_rejected, round(avg(loss), 6) as {p}loss"""


def _sigmoid_losses(spark, sf):
    return P.preference_loss(_pairs(spark, sf), "sigmoid", beta=BETA)


@register("pref_batch_metrics", with_fixtures(_METRICS + f"""
select batch_id, {_METRIC_COLS.format(p='')} from lm group by batch_id
""", "f_pairlogp"))
def q_pref_batch_metrics(spark, sf):
    return rounded(P.batch_metrics(_sigmoid_losses(spark, sf)))


_SPLIT = "case pair_id % 10 when 1 then 'eval_first' when 7 then 'eval_seventh' else 'train' end"


@register("pref_eval_metrics", with_fixtures(_METRICS + f"""
select {_SPLIT} as split, batch_id, {_METRIC_COLS.format(p='eval_')}
from lm where {_SPLIT} <> 'train' group by {_SPLIT}, batch_id
""", "f_pairlogp"))
def q_pref_eval_metrics(spark, sf):
    split = (F.when(F.col("pair_id") % 10 == 1, "eval_first").when(F.col("pair_id") % 10 == 7, "eval_seventh")
             .otherwise("train"))
    losses = _sigmoid_losses(spark, sf).withColumn("split", split).where(F.col("split") != "train")
    return rounded(P.batch_metrics(losses, ("split", "batch_id"), prefix="eval_"))


@register("pref_log_windows", with_fixtures(_METRICS + f"""
, bm as (select batch_id, avg(cr) as rewards_chosen, avg(rr) as rewards_rejected,
                avg(case when cr > rr then 1.0 else 0.0 end) as rewards_accuracies, avg(cr - rr) as rewards_margins,
                avg(chosen_logps) as logps_chosen, avg(rejected_logps) as logps_rejected, avg(loss) as loss
         from lm group by batch_id)
select cast(floor(batch_id / 4) as bigint) as window_id, count(*) as n_batches,
       round(avg(rewards_chosen), 6) as rewards_chosen, round(avg(rewards_rejected), 6) as rewards_rejected,
       round(avg(rewards_accuracies), 6) as rewards_accuracies, round(avg(rewards_margins), 6) as rewards_margins,
       round(avg(logps_chosen), 6) as logps_chosen, round(avg(logps_rejected), 6) as logps_rejected, round(avg(loss), 6) as loss
from bm group by cast(floor(batch_id / 4) as bigint)
""", "f_pairlogp"))
def q_pref_log_windows(spark, sf):
    return rounded(P.log_windows(P.batch_metrics(_sigmoid_losses(spark, sf)), 4))


@register("seq_logps", with_fixtures("""
select pair_id, side, round(sum(case when in_loss then logp else 0.0 end), 6) as logps_sum,
       count(*) filter (where in_loss) as n_loss_tokens,
       round(sum(case when in_loss then logp else 0.0 end) / nullif(count(*) filter (where in_loss), 0), 6) as logps
from f_toklogp group by pair_id, side
""", "f_toklogp"))
def q_seq_logps(spark, sf):
    return rounded(P.sequence_logps(fixture(spark, sf, "f_toklogp"), normalize=True))


@register("seq_logps_ld", with_fixtures("""
, t as (select *, sum(case when in_loss and side = 0 then 1 else 0 end) over (partition by pair_id) as len_c,
                  sum(case when in_loss and side = 1 then 1 else 0 end) over (partition by pair_id) as len_r
        from f_toklogp)
select pair_id, side,
       round(sum(case when pos < least(len_c, len_r) and in_loss then logp else 0.0 end)
             + 0.5 * sum(case when pos >= least(len_c, len_r) and pos < (case when side = 0 then len_c else len_r end) and in_loss
                              then logp else 0.0 end), 6) as logps,
       cast(min(len_c) as bigint) as len_chosen, cast(min(len_r) as bigint) as len_rejected
from t group by pair_id, side
""", "f_toklogp"))
def q_seq_logps_ld(spark, sf):
    out = P.length_desensitised_logps(fixture(spark, sf, "f_toklogp"), 0.5)
    return rounded(out.select("pair_id", "side", "logps", F.col("len_chosen").cast("bigint"),
                              F.col("len_rejected").cast("bigint")))


def _token_pairs_sql(policy, ref):
    """Pair table over f_toklogp; ``policy`` and ``ref`` aggregate one side's tokens."""
    side = lambda e, k: e.replace("SIDE", f"in_loss and side = {k}")
    return f"""
, pt as (select pair_id, pair_id % 64 as batch_id, {side(policy, 0)} as chosen_logps, {side(policy, 1)} as rejected_logps,
                {side(ref, 0)} as ref_chosen_logps, {side(ref, 1)} as ref_rejected_logps,
                least(exp({side('avg(logp - lse2) filter (where SIDE)', 0)} + {side('avg(logp - lse2) filter (where SIDE)', 1)}), 1.0) as weight
         from f_toklogp group by pair_id)
"""


_REF = "logp - cast(token_id % 3 as double) / 8"
_SUMS = _token_pairs_sql("sum(logp) filter (where SIDE)", f"sum({_REF}) filter (where SIDE)")
_MEANS = _token_pairs_sql("avg(logp) filter (where SIDE)", f"avg({_REF}) filter (where SIDE)")


def _from_tokens(spark, sf, losses, **kw):
    """Policy and reference tokens to pair tables, joined, to losses."""
    tokens = _tokens(spark, sf)
    ref = tokens.withColumn("logp", F.col("logp") - F.col("token_id") % 3 / 8)
    policy = P.pair_logps(tokens, losses, keep=("batch_id",), **kw)
    reference = P.pair_logps(ref, losses).select("pair_id", F.col("chosen_logps").alias("ref_chosen_logps"),
                                                 F.col("rejected_logps").alias("ref_rejected_logps"))
    return P.attach_reference(policy, reference)


@register("loss_ipo_tokens", with_fixtures(_MEANS + f"""
select pair_id, batch_id, round(pow({Z} - 1 / (2 * {BETA}), 2), 6) as loss, {REW} from pt
""", "f_toklogp"))
def q_loss_ipo_tokens(spark, sf):
    return _out(P.preference_loss(_from_tokens(spark, sf, ["ipo"]), "ipo", beta=BETA))


@register("loss_cmcl_tokens", with_fixtures(_MEANS + f"""
select pair_id, batch_id, round(-1.0 * {CL} + 1.0 * {RL} + (30.0 / 2.0) * pow({CL}, 2) + (60.0 / 2.0) * pow({RL}, 2), 6) as loss, {REW} from pt
""", "f_toklogp"))
def q_loss_cmcl_tokens(spark, sf):
    return _out(P.preference_loss(_from_tokens(spark, sf, ["cmcl"]), "cmcl", beta=BETA, cmcl=CMCL_RUN))


@register("loss_wpo_tokens", with_fixtures(_SUMS + f"""
select pair_id, batch_id, round(-{_ls(f'{BETA} * {Z}')} * weight, 6) as loss, {REW} from pt
""", "f_toklogp"))
def q_loss_wpo_tokens(spark, sf):
    pairs = _from_tokens(spark, sf, ["sigmoid"], weighting=True)
    return _out(P.weighted_losses(pairs, ["sigmoid"], policy_weights=pairs.select("pair_id", "policy_weight"), beta=BETA))


@register("pair_logps_ld", with_fixtures("""
, t as (select *, sum(case when in_loss and side = 0 then 1 else 0 end) over (partition by pair_id) as len_c,
                  sum(case when in_loss and side = 1 then 1 else 0 end) over (partition by pair_id) as len_r
        from f_toklogp),
w as (select pair_id, side, case when not in_loss then 0.0 when pos < least(len_c, len_r) then logp
                                 when pos < (case when side = 0 then len_c else len_r end) then 0.5 * logp else 0.0 end as x, len_c, len_r from t)
select pair_id, round(sum(case when side = 0 then x else 0.0 end), 6) as chosen_logps,
       round(sum(case when side = 1 then x else 0.0 end), 6) as rejected_logps,
       cast(min(len_c) as bigint) as n_chosen, cast(min(len_r) as bigint) as n_rejected
from w group by pair_id
""", "f_toklogp"))
def q_pair_logps_ld(spark, sf):
    return rounded(P.pair_logps(fixture(spark, sf, "f_toklogp"), ["sigmoid"], ld_alpha=0.5))


@register("ref_logps_attach", with_fixtures("""
select pair_id, round(chosen_logps, 6) as chosen_logps, round(rejected_logps, 6) as rejected_logps,
       round(ref_chosen_logps, 6) as ref_chosen_logps, round(ref_rejected_logps, 6) as ref_rejected_logps from f_pairlogp
""", "f_pairlogp"))
def q_ref_logps_attach(spark, sf):
    df = _pairs(spark, sf)
    policy = df.select("pair_id", "chosen_logps", "rejected_logps")
    reference = df.select("pair_id", "ref_chosen_logps", "ref_rejected_logps")
    return rounded(P.attach_reference(policy, reference))
