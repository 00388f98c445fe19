"""Preference-loss analytics over logged log-probabilities.

Inputs are the four sequence log-probabilities per pair (``chosen_logps``,
``rejected_logps``, ``ref_chosen_logps``, ``ref_rejected_logps``) plus a
``batch_id``; token-level tables carry ``(pair_id, side, pos, logp, ...)``.
Row-wise losses are pure column arithmetic; batch-level terms (running
mean, rank alignment, batch NLL) are small per-batch aggregates joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.numeric import capped_exp, log_sigmoid, relu, sigmoid, softplus
from stepwise.operators.joins import join_summary
from stepwise.operators.ordering import row_number_within, running_mean

LOSS_TYPES = ("sigmoid", "robust", "exo_pair", "hinge", "ipo", "bco_pair", "sppo_hard", "nca_pair",
              "aot_pair", "aot", "apo_zero", "apo_down", "discopop", "sft", "cmcl")
DIVERGENCES = ("reverse_kl", "js_divergence", "alpha_divergence")

# Defaults of the preference configuration.
DEFAULT_BETA = 0.1
DEFAULT_ALPHA_DIVERGENCE_COEF = 1.0
DEFAULT_DISCOPOP_TAU = 0.05
DEFAULT_CMCL = {"alpha": 1.0, "beta": 0.1, "gamma": 0.1, "tau": 1.0}
EXO_DEFAULT_SMOOTHING = 1e-3

C, R, RC, RR = "chosen_logps", "rejected_logps", "ref_chosen_logps", "ref_rejected_logps"


def _cols():
    return F.col(C), F.col(R), F.col(RC), F.col(RR)


def log_ratios(reference_free: bool = False) -> tuple[Column, Column]:
    c, r, rc, rr = _cols()
    if reference_free:
        return c, r
    return c - rc, r - rr


def logits(divergence: str = "reverse_kl", reference_free: bool = False,
           alpha: float = DEFAULT_ALPHA_DIVERGENCE_COEF) -> Column:
    """Preference logits under the chosen f-divergence."""
    c, r, rc, rr = _cols()
    cl, rl = log_ratios(reference_free)
    if divergence == "alpha_divergence":
        return (capped_exp(rl * -alpha) - capped_exp(cl * -alpha)) / alpha
    z = (c - r) - (F.lit(0.0) if reference_free else (rc - rr))
    if divergence == "js_divergence":
        z = z - (softplus(cl) - softplus(rl))
    elif divergence != "reverse_kl":
        raise ValueError(f"unknown divergence {divergence}")
    return z


def rewards(beta: float = DEFAULT_BETA) -> tuple[Column, Column]:
    """Implicit rewards, always measured against the reference."""
    c, r, rc, rr = _cols()
    return beta * (c - rc), beta * (r - rr)


def _sigmoid_form(x: Column, eps: float) -> Column:
    return -log_sigmoid(x) * (1 - eps) - log_sigmoid(-x) * eps


def _running_delta(df: DataFrame, beta: float, batch_col: str) -> DataFrame:
    """Per batch: mean of all chosen and rejected rewards; running mean so far."""
    cr, rr_ = rewards(beta)
    per_batch = df.groupBy(batch_col).agg(((F.sum(cr) + F.sum(rr_)) / (2 * F.count(F.lit(1)))).alias("batch_mean"))
    # one row per batch; the running mean gives every batch equal weight
    return running_mean(per_batch, [batch_col], "batch_mean")


def running_reward_mean(df: DataFrame, beta: float = DEFAULT_BETA, batch_col: str = "batch_id") -> DataFrame:
    return _running_delta(df, beta, batch_col)


def _rank_aligned(df: DataFrame, left: Column, right: Column, batch_col: str, key_col: str) -> DataFrame:
    """Pair the k-th smallest ``left`` with the k-th smallest ``right`` per batch.

    The left side carries every input column, so no join back is needed.
    """
    a = row_number_within(df.select("*", left.alias("_v")), [batch_col], ["_v", key_col], "_k")
    b = row_number_within(df.select(batch_col, key_col, right.alias("_v")), [batch_col], ["_v", key_col], "_k")
    return (a.withColumnRenamed("_v", "_left")
             .join(b.select(batch_col, "_k", F.col("_v").alias("_right")), [batch_col, "_k"]))


BATCH_LOSSES = {"bco_pair", "aot_pair", "aot", "sft"}


def preference_loss_column(loss_type: str = "sigmoid", beta: float = DEFAULT_BETA, label_smoothing: float = 0.0,
                           reference_free: bool = False, divergence: str = "reverse_kl",
                           alpha: float = DEFAULT_ALPHA_DIVERGENCE_COEF, discopop_tau: float = DEFAULT_DISCOPOP_TAU,
                           cmcl: dict | None = None) -> Column:
    """The per-row loss of a row-wise loss type as one column expression."""
    if loss_type in BATCH_LOSSES:
        raise ValueError(f"{loss_type} needs batch context; use preference_loss")
    return _row_loss(loss_type, beta, label_smoothing, reference_free, divergence, alpha, discopop_tau, cmcl)


def _row_loss(loss_type, beta, eps, reference_free, divergence, alpha, discopop_tau, cmcl) -> Column:
    import math
    c, r, rc, rr = _cols()
    cl, rl = log_ratios(reference_free)
    z = logits(divergence, reference_free, alpha)
    bz = beta * z
    if loss_type == "sigmoid":
        return _sigmoid_form(bz, eps)
    if loss_type == "robust":
        return (-log_sigmoid(bz) * (1 - eps) + log_sigmoid(-bz) * eps) / (1 - 2 * eps)
    if loss_type == "exo_pair":
        e = eps if eps != 0 else EXO_DEFAULT_SMOOTHING  # local only: never leaks to other losses
        return sigmoid(bz) * (log_sigmoid(bz) - math.log(1 - e)) + sigmoid(-bz) * (log_sigmoid(-bz) - math.log(e))
    if loss_type == "hinge":
        return relu(1 - bz)
    if loss_type == "ipo":
        return F.pow(z - 1 / (2 * beta), 2)
    if loss_type == "sppo_hard":
        return F.pow((c - rc) - 0.5 / beta, 2) + F.pow((r - rr) + 0.5 / beta, 2)
    if loss_type == "nca_pair":
        a, b = (c - rc) * beta, (r - rr) * beta
        return -log_sigmoid(a) - 0.5 * log_sigmoid(-a) - 0.5 * log_sigmoid(-b)
    if loss_type == "apo_zero":
        return 1 - sigmoid(beta * cl) + sigmoid(beta * rl)
    if loss_type == "apo_down":
        return sigmoid(beta * cl) + 1 - sigmoid(beta * (cl - rl))
    if loss_type == "discopop":
        u = beta * ((c - r) - (rc - rr))
        m = sigmoid(u / discopop_tau)
        return -log_sigmoid(u) * (1 - m) + F.exp(-u) * m
    if loss_type == "cmcl":
        p = {**DEFAULT_CMCL, **(cmcl or {})}
        t2 = p["tau"] ** 2
        return (-p["tau"] * cl + p["alpha"] * p["tau"] * rl
                + (p["beta"] * t2 / 2.0) * F.pow(cl, 2) + (p["gamma"] * t2 / 2.0) * F.pow(rl, 2))
    raise ValueError(f"unknown loss type {loss_type}")


def preference_loss(df: DataFrame, loss_type: str = "sigmoid", beta: float = DEFAULT_BETA,
                    label_smoothing: float = 0.0, reference_free: bool = False,
                    divergence: str = "reverse_kl", alpha: float = DEFAULT_ALPHA_DIVERGENCE_COEF,
                    discopop_tau: float = DEFAULT_DISCOPOP_TAU, cmcl: dict | None = None,
                    batch_nll: DataFrame | None = None, batch_col: str = "batch_id",
                    key_col: str = "pair_id") -> DataFrame:
    """Add ``loss``, ``chosen_reward`` and ``rejected_reward`` per pair.

    ``aot`` / ``aot_pair`` compare rank-aligned values within a batch, so
    the loss of a row belongs to its chosen-side rank.  ``sft`` needs
    ``batch_nll`` = ``(batch_id, nll_loss)``.
    """
    eps = label_smoothing
    c, r, rc, rr = _cols()
    cr, rr_ = rewards(beta)
    out = df
    if loss_type not in BATCH_LOSSES:
        loss = _row_loss(loss_type, beta, eps, reference_free, divergence, alpha, discopop_tau, cmcl)
    elif loss_type == "bco_pair":
        delta = _running_delta(df, beta, batch_col).select(batch_col, F.col("running_mean").alias("_delta"))
        out = join_summary(df, delta, [batch_col])
        d = F.col("_delta")
        loss = -log_sigmoid(beta * (c - rc) - d) - log_sigmoid(-(beta * (r - rr) - d))
    elif loss_type in ("aot_pair", "aot"):
        if loss_type == "aot_pair":
            left, right = c - rc, r - rr
        else:
            left, right = c - r, rc - rr
        ranked = _rank_aligned(df, left, right, batch_col, key_col)
        out = ranked.drop("_k").withColumn("loss", _sigmoid_form(beta * (F.col("_left") - F.col("_right")), eps)) \
                    .drop("_left", "_right")
        loss = F.col("loss")
    else:  # sft
        if batch_nll is None:
            raise ValueError("sft loss needs batch_nll")
        out = join_summary(df, batch_nll.select(batch_col, F.col("nll_loss").alias("_nll")), [batch_col], "left")
        loss = F.coalesce("_nll", F.lit(float("nan")))   # mean over no tokens
    return (out.withColumn("loss", loss)
               .withColumn("chosen_reward", cr)
               .withColumn("rejected_reward", rr_)
               .drop("_delta", "_nll"))


def weighted_losses(df: DataFrame, loss_types: Sequence[str], weights: Sequence[float] | None = None,
                    rpo_alpha: float | None = None, batch_nll: DataFrame | None = None,
                    policy_weights: DataFrame | None = None, aux_coef: float | None = None,
                    key_col: str = "pair_id", batch_col: str = "batch_id", **kw) -> DataFrame:
    """Weighted sum of several losses; the same weights scale the rewards.

    Optional terms: ``+ rpo_alpha * nll`` (batch NLL), ``* policy_weight``
    (``policy_weights`` = ``(key, policy_weight)``), ``+ aux_coef * aux_loss``
    when the input carries an ``aux_loss`` column.
    """
    weights = list(weights) if weights is not None else [1.0] * len(loss_types)
    if len(weights) != len(loss_types):
        raise ValueError("one weight per loss type is required")
    aux = [c for c in ("aux_loss",) if c in df.columns]
    base = df.select(key_col, batch_col, C, R, RC, RR, *aux)
    cr, rr_ = rewards(kw.get("beta", DEFAULT_BETA))
    if not set(loss_types) & BATCH_LOSSES:
        # all row-wise: one projection, no join
        loss = sum((preference_loss_column(lt, **kw) * w for lt, w in zip(loss_types, weights)), F.lit(0.0))
        out = base.select(key_col, batch_col, C, R, RC, RR, *aux, loss.alias("loss"),
                          (cr * sum(weights)).alias("chosen_reward"), (rr_ * sum(weights)).alias("rejected_reward"))
    else:
        # the row-wise losses in one projection, one join for each loss of a batch
        rows = [(lt, w) for lt, w in zip(loss_types, weights) if lt not in BATCH_LOSSES]
        total = base.withColumn("_rows", sum((preference_loss_column(lt, **kw) * w for lt, w in rows), F.lit(0.0)))
        terms = []
        for lt, w in zip(loss_types, weights):
            if lt in BATCH_LOSSES:
                terms.append(f"_l{len(terms)}")
                part = preference_loss(base, lt, batch_nll=batch_nll, batch_col=batch_col, key_col=key_col, **kw)
                total = total.join(part.select(key_col, batch_col, (F.col("loss") * w).alias(terms[-1])), [key_col, batch_col])
        out = total.select(
            key_col, batch_col, C, R, RC, RR, *aux, sum((F.col(t) for t in terms), F.col("_rows")).alias("loss"),
            (cr * sum(weights)).alias("chosen_reward"), (rr_ * sum(weights)).alias("rejected_reward"))
    if rpo_alpha is not None:
        out = join_summary(out, batch_nll.select(batch_col, "nll_loss"), [batch_col], "left") \
                 .withColumn("loss", F.col("loss") + rpo_alpha * F.coalesce("nll_loss", F.lit(float("nan")))).drop("nll_loss")
    if policy_weights is not None:
        out = out.join(policy_weights.select(key_col, "policy_weight"), key_col, "left") \
                 .withColumn("loss", F.col("loss") * F.coalesce("policy_weight", F.lit(float("nan")))).drop("policy_weight")
    if aux_coef is not None and "aux_loss" in df.columns:
        out = out.withColumn("loss", F.col("loss") + aux_coef * F.col("aux_loss"))
    return out


# --------------------------------------------------------------------------
# Batch and window metrics
# --------------------------------------------------------------------------

def batch_metrics(losses: DataFrame, batch_cols: Sequence[str] = ("batch_id",), prefix: str = "") -> DataFrame:
    """Per batch: mean rewards, accuracy (strict >), margin, log-probs, loss.

    Means of ``mean_chosen_logits`` / ``mean_rejected_logits`` / ``nll_loss`` /
    ``aux_loss`` are added when those columns are present.
    """
    cr, rr_ = F.col("chosen_reward"), F.col("rejected_reward")
    aggs = [F.avg(cr).alias(f"{prefix}rewards_chosen"), F.avg(rr_).alias(f"{prefix}rewards_rejected"),
            F.avg((cr > rr_).cast("double")).alias(f"{prefix}rewards_accuracies"),
            F.avg(cr - rr_).alias(f"{prefix}rewards_margins"),
            F.avg(C).alias(f"{prefix}logps_chosen"), F.avg(R).alias(f"{prefix}logps_rejected"),
            F.avg("loss").alias(f"{prefix}loss")]
    for c, name in (("mean_chosen_logits", "logits_chosen"), ("mean_rejected_logits", "logits_rejected"),
                    ("nll_loss", "nll_loss"), ("aux_loss", "aux_loss")):
        if c in losses.columns:
            aggs.append(F.avg(c).alias(f"{prefix}{name}"))
    return losses.groupBy(*batch_cols).agg(*aggs)


def log_windows(metrics: DataFrame, logging_steps: int, batch_col: str = "batch_id") -> DataFrame:
    """Mean of batch means over each window of ``logging_steps`` batches."""
    vals = [c for c in metrics.columns if c != batch_col]
    w = F.floor(F.col(batch_col) / logging_steps).cast("bigint").alias("window_id")
    return metrics.groupBy(w).agg(F.count(F.lit(1)).alias("n_batches"), *[F.avg(c).alias(c) for c in vals])


# --------------------------------------------------------------------------
# Token-level aggregations
# --------------------------------------------------------------------------

def sequence_logps(tokens: DataFrame, normalize: bool = False) -> DataFrame:
    """Per (pair, side): masked log-prob sum, loss-token count, optional mean."""
    il = F.col("in_loss")
    agg = tokens.groupBy("pair_id", "side").agg(
        F.sum(F.when(il, F.col("logp")).otherwise(0.0)).alias("logps_sum"),
        F.count_if(il).alias("n_loss_tokens"))
    if normalize:
        agg = agg.withColumn("logps", F.try_divide(F.col("logps_sum"), F.col("n_loss_tokens").cast("double")))
    else:
        agg = agg.withColumn("logps", F.col("logps_sum"))
    return agg


#: Losses whose sequence log-probabilities are means over the loss tokens.
NORMALISED_LOSSES = {"ipo", "cmcl"}


def pair_logps(tokens: DataFrame, loss_types: Sequence[str], keep: Sequence[str] = (), ld_alpha: float | None = None,
               weighting: bool = False, key_col: str = "pair_id") -> DataFrame:
    """Token log-probabilities (``side`` 0 chosen, 1 rejected) to the pair table of the losses, in one aggregate.

    ``chosen_logps`` and ``rejected_logps`` are sums over the loss tokens, or
    means if a loss of ``loss_types`` asks for them; ``n_chosen`` and
    ``n_rejected`` count the tokens.  With ``ld_alpha`` they are the
    length-desensitised sums instead: tokens at or beyond the shorter side's
    number weigh ``ld_alpha``, those beyond the side's own are left out
    (positions count from the start of the sequence).  ``weighting`` adds
    ``policy_weight`` (see ``policy_weights``).  ``keep`` names columns that
    are equal for all tokens of a pair.  A side without loss tokens has sum 0
    and no mean.
    """
    il = F.col("in_loss")
    aggs = []
    for k, name in ((0, "chosen"), (1, "rejected")):
        own = il & (F.col("side") == k)
        aggs += [F.sum(F.when(own, F.col("logp")).otherwise(0.0)).alias(f"_s_{name}"), F.count_if(own).alias(f"n_{name}")]
        if weighting:
            aggs.append(F.avg(F.when(own, F.col("logp") - F.col("lse2"))).alias(f"_w_{name}"))
        if ld_alpha is not None:
            # bounded by the length of a sequence
            aggs.append(F.collect_list(F.when(own, F.struct("pos", "logp"))).alias(f"_t_{name}"))
    out = tokens.groupBy(key_col, *keep).agg(*aggs)
    public = F.least("n_chosen", "n_rejected")
    logps = []
    for name in ("chosen", "rejected"):
        total, n = F.col(f"_s_{name}"), F.col(f"n_{name}")
        if ld_alpha is not None:
            part = lambda t: F.when(t["pos"] < public, t["logp"]).when(t["pos"] < n, ld_alpha * t["logp"]).otherwise(0.0)  # noqa: B023, E731
            total = F.aggregate(F.array_sort(f"_t_{name}"), F.lit(0.0), lambda a, t: a + part(t))  # noqa: B023
        elif NORMALISED_LOSSES & set(loss_types):
            total = F.try_divide(total, n.cast("double"))
        logps.append(total.alias(f"{name}_logps"))
    weight = [F.least(F.exp(F.col("_w_chosen") + F.col("_w_rejected")), F.lit(1.0)).alias("policy_weight")] if weighting else []
    return out.select(key_col, *keep, *logps, "n_chosen", "n_rejected", *weight)


def length_desensitised_logps(tokens: DataFrame, ld_alpha: float) -> DataFrame:
    """Per (pair, side): tokens before the shorter completion length weigh 1, later ones ``ld_alpha``.

    As in the reference, positions count from the start of the whole
    sequence and positions at or beyond the side's own loss-token count are
    dropped.  The window spans the tokens of one pair; the following
    aggregation reuses its partitioning.
    """
    il = F.col("in_loss")
    per_pair = Window.partitionBy("pair_id")
    t = (tokens
         .withColumn("_len_c", F.sum(F.when(il & (F.col("side") == 0), 1).otherwise(0)).over(per_pair))
         .withColumn("_len_r", F.sum(F.when(il & (F.col("side") == 1), 1).otherwise(0)).over(per_pair)))
    own = F.when(F.col("side") == 0, F.col("_len_c")).otherwise(F.col("_len_r"))
    public = F.least(F.col("_len_c"), F.col("_len_r"))
    lp = F.when(il, F.col("logp")).otherwise(0.0)
    front = F.when(F.col("pos") < public, lp).otherwise(0.0)
    rear = F.when((F.col("pos") >= public) & (F.col("pos") < own), lp).otherwise(0.0)
    return t.groupBy("pair_id", "side").agg((F.sum(front) + ld_alpha * F.sum(rear)).alias("logps"),
                                            F.first("_len_c").alias("len_chosen"),
                                            F.first("_len_r").alias("len_rejected"))


def policy_weights(tokens: DataFrame) -> DataFrame:
    """Per pair: ``min(1, exp(w_chosen + w_rejected))`` with ``w`` the mean of ``logp - lse2`` over loss tokens.

    Positions are aligned (logp and lse2 of the same token).
    """
    il = F.col("in_loss")
    adj = F.col("logp") - F.col("lse2")
    side_mean = lambda s: (F.sum(F.when(il & (F.col("side") == s), adj))
                           / F.count_if(il & (F.col("side") == s)))
    return (tokens.groupBy("pair_id")
            .agg(side_mean(0).alias("w_chosen"), side_mean(1).alias("w_rejected"))
            .withColumn("policy_weight", F.least(F.exp(F.col("w_chosen") + F.col("w_rejected")), F.lit(1.0))))


def batch_nll(tokens: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Token-mean NLL of the chosen side per batch; label id 0 is ignored."""
    keep = F.col("in_loss") & (F.col("side") == 0) & (F.col("token_id") != 0)
    return (tokens.where(keep).groupBy(batch_col)
            .agg((-F.avg("logp")).alias("nll_loss"), F.count(F.lit(1)).alias("n_tokens")))


def attach_reference(policy: DataFrame, reference: DataFrame, key_col: str = "pair_id") -> DataFrame:
    """Use precomputed reference log-probs: an equi-join on the pair key.

    Skipped when the policy table already carries both reference columns.
    Pairs without reference values stay, with null log-probs.
    """
    if RC in policy.columns and RR in policy.columns:
        return policy
    return policy.join(reference.select(key_col, RC, RR), key_col, "left")
