"""Evaluation analytics: first-error detection and confusion reports.

Plans are single aggregations with conditional counts: no sort and no
window over the step table, so a chain (or class) with a third of all rows
is folded by map-side partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.numeric import harmonic, safe_ratio

# Judgment labels and their descriptions.  The descriptions are
# kept verbatim although they contradict the formulas (the positive class is
# "the step is correct").
JUDGMENT_TEXT = {
    "TP": "Correctly predicted as error",
    "FP": "Incorrectly predicted as error (False Alarm)",
    "TN": "Correctly predicted as correct",
    "FN": "Incorrectly predicted as correct (Missed Error)",
}
IGNORE_REASON = "missing_avg_score_without_detected_error"
ERROR_TYPE_MISMATCH = "first_error_step_mismatch"
ERROR_TYPE_FALSE_POSITIVE = "false_positive_error_detection"

# ProcessBench: a step is an error iff its mean score is <= threshold.
FIRST_ERROR_THRESHOLD = 0.5
# PRMBench: a step is predicted wrong iff its reward is < threshold.
REWARD_THRESHOLD = 0.5


# --------------------------------------------------------------------------
# First-error evaluation (step results keyed by chain id and 0-based index)
# --------------------------------------------------------------------------

def first_error_per_chain(steps: DataFrame, threshold: float = FIRST_ERROR_THRESHOLD,
                          id_col: str = "orig_id", index_col: str = "step_index",
                          score_col: str = "avg_score", with_steps: bool = False) -> DataFrame:
    """One row per chain: the first step predicted wrong (or -1).

    ``first_error_step`` is the smallest index whose score is ``<= threshold``
    (steps without a score are skipped); ``ignored`` marks chains that have a
    missing score and no detected error.  Rows without an id are dropped.
    """
    score = F.col(score_col)
    aggs = [
        F.min(F.when(score <= F.lit(threshold), F.col(index_col))).alias("first_error_step"),
        F.max(score.isNull()).alias("has_missing_score"),
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(score.isNull()).alias("n_missing"),
    ]
    if with_steps:
        # bounded by the number of steps of one chain
        aggs.append(F.sort_array(F.collect_list(F.struct(F.col(index_col).alias("step_index"),
                                                          score.alias("avg_score")))).alias("steps"))
    out = (steps.where(F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("orig_id"))
           .agg(*aggs))
    return (out
            .withColumn("predicted_first_error_step",
                        F.coalesce(F.col("first_error_step"), F.lit(-1)).cast("int"))
            .withColumn("ignored", F.col("has_missing_score") & F.col("first_error_step").isNull()))


def ignored_chains(steps: DataFrame, threshold: float = FIRST_ERROR_THRESHOLD, **kw) -> DataFrame:
    """Chains skipped by the evaluation, with the reason."""
    return (first_error_per_chain(steps, threshold, **kw)
            .where("ignored")
            .select("orig_id", F.lit(IGNORE_REASON).alias("reason"), "n_steps", "n_missing"))


def _labelled(steps: DataFrame, gold: DataFrame, threshold: float, with_steps: bool = False,
              gold_id: str = "id", gold_label: str = "label") -> DataFrame:
    chains = first_error_per_chain(steps, threshold, with_steps=with_steps)
    labels = gold.select(F.col(gold_id).alias("orig_id"), F.col(gold_label).cast("int").alias("label"))
    # Both sides have one row per id; the join is a shuffle on the id that the
    # chain aggregate already produced (AQE broadcasts the label side at
    # run time when it turns out small).
    return chains.join(labels, "orig_id", "left")


def first_error_summary(steps: DataFrame, gold: DataFrame,
                        threshold: float = FIRST_ERROR_THRESHOLD) -> DataFrame:
    """Sample-level first-error report: one row."""
    j = _labelled(steps, gold, threshold)
    pred, label = F.col("predicted_first_error_step"), F.col("label")
    valid = ~F.col("ignored") & label.isNotNull()
    err, ok = valid & (label != -1), valid & (label == -1)
    counts = j.agg(
        F.count_if(err).alias("error_samples"),
        F.count_if(err & (pred == label)).alias("first_error_correct"),
        F.count_if(ok).alias("no_error_samples"),
        F.count_if(ok & (pred == -1)).alias("no_error_correct"),
        F.count_if(valid).alias("valid_samples"),
        F.count_if(F.col("ignored")).alias("ignored_samples"),
    )
    a1 = safe_ratio(F.col("first_error_correct"), F.col("error_samples"))
    a2 = safe_ratio(F.col("no_error_correct"), F.col("no_error_samples"))
    return (counts
            .withColumn("first_error_accuracy", a1)
            .withColumn("no_error_accuracy", a2)
            .withColumn("f1", harmonic(F.col("first_error_accuracy"), F.col("no_error_accuracy")))
            .withColumn("wrong_error_samples", F.col("error_samples") - F.col("first_error_correct"))
            .withColumn("wrong_no_error_samples", F.col("no_error_samples") - F.col("no_error_correct")))


def first_error_wrong_samples(steps: DataFrame, gold: DataFrame,
                              threshold: float = FIRST_ERROR_THRESHOLD) -> DataFrame:
    """Chains whose predicted first error differs from the gold label."""
    j = _labelled(steps, gold, threshold, with_steps=True)
    pred, label = F.col("predicted_first_error_step"), F.col("label")
    valid = ~F.col("ignored") & label.isNotNull()
    return (j.where(valid & (pred != label))
            .select("orig_id",
                    pred.alias("predicted_first_error_step"),
                    label.alias("true_first_error_step"),
                    F.when(label != -1, F.lit(ERROR_TYPE_MISMATCH))
                     .otherwise(F.lit(ERROR_TYPE_FALSE_POSITIVE)).alias("error_type"),
                    "n_steps", "steps"))


def first_error_profile(steps: DataFrame, gold: DataFrame,
                        threshold: float = FIRST_ERROR_THRESHOLD) -> DataFrame:
    """Input profile: step rows, chains, label-map size, valid and ignored chains."""
    score = F.col("avg_score")
    chains = (steps.groupBy(F.col("orig_id"))
              .agg(F.count(F.lit(1)).alias("n_steps"),
                   F.min(F.when(score <= F.lit(threshold), F.col("step_index"))).alias("fe"),
                   F.max(score.isNull()).alias("miss")))
    labels = gold.select(F.col("id").alias("orig_id"), F.lit(True).alias("has_label"))
    j = chains.join(labels, "orig_id", "full_outer")
    has_chain = F.col("n_steps").isNotNull() & F.col("orig_id").isNotNull()
    ignored = has_chain & F.col("miss") & F.col("fe").isNull()
    return j.agg(
        F.coalesce(F.sum("n_steps"), F.lit(0)).cast("bigint").alias("step_rows"),
        F.count_if(has_chain).alias("chain_rows"),
        F.count_if(F.col("has_label")).alias("label_map_size"),
        F.count_if(has_chain & ~ignored & F.col("has_label").isNotNull()).alias("valid_samples"),
        F.count_if(ignored).alias("ignored_samples"),
    )


# --------------------------------------------------------------------------
# Classified step evaluation (confusion matrix, overall and per class)
# --------------------------------------------------------------------------

def _flags(df: DataFrame, threshold: float) -> tuple:
    is_err = F.coalesce(F.col("is_error"), F.lit(False))
    pred_err = F.coalesce(F.col("reward"), F.lit(0.5)) < F.lit(threshold)
    return is_err, pred_err


def _confusion_aggs(df: DataFrame, threshold: float) -> list:
    is_err, pred_err = _flags(df, threshold)
    return [
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(~is_err & ~pred_err).alias("true_positives"),
        F.count_if(is_err & ~pred_err).alias("false_positives"),
        F.count_if(is_err & pred_err).alias("true_negatives"),
        F.count_if(~is_err & pred_err).alias("false_negatives"),
    ]


def with_confusion_ratios(counts: DataFrame) -> DataFrame:
    """Add the nine ratios; every zero denominator yields 0.0."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives",
                                         "true_negatives", "false_negatives"))
    return (counts
            .withColumn("accuracy", safe_ratio(tp + tn, F.col("total_samples")))
            .withColumn("precision", safe_ratio(tp, tp + fp))
            .withColumn("recall", safe_ratio(tp, tp + fn))
            .withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
            .withColumn("negative_precision", safe_ratio(tn, tn + fn))
            .withColumn("negative_recall", safe_ratio(tn, tn + fp))
            .withColumn("negative_f1_score", harmonic(F.col("negative_precision"), F.col("negative_recall")))
            .withColumn("avg_f1", (F.col("f1_score") + F.col("negative_f1_score")) / 2.0))


def confusion_metrics(results: DataFrame, threshold: float = REWARD_THRESHOLD) -> DataFrame:
    """Overall confusion counts and ratios: one row."""
    return with_confusion_ratios(results.agg(*_confusion_aggs(results, threshold)))


def confusion_metrics_by_class(results: DataFrame, threshold: float = REWARD_THRESHOLD,
                               default_class: str = "unclassified") -> DataFrame:
    """Overall row plus one row per classification, in one scan.

    ``rollup`` yields the grouping sets ((classification), ()).  Per-class
    rows are kept only if there is more than one class or the single class
    is not the default one.
    """
    cls = F.coalesce(F.col("classification"), F.lit(default_class)).alias("classification")
    rolled = (results.select(cls, "is_error", "reward")
              .rollup("classification")
              .agg(F.grouping("classification").alias("_g"), *_confusion_aggs(results, threshold)))
    whole = Window.partitionBy()  # over the rolled-up rows only: #classes + 1
    rolled = (rolled
              .withColumn("_n_cls", F.sum(1 - F.col("_g")).over(whole))
              .withColumn("_only_default", F.max(F.when((F.col("_g") == 0) & (F.col("classification") != default_class), 1)
                                                  .otherwise(0)).over(whole) == 0))
    keep = (F.col("_g") == 1) | (F.col("_n_cls") > 1) | ~F.col("_only_default")
    out = (rolled.where(keep)
           .withColumn("scope", F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.lit("class")))
           .withColumn("classification", F.when(F.col("_g") == 0, F.col("classification")))
           .drop("_g", "_n_cls", "_only_default"))
    return with_confusion_ratios(out)


def step_judgments(results: DataFrame, threshold: float = REWARD_THRESHOLD) -> DataFrame:
    """Per-step judgment type and description."""
    is_err, pred_err = _flags(results, threshold)
    jtype = (F.when(~is_err & ~pred_err, "TP").when(is_err & ~pred_err, "FP")
             .when(is_err & pred_err, "TN").otherwise("FN"))
    desc = F.create_map(*[F.lit(x) for kv in JUDGMENT_TEXT.items() for x in kv])
    return (results
            .select(F.coalesce(F.col("original_id").cast("string"), F.lit("unknown")).alias("original_id"),
                    F.coalesce(F.col("step_id"), F.lit(0)).alias("step_id"),
                    is_err.alias("is_error"),
                    F.coalesce(F.col("reward"), F.lit(0.5)).alias("reward"),
                    pred_err.alias("predicted_error"),
                    jtype.alias("judgment_type"))
            .withColumn("judgment_desc", desc[F.col("judgment_type")]))


def report_text(metrics: DataFrame, places: int = 4, percent: tuple[str, ...] = ()) -> DataFrame:
    """Printable report: ratios with ``places`` decimals, chosen columns as percent.

    Counts stay integers; only double columns are formatted (one row per
    report, so this is a projection over a tiny table).
    """
    cols = []
    for f in metrics.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            if f.name in percent:
                c = F.concat(F.format_string(f"%.{places}f", c * 100.0), F.lit("%"))
            else:
                c = F.format_string(f"%.{places}f", c)
        cols.append(c.alias(f.name))
    return metrics.select(*cols)
