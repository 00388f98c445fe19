"""Answer consistency: predictions vs gold answers.

Plan shape: keep-last dedup of each side (hash aggregate on id with partial
aggregation), one full-outer join on id, narrow projections for parsing.
Numbers and, for what is no plain number, arithmetic expressions are parsed
by Spark expressions; no Python stands in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions import answers as A
from stepwise.functions.expressions import expression_value
from stepwise.functions.text import py_strip

# Status names and reasons of the comparison records.
STATUS_COMPARED = "compared"
STATUS_PRED_MISSING = "pred_missing_answer"
STATUS_GT_MISSING = "gt_missing_answer"
STATUS_ONLY_PRED = "only_in_pred"
STATUS_ONLY_GT = "only_in_gt"
REASON_PRED_MISSING = "prediction answer missing"
REASON_GT_MISSING = "ground-truth answer missing"
REASON_ONLY_PRED = "id only exists in prediction file"
REASON_ONLY_GT = "id only exists in ground-truth file"
KIND_NUMERIC = "numeric compare"
KIND_STRING = "string fallback"


def keep_last(df: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """One row per non-null key: the row with the largest ``order_col``.

    ``order_col`` is the input order (a sequence number, or the readers'
    ``position``, which is taken if no column is named).  Without either the
    rows' present order counts, which nothing keeps through a shuffle.
    ``max_by`` is a partial + final aggregation, so a hot key is folded
    map-side.
    """
    if order_col is None and "position" in df.columns:
        order_col = "position"
    cols = [c for c in df.columns if c != key]
    src = df.where(F.col(key).isNotNull())
    if not cols:
        return src.select(key).distinct()
    payload = F.struct(*[F.col(c) for c in cols])
    order = F.col(order_col) if order_col else F.col("_at")
    if not order_col:
        src = src.withColumn("_at", F.monotonically_increasing_id())
    agg = src.groupBy(key).agg(F.max_by(payload, order).alias("_r"))
    return agg.select(key, *[F.col("_r")[c].alias(c) for c in cols])


def resolve_answers(df: DataFrame, src: str, prefix: str, fallback: bool = True) -> DataFrame:
    """Add ``{prefix}_norm`` (wrapper-stripped text) and ``{prefix}_value`` (number or null).

    The answer is normalised once; the value comes from the number parser
    and, only for answers it leaves open, from the expression evaluator.
    """
    norm, val, frac = f"{prefix}_norm", f"{prefix}_value", f"_{prefix}_frac"
    df = A.strip_wrappers_steps(df, src, norm)
    df = A.number_from_normalised(df, norm, val, src, frac_col=frac)
    if fallback:
        open_ = F.col(val).isNull() & (F.length(py_strip(F.col(src).cast("string"))) > 0)
        df = df.withColumn(val, F.when(open_, expression_value(F.col(frac))).otherwise(F.col(val)))
    return df.drop(frac)


def answer_values(df: DataFrame, src: str, dst: str, fallback: bool = True) -> DataFrame:
    """Add ``dst`` = numeric value of ``src`` (native parser, then fallback)."""
    out = resolve_answers(df, src, f"_{dst}", fallback)
    return out.withColumnRenamed(f"_{dst}_value", dst).drop(f"_{dst}_norm")


def unresolved_expression_values(answers: DataFrame, col: str = "answer") -> DataFrame:
    """Distinct answers that are no plain numbers, with the value of the expression (null: none)."""
    df = A.simple_number_steps(answers.select(col), col, "_v")
    df = A.strip_wrappers_steps(df.where(F.col("_v").isNull() & (F.length(py_strip(F.col(col))) > 0)), col, "expr")
    df = df.select(A.fractions_to_plain(F.col("expr")).alias("expr")).distinct()
    return df.select("expr", expression_value(F.col("expr")).alias("value"))


# --------------------------------------------------------------------------
# Comparison records, summary, id sets
# --------------------------------------------------------------------------

def _blank(c):
    return c.isNull() | (F.length(py_strip(c.cast("string"))) == 0)


def compare_answers(pred: DataFrame, gold: DataFrame, id_col: str = "id", answer_col: str = "answer",
                    pred_order: str | None = None, gold_order: str | None = None,
                    rel_tol: float = A.REL_TOL, abs_tol: float = A.ABS_TOL, fallback: bool = True) -> DataFrame:
    """Tagged full-outer comparison of predicted and gold answers.

    ``status`` is one of compared / pred_missing_answer / gt_missing_answer /
    only_in_pred / only_in_gt; ``match`` is the tolerant numeric comparison
    when both sides parse, else exact equality of the wrapper-stripped text.
    """
    p = keep_last(pred.select(id_col, answer_col, *([pred_order] if pred_order else [])), id_col, pred_order)
    g = keep_last(gold.select(id_col, answer_col, *([gold_order] if gold_order else [])), id_col, gold_order)
    j = (p.select(F.col(id_col).alias("id"), F.col(answer_col).cast("string").alias("pred_answer"),
                  F.lit(True).alias("_inp"))
         .join(g.select(F.col(id_col).alias("id"), F.col(answer_col).cast("string").alias("gt_answer"),
                        F.lit(True).alias("_ing")), "id", "full_outer"))
    inp, ing = F.col("_inp").isNotNull(), F.col("_ing").isNotNull()
    status = (F.when(inp & ~ing, STATUS_ONLY_PRED).when(~inp & ing, STATUS_ONLY_GT)
              .when(_blank(F.col("pred_answer")), STATUS_PRED_MISSING)
              .when(_blank(F.col("gt_answer")), STATUS_GT_MISSING).otherwise(STATUS_COMPARED))
    j = j.withColumn("status", status)
    # parse only what is compared
    cmp = F.col("status") == STATUS_COMPARED
    j = j.withColumn("_pa", F.when(cmp, F.col("pred_answer"))).withColumn("_ga", F.when(cmp, F.col("gt_answer")))
    j = resolve_answers(j, "_pa", "pred", fallback)
    j = resolve_answers(j, "_ga", "gt", fallback)
    numeric = F.col("pred_value").isNotNull() & F.col("gt_value").isNotNull()
    match = F.when(~cmp, F.lit(False)).when(
        numeric, A.values_close(F.col("pred_value"), F.col("gt_value"), rel_tol, abs_tol)).otherwise(
        F.col("pred_norm") == F.col("gt_norm"))
    reason = (F.when(F.col("status") == STATUS_ONLY_PRED, REASON_ONLY_PRED)
              .when(F.col("status") == STATUS_ONLY_GT, REASON_ONLY_GT)
              .when(F.col("status") == STATUS_PRED_MISSING, REASON_PRED_MISSING)
              .when(F.col("status") == STATUS_GT_MISSING, REASON_GT_MISSING)
              .when(numeric, KIND_NUMERIC).otherwise(
                  F.concat(F.lit(KIND_STRING + ": '"), F.col("pred_norm"), F.lit("' vs '"), F.col("gt_norm"), F.lit("'"))))
    return (j.withColumn("match", match)
             .withColumn("reason", reason)
             .withColumn("pred_value", F.when(cmp & numeric, F.col("pred_value")))
             .withColumn("gt_value", F.when(cmp & numeric, F.col("gt_value")))
             .select("id", "pred_answer", "gt_answer", "status", "match", "reason", "pred_value", "gt_value"))


def answer_summary(records: DataFrame, pred_rows: DataFrame, gold_rows: DataFrame,
                   rel_tol: float = A.REL_TOL, abs_tol: float = A.ABS_TOL) -> DataFrame:
    """One-row consistency summary.

    ``pred_samples`` / ``gt_samples`` count raw input rows (duplicates and
    rows without id included); every other count is over distinct ids.
    The three inputs are aggregated separately and combined by a union of
    one-row partial results (no join).
    """
    st = F.col("status")
    counts = records.agg(
        F.count_if(st == STATUS_COMPARED).alias("comparable_samples"),
        F.count_if((st == STATUS_COMPARED) & F.col("match")).alias("matched_samples"),
        F.count_if(st.isin(STATUS_COMPARED, STATUS_PRED_MISSING, STATUS_GT_MISSING)).alias("id_overlap"),
        F.count_if(st == STATUS_ONLY_PRED).alias("only_in_pred"),
        F.count_if(st == STATUS_ONLY_GT).alias("only_in_gt"),
        F.count_if(st == STATUS_PRED_MISSING).alias("pred_missing_answer"),
        F.count_if(st == STATUS_GT_MISSING).alias("gt_missing_answer"),
        F.lit(0).cast("bigint").alias("pred_samples"), F.lit(0).cast("bigint").alias("gt_samples"))
    names = counts.columns
    zero = {c: F.lit(0).cast("bigint").alias(c) for c in names}
    praw = pred_rows.agg(*[F.count(F.lit(1)).alias(c) if c == "pred_samples" else zero[c] for c in names])
    graw = gold_rows.agg(*[F.count(F.lit(1)).alias(c) if c == "gt_samples" else zero[c] for c in names])
    total = counts.unionByName(praw).unionByName(graw).agg(*[F.sum(c).cast("bigint").alias(c) for c in names])
    return (total.withColumn("accuracy", F.coalesce(F.try_divide(F.col("matched_samples").cast("double"),
                                                                 F.col("comparable_samples").cast("double")), F.lit(0.0)))
                 .withColumn("abs_tol", F.lit(abs_tol)).withColumn("rel_tol", F.lit(rel_tol)))


def id_sets(pred: DataFrame, gold: DataFrame, id_col: str = "id") -> DataFrame:
    """Each distinct id tagged ``both`` / ``only_pred`` / ``only_gt``.

    Intersect and both differences from one full-outer join of the two
    distinct id sets (one shuffle instead of three set operations).
    """
    p = pred.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().withColumn("_p", F.lit(True))
    g = gold.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().withColumn("_g", F.lit(True))
    j = p.join(g, "id", "full_outer")
    return j.select("id", F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), "both")
                    .when(F.col("_p").isNotNull(), "only_pred").otherwise("only_gt").alias("membership"))


def gold_answer_map(gold: DataFrame, id_col: str = "id", answer_col: str = "answer",
                    order_col: str | None = None) -> DataFrame:
    """Gold answers with id and answer present, trimmed, last one per id."""
    g = gold.where(F.col(id_col).isNotNull() & F.col(answer_col).isNotNull())
    g = g.select(id_col, py_strip(F.col(answer_col).cast("string")).alias(answer_col),
                 *([order_col] if order_col else []))
    return keep_last(g, id_col, order_col)
