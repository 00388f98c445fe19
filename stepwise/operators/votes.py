"""Vote aggregation over sampled verifier generations.

Input is the long vote table ``(key..., gen_idx, text)`` a scorer emits.
Parsing is a narrow projection; the vote is one hash aggregation on the
step key with map-side partial aggregation.  The per-key lists are bounded
by the number of generations per prompt (a scorer parameter, 8 by default).
A vote is sorted as its generation and its reward alone: labels follow from
rewards, and texts are a list of their own, which Spark leaves out where
nobody reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.text import py_strip
from stepwise.functions.verdicts import first_verdict_score, last_verdict, reward_label, verdict_reward


def vote_counted(votes: DataFrame, keys: Sequence[str], gen_col: str = "gen_idx",
                 text_col: str = "output", prefix: str | None = None,
                 strip: bool = False, steps: DataFrame | None = None,
                 keep_outputs: bool = False) -> DataFrame:
    """Mean reward with unparsable generations counted as 0.5.

    Labels come from the *last* verdict in ``prefix + text`` (the prompt is
    prepended when ``prefix`` names a column).  Output per key: ``reward``,
    ``n_votes``, ``parse_failed`` (any label missing), ``all_rewards`` and
    ``verification_labels`` in generation order, with ``keep_outputs`` also
    the ``outputs`` that the labels were read from, prompt included.  With ``steps`` given, keys
    without any vote are kept with reward 0.5 and no labels.
    """
    text = F.col(text_col)
    if strip:
        text = py_strip(text)
    if prefix:
        text = F.concat(F.col(prefix), text)
    labelled = votes.select(*keys, F.col(gen_col).alias("_g"), verdict_reward(last_verdict(text)).alias("_r"),
                            text.alias("_t"))
    outputs = [F.sort_array(F.collect_list(F.struct("_g", "_r", "_t")))["_t"].alias("outputs")] if keep_outputs else []
    agg = (labelled.groupBy(*keys)
           .agg(F.avg("_r").alias("reward"),
                F.count(F.lit(1)).alias("n_votes"),
                F.max(reward_label(F.col("_r")).isNull()).alias("parse_failed"),
                F.sort_array(F.collect_list(F.struct("_g", "_r")))["_r"].alias("all_rewards"),
                *outputs))
    labels = F.transform("all_rewards", reward_label).alias("verification_labels")
    agg = agg.select(*keys, "reward", "n_votes", "parse_failed", "all_rewards", labels, *(["outputs"] if keep_outputs else []))
    if steps is not None:
        agg = (steps.select(*keys).join(agg, list(keys), "left")
               .withColumn("reward", F.coalesce("reward", F.lit(0.5)))
               .withColumn("n_votes", F.coalesce("n_votes", F.lit(0)))
               .withColumn("parse_failed", F.coalesce("parse_failed", F.lit(False)))
               .withColumn("all_rewards", F.coalesce("all_rewards", F.array().cast("array<double>")))
               .withColumn("verification_labels",
                           F.coalesce("verification_labels", F.array().cast("array<string>"))))
    return agg


def vote_excluding_unparsed(votes: DataFrame, keys: Sequence[str], gen_col: str = "gen_idx",
                            text_col: str = "output", keep_outputs: bool = False) -> DataFrame:
    """Mean score over parsable generations only (null when none parse).

    Scores come from the *first* verdict in each generation.  The texts
    themselves travel through the shuffle only with ``keep_outputs``.
    """
    scored = votes.select(*keys, F.col(gen_col).alias("_g"), F.col(text_col).alias("_t"),
                          first_verdict_score(F.col(text_col)).alias("_s"))
    outputs = [F.sort_array(F.collect_list(F.struct("_g", "_s", "_t")))["_t"].alias("outputs")] if keep_outputs else []
    return (scored.groupBy(*keys)
            .agg(F.avg("_s").alias("avg_score"),  # avg skips nulls; all null -> null
                 F.count(F.lit(1)).alias("n_outputs"),
                 F.count("_s").alias("n_valid"),
                 F.sort_array(F.collect_list(F.struct("_g", "_s")))["_s"].alias("scores"),
                 *outputs))


def vote_candidates(votes: DataFrame, sample_col: str = "sample_id", idx_col: str = "candidate_idx",
                    gen_col: str = "gen_idx", text_col: str = "output") -> DataFrame:
    """Candidate reward: mean over the votes of ``(sample, candidate_idx)``.

    Generations are stripped before parsing; duplicate keys are pooled.
    Output: ``reward``, ``n_votes``, ``analysis_outputs``, ``analysis_labels``.
    """
    return (vote_counted(votes, [sample_col, idx_col], gen_col, text_col, strip=True, keep_outputs=True)
            .withColumnRenamed("verification_labels", "analysis_labels")
            .withColumnRenamed("outputs", "analysis_outputs")
            .drop("all_rewards", "parse_failed"))


def vote_counted_wide(df: DataFrame, outputs_col: str = "outputs", strip: bool = True) -> DataFrame:
    """Voting when the n generations of a prompt arrive as one array: no shuffle.

    Same rule as ``vote_counted`` (last verdict, unparsable = 0.5, no
    generations = 0.5): a narrow projection over the array.
    """
    texts = F.col(outputs_col)
    labels = F.transform(texts, lambda t: last_verdict(py_strip(t) if strip else t))
    out = df.withColumn("verification_labels", labels)
    rewards = F.transform("verification_labels", verdict_reward)
    n = F.size("verification_labels")
    return (out.withColumn("all_rewards", rewards)
               .withColumn("n_votes", n.cast("bigint"))
               .withColumn("reward", F.when(n > 0, F.aggregate("all_rewards", F.lit(0.0), lambda a, x: a + x) / n)
                           .otherwise(F.lit(0.5)))
               .withColumn("parse_failed", F.exists("verification_labels", lambda x: x.isNull())))
