"""Queries of the text operators: language, quality, packing, rules, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import decision_lists, language_id, packing, pieces, quality_ordinal
from stepwise.llm.common import table

GRADES, KEEP_GRADE = 3, 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sample = language_id.training_sample(learn)
    net = language_id.train([t for t, _ in sample], [c for _, c in sample])
    return (language_id.identify(docs, net, ["doc_id"])
            .select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, columns: list[str]) -> DataFrame:
    """Scores of ``docs`` by a model learned from the rated rows of ``documents``."""
    ratings = quality_ordinal.graded(table(spark, sf_dir, "labels"))
    model = quality_ordinal.train(quality_ordinal.rated_sample(table(spark, sf_dir, "documents"), ratings), GRADES)
    return quality_ordinal.score(docs, model, columns, GRADES, KEEP_GRADE)


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def learned_rules(spark: SparkSession, sf_dir: str) -> list[decision_lists.Rule]:
    """Rules from at most ``MAX_ROWS`` labelled rows of ``documents``, counted in the scan that finds them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    sample = decision_lists.label_sample(labels)
    # bounded by MAX_ROWS short rows
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return decision_lists.learn_rules(*decision_lists.labelled_statistics(decision_lists.with_counts(docs, ["doc_id", "good"])))


def op6_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = decision_lists.with_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    return decision_lists.apply_rules(counts, learned_rules(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


QUERIES = {"op1_language_id": op1_language_id, "op2_quality_ordinal": op2_quality_ordinal, "op4_packing": op4_packing,
           "op6_decision_lists": op6_decision_lists, "op10_pieces": op10_pieces}
