"""A training corpus from raw documents: filter, deduplicate, cut repeats, pack.

Every stage takes and returns the columns of ``documents`` (the last returns
the pieces of packed sequences).  ``run`` writes each stage as Parquet in the
shared folder and starts the next one from the files.

Defined results: null texts have low quality scores like empty ones and are
dropped by the rules; rows without an id link with nothing and stay; rows
that share an id are one document, of which the first by text stays; clean
documents stay; long texts are handled whole; an empty table gives no pieces.
Extra columns are carried through whatever their names, and none is read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.llm import decision_lists, minhash_join, packing, passages, q_text
from stepwise.llm.common import box, materialise, table

# SQL cannot express the learned and byte-level stages.
ORACLE_SQL = None


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no operator's columns clash with the table's."""
    return docs.select(F.struct("*").alias("_row"), F.col("text"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are unlikely to be rated good and clean."""
    return q_text.quality_scores(spark, _boxed(docs), sf_dir, ["_row"]).where("kept").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a learned rule."""
    counts = decision_lists.with_counts(_boxed(docs), ["_row"])
    return decision_lists.apply_rules(counts, q_text.learned_rules(spark, sf_dir)).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    found = minhash_join.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialise(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64("row"))
    one = left.join(again, "doc_id", "left_semi").select("doc_id", "text", box(docs.columns).alias("row"))
    one = one.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that occur elsewhere; ``n_chars`` follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = passages.remove_passages(docs.select("doc_id", "text", box(rest).alias("row")))
    cut = F.col("n_removed") > 0
    now = {c: F.col(f"row.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in now:
        now["n_chars"] = F.when(cut, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(now["n_chars"])
    return out.select(*(now[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
