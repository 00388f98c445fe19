"""Merkle fingerprints of documents (native).

A document is a tree: its sections, their paragraphs (lines), their phrases.
A section ends after an empty paragraph or one whose digest starts with 0-3,
so boundaries move with the content and an insertion disturbs its own section
only.  The fingerprint is ``root:body``; the body lists the paragraphs
(128-bit digest, a dot, a 32-bit hash per phrase), each followed by ``,`` or,
at the end of a section, ``/``.  The root hashes the section hashes: equal
texts have equal roots, and differing branches locate an edit
(``changed_sections``).

Likeness of two fingerprints is the Dice coefficient of their distinct phrase
hashes, 1.0 if both have none.  Null text counts as empty; rows are never
merged, so repeated rows give repeated results.  "Next" follows ascending
doc_id, nulls first, ties by text hash; after the last comes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A phrase: up to 32 characters of a sentence with its closing marks.
PHRASE = r"[^.!?]{1,32}[.!?]*|[.!?]+"


def _with_tree(df: DataFrame, text: str, fingerprint: str, leaves: str) -> DataFrame:
    """Add the fingerprint and the phrase hashes of a text column."""
    node = F.transform(F.split(F.col(text), "\n"), lambda p: F.struct(
        F.substring(F.sha2(p, 256), 1, 32).alias("d"), (p == "").alias("empty"),
        F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)),
                    lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))).alias("l")))
    df = df.withColumn("_node", node)
    body = F.array_join(F.transform("_node", lambda n: F.concat(
        n["d"], F.lit("."), F.array_join(F.transform(n["l"], lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ""),
        F.when(n["empty"] | (F.substring(n["d"], 1, 1) <= "3"), F.lit("/")).otherwise(F.lit(",")))), "")
    df = df.withColumn("_body", body).withColumn(leaves, F.flatten(F.transform("_node", lambda n: n["l"])))
    root = F.sha2(F.array_join(F.transform(F.split("_body", "/"), lambda s: F.sha2(s, 256)), ""), 256)
    return df.withColumn(fingerprint, F.concat(root, F.lit(":"), F.col("_body"))).drop("_node", "_body")


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (replacing one of that name)."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    return _with_tree(out, "_text", "fingerprint", "_leaves").drop("_text", "_leaves")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of phrase hashes."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of fingerprint ``b`` that fingerprint ``a`` lacks (1-based); empty if the roots agree."""
    parts = lambda f: F.split(F.substring_index(f, ":", -1), "/")
    old = parts(a)
    numbered = F.transform(parts(b), lambda s, i: F.when(~F.array_contains(old, s), i + 1))
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.array().cast("array<int>")).otherwise(F.filter(numbered, lambda i: i.isNotNull()))


def _buckets(ids: DataFrame, n: int) -> tuple[Column, Column]:
    """Order-preserving bucket ``(_b, _sub)`` of a row by its ``doc_id`` and text hash ``_h``.

    At most ``n`` boundaries reach the driver.  An id that fills several
    buckets, or null, is split further by the text hash.
    """
    q = [(i + 1) / n for i in range(n - 1)]
    cuts = ids.select(F.percentile_approx("doc_id", q, max(10_000, 10 * n)).alias("q")).first()["q"] if q else None
    cuts = sorted(cuts or [])
    hot = sorted({c for c, d in zip(cuts, cuts[1:]) if c == d})
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    lits = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    below = lambda arr: F.size(F.filter(arr, lambda c: c < F.col("doc_id")))
    if cuts:
        coarse = below(lits(cuts[step - 1::step])) * step
        b = coarse + below(F.slice(lits(cuts), coarse + 1, F.lit(step)))
    else:
        b = F.lit(0)
    by_hash = F.shiftright("_h", 56).cast("int")
    sub = F.when(F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False)), by_hash).otherwise(F.lit(-129))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(b), sub


def with_following_heads(docs: DataFrame) -> DataFrame:
    """Rows dealt to order-preserving buckets ``(_b, _sub)``, each closed by the next bucket's head.

    ``docs`` holds ``doc_id``, the text hash ``_h`` and a payload.  The head
    of the following bucket travels along as an extra row (``_ghost``), so
    a window over a bucket sees every row's successor and no task more than
    its bucket; the last bucket is closed by the very first row.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    b, sub = _buckets(docs.select("doc_id"), n)
    rows = docs.withColumn("_b", b).withColumn("_sub", sub)
    heads = sorted(((r["_b"], r["_sub"], r["m"]["doc_id"], r["m"]["_h"]) for r in
                    rows.groupBy("_b", "_sub").agg(F.min(F.struct("doc_id", "_h")).alias("m")).toLocalIterator()),
                   key=lambda r: r[:2])
    pairs = [(*prev[:2], *head[2:]) for prev, head in zip(heads, heads[1:] + heads[:1])]
    links = spark.createDataFrame(pairs, "_b int, _sub int, _id bigint, _hh bigint")
    # one short row per bucket: bounded by the number of buckets, whatever the table's size
    ghosts = (docs.join(F.broadcast(links), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")))
              .select(*docs.columns, "_b", "_sub").dropDuplicates(["_b", "_sub"]).withColumn("_ghost", F.lit(True)))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts).repartition("_b", "_sub")
    return both


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edit replaces the last quarter (floor) of the code points by the
    first as many of the next document.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("_h", F.xxhash64("text"))
    rows = _with_tree(with_following_heads(base), "text", "fingerprint", "_leaves")
    w = Window.partitionBy("_b", "_sub").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h")
    rows = (rows.withColumn("_next", F.lead(F.struct("text", "_leaves")).over(w)).where("not _ghost")
            .withColumn("n_chars", F.char_length("text").cast("bigint")))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - k).cast("int")),
                                               F.substring(F.col("_next.text"), F.lit(1), k)))
    rows = _with_tree(rows, "_edited", "edited_fingerprint", "_edited_leaves")
    return rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("_leaves"), F.col("_edited_leaves")).alias("near_edited"),
                       likeness(F.col("_leaves"), F.col("_next._leaves")).alias("near_next"),
                       changed_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("changed_sections"))
