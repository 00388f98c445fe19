"""Hard-negative mining over integer inner products, with rotated one-bit codes.

1. Every vector becomes integers, and those are turned by one fixed random
   rotation.  Its code is the sign of each turned component.  With b the unit
   vector of the signs, the vector is ``a * b + r``: the alignment ``a`` (its
   length along b) and the length of the residual r are stored beside the code.
2. An anchor stays whole: its turned components are rounded to ``PLANES`` bits
   and kept as bit planes, so ``<b, anchor>`` is a weighted sum of popcounts.
   The estimate of an inner product is ``a * <b, anchor>``.  r is at right
   angles to b, so by Cauchy-Schwarz the rest is at most
   ``|r| * sqrt(|anchor|^2 - <b, anchor>^2)``; the rounding of the anchor adds
   at most ``a * |rounding|``.  The interval is certain, not likely.
3. The rows of the best estimates are scored in integers first.  Rows whose
   interval cannot reach the k-th best of these (or the window of scores asked
   for) are passed over; the other surviving intervals are scored in integers.
4. Anchors are held against all rows in blocks of both: a task sees one block
   of anchors and one of rows and passes on the best few of each anchor.

Defined results: rows with a null id, label or vector, or a null or
non-finite component take no part, nor do rows with a component beyond
``LIMIT`` after scaling, whose scores would not fit a long.  Rows that share
an id are one row, the smallest by label and vector.  Shorter vectors are
filled up with zeros.  Equal scores go by id.  Anchors without another row of
their label, and positives without a row in their window, give no rows; an
empty table gives none.  Only the three named columns are read, so others
cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.common import materialise

SCALE = 256
LIMIT = 1 << 24
PLANES = 6
#: Rows of the best estimates that are scored first, for a threshold.
PROBES = 64
SEED = 13
ANCHOR_BLOCK = 1024
ROW_BLOCK = 8192
ROW_BLOCK_BYTES = 16 << 20

CODED = "vec_id bigint, label bigint, anchor boolean, v array<int>, code array<bigint>, along double, rest double"


def integer_rows(vectors: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v, anchor)``: one row per id, its vector as integers."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fits)
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return one.withColumn("anchor", anchor)


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), np.uint8)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), words)


def dense(column: pa.ChunkedArray | pa.Array, dim: int, dtype: type) -> np.ndarray:
    """Lists as rows of ``dim`` numbers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(dtype)
    if len(size) and (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim), dtype)
    out[np.arange(dim) < size[:, None]] = values
    return out


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and residual lengths of the rows of ``v``."""
    turned = v @ turn
    along = np.abs(turned).sum(axis=1) / math.sqrt(v.shape[1])
    rest = np.sqrt(np.maximum((v * v).sum(axis=1) - along ** 2, 0))
    return packed(turned > 0), along, rest


def coded(rows: DataFrame, dim: int) -> DataFrame:
    """``CODED``: rows with their stored codes and alignments."""

    def run(batches):
        turn = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = dense(batch.column("v"), dim, np.int32)
            code, along, rest = encode(v.astype(np.float64), turn)
            lists = lambda m, t: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("anchor"), lists(v, pa.int32()),
                 lists(code.view(np.int64), pa.int64()), pa.array(along), pa.array(rest)],
                names=["vec_id", "label", "anchor", "v", "code", "along", "rest"])

    return rows.select("vec_id", "label", "anchor", "v").mapInArrow(run, CODED)


class Block:
    """The rows of one block, ready for anchors."""

    def __init__(self, t: pa.Table, dim: int):
        self.ids, self.label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        self.v = dense(t.column("v"), dim, np.int64)
        self.code = dense(t.column("code"), -(-dim // 64), np.int64).view(np.uint64)
        self.along, self.rest = t.column("along").to_numpy(), t.column("rest").to_numpy()
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.norm = np.sqrt(self.along ** 2 + self.rest ** 2)


def intervals(block: Block, at: np.ndarray, anchor: np.ndarray, turned: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of the anchor with the rows ``at``, and how far off they can be at most."""
    dim = len(turned)
    low, most = turned.min(), (1 << planes) - 1
    step = max((turned.max() - low) / most, 1e-12)
    level = np.clip(np.rint((turned - low) / step), 0, most).astype(np.int64)
    rounded = low + step * level
    code = block.code[at]
    weighted = np.zeros(len(at), np.int64)
    for j in range(planes):
        plane = packed(((level >> j) & 1).astype(bool)[None, :])[0]
        weighted += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << j
    # <b, anchor> = (2 * sum over ones - sum over all) / sqrt(dim), of the rounded anchor
    t = (2 * (low * block.ones[at] + step * weighted) - rounded.sum()) / math.sqrt(dim)
    off = float(np.linalg.norm(turned - rounded))
    length2 = float(anchor @ anchor)
    least = np.maximum(np.abs(t) - off, 0)
    width = block.rest[at] * np.sqrt(np.maximum(length2 - least ** 2, 0)) + block.along[at] * off
    width += 1e-9 * (block.norm[at] * math.sqrt(length2) + 1)  # rounding of the floats themselves
    return block.along[at] * t, width


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest values (all, if fewer)."""
    return np.argpartition(values, len(values) - k)[len(values) - k:] if len(values) > k else np.arange(len(values))


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -math.inf


def best(block: Block, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places in ``at`` of the ``k`` best scores, ties by id."""
    if len(at) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(at))
    return keep[np.lexsort((block.ids[at[keep]], -scores[keep]))][:k]


def best_same(block: Block, anchor_id: int, label: int, anchor: np.ndarray, turned: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``(id, score)`` of the anchor's ``k`` best other rows of its label in the block."""
    at = np.flatnonzero((block.label == label) & (block.ids != anchor_id))
    if not len(at):
        return []
    middle, width = intervals(block, at, anchor, turned)
    sure = block.v[at[largest(middle, PROBES)]] @ anchor
    at = at[middle + width >= kth_largest(sure, k)]
    scores = block.v[at] @ anchor
    return [(int(block.ids[at[i]]), int(scores[i])) for i in best(block, at, scores, k)]


def best_in_windows(block: Block, label: int, anchor: np.ndarray, turned: np.ndarray, positives: list[tuple[int, int]], k: int,
                    least: int, most: int) -> list[tuple[int, int, int, int]]:
    """``(positive, its score, id, score)``: for each positive the ``k`` best rows of other labels in its window."""
    at = np.flatnonzero(block.label != label)
    if not len(at):
        return []
    middle, width = intervals(block, at, anchor, turned)
    low, high = middle - width, middle + width
    may = np.zeros(len(at), bool)
    for _, score in positives:
        bottom, top = least * score / 100, most * score / 100
        under = np.flatnonzero(middle <= top)
        sure = block.v[at[under[largest(middle[under], PROBES)]]] @ anchor
        sure = sure[(100 * sure >= least * score) & (100 * sure <= most * score)]
        may |= (high >= max(bottom, kth_largest(sure, k))) & (low <= top)
    at = at[may]
    scores = block.v[at] @ anchor
    out = []
    for pid, score in positives:
        fits = np.flatnonzero((100 * scores >= least * score) & (100 * scores <= most * score))
        for i in best(block, at[fits], scores[fits], k):
            out.append((pid, score, int(block.ids[at[fits[i]]]), int(scores[fits[i]])))
    return out


def _in_blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, dim: int, found, schema: str) -> DataFrame:
    """``found(block, anchor row, ints, turned)`` for every anchor and every block of rows.

    Rows are copied once a block of anchors and anchors once a block of rows;
    a group holds one block of each.
    """
    per = max(256, min(ROW_BLOCK, ROW_BLOCK_BYTES // (8 * dim)))
    n_r, n_a = max(1, -(-n_rows // per)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = (rows.select("vec_id", "label", "v", "code", "along", "rest", deal(n_r, 1).alias("r"))
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1)))))
    right = anchors.withColumn("a", deal(n_a, 2)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(t: pa.Table, many: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and many.num_rows:
            block = Block(t, dim)
            whole = dense(many.column("v"), dim, np.int64)
            turned = whole.astype(np.float64) @ rotation(dim)
            for row, v, q in zip(many.drop_columns(["v"]).to_pylist(), whole, turned):
                out += [(row["vec_id"], *x) for x in found(block, row, v, q)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names)

    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(run, schema)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = SCALE) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id`` and both scores.

    ``anchor`` is a condition on ``vec_id``.  An anchor's positives are its best other rows of the same
    label; a negative's score is ``least`` to ``most`` per cent of the positive's.
    """
    rows = materialise(integer_rows(vectors, anchor, id_col, label_col, vector_col, scale), "integers")
    n, n_anchors, dim = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("v"))).first()
    dim = max(dim or 1, 1)
    rows = materialise(coded(rows, dim), "codes")
    anchors = rows.where("anchor").select("vec_id", "label", "v")
    near = _in_blocks(rows, anchors, n, n_anchors, dim,
                      lambda block, row, v, q: best_same(block, row["vec_id"], row["label"], v, q, positives),
                      "vec_id bigint, positive_id bigint, score bigint")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    chosen = near.groupBy("vec_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("chosen"))  # at most ``positives``
    asked = materialise(anchors.join(chosen, "vec_id"), "positives")
    hard = _in_blocks(rows, asked, n, n_anchors, dim,
                      lambda block, row, v, q: best_in_windows(block, row["label"], v, q, [(p["positive_id"], p["score"]) for p in row["chosen"]],
                                                               negatives, least, most),
                      "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
