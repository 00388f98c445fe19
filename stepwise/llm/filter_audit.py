"""Filter interaction audit by a Gray-code walk over the subsets of filters.

1. Every document gets one bit per filter that it fails.  Filters are boolean
   columns; one more, ``COPY``, fails documents whose text equals that of a
   smaller id anywhere in the table.  The smallest id of each text is a
   partial aggregate over text digests, and the documents that pass are found
   by a join on (id, digest), so a text with very many copies is no hot key.
2. Documents are counted by part and mask (at most ``2 ** k`` cells a part).
3. Per part, the walk visits all subsets of filters in Gray-code order.  It
   toggles one filter at a time and keeps, for each cell, the number of active
   filters that it fails; a cell that goes from none to one leaves the running
   survivors, one that goes back to none returns.  The survivors of each
   subset are stored, and a step of any order is a difference of two of them.

Defined results: null text is empty text; a null part is the empty string; a
row without an id has no copy before it, is no copy's original and has no
label; rows that share an id and a text are originals alike (no id is smaller); labels of
a repeated id count if any row has them; an empty table has no parts and no
rows.  Texts of any length are handled whole; columns of the table other than
the three named are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import materialise

COPY = "copy"
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def standard_filters(text: Column) -> dict[str, Column | str]:
    """Failure conditions by letter: few words, repeated words, capitals, symbols, copies."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {"A": F.size(words) < 100,
            "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            "C": 100 * capitals > 10 * F.char_length(text),
            "D": text.rlike("[#$%&*|]"),
            "E": COPY}


def failure_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, good, toxic)``: one row per document; bit i of the mask is filter i's failure.

    ``filters`` are conditions on a column ``text`` (null-free).  ``labels`` has ``doc_id, quality, toxic``.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = F.lit(0)
    copies = 0
    for i, failed in enumerate(filters.values()):
        if isinstance(failed, str):
            copies |= 1 << i
        else:
            bits = bits + F.when(failed, F.lit(1 << i)).otherwise(0)
    rows = rows.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    if copies:
        rows = materialise(rows, "masks")
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        late = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(late, F.lit(copies)).otherwise(0))
    rated = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                         F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(rated, "doc_id", "left")
    return rows.select("doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors_by_subset(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: ``out[subset]`` of ``counts[mask]`` (2 ** k rows, any columns)."""
    size = len(counts)
    mask = np.arange(size)
    active = np.zeros(size, np.int64)  # failures of each cell among the filters switched on
    running = counts.sum(axis=0)
    out = np.empty_like(counts)
    subset = 0
    out[0] = running
    for step in range(1, size):
        bit = step & -step  # the bit in which a Gray code differs from the one before
        has = (mask & bit) > 0
        if subset & bit:
            active[has] -= 1
            running = running + counts[has & (active == 0)].sum(axis=0)
        else:
            running = running - counts[has & (active == 0)].sum(axis=0)
            active[has] += 1
        subset ^= bit
        out[subset] = running
    return out


STEPS = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
         "good_lost bigint, toxic_lost bigint, shapley bigint")


def order_steps(part: str, counts: np.ndarray, letters: list[str]) -> list[tuple]:
    """Rows of ``STEPS`` for all orders of the filters, from ``counts[mask] = (documents, good, toxic)``."""
    k = len(letters)
    alive = survivors_by_subset(counts)
    every = (1 << k) - 1
    failing = [int(alive[0][0] - alive[1 << i][0]) for i in range(k)]
    alone = [int(alive[every ^ 1 << i][0] - alive[every][0]) for i in range(k)]
    # how many orders have exactly the filters of a subset before a given one
    orders = [math.factorial(n) * math.factorial(k - 1 - n) for n in range(k)]
    shapley = [sum(orders[s.bit_count()] * int(alive[s][0] - alive[s | 1 << i][0]) for s in range(every + 1) if not s >> i & 1)
               for i in range(k)]
    out = []
    for order in permutations(range(k)):
        name = "".join(letters[i] for i in order)
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = alive[before] - alive[after]
            out.append((part, name, step, int(alive[after][0]), int(lost[0]), failing[i] - int(lost[0]), alone[i],
                        int(lost[1]), int(lost[2]), shapley[i]))
            before = after
    return out


def audit(masks: DataFrame, letters: list[str]) -> DataFrame:
    """Every step of every order of the filters, for each part of ``masks(part, mask, good, toxic)``."""
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells_ in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                counts = np.zeros((1 << len(letters), 3), np.int64)
                for c in cells_:
                    counts[c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = list(zip(*order_steps(part, counts, letters)))
                types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                names = [c.split()[0] for c in STEPS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return parts.mapInArrow(run, STEPS)
