"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts (one narrow pass) and their labels give an ordered
list of rules, each a conjunction of thresholds such as
``symbol_share >= 0.12 and n_words < 300``.  A rule is grown condition by
condition by information gain on two thirds of the rows left, pruned on the
other third, and the rows it covers are set aside; growing stops when a
pruned rule is no better than ``min_precision``.  The list becomes one
``CASE WHEN`` expression, so applying it is plain Spark.

Learning uses at most ``max_rows`` labelled rows (their statistics only).

Defined results: null text has no words and fails the base rules; rows
without a label are not learned from; an id labelled several times counts
as its lowest label; without both labels the list is empty and every text
that passes the base rules is kept.  Long texts are counted whole; repeated
rows have the same counts; of equally good conditions the first in the order
of ``COUNTS`` and ``SHARES`` is taken; an empty table gives no rows and no
rules.  Columns named like the results are replaced, others are untouched
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import box, map_batches, unbox

MAX_ROWS = 6000
SEED = 41
RESULTS = ["base_failed", "rule", "kept"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
# Statistics that conditions may test, as expressions of the counts.
SHARES = {"symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
          "repeat_share": "n_repeat_words / greatest(n_words, 1)", "upper_share": "n_upper / greatest(word_chars, 1)",
          "mark_share": "n_marks / greatest(word_chars, 1)", "chars_per_word": "word_chars / greatest(n_words, 1)",
          "words_per_line": "n_words / greatest(n_lines, 1)"}
BASE_RULE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text; words are runs of anything but space and 0x09-0x0D."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(raw.count(c) for c in _SPACE)
    n_symbols = sum(raw.count(c) for c in b"#*$%&|<>")
    seen, dup, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= 4:
        triples = list(zip(words, words[1:], words[2:]))
        if len(set(triples)) < len(triples):
            first: set = set()
            twice = {t for t in triples if t in first or first.add(t)}
            covered = np.zeros(n, bool)
            for i, t in enumerate(triples):
                if t in twice:
                    covered[i:i + 3] = True
            repeated = int(covered.sum())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return n, word_chars, n_symbols, dup, repeated, upper, raw.count(b"!") + raw.count(b"?"), n_lines


def with_counts(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` with the ``COUNTS`` (in place of columns of those names); a narrow pass over whole texts."""
    columns = [c for c in columns if c not in COUNTS]
    rows = docs.select(box(columns).alias("row"), F.col(text_col).alias("text"))
    schema = rows.select("row").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_counts(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(got[:, k]) for k in range(len(COUNTS)))],
                                             names=["row", *COUNTS])

    return unbox(map_batches(rows, run, schema), columns, COUNTS)


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    value: float

    def sql(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {self.value!r}D"

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return stats[self.stat] >= self.value if self.at_least else stats[self.stat] < self.value


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)

    def covers(self, stats: dict[str, np.ndarray], n: int) -> np.ndarray:
        hit = np.ones(n, bool)
        for c in self.conditions:
            hit &= c.holds(stats)
        return hit


def _best_condition(stats: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the highest gain ``p * (log2 purity after - log2 purity before)``."""
    before = np.log2(max(bad.mean(), 1e-9))
    top, best = 0.0, None
    for name, x in stats.items():
        order = np.argsort(x, kind="stable")
        v, y = x[order], bad[order].astype(np.float64)
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        p_low = np.cumsum(y)[cut - 1]
        p_high = y.sum() - p_low
        for at_least, p, n in ((False, p_low, cut), (True, p_high, len(v) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - before), 0.0)
            i = int(gain.argmax())
            if gain[i] > top + 1e-12:
                lo, hi = float(v[cut[i] - 1]), float(v[cut[i]])
                mid = float(np.float32((lo + hi) / 2))
                top, best = float(gain[i]), Condition(name, at_least, mid if lo < mid <= hi else hi)
    return top, best


def learn_rules(stats: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_cover: int = 4,
                max_rules: int = 24, max_conditions: int = 4, seed: int = SEED) -> list[Rule]:
    """Ordered reject rules; ``bad`` marks the rows to reject."""
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[left].sum() >= min_cover:
        mixed = rng.permutation(left)
        grow, prune = mixed[:2 * len(mixed) // 3], mixed[2 * len(mixed) // 3:]
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < max_conditions and len(inside) and not bad[inside].all():
            gain, c = _best_condition({k: v[inside] for k, v in stats.items()}, bad[inside])
            if c is None:
                break
            conditions.append(c)
            inside = inside[c.holds({c.stat: stats[c.stat][inside]})]
        if not conditions:
            break
        # drop final conditions while (p - n) / (p + n) on the pruning rows does not fall
        def worth(k: int) -> float:
            hit = prune[Rule(tuple(conditions[:k])).covers({s: v[prune] for s, v in stats.items()}, len(prune))]
            return (2 * bad[hit].sum() - len(hit)) / (len(hit) + 1)
        k = max(range(1, len(conditions) + 1), key=lambda j: (worth(j), -j))
        rule = Rule(tuple(conditions[:k]))
        hit = rule.covers({s: v[left] for s, v in stats.items()}, len(left))
        if hit.sum() < min_cover or bad[left][hit].mean() < min_precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def rules_expression(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects a row, else null: one ordered CASE WHEN."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("case " + " ".join(f"when {r.sql()} then {i}" for i, r in enumerate(rules, 1)) + " end")


def label_sample(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` ids of ``labels(doc_id, good)`` in hash order, each with its lowest label."""
    one = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    return one.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)


def labelled_statistics(counts: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and bad marks of at most ``max_rows`` rows of ``counts`` with ``doc_id`` and ``good``."""
    names = [*COUNTS, *SHARES]
    rows = (counts.withColumns({k: F.expr(v) for k, v in SHARES.items()})
            .select("good", "doc_id", *(F.col(n).cast("double") for n in names))
            .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", *names).limit(max_rows).collect())
    rows.sort(key=lambda r: tuple(r[1:]))
    stats = np.array([r[2:] for r in rows], np.float64).reshape(-1, len(names))
    return dict(zip(names, stats.T)), np.array([not r["good"] for r in rows], bool)


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``counts`` with ``base_failed``, ``rule`` (number of the rejecting rule) and ``kept`` (in place of columns of those names)."""
    columns = [c for c in counts.columns if c not in RESULTS]
    out = counts.select(box(columns).alias("row"), *COUNTS).withColumns({k: F.expr(v) for k, v in SHARES.items()})
    out = out.withColumn("base_failed", F.expr(BASE_RULE)).withColumn("rule", rules_expression(rules))
    return unbox(out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), columns, RESULTS)
