"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade > k) = sigmoid(w.x - theta_k)`` with weights ``w`` over hashed text
features shared by all grades and ordered thresholds ``theta_0 < theta_1 ..``.
It gives the expected grade and the tail probability ``P(grade >= g)`` used
for selection.  Features of a text, hashed to ``2**18`` places: its distinct
lower-cased words and their first five letters, its word shapes (letter case,
digits, kept marks; runs collapsed) weighted by their share of all words, a
bucketed length and the shares of repeated words and lines.

Training takes at most ``max_rows`` rated rows in hash order (numpy, AdaGrad
on the driver); scoring is one narrow pass over whole texts.

Defined results: null text counts as empty; a text without words has the
features of length 0 only; rows without a rating are not learned from; an id
rated several times has its lowest rating.  Without at least two grades to
learn from every text gets the top grade with probability 1, so nothing is
rejected.  Long texts are scored whole; repeated rows score alike, and a
probability of exactly ``min_tail`` is kept; an empty table gives no rows.  Columns named like the results are replaced,
others are untouched whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import box, map_batches, unbox

PLACES = 1 << 18
MAX_ROWS = 3000
#: Expected share of features that get a weight by chance alone.
FALSE_RATE = 0.001
SEED = 29
RESULTS = ["expected_grade", "tail_prob", "kept"]
CACHE_WORDS = 300_000

_MARKS = ".,;:!?"


def _shape(word: str) -> str:
    """``Word,`` -> ``Aa,``; ``WORD!!`` -> ``A!!``: letters and digits by case with runs collapsed, at most 8 characters."""
    core = word.rstrip(_MARKS)
    if core.isalpha():
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[1:].islower() else "AaA"
        return kind + word[len(core):][:5]
    return "".join(k for k, _ in groupby(
        "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))[:8]


def _place(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}\t{value}".encode()) % PLACES


class Features:
    """Hashed features of texts, or of those at ``useful`` places alone; remembers at most ``CACHE_WORDS`` words."""

    def __init__(self, useful: np.ndarray | None = None):
        self.useful = useful
        self.words: dict[str, tuple[tuple[int, ...], int]] = {}

    def _of_word(self, word: str) -> tuple[tuple[int, ...], int]:
        """Places of the word and of its first letters; place of its shape."""
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        core = word.lower().strip(_MARKS)
        places = (_place("w", core[:64]), _place("p", core[:5]))
        if self.useful is not None:
            places = tuple(p for p in places if self.useful[p])
        self.words[word] = got = places, _place("s", _shape(word[:64]))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places and their values."""
        words = (text or "").split()
        n = len(words)
        value: dict[int, float] = {_place("n", str(int(math.log2(n + 1)))): 0.5}
        if n:
            counts = Counter(words)
            shapes: dict[int, int] = {}
            known, learn = self.words, self._of_word
            for word, c in counts.items():
                places, shape = known.get(word) or learn(word)
                for p in places:
                    value[p] = 1.0
                shapes[shape] = shapes.get(shape, 0) + c
            for shape, c in shapes.items():
                value[shape] = 3.0 * c / n
            lines = [x for x in text.split("\n") if x.strip()]
            value[_place("r", "words")] = 3.0 * (1 - len(counts) / n)
            value[_place("r", "lines")] = 3.0 * (1 - len(set(lines)) / len(lines)) if lines else 0.0
        return np.fromiter(value.keys(), np.int64, len(value)), np.fromiter(value.values(), np.float32, len(value))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for every threshold k."""
        if not len(self.thresholds):
            return np.ones(0)
        margin = float(self.weights[places] @ values) - self.thresholds
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _telling_places(data: list, grades: int, min_texts: int, false_rate: float) -> np.ndarray:
    """Places whose texts exceed some grade more or less often than all do.

    Of the places found for a grade, a share of ``false_rate`` is expected to
    be there by chance (Benjamini and Hochberg's step-up over the places of
    ``min_texts`` texts or more), so the bound follows the numbers of features
    and of rated rows.
    """
    grade = np.array([g for _, _, g in data])
    size = [len(p) for p, _, _ in data]
    places = np.concatenate([p for p, _, _ in data])
    n = np.bincount(places, minlength=PLACES)
    telling = n == len(data)
    often = np.flatnonzero(n >= min_texts)
    for k in range(grades - 1):
        above = (grade > k).astype(np.float64)
        total = np.bincount(places, weights=np.repeat(above, size), minlength=PLACES)
        z = (total - n * above.mean())[often] / (max(above.std(), 1e-9) * np.sqrt(n[often]))
        chance = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z.tolist()])
        order = np.argsort(chance, kind="stable")
        passed = np.flatnonzero(chance[order] <= false_rate * np.arange(1, len(order) + 1) / max(len(order), 1))
        if len(passed):
            telling[often[order[:passed[-1] + 1]]] = True
    return telling


def train(rows: list[tuple[str | None, int]], grades: int, epochs: int = 8, rate: float = 0.3, l2: float = 1e-4,
          min_texts: int = 5, false_rate: float = FALSE_RATE, seed: int = SEED) -> OrdinalModel | None:
    """AdaGrad on the cumulative-link likelihood over the telling places; the others keep weight 0."""
    seen = Counter(g for _, g in rows)
    if len(seen) < 2:
        return None
    features = Features()
    data = [(*features(text), grade) for text, grade in rows]
    telling = _telling_places(data, grades, min_texts, false_rate)
    data = [(p[keep], v[keep], g) for p, v, g in data for keep in [telling[p]]]
    w, gw = np.zeros(PLACES, np.float32), np.full(PLACES, 0.1, np.float32)
    # thresholds: theta_0 = t[0], theta_k = theta_{k-1} + exp(t[k])
    t, gt = np.zeros(grades - 1), np.ones(grades - 1)
    t[0] = -2.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            places, values, g = data[i]
            theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
            margin = float(w[places] @ values)
            tail = 1.0 / (1.0 + np.exp(-np.clip(margin - theta, -30, 30)))
            # P(g) = tail[g-1] - tail[g]; gradient of -log P
            hi = tail[g - 1] if g else 1.0
            lo = tail[g] if g < grades - 1 else 0.0
            p = max(hi - lo, 1e-6)
            d_hi = hi * (1 - hi) if g else 0.0
            d_lo = lo * (1 - lo) if g < grades - 1 else 0.0
            d_margin = -(d_hi - d_lo) / p
            d_theta = np.zeros(grades - 1)
            if g:
                d_theta[g - 1] += d_hi / p
            if g < grades - 1:
                d_theta[g] -= d_lo / p
            grad = d_margin * values + l2 * w[places]
            gw[places] += grad * grad
            w[places] -= rate * grad / np.sqrt(gw[places])
            back = np.cumsum(d_theta[::-1])[::-1].copy()
            back[1:] *= np.exp(t[1:])
            gt += back * back
            t -= rate * back / np.sqrt(gt)
    return OrdinalModel(w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def rated_sample(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str | None, int]]:
    """At most ``max_rows`` (text, grade); ``ratings(doc_id, grade)``.

    The sampled ids (bounded by ``max_rows``) are broadcast, so the texts
    are filtered in the scan and only sampled ones move.
    """
    one = (ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
           .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows))
    got = (docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
           .select("doc_id", "text", "grade")
           .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", F.xxhash64("text"), "text").limit(2 * max_rows).collect())
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [(r["text"], int(r["grade"])) for r in got]


def score(docs: DataFrame, model: OrdinalModel | None, columns: list[str], grades: int, keep_grade: int,
          min_tail: float = 0.3, text_col: str = "text") -> DataFrame:
    """``columns`` with ``expected_grade``, ``tail_prob`` = P(grade >= keep_grade) and ``kept`` (in place of columns of those names)."""
    columns = [c for c in columns if c not in RESULTS]
    rows = docs.select(box(columns).alias("row"), F.col(text_col).alias("text"))
    if model is None:
        rows = rows.withColumns({"expected_grade": F.lit(float(grades - 1)), "tail_prob": F.lit(1.0), "kept": F.lit(True)})
        return unbox(rows, columns, RESULTS)
    schema = rows.select("row").schema.add("expected_grade", "double").add("tail_prob", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.weights != 0)
        for batch in batches:
            tails = [model.tails(*features(t)) for t in batch.column("text").to_pylist()]
            expected = pa.array([float(x.sum()) for x in tails], pa.float64())
            tail = pa.array([float(x[keep_grade - 1]) for x in tails], pa.float64())
            kept = pa.array([bool(x[keep_grade - 1] >= min_tail) for x in tails], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row"), expected, tail, kept], names=["row", *RESULTS])

    return unbox(map_batches(rows, run, schema), columns, RESULTS)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from 0/1 labels: 0 low quality, 1 good but toxic, 2 good and clean (unknown toxicity: clean)."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
