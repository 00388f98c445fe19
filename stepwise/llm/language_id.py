"""Language identification by a bidirectional gated recurrent network over bytes.

Each text is read as UTF-8 bytes in windows of 128; a forward and a backward
gated recurrent layer (numpy; update gate and candidate with softsign
activations) label every byte, and a document's probability
of a language is the mean over all its bytes.  Training is backpropagation
through time on a bounded sample: about ``rows_per_lang`` texts of every
language (fewer, but one at least, where all would exceed ``budget``), one window of 512 characters each.

Defined results: a text that is null or has no letter is ``und`` with score
0; so is every text if there is nothing to learn from.  Rows with null text
or language are never learned from.  Ties go to the language first in
alphabetical order.  Long texts are cut into windows, so memory does not
depend on the length of the rows in flight beyond the texts themselves.
Repeated rows are labelled alike; an empty table gives no rows.  Columns named
like the results are replaced, others are untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import box, unbox

WINDOW = 128
HIDDEN = 8
BATCH = 2048
ROWS_PER_LANG = 400
BUDGET = 25_600
SEED = 17


def _byte_classes() -> np.ndarray:
    """Bytes as the network sees them: A-Z as a-z, other ASCII but letters as space."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    ascii_other = [b for b in range(128) if not 97 <= lut[b] <= 122]
    lut[ascii_other] = 32
    return lut


BYTES = _byte_classes()


@dataclass
class Network:
    """Per direction: ``wx`` (2, 2, 256, H), ``u`` (2, 2, H, H), ``b`` (2, 2, 1, H) for the update gate and the
    candidate; read-out ``wo`` (L, 2H), ``bo`` (L, 1)."""
    langs: list[str]
    wx: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.b, self.wo, self.bo]


def _new_network(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    f = np.float32
    return Network(langs, rng.normal(0, 0.4, (2, 2, 256, hidden)).astype(f),
                   rng.normal(0, 1 / hidden ** 0.5, (2, 2, hidden, hidden)).astype(f),
                   np.concatenate([np.ones((2, 1, 1, hidden), f), np.zeros((2, 1, 1, hidden), f)], axis=1),
                   rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(f), np.zeros((len(langs), 1), f))


def _step(table: np.ndarray, u: np.ndarray, byte: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pre-activations (2, B, H) of update gate and candidate after one byte."""
    g = np.matmul(h, u)
    g[0] += table[0].take(byte, axis=0, mode="clip")
    g[1] += table[1].take(byte, axis=0, mode="clip")
    return g


def _softsign(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x / (1 + |x|)`` and ``1 + |x|``; the gate is ``(1 + softsign) / 2``."""
    d = np.abs(g)
    d += 1
    return g / d, d


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _loss_gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of windows ``x`` (B, T) labelled ``y`` (B), and its gradients."""
    n, t_max = x.shape
    h_dim = net.u.shape[2]
    steps = [range(t_max), range(t_max - 1, -1, -1)]
    states = np.zeros((t_max, n, 2 * h_dim), np.float32)
    tape = [[None] * t_max, [None] * t_max]
    xt = np.ascontiguousarray(x.T).astype(np.intp)
    for d in (0, 1):
        table = net.wx[d] + net.b[d]
        h = np.zeros((n, h_dim), np.float32)
        for t in steps[d]:
            s, den = _softsign(_step(table, net.u[d], xt[t], h))
            z, c = 0.5 + 0.5 * s[0], s[1]
            tape[d][t] = (h, z, c, den)
            h = c + z * (h - c)
            states[t, :, d * h_dim:(d + 1) * h_dim] = h
    flat = states.reshape(-1, 2 * h_dim)
    p = _softmax(net.wo @ flat.T + net.bo)
    target = np.tile(y, t_max)
    at = np.arange(len(target))
    loss = -float(np.log(p[target, at] + 1e-9).mean())
    p[target, at] -= 1
    p /= n * t_max
    d_states = (p.T @ net.wo).reshape(t_max, n, 2 * h_dim)
    d_wx, d_u, d_b = np.zeros_like(net.wx), np.zeros_like(net.u), np.zeros_like(net.b)
    order = np.argsort(xt, axis=None, kind="stable")
    values, starts = np.unique(xt.ravel()[order], return_index=True)
    for d in (0, 1):
        dh = np.zeros((n, h_dim), np.float32)
        dg = np.empty((2, t_max, n, h_dim), np.float32)
        for t in reversed(steps[d]):
            h, z, c, den = tape[d][t]
            dh = dh + d_states[t, :, d * h_dim:(d + 1) * h_dim]
            dg[0, t] = dh * (h - c) * 0.5 / (den[0] * den[0])
            dg[1, t] = dh * (1 - z) / (den[1] * den[1])
            d_u[d, 0] += h.T @ dg[0, t]
            d_u[d, 1] += h.T @ dg[1, t]
            dh = dh * z + dg[0, t] @ net.u[d, 0].T + dg[1, t] @ net.u[d, 1].T
        for k in (0, 1):
            by_byte = dg[k].reshape(-1, h_dim)
            d_wx[d, k][values] = np.add.reduceat(by_byte[order], starts, axis=0)
            d_b[d, k] = by_byte.sum(axis=0)
    return loss, [d_wx, d_u, d_b, p @ flat, p.sum(axis=1, keepdims=True)]


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = 250, batch: int = 128,
          window: int = 64, seed: int = SEED) -> Network | None:
    """Adam on random windows, languages drawn evenly; None without usable rows."""
    coded = [(BYTES[np.frombuffer(t.encode(), np.uint8)], c) for t, c in zip(texts, langs) if t]
    names = sorted({c for _, c in coded})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = _new_network(names, hidden, rng)
    by_lang = [[b for b, c in coded if c == name] for name in names]
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        x = np.full((batch, window), 32, np.uint8)
        y = rng.integers(0, len(names), batch)
        for i, c in enumerate(y):
            doc = by_lang[c][rng.integers(len(by_lang[c]))]
            at = rng.integers(0, max(1, len(doc) - window + 1))
            part = doc[at:at + window]
            x[i, :len(part)] = part
        _, grads = _loss_gradients(net, x, y)
        rate = 0.02 * min(1.0, step / 10) * (1.0 if step < 0.7 * steps else 0.3)
        for p, g, a, q in zip(net.params(), grads, m, v):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            q += 0.01 * (g * g - q)
            p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


class Labeller:
    """Position labels of many windows at once."""

    def __init__(self, net: Network, window: int = WINDOW, batch: int = BATCH):
        self.net, self.window, self.batch = net, window, batch
        self.table = [net.wx[d] + net.b[d] for d in (0, 1)]

    def window_sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed position probabilities (B, L) of windows ``x`` (B, T); positions past a length don't count."""
        n, t_max = x.shape
        h_dim = self.net.u.shape[2]
        xt = np.ascontiguousarray(x.T).astype(np.intp)
        states = np.empty((t_max, n, 2 * h_dim), np.float32)
        for d in (0, 1):
            h = np.zeros((n, h_dim), np.float32)
            for t in (range(t_max) if d == 0 else range(t_max - 1, -1, -1)):
                g = _step(self.table[d], self.net.u[d], xt[t], h)
                den = np.abs(g)
                den += 1
                g /= den
                z, c = g[0], g[1]
                z *= 0.5
                z += 0.5
                h -= c
                h *= z
                h += c
                states[t, :, d * h_dim:(d + 1) * h_dim] = h
        p = _softmax(self.net.wo @ states.reshape(-1, 2 * h_dim).T + self.net.bo).reshape(-1, t_max, n)
        p *= np.arange(t_max)[:, None] < lengths[None, :]
        return p.sum(axis=1, dtype=np.float64).T

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean position probabilities (documents, L); zeros for empty texts."""
        total = np.zeros((len(texts), len(self.net.langs)))
        size = np.zeros(len(texts))
        x = np.full((self.batch, self.window), 32, np.uint8)
        lengths, owner, used = np.zeros(self.batch, np.int64), np.zeros(self.batch, np.int64), 0

        def flush():
            nonlocal used
            if used:
                np.add.at(total, owner[:used], self.window_sums(x[:used], lengths[:used]))
                x[:used] = 32
                used = 0

        for i, text in enumerate(texts):
            doc = BYTES[np.frombuffer(text.encode(), np.uint8)]
            size[i] = max(1, len(doc))
            while len(doc):
                now = doc[:(self.batch - used) * self.window]
                full, rest = divmod(len(now), self.window)
                x[used:used + full] = now[:full * self.window].reshape(full, self.window)
                lengths[used:used + full] = self.window
                if rest:
                    x[used + full, :rest] = now[full * self.window:]
                    lengths[used + full] = rest
                rows = full + (rest > 0)
                owner[used:used + rows] = i
                used += rows
                doc = doc[len(now):]
                if used == self.batch:
                    flush()
        flush()
        return total / size[:, None]


def training_sample(rows: DataFrame, rows_per_lang: int = ROWS_PER_LANG, budget: int = BUDGET) -> list[tuple[str, str]]:
    """About ``rows_per_lang`` (snippet, lang) pairs of every language, about ``budget`` in all.

    With more languages than fit, each has fewer, but one at least.

    ``rows(doc_id, text, lang)``; snippets are 512 characters at a hashed
    place, so the driver's share is bounded whatever the texts' length.
    """
    rows = rows.where("text is not null and lang is not null")
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return []
    each = max(1, min(rows_per_lang, budget // len(counts)))
    below = {r["lang"]: max(int(1_000_000 * min(1.0, each / r["n"])), r["least"]) + 1 for r in counts}
    chosen = draw < F.element_at(F.map_from_arrays(F.lit(list(below)), F.lit(list(below.values()))), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.lit(1), F.char_length("text") - 512)) + 1
    snippet = F.substring(F.col("text"), place.cast("int"), F.lit(512))
    got = rows.where(chosen).select(snippet.alias("s"), "lang", "doc_id").orderBy(draw, "doc_id", "lang", "s").limit(2 * max(budget, len(counts))).collect()
    got.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["s"]))
    return [(r["s"], r["lang"]) for r in got]


def identify(docs: DataFrame, net: Network | None, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with ``lang_pred`` and ``score``; one narrow pass, no shuffle."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    results = ["lang_pred", "score"]
    id_cols = [c for c in id_cols if c not in results]
    rows = docs.select(box(id_cols).alias("row"), F.when(letters, F.col(text_col)).alias("text"))
    if net is None:
        return unbox(rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}), id_cols, results)
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        names = labeller.net.langs
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = labeller.documents([t or "" for t in texts])
            best = p.argmax(axis=1)
            lang = pa.array([names[b] if t is not None else "und" for b, t in zip(best, texts)], pa.string())
            score = pa.array([float(min(1.0, p[i, b])) if t is not None else 0.0
                              for i, (b, t) in enumerate(zip(best, texts))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), lang, score], names=["row", *results])

    return unbox(rows.mapInArrow(label, schema), id_cols, results)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that nothing is learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))
