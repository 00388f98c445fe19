"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else in
the corpus is removed (UTF-8 bytes; matches never cross documents).

1. Anchors: each 400-byte window has a minimiser, its smallest hashed 64-byte
   gram.  Equal windows have equal minimisers at equal places, so only
   windows of one gram need comparing.  Neighbouring windows with the same
   minimiser form a span; equal spans are merged into one with the number of
   its occurrences, and grams that occur once are dropped.
2. A span that occurs twice or more is repeated as a whole.  Shards: the spans
   of grams with a span that occurs once and other spans beside it go to
   shards by their gram, bounded in size.  A shard
   sorts its suffixes by Larsson-Sadakane refinement (numpy), up to the
   length asked for: neighbours in that order whose ranks are still equal
   share 400 bytes, so no common prefixes need counting.  Such neighbouring
   windows are one class, repeated if its spans occur twice or more in all.
3. Blocks: the distinct spans of a very frequent gram are cut into blocks of
   neighbouring windows by the gram's place in the window.  Equal windows
   have their gram at equal places, so they lie in blocks of one place, and
   share what all windows of such a block share, its core.  Blocks take the
   way of spans, with the core for the gram: equal ones are merged, cores
   that occur once are dropped, the blocks of the others go to shards, and
   those of a core that is still very frequent are cut again, down to single
   windows.
4. The repeated windows of each span give byte ranges in every document that
   has the span; the ranges of a document are united and cut.

Defined results: null text counts as empty; a repeated row is a repeated
text (all of its bytes go, if there are at least ``LENGTH``); a null id is an
ordinary id; texts of any length are read in parts; an empty table gives no
rows; columns named like the results are replaced, others are untouched
whatever their names.  Nothing whole passes through the driver or one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import box, map_batches, materialise, unbox

LENGTH = 400
GRAM = 64
BUFFER = 1 << 20
SHARD_BYTES = 2_000_000
SHARD_SPANS = 3000
CUTS = 8


class Symbols(NamedTuple):
    """What texts are strings of; lengths and places count symbols."""

    dtype: type
    encode: Callable[[str], bytes]


BYTES = Symbols(np.uint8, str.encode)

_rng = np.random.default_rng(7)
_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(x) * 2 + 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base, inverse = _BASE[which], pow(_BASE[which], -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            t = np.empty(n, np.uint64)
            t[0] = 1
            size = 1
            while size < n:
                step = np.uint64(pow(b, size, 1 << 64))
                t[size:2 * size] = t[:min(size, n - size)] * step
                size *= 2
            tables.append(t)
        _powers[which] = have = (tables[0], tables[1])
    return have


def gram_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hash of every gram of ``length`` symbols of ``data`` (bytes, or 64-bit hashes)."""
    n = len(data)
    up, down = _power_tables(which, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    values = _VALUES[which][data] if data.dtype == np.uint8 else data
    np.cumsum(values * up[:n], out=sums[1:])
    h = (sums[length:] - sums[:n + 1 - length]) * down[:n + 1 - length]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def spans_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the texts ``data[bounds[i]:bounds[i + 1]]``: (text, start in ``data``, bytes, gram hash)."""
    grams = gram_hashes(data, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    key = (grams & ~np.uint64(0xFFFFFF)) | place
    low = _sliding_min(key, length - gram + 1)
    starts, ends = bounds[:-1], bounds[1:] - length + 1
    some = np.flatnonzero(ends > starts)
    counts = (ends - starts)[some]
    text = np.repeat(some, counts)
    first = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    p = first + np.arange(len(text))
    at = (low[p] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1
    lo = np.concatenate([[0], cut]) if len(p) else np.empty(0, np.int64)
    hi = np.concatenate([cut, [len(p)]]) if len(p) else np.empty(0, np.int64)
    return text[lo], p[lo], hi - lo - 1 + length, grams[at[lo]].view(np.int64)


def _key_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is its id and text hash; equal ones are cut alike.  ``(row, _text, _did, _th)`` with all columns in ``row``.

    A null id counts as -1: with the text's hash beside it, it meets a real -1 of the same text alone.
    """
    rows = docs.select(box(docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).cast("bigint").alias("_did"))
    return rows.withColumn("_th", F.xxhash64("_text"))


ANCHORS = "h bigint, s bigint, len int, did bigint, th bigint, lo bigint"


def anchors(docs: DataFrame, length: int, gram: int, symbols: Symbols = BYTES) -> DataFrame:
    """One row per span of ``docs(_did, _th, _text)``: gram hash, hash and bytes of the span, where it starts."""
    rows = docs.select("_did", "_th", "_text").where(F.octet_length("_text") >= length)
    item = np.dtype(symbols.dtype).itemsize
    most = max(BUFFER // item, 2 * length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([batch.column("_did").to_numpy(), batch.column("_th").to_numpy()])
            parts, owner, base, size = [], [], [], 0

            def found() -> pa.RecordBatch:
                raw = b"".join(parts)
                bounds = np.concatenate([[0], np.cumsum([len(x) // item for x in parts])])
                text, lo, n, h = spans_of(np.frombuffer(raw, symbols.dtype), bounds, length, gram)
                view = memoryview(raw)
                blake = hashlib.blake2b
                s = np.frombuffer(b"".join([blake(view[a:a + k], digest_size=8).digest()
                                            for a, k in zip((lo * item).tolist(), (n * item).tolist())]), "<i8")
                row = np.array(owner)[text]
                start = lo - bounds[text] + np.array(base)[text]
                return pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(s), pa.array(n.astype(np.int32)), pa.array(ids[0][row]), pa.array(ids[1][row]),
                     pa.array(start.astype(np.int64))], names=["h", "s", "len", "did", "th", "lo"])

            for i, t in enumerate(batch.column("_text")):
                raw = symbols.encode(t.as_py())
                for at in range(0, len(raw) // item - length + 1, most - length + 1):  # windows of a long text fall into one part each
                    part = raw[at * item:(at + most) * item]
                    if size + len(part) // item > most and parts:
                        yield found()
                        parts, owner, base, size = [], [], [], 0
                    parts.append(part), owner.append(i), base.append(at)
                    size += len(part) // item
            if parts:
                yield found()

    return map_batches(rows, run, ANCHORS)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` symbols or more (equal ranks: equal so far).

    Larsson-Sadakane refinement: suffixes are sorted by 8 bytes, then the
    depth in symbols doubles; only groups that are not yet single are sorted again, by
    the rank of the suffix a depth further on.
    """
    n = len(data)
    depth = 8 // data.dtype.itemsize
    word = data
    if depth > 1:
        padded = np.zeros(n + 8, np.uint64)
        padded[:n] = data
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word <<= np.uint64(8)
            word |= padded[k:k + n]
        del padded
    small = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(word, kind="stable").astype(small)
    word = word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    del word
    rank = np.empty(n + 1, small)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=small), small(0)))
    size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
    open_ = order[np.repeat(size, size) > 1]
    del order, size
    while depth < length and len(open_):
        step = min(depth, length - depth)
        key = rank[open_].astype(np.int64)
        key *= n + 2
        key += rank[np.minimum(open_ + np.int64(step), n)]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        del by
        group = rank[open_]
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        at = np.arange(len(open_), dtype=small)
        offset = np.maximum.accumulate(np.where(new, at, small(0))) - np.maximum.accumulate(np.where(starts, at, small(0)))
        rank[open_] = group + offset
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        open_ = open_[np.repeat(size, size) > 1]
        depth += step
    return rank[:n]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_windows(texts: list[bytes], length: int, times: np.ndarray | None = None,
                     symbols: Symbols = BYTES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For a shard's texts, each occurring ``times`` times: which windows are repeated.

    Windows that share ``length`` symbols with their neighbour in suffix order
    are one class; it is repeated if its texts occur twice or more in all.
    Returns the flags by text, and of one window of each class: (text, start).
    """
    data = np.frombuffer(b"".join(texts), symbols.dtype)
    size = np.array([len(t) for t in texts], np.int64) // data.dtype.itemsize
    ends = np.cumsum(size)
    starts = ends - size
    rank = suffix_ranks(data, length)
    # a window lies in its text, so windows of equal rank share their ``length`` symbols; in order of place among equals
    chosen = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(ends, size))
    chosen = chosen[np.argsort(rank[chosen], kind="stable")]
    same = np.zeros(len(chosen), bool)
    same[:-1] = rank[chosen[1:]] == rank[chosen[:-1]]
    owner = np.repeat(np.arange(len(texts)), size)
    first = np.flatnonzero(np.concatenate([[True], ~same[:-1]])) if len(chosen) else np.zeros(0, np.int64)
    hit = np.zeros(len(data), bool)
    if len(chosen):
        weight = np.minimum(times, 2)[owner[chosen]] if times is not None else np.ones(len(chosen), np.int64)
        several = np.add.reduceat(weight, first) > 1
        hit[chosen] = np.repeat(several, np.diff(np.concatenate([first, [len(chosen)]])))
    heads = chosen[first]
    flags = [hit[a:max(a, b - length + 1)] for a, b in zip(starts, ends)]
    return flags, owner[heads], heads - starts[owner[heads]]


SPAN_KEY = ["h", "s", "len"]
FOUND = "h bigint, s bigint, len int, a int, b int"


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of the rows of one group each; the rows come sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and group[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = group[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _fetch(docs: DataFrame, spans: DataFrame, symbols: Symbols = BYTES) -> DataFrame:
    """The symbols of spans from one document each: ``(shard, often, n, h, s, len, raw)``."""
    wanted = spans.groupBy(F.col("did").alias("_did"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("shard", "often", "n", "h", "s", "len", "lo")).alias("w"))
    rows = docs.select("_did", "_th", "_text").join(wanted, ["_did", "_th"])
    item = np.dtype(symbols.dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "often", "n", "h", "s", "len"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out, raws = [[] for _ in names], []
                for text, want in zip(part.column("_text").to_pylist(), part.column("w").to_pylist()):
                    raw = symbols.encode(text)
                    for w in want:
                        for k, name in enumerate(names):
                            out[k].append(w[name])
                        raws.append(raw[w["lo"] * item:(w["lo"] + w["len"]) * item])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), pa.array(raws, pa.binary())],
                                                 names=[*names, "raw"])

    return map_batches(rows, run, "shard bigint, often boolean, n bigint, h bigint, s bigint, len int, raw binary")


def _sort_shards(spans: DataFrame, length: int, symbols: Symbols = BYTES) -> DataFrame:
    """Per shard: ranges ``[a, b)`` of repeated windows of the spans that occur once."""
    rows = spans.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "shard"):
            key = [t.column(c).to_numpy() for c in SPAN_KEY]
            n = t.column("n").to_numpy()
            flags, _, _ = repeated_windows(t.column("raw").to_pylist(), length, n, symbols)
            out: list[list] = [[] for _ in range(5)]
            for i in np.flatnonzero(n == 1).tolist():  # the others are known to be repeated
                for a, b in _runs(flags[i]):
                    for c, v in zip(out, (*(int(k[i]) for k in key), a, b - 1 + length)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, types)], names=["h", "s", "len", "a", "b"])

    return map_batches(rows, run, FOUND)


def _blocks(spans: DataFrame, length: int, gram: int, width: int, symbols: Symbols = BYTES) -> DataFrame:
    """Blocks of ``width`` windows of the spans ``(h, s, n, raw)``, like anchors: hash of the core, hash and symbols of the
    block, the span and where in it the block starts, and the span's number of occurrences."""
    item = np.dtype(symbols.dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raws = part.column("raw").to_pylist()
                whole = np.frombuffer(b"".join(raws), symbols.dtype)
                grams, cores = gram_hashes(whole, gram), gram_hashes(whole, length - width + 1)
                row, lo, size, core, s = [], [], [], [], []
                base = 0
                for i, raw in enumerate(raws):
                    n = len(raw) // item
                    # the minimiser of the first window is that of all windows of the span
                    place = int(np.argmin(grams[base:base + length - gram + 1] & ~np.uint64(0xFFFFFF)))
                    for j in range((place - (n - length)) // width, place // width + 1):
                        a, b = max(0, place - j * width - width + 1), min(n - length, place - j * width) + length
                        row.append(i), lo.append(a), size.append(b - a), core.append(base + place - j * width)
                        s.append(blake(raw[a * item:b * item], digest_size=8).digest())
                    base += n
                span = [part.column(c).to_numpy()[row] for c in ("h", "s", "n")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cores[core].view(np.int64)), pa.array(np.frombuffer(b"".join(s), "<i8")), pa.array(size, pa.int32()),
                     pa.array(span[0]), pa.array(span[1]), pa.array(lo, pa.int64()), pa.array(span[2])],
                    names=["h", "s", "len", "did", "th", "lo", "n"])

    return map_batches(spans, run, f"{ANCHORS}, n bigint")


def _ranges(docs: DataFrame, marks: DataFrame, times: Column, length: int, gram: int, width: int, shard_bytes: int,
            shard_spans: int, symbols: Symbols) -> DataFrame:
    """``(did, th, a, b)``: repeated ranges of ``docs``, of which ``marks`` are the spans, or blocks of ``width`` windows.

    ``times`` counts the occurrences of equal spans.
    """
    merged = marks.groupBy(*SPAN_KEY).agg(times.cast("bigint").alias("n"), F.first("did").alias("did"),
                                          F.first("th").alias("th"), F.first("lo").alias("lo"))
    grams = (merged.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
             .where("total > 1"))
    spans = materialise(merged.join(grams.drop("total"), "h"), "spans")
    # all windows of a span that occurs again are repeated; suffix arrays are for those that occur once
    known = spans.where("n > 1").select(*SPAN_KEY, F.lit(0).alias("a"), F.col("len").alias("b"))
    often = (F.col("kinds") > shard_spans) & F.lit(width > 1)
    spans = spans.where("least = 1").drop("least").withColumn("often", often)
    size, more = spans.agg(F.sum(F.when(F.col("often"), 0).otherwise(F.col("len"))), F.max("often")).first()
    n_shards = max(1, -(-(size or 0) // shard_bytes))
    spans = spans.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards)))
    texts = _fetch(docs, spans, symbols)
    if more:
        texts = materialise(texts, "texts")
    found = materialise(_sort_shards(texts.where("not often"), length, symbols), "repeats")
    ranges = found.unionByName(known)
    if more:
        common = texts.where("often")
        width = -(-width // CUTS)
        blocks = materialise(_blocks(common, length, gram, width, symbols), "blocks")
        inner = common.select(F.col("h").alias("_did"), F.col("s").alias("_th"), F.col("raw").alias("_text"))
        again = _ranges(inner, blocks, F.sum("n"), length, gram, width, shard_bytes, shard_spans, symbols._replace(encode=bytes))
        once = common.where("n = 1").select(*SPAN_KEY)
        ranges = ranges.unionByName(once.join(again.withColumnsRenamed({"did": "h", "th": "s"}), ["h", "s"])
                                    .select(*SPAN_KEY, F.col("a").cast("int"), F.col("b").cast("int")))
    return marks.join(ranges, SPAN_KEY).select("did", "th", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                    shard_spans: int = SHARD_SPANS, symbols: Symbols = BYTES) -> DataFrame:
    """``(did, th, ranges)``: repeated ranges of symbols of the documents ``docs(_did, _th, _text)``."""
    marks = materialise(anchors(docs, length, gram, symbols), "anchors")
    ranges = _ranges(docs, marks, F.count(F.lit(1)), length, gram, length - gram + 1, shard_bytes, shard_spans, symbols)
    return ranges.groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_spans: int = SHARD_SPANS,
                   as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept``, ``n_bytes``, ``n_removed`` and ``n_spans`` (replacing columns of those names).

    ``kept`` holds the remaining bytes; as text it leaves out characters that a cut went through.
    """
    results = ["kept", "n_bytes", "n_removed", "n_spans"]
    columns = [c for c in docs.columns if c not in results]
    keyed = _key_columns(docs, id_col, text_col)
    ranges = repeated_ranges(keyed, length, gram, shard_bytes, shard_spans)
    joined = (keyed.join(ranges.withColumnsRenamed({"did": "_did", "th": "_th"}), ["_did", "_th"], "left")
              .select("row", "_text", "ranges"))
    kind = "string" if as_text else "binary"
    schema = (joined.select("row").schema.add("kept", kind).add("n_bytes", "long").add("n_removed", "long")
              .add("n_spans", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for text, cuts in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = text.encode()
                left, spans = cut(raw, [(r["a"], r["b"]) for r in cuts or []])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                counts.append((len(raw), len(raw) - len(left), spans))
            table = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string() if as_text else pa.binary()),
                                              *(pa.array(table[:, k]) for k in range(3))], names=schema.names)

    return unbox(map_batches(joined, run, schema), columns, results)


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the ranges, and the number of maximal removed runs."""
    out, at, runs = [], 0, 0
    end = -1
    for a, b in sorted(ranges):
        if a > end:
            out.append(raw[at:a])
            runs += 1
        end = at = max(end, b)
    out.append(raw[at:])
    return b"".join(out), runs
