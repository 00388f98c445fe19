"""Removal of repeated passages of words.

Every word covered by ``WORDS`` neighbouring words that occur anywhere else
in the corpus is removed, with the white space between removed words.  A word
is a run without white space (as ``str.split``); how words are spaced makes no
difference.  Anchors, shards and merging are those of ``suffix_dedup``, over
64-bit hashes of words in place of bytes: the minimiser is a gram of ``GRAM``
words, and the suffix arrays hold words.

Defined results: null text counts as empty; a repeated row is a repeated text
(all of its words go, if there are at least ``WORDS``); a null id is an
ordinary id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepwise.llm import suffix_dedup
from stepwise.llm.common import map_batches, unbox

WORDS = 51
GRAM = 10
BLOCK = 1 << 16
LONG = 256
SHARD_WORDS = 500_000

_SPACE = np.array([chr(c).isspace() for c in range(1 << 16)])
_GAP = re.compile(r"\s")
_rng = np.random.default_rng(11)
_CHARS = _rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64)
_POWERS = np.cumprod(np.full(LONG + 1, int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1, np.uint64))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character (exclusive) and 64-bit hash of every word."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    at = 0
    while at < len(text):  # a block ends at white space
        gap = _GAP.search(text, at + BLOCK)
        stop = gap.start() if gap else len(text)
        points = np.frombuffer(text[at:stop].encode("utf-32-le"), np.uint32)
        inside = np.concatenate([[False], ~_SPACE[np.minimum(points, 0xFFFF)], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        lo, hi = edge[::2], edge[1::2]
        head = np.zeros(len(points), np.int64)
        head[lo] = lo
        place = np.minimum(np.arange(len(points)) - np.maximum.accumulate(head), LONG)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_CHARS[points] * _POWERS[place], out=sums[1:])
        h = sums[hi] - sums[lo]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(hi - lo > LONG):
            word = text[at + lo[i]:at + hi[i]].encode()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        found.append((lo + at, hi + at, h))
        at = stop
    starts, ends, ids = (np.concatenate(x) for x in zip(*found))
    return starts, ends, ids


def word_ids(text: str) -> bytes:
    return words_of(text)[2].tobytes()


SYMBOLS = suffix_dedup.Symbols(np.uint64, word_ids)


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text outside the ranges of words, and the number of removed words."""
    if not ranges:
        return text, 0
    starts, ends, _ = words_of(text)
    out, at, removed, last = [], 0, 0, 0
    for a, b in sorted(ranges):
        if b <= last:
            continue
        if a > last or not removed:
            out.append(text[at:starts[a]])
        removed += b - max(a, last)
        at, last = ends[b - 1], b
    out.append(text[at:])
    return "".join(out), removed


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM,
                    shard_words: int = SHARD_WORDS, shard_spans: int = suffix_dedup.SHARD_SPANS) -> DataFrame:
    """``docs`` with ``kept`` and ``n_removed`` in words (replacing columns of those names)."""
    results = ["kept", "n_removed"]
    columns = [c for c in docs.columns if c not in results]
    keyed = suffix_dedup._key_columns(docs, id_col, text_col)
    ranges = suffix_dedup.repeated_ranges(keyed, words, gram, shard_words, shard_spans, SYMBOLS)
    joined = (keyed.join(ranges.withColumnsRenamed({"did": "_did", "th": "_th"}), ["_did", "_th"], "left")
              .select("row", "_text", "ranges"))
    schema = joined.select("row").schema.add("kept", "string").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [cut(text, [(r["a"], r["b"]) for r in ranges or []])
                    for text, ranges in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([k for k, _ in both], pa.string()),
                                              pa.array([n for _, n in both], pa.int64())], names=schema.names)

    return unbox(map_batches(joined, run, schema), columns, results)
