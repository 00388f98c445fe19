"""Sum-of-squares online packing of tokenised documents.

Every input partition is a shard with its own array of levels: ``N(h)`` is
the number of open windows filled to ``h`` tokens.  A document's full windows
are closed at once; its rest goes to the level ``h`` (0: a new window) that
minimises the sum of ``N(h)**2`` over partially filled windows.  At the end
of a shard, and whenever more than ``max_open`` windows are open, the open
windows are emptied into full ones by cutting pieces; at most one partial
window a shard remains.  No shuffle; a task holds its open windows only.

Documents are tokenised by a distinct-chunk table: white-space separated
chunks are encoded once per worker (the tokenizer drops white space, so pieces
never cross it) and their ids are joined by position.

Defined results: null text counts as empty and gives one piece (the end id
alone); each row is a document, repeated rows are packed as often as they
occur; an empty table gives no rows.  Sequence ids are the partition number
times ``2**32`` plus a running number, so they depend on the input's splits.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import map_batches

CAPACITY = 2048
END_ID = 1
MAX_OPEN = 1024
CACHE_CHUNKS = 300_000
LONG_CHUNK = 64

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


# Runs of letters and digits, runs of other signs, and whole chunks around an apostrophe
# (the tokenizer takes 's, 't, .. as units); it never joins across these borders.
_TRAIL = ".,;:!?"
_RUNS = re.compile(r"[^ \n']*'[^ \n]*|[^\W_]+|(?:[^\w \n]|_)+")


class ChunkTable:
    """Ids (little-endian unsigned 32-bit) of the chunks of texts, by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model's letters for bytes, for Latin-1 letters
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {o: to_bytes(chr(o))[0][0] for o in range(256) if chr(o).isalpha()}
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word_ids(self, word: str) -> bytes:
        """Ids of a lower-cased Latin-1 run of letters, which the tokenizer hands to its model as one word."""
        found = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
        return self.pack(*[t.id for t in found]) if len(found) != 1 else found[0].id.to_bytes(4, "little")

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _age(self) -> None:
        """Full tables become the old ones, from which what is still in use moves back: memory stays bounded."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.runs) > CACHE_CHUNKS:
            self.old_runs, self.runs = self.runs, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as bytes."""
        split = [self._chunks(t) if t else [] for t in texts]
        self._age()
        chunks = self.chunks
        new = set().union(*split).difference(chunks)
        if new and len(max(new, key=len)) > LONG_CHUNK:
            chunks = {c: chunks[c] for part in split for c in part if c in chunks}
        self._learn(new, chunks)
        return [b"".join(itemgetter(*part)(chunks)) if len(part) > 1 else chunks[part[0]] if part else b"" for part in split]

    def _learn(self, new: set[str], chunks: dict[str, bytes]) -> None:
        """Add the ids of chunks; lower-cased Latin-1 ones are put together from the table of their runs."""
        whole = []
        old, run_ids = self.old_chunks, self._run_ids
        fresh = new.difference(old)
        for c in new.difference(fresh):
            chunks[c] = old[c]
        for c in fresh:
            if len(c) > LONG_CHUNK or not self._plain(c):
                whole.append(c)
                continue
            core = c.rstrip(_TRAIL)
            if core.isalpha():
                chunks[c] = run_ids(core) if len(core) == len(c) else run_ids(core) + run_ids(c[len(core):])
            else:
                chunks[c] = b"".join(map(run_ids, _RUNS.findall(c)))
        for lo in range(0, len(whole), 4096):
            chunks.update(zip(whole[lo:lo + 4096], self._ids(whole[lo:lo + 4096])))

    def _run_ids(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            got = self.old_runs.get(run)
            if got is None:
                got = self._word_ids(run) if run.isalpha() else self._ids([run])[0]
            self.runs[run] = got
        return got

    @staticmethod
    def _plain(chunk: str) -> bool:
        """Latin-1 (nothing to compose), lower-cased, without the start of a special token."""
        if not chunk.isascii():
            try:
                chunk.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return "<|" not in chunk and chunk == chunk.lower()

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Chunks between spaces and line breaks; Latin-1 texts lower-case alike everywhere, so do it
        here to share chunks (special tokens are matched before lower-casing: not with their start)."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")


@functools.lru_cache(maxsize=1)
def chunk_table(path: str) -> ChunkTable:
    """The table of this worker process; its next tasks go on with it."""
    return ChunkTable(path)


class Packer:
    """One shard: places documents, yields pieces ``(doc, start, ids, doc_tokens, sequence, offset)``."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.next_sequence = first_sequence
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]  # open windows by level: pieces
        self.open = 0
        self.costs = np.arange(1, capacity + 1)

    def _close(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self.next_sequence, 0
        self.next_sequence += 1
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, sequence, offset
            offset += len(ids)

    def _level_for(self, size: int) -> int:
        """Level whose use minimises the change of the sum of squares; ties to the fullest."""
        n, cap = self.levels, self.capacity
        h = np.arange(cap - size, -1, -1)
        h = h[(n[h] > 0) | (h == 0)]
        after = np.where(h + size < cap, 2 * n[np.minimum(h + size, cap)] + 1, 0)
        change = after + np.where(h > 0, 1 - 2 * n[h], 0)
        return int(h[change.argmin()])

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        cap, total = self.capacity, len(ids)
        full = total - total % cap
        for start in range(0, full, cap):
            yield from self._close([(doc, start, ids[start:start + cap], total)])
        rest = ids[full:]
        if not len(rest):
            return
        h = self._level_for(len(rest))
        window = self.windows[h].pop() if h else []
        if h:
            self.levels[h] -= 1
            self.open -= 1
        window.append((doc, full, rest, total))
        fill = h + len(rest)
        if fill == cap:
            yield from self._close(window)
            return
        self.levels[fill] += 1
        self.windows[fill].append(window)
        self.open += 1
        if self.open > self.max_open:
            yield from self._empty(last=False)

    def _empty(self, last: bool) -> Iterator[tuple]:
        """Refill the open windows' pieces into full windows, cutting where one ends."""
        filling, fill = [], 0
        for level in range(self.capacity - 1, 0, -1):
            for window in self.windows[level]:
                for doc, start, ids, total in window:
                    while len(ids):
                        take = ids[:self.capacity - fill]
                        filling.append((doc, start, take, total))
                        start, ids, fill = start + len(take), ids[len(take):], fill + len(take)
                        if fill == self.capacity:
                            yield from self._close(filling)
                            filling, fill = [], 0
            self.windows[level] = []
        self.levels[:] = 0
        self.open = 0
        if filling and last:
            yield from self._close(filling)
        elif filling:
            self.windows[fill], self.levels[fill], self.open = [filling], 1, 1

    def finish(self) -> Iterator[tuple]:
        yield from self._empty(last=True)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, max_open)

        def out(pieces: Iterator[tuple]) -> list[tuple]:
            return [(doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
                    for doc, start, ids, total, sequence, offset in pieces]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()
            for lo in range(0, len(ids), 256):
                found = []
                for doc, raw in zip(ids[lo:lo + 256], table.encode(texts[lo:lo + 256])):
                    found += out(packer.add(doc, np.frombuffer(raw + end, "<u4")))
                if found:
                    yield batch_of(found)
        found = out(packer.finish())
        if found:
            yield batch_of(found)

    return map_batches(rows, run, SCHEMA)
