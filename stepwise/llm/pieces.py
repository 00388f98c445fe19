"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of a model has a white-space marker after another character,
pieces cannot cross from a word into the marker before the next word, and
none can touch a line break that no piece contains.  A text is cut there;
each distinct chunk (marked word) is segmented and decoded once per worker and
the results are joined back by position.  ``ChunkCodec`` checks the model and
sends whole texts through the library if the property does not hold.

Defined results: null text counts as empty; an empty text has the end id
only and decodes to the empty string; rows are independent, so repeated rows
give repeated results.  The table holds at most ``CACHE_CHUNKS`` chunks of up
to ``LONG_CHUNK`` characters; longer chunks are segmented each time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_CHUNKS = 700_000
LONG_CHUNK = 64


class ChunkCodec:
    """Encoding with an end id, and decoding, of one SentencePiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.whole = SentencePieceProcessor(model_file=path)
        # the library adds a marker in front of a text: chunks are encoded behind a line break,
        # which no piece joins, and that lead is taken off again
        self.lead = self.whole.encode("\n")
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.chunked = not any(crossing.search(p) or "\n" in p for p in pieces) and self._agrees("a  b " + MARK + "c\td\n e")
        self.end = self.whole.eos_id()
        self.known: dict[str, str] = {}  # chunk: ids joined by spaces
        self.odd: dict[str, str] = {}  # chunk: decoded text, where it is not the chunk's own

    def _agrees(self, text: str) -> bool:
        """Whether chunks give the library's ids and text (some models normalise white space otherwise)."""
        ids = self.whole.encode(text)
        got, odd = {}, {}
        chunks = self._chunks(text)
        self._learn(chunks, got, odd)
        return (" ".join(got[c] for c in chunks) == " ".join(map(str, ids))
                and "".join(odd.get(c, c).replace(MARK, " ") for c in chunks)[1:] == self.whole.decode(ids))

    def _learn(self, chunks: list[str], known: dict[str, str], odd: dict[str, str]) -> None:
        skip, gone = len(self.lead), len(self.whole.decode(self.lead))
        for lo in range(0, len(chunks), 4096):
            part = chunks[lo:lo + 4096]
            ids = self.whole.encode(["\n" + c for c in part], num_threads=1)
            for chunk, got, text in zip(part, ids, self.whole.decode(ids, num_threads=1)):
                known[chunk] = " ".join(map(str, got[skip:]))
                if text[gone:] != chunk.replace(MARK, " "):
                    odd[chunk] = text[gone:]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Marked words of a text with its leading marker; line breaks stand alone."""
        if not text:
            return []
        if MARK not in text and "  " not in text and "\n " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
            if "\n" not in text:
                return [MARK + w for w in text.split(" ")]
            out = []
            for i, line in enumerate(text.split("\n")):
                words = line.split(" ")
                head = MARK + words[0] if i == 0 else words[0]
                if i:
                    out.append("\n")
                if head:
                    out.append(head)
                out += [MARK + w for w in words[1:]]
            return out
        return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids with the end id, ids joined by spaces, decoded text) of every text."""
        if not self.chunked:
            return [self._whole(t or "") for t in texts]
        split = [self._chunks(t or "") for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
            self.odd.clear()
        known, odd = self.known, self.odd
        new = [c for c in set().union(*split) if c not in known]
        long = [c for c in new if len(c) > LONG_CHUNK]
        self._learn([c for c in new if len(c) <= LONG_CHUNK], known, odd)
        if long:
            known = {c: known[c] for chunks in split for c in chunks if len(c) <= LONG_CHUNK}
            odd = dict(odd)
            self._learn(long, known, odd)
        end = str(self.end)
        out = []
        for chunks in split:
            ids = " ".join([*[known[c] for c in chunks], end])
            parts = chunks if not odd or odd.keys().isdisjoint(chunks) else [odd.get(c, c) for c in chunks]
            out.append((ids.count(" ") + 1, ids, "".join(parts).replace(MARK, " ")[1:]))
        return out

    def _whole(self, text: str) -> tuple[int, str, str]:
        ids = self.whole.encode(text, add_eos=True)
        return len(ids), " ".join(map(str, ids)), self.whole.decode(ids)


@functools.lru_cache(maxsize=1)
def chunk_codec(path: str) -> ChunkCodec:
    """The codec of this worker process; its next tasks go on with its table."""
    return ChunkCodec(path)


def encode_documents(docs: DataFrame, model_path: str, columns: list[str], text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """``columns`` with n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    rows = docs.select(*columns, F.col(text_col).alias("_text"))
    schema = (rows.select(*columns).schema.add("n_tokens", "long").add("ids_sha256", "string")
              .add("decoded_sha256", "string"))
    if with_ids:
        schema = schema.add("ids", "string").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(model_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                got = codec(batch.column("_text").to_pylist())
                arrays = [*(batch.column(c) for c in columns), pa.array([g[0] for g in got], pa.int64()),
                          pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()),
                          pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got], pa.string())]
                if with_ids:
                    arrays += [pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
