"""Tokenisers as column functions: ``Column[string] -> Column[array<int>]``.

The default is native: whitespace-separated words mapped to ids by a hash
(``md5`` prefix modulo the vocabulary), so it runs inside code generation.
A caller-supplied Python tokenizer is wrapped in an Arrow-batched UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Fixed ids of the special tokens of the default vocabulary.
PAD_ID, EOS_ID, BOS_ID = 0, 1, 2
N_SPECIAL = 3
DEFAULT_VOCAB = 50000
LABEL_PAD = -100

Tokenizer = Callable[[Column], Column]


def hashed_word_tokenizer(vocab_size: int = DEFAULT_VOCAB) -> Tokenizer:
    """Words (runs of non-whitespace) -> ``3 + md5(word)[:8] mod (vocab - 3)``."""
    span = vocab_size - N_SPECIAL

    def tok(text: Column) -> Column:
        words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
        return F.transform(words, lambda w: (F.lit(N_SPECIAL) + F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(span))).cast("int"))
    return tok


def hashed_word_tokenizer_sql(expr: str, vocab_size: int = DEFAULT_VOCAB) -> str:
    span = vocab_size - N_SPECIAL
    return (f"list_transform(list_filter(regexp_split_to_array(coalesce({expr}, ''), '\\s+'), lambda w: w <> ''), "
            f"lambda w: cast({N_SPECIAL} + (('0x' || substr(md5(w), 1, 8))::bigint % {span}) as integer))")


@dataclass(frozen=True)
class TextTokenizer:
    """A tokenizer with its special ids (None where it has none).

    ``encode`` gives the ids of a text as such, ``encode_whole`` those of a
    text that stands alone, with what the tokenizer puts around it.  The text
    ``eos_token`` has the id ``eos_id``.
    """

    encode: Tokenizer
    encode_whole: Tokenizer
    eos_token: str = "</s>"
    pad_id: int | None = PAD_ID
    eos_id: int | None = EOS_ID
    bos_id: int | None = BOS_ID


# A space joins the piece after it, so ids of a joined text differ from those of its parts at the border.
PIECE_PATTERN = r"</s>|[ \t\r\n\f]*[^ \t\r\n\f<]{1,4}|[ \t\r\n\f]+|<"


def hashed_piece_tokenizer(vocab_size: int = DEFAULT_VOCAB, pad_id: int = 0, eos_id: int = 1, bos_id: int = 2) -> TextTokenizer:
    """Native stand-in for a subword tokenizer: pieces of up to four characters with the space before them; a begin id leads a text."""
    span = vocab_size - N_SPECIAL

    def encode(text: Column) -> Column:
        pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_PATTERN), F.lit(0))
        return F.transform(pieces, lambda w: F.when(w == "</s>", F.lit(eos_id)).otherwise(
            (F.lit(N_SPECIAL) + F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(span))).cast("int")))

    return TextTokenizer(encode, lambda text: F.concat(F.array(F.lit(bos_id)), encode(text)), "</s>", pad_id, eos_id, bos_id)


def object_tokenizer(tokenizer) -> TextTokenizer:
    """A tokenizer object with its own special ids, each text in one call of an Arrow UDF.

    Either ``tokenizer(text, add_special_tokens=...)["input_ids"]`` or
    ``tokenizer.encode(text, add_special_tokens=...).ids``; ``pad_token_id``,
    ``eos_token_id``, ``bos_token_id`` and ``eos_token`` are read where it has them.
    """
    def ids(special: bool) -> Callable[[str], list[int]]:
        if callable(tokenizer):
            return lambda text: tokenizer(text, add_special_tokens=special)["input_ids"]
        return lambda text: tokenizer.encode(text, add_special_tokens=special).ids

    special = {k: getattr(tokenizer, f"{k[:3]}_token_id", None) for k in ("pad_id", "eos_id", "bos_id")}
    return TextTokenizer(python_tokenizer(ids(False)), python_tokenizer(ids(True)), getattr(tokenizer, "eos_token", None) or "", **special)


def python_tokenizer(fn: Callable[[str], list[int]]) -> Tokenizer:
    """Wrap ``fn(text) -> ids`` (e.g. a pretrained tokenizer) as an Arrow UDF."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def _tok(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(fn(t if t is not None else "")))
    return lambda text: _tok(text)
