"""Training-data preparation: tokenise, mask, truncate, pad, pack.

Token sequences are ragged ``array<int>`` columns, so most steps are narrow
array expressions.  Padding needs the batch maximum: a window over one
batch (a bounded group of ``batch_size`` rows).  Batches are numbered with
the exact distributed row numbering, not a single global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions import templates as T
from stepwise.functions.tokens import BOS_ID, EOS_ID, LABEL_PAD, PAD_ID, TextTokenizer, Tokenizer, hashed_word_tokenizer

CHAT_TURN_HEAD = "<|im_start|>"
CHAT_TURN_TAIL = "<|im_end|>\n"


def keep_first(ids: Column, n: int | None) -> Column:
    return ids if n is None else F.slice(ids, 1, n)


def keep_last(ids: Column, n: int | None) -> Column:
    """Last ``n`` items (all of them when shorter)."""
    if n is None:
        return ids
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 1), n)


def _repeat(v: int, n: Column) -> Column:
    return F.array_repeat(F.lit(v), F.greatest(n, F.lit(0)))


def sft_tokenize(df: DataFrame, max_length: int = 2048, tokenizer: Tokenizer | TextTokenizer | None = None,
                 instruction_col: str = "instruction", output_col: str = "output") -> DataFrame:
    """``input_ids`` / ``attention_mask`` / ``labels`` for instruction tuning.

    The full text is ``prompt + output`` followed by the end-of-sequence id;
    full text and prompt are truncated to ``max_length`` separately and the
    first ``len(prompt_ids)`` labels are masked with -100.

    A ``TextTokenizer`` gets the joined text with its end token in one piece
    and the prompt alone, each with the special ids that it adds to a text; a
    plain column function is taken to split at the border, so its prompt ids
    are reused.
    """
    tok = tokenizer or hashed_word_tokenizer()
    prompt = F.concat(F.lit(T.INSTRUCTION_HEAD), F.col(instruction_col), F.lit(T.RESPONSE_HEAD))
    if isinstance(tok, TextTokenizer):
        joined = F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(F.col(output_col), F.lit("")), F.lit(tok.eos_token))
        out = (df.withColumn("_p", keep_first(tok.encode_whole(prompt), max_length))
                 .withColumn("input_ids", keep_first(tok.encode_whole(joined), max_length)))
    else:
        out = (df.withColumn("_p", keep_first(tok(prompt), max_length))
                 .withColumn("input_ids", keep_first(F.concat(F.col("_p"), tok(F.col(output_col)),
                                                              F.array(F.lit(EOS_ID))), max_length)))
    out = out.withColumn("prompt_len", F.size("_p"))
    return (out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
               .withColumn("labels", F.transform("input_ids", lambda x, i: F.when(i < F.col("prompt_len"),
                                                                                   F.lit(LABEL_PAD)).otherwise(x)))
               .drop("_p"))


def preference_tokenize(df: DataFrame, max_prompt_length: int | None = 800,
                        max_completion_length: int | None = None, add_special_tokens: bool = False,
                        tokenizer: Tokenizer | TextTokenizer | None = None) -> DataFrame:
    """Prompt keeps its *last* tokens, completions their *first*; eos ends each completion.

    Special ids are those of a ``TextTokenizer`` (a prompt gets only those
    that it has), else the default vocabulary's.
    """
    tok, bos_id, eos_id = tokenizer or hashed_word_tokenizer(), BOS_ID, EOS_ID
    if isinstance(tok, TextTokenizer):
        tok, bos_id, eos_id = tok.encode, tok.bos_id, tok.eos_id
        if eos_id is None:
            raise ValueError("completions end with the tokenizer's eos id, and it has none")
    p = tok(F.col("prompt"))
    if add_special_tokens:
        p = F.concat(*(F.array(F.lit(i)) for i in (bos_id,) if i is not None), p, F.array(F.lit(eos_id)))
    eos = F.array(F.lit(eos_id))
    return (df.withColumn("prompt_input_ids", keep_last(p, max_prompt_length))
              .withColumn("chosen_input_ids", keep_first(F.concat(tok(F.col("chosen")), eos), max_completion_length))
              .withColumn("rejected_input_ids", keep_first(F.concat(tok(F.col("rejected")), eos), max_completion_length)))


def pad_right(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, _repeat(value, width - F.size(ids)))


def pad_left(ids: Column, width: Column, value: int) -> Column:
    return F.concat(_repeat(value, width - F.size(ids)), ids)


def sft_collate(df: DataFrame, batch_col: str = "batch_id", pad_id: int = PAD_ID) -> DataFrame:
    """Right-pad ids (pad id), mask (0) and labels (-100) to the batch maximum."""
    w = Window.partitionBy(batch_col)
    width = F.max(F.size("input_ids")).over(w)
    out = df.withColumn("padded_len", width)
    return (out.withColumn("input_ids", pad_right(F.col("input_ids"), F.col("padded_len"), pad_id))
               .withColumn("attention_mask", pad_right(F.col("attention_mask"), F.col("padded_len"), 0))
               .withColumn("labels", pad_right(F.col("labels"), F.col("padded_len"), LABEL_PAD)))


def preference_collate(df: DataFrame, batch_col: str = "batch_id", pad_id: int = PAD_ID) -> DataFrame:
    """Prompts left-padded, completions right-padded, each to its batch maximum; masks alongside."""
    w = Window.partitionBy(batch_col)
    out = df
    for name, left in (("prompt", True), ("chosen", False), ("rejected", False)):
        ids = f"{name}_input_ids"
        out = out.withColumn(f"_{name}_w", F.max(F.size(ids)).over(w))
        pad = pad_left if left else pad_right
        out = (out.withColumn(f"{name}_attention_mask", pad(F.array_repeat(F.lit(1), F.size(ids)),
                                                            F.col(f"_{name}_w"), 0))
                  .withColumn(ids, pad(F.col(ids), F.col(f"_{name}_w"), pad_id)))
    return out.drop("_prompt_w", "_chosen_w", "_rejected_w")


def stack_pairs(df: DataFrame, key_col: str = "pair_id") -> DataFrame:
    """Chosen and rejected as two rows sharing the prompt (side 0 / 1)."""
    return df.select(key_col, *[c for c in ("batch_id",) if c in df.columns], "prompt_input_ids",
                     F.inline(F.array(
                         F.struct(F.lit(0).alias("side"), F.col("chosen_input_ids").alias("completion_input_ids")),
                         F.struct(F.lit(1).alias("side"), F.col("rejected_input_ids").alias("completion_input_ids")))))


def pad_stacked(stacked: DataFrame, batch_col: str = "batch_id", pad_id: int = PAD_ID) -> DataFrame:
    """Pad completions of both sides to the pair-batch maximum."""
    w = Window.partitionBy(batch_col)
    out = stacked.withColumn("completion_width", F.max(F.size("completion_input_ids")).over(w))
    return (out.withColumn("completion_attention_mask",
                           pad_right(F.array_repeat(F.lit(1), F.size("completion_input_ids")), F.col("completion_width"), 0))
               .withColumn("completion_input_ids", pad_right(F.col("completion_input_ids"), F.col("completion_width"), pad_id)))


def join_and_truncate(stacked: DataFrame, max_length: int | None = None,
                      truncation_mode: str = "keep_end") -> DataFrame:
    """``prompt + completion`` with a loss mask (prompt 0, completion 1), truncated.

    Ragged arrays carry no padding, so no flushing is needed: keep_start
    keeps each row's first ``max_length`` tokens, keep_end its last.  (Rows
    within ``max_length`` are unchanged either way, which is why the
    padded-batch-width condition of a padded layout does not alter results.)
    """
    ids = F.concat(F.col("prompt_input_ids"), F.col("completion_input_ids"))
    mask = F.concat(F.array_repeat(F.lit(0), F.size("prompt_input_ids")),
                    F.array_repeat(F.lit(1), F.size("completion_input_ids")))
    out = stacked.withColumn("input_ids", ids).withColumn("loss_mask", mask)
    if max_length is not None:
        cut = keep_first if truncation_mode == "keep_start" else keep_last
        if truncation_mode not in ("keep_start", "keep_end"):
            raise ValueError(f"unknown truncation mode {truncation_mode}")
        out = out.withColumn("input_ids", cut(F.col("input_ids"), max_length)) \
                 .withColumn("loss_mask", cut(F.col("loss_mask"), max_length))
    return out


def pack_batches(df: DataFrame, batch_col: str = "batch_id", order_col: str = "_order") -> DataFrame:
    """Padding-free packing: per batch one flat sequence, position ids restart per row."""
    item = F.struct(F.col(order_col).alias("o"), F.col("input_ids").alias("ids"))
    packed = df.groupBy(batch_col).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    pos = F.transform("_s", lambda x: F.when(F.size(x["ids"]) > 0, F.sequence(F.lit(0), F.size(x["ids"]) - 1))
                      .otherwise(F.array().cast("array<int>")))
    return packed.select(batch_col, F.size("_s").alias("n_sequences"),
                         F.flatten(F.transform("_s", lambda x: x["ids"])).alias("input_ids"),
                         F.flatten(pos).alias("position_ids"))


def response_start(labels: Column) -> Column:
    """Index of the first label that is not -100 (0 when there is none)."""
    return F.greatest(F.array_position(F.transform(labels, lambda x: x != LABEL_PAD), True) - 1, F.lit(0)).cast("int")


def implicit_prompt(df: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Split off the shared prefix of chosen and rejected as the prompt.

    Same rule as the common preference tooling: cut at the first differing
    character, one further left when the character before it is a space
    (at position 0 that looks at the *last* character, as negative indexing
    does); with no difference the cut is at ``min_len - 1``.
    """
    c, r = F.col(chosen_col), F.col(rejected_col)
    out = df.withColumn("_m", F.least(F.char_length(c), F.char_length(r)))
    out = out.withColumn("_l", common_prefix_length(c, r))
    before = F.when(F.col("_l") >= 1, F.substring(c, F.col("_l"), F.lit(1))).otherwise(F.right(c, F.lit(1)))
    idx = (F.when(F.col("_m") == 0, F.lit(0))
           .when(F.col("_l") == F.col("_m"), F.col("_m") - 1)
           .when(before == " ", F.col("_l") - 1)
           .otherwise(F.col("_l")))
    out = out.withColumn("_idx", idx)
    i = F.col("_idx")
    # s[i:] and s[:i] as Python has them for i = -1
    since = lambda t: F.when(i >= 0, F.substring(t, i + 1, F.char_length(t))).otherwise(F.right(t, F.lit(1)))
    until = F.substring(c, F.lit(1), F.when(i >= 0, i).otherwise(F.greatest(F.char_length(c) - 1, F.lit(0))))
    return (out.withColumns({"prompt": until, chosen_col: since(c), rejected_col: since(r)})
               .drop("_m", "_l", "_idx"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share, by binary search over equality of prefixes."""
    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        narrower = F.when(same, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))
        return F.when(s["lo"] < s["hi"], narrower).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.least(F.char_length(a), F.char_length(b)).alias("hi"))
    # a text has fewer than 2 ** 31 characters
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step, lambda s: s["lo"])


def render_chat(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One rendered chat text per conversation, turns in order."""
    piece = F.concat(F.lit(CHAT_TURN_HEAD), F.col(role_col), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")),
                     F.lit(CHAT_TURN_TAIL))
    agg = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                                         piece.alias("p")))).alias("_t"))
    return agg.select(id_col, F.size("_t").alias("n_turns"),
                      F.array_join(F.transform("_t", lambda x: x["p"]), "").alias("text"))


def keep_signature_columns(df: DataFrame, allowed: tuple[str, ...] = (
        "prompt_input_ids", "chosen_input_ids", "rejected_input_ids", "ref_chosen_logps", "ref_rejected_logps",
        "token_type_ids", "pixel_values", "pixel_attention_mask", "image_sizes")) -> DataFrame:
    """Keep only the columns a trainer accepts (in input order)."""
    return df.select(*[c for c in df.columns if c in allowed])


def shift_right(ids: Column, start_id: int) -> Column:
    """Decoder inputs: ``[start] + ids[:-1]`` (same length as ``ids``)."""
    return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(start_id)), F.slice(ids, F.lit(1), F.size(ids) - 1))) \
            .otherwise(ids)


def roll(ids: Column, shift: int) -> Column:
    """Cyclic shift by ``shift`` positions (+1: last item first; -1: first item last)."""
    n = F.size(ids)
    if shift == 0:
        return ids
    k = abs(shift)
    if shift > 0:
        return F.when(n > k, F.concat(F.slice(ids, n - k + 1, F.lit(k)), F.slice(ids, F.lit(1), n - k))).otherwise(ids)
    return F.when(n > k, F.concat(F.slice(ids, F.lit(k + 1), n - k), F.slice(ids, F.lit(1), F.lit(k)))).otherwise(ids)
