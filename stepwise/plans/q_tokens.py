"""Queries: tokenisation, masking, truncation, padding and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions.templates import INSTRUCTION_HEAD, RESPONSE_HEAD, sql_literal
from stepwise.functions.tokens import DEFAULT_VOCAB, N_SPECIAL, PIECE_PATTERN, hashed_piece_tokenizer
from stepwise.functions.tokens import hashed_word_tokenizer_sql as tok_sql
from stepwise.operators import tokens as TK
from stepwise.operators.ordering import assign_batches
from stepwise.plans.fixtures import fixture, read_table, with_fixtures
from stepwise.plans.registry import register

MAX_LEN = 2048
MAX_PROMPT = 800
SFT_BATCH = 8
PREF_BATCH = 4


def _isum(col):
    return F.aggregate(col, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _sft(spark, sf):
    return TK.sft_tokenize(fixture(spark, sf, "f_sft"), MAX_LEN)


_SFT_SQL = f"""
, t as (select conv_id, turn,
               {tok_sql(sql_literal(INSTRUCTION_HEAD) + ' || instruction || ' + sql_literal(RESPONSE_HEAD))} as p,
               {tok_sql('output')} as o from f_sft),
u as (select conv_id, turn, list_slice(list_concat(list_concat(p, o), [1]), 1, {MAX_LEN}) as ids,
             least(len(p), {MAX_LEN}) as plen from t),
v as (select *, list_transform(ids, lambda x, i: case when i <= plen then -100 else x end) as labels from u)
"""


@register("sft_mask_labels", with_fixtures(_SFT_SQL + """
select conv_id, turn, cast(len(ids) as int) as n_ids, cast(plen as int) as prompt_len,
       cast(len(list_filter(labels, lambda x: x = -100)) as int) as n_masked,
       cast(list_sum(ids) as bigint) as ids_sum, cast(list_sum(labels) as bigint) as labels_sum from v
""", "f_sft"))
def q_sft_mask_labels(spark, sf):
    t = _sft(spark, sf)
    return t.select("conv_id", "turn", F.size("input_ids").alias("n_ids"), "prompt_len",
                    F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
                    _isum(F.col("input_ids")).alias("ids_sum"), _isum(F.col("labels")).alias("labels_sum"))


@register("response_start", with_fixtures(_SFT_SQL + """
select conv_id, turn, cast(case when len(ids) > plen then plen else 0 end as int) as response_start,
       cast(greatest(len(ids) - plen, 0) as int) as n_response_tokens from v
""", "f_sft"))
def q_response_start(spark, sf):
    t = _sft(spark, sf)
    return t.select("conv_id", "turn", TK.response_start(F.col("labels")).alias("response_start"),
                    F.size(F.filter("labels", lambda x: x != -100)).alias("n_response_tokens"))


# a subword tokenizer that joins across the border of prompt and output and leads a text with id 7
PIECES = hashed_piece_tokenizer(pad_id=5, eos_id=6, bos_id=7)
CUT_LEN, CUT_PROMPT, CUT_COMPLETION = 200, 12, 40


def _piece_sql(expr):
    return (f"list_transform(regexp_extract_all(coalesce({expr}, ''), '{PIECE_PATTERN}'), lambda w: case when w = '</s>' then {PIECES.eos_id} "
            f"else cast({N_SPECIAL} + (('0x' || substr(md5(w), 1, 8))::bigint % {DEFAULT_VOCAB - N_SPECIAL}) as integer) end)")


def _ids_text(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


@register("sft_joined_labels", with_fixtures(f"""
, x as (select conv_id, turn, {sql_literal(INSTRUCTION_HEAD)} || instruction || {sql_literal(RESPONSE_HEAD)} as prompt, output from f_sft),
t as (select conv_id, turn, list_slice(list_concat([{PIECES.bos_id}], {_piece_sql("prompt || output || '</s>'")}), 1, {CUT_LEN}) as ids,
             least(len({_piece_sql('prompt')}) + 1, {CUT_LEN}) as plen from x)
select conv_id, turn, cast(plen as int) as prompt_len, array_to_string(ids, ' ') as ids_text,
       array_to_string(list_transform(ids, lambda v, i: case when i <= plen then -100 else v end), ' ') as labels_text from t
""", "f_sft"))
def q_sft_joined_labels(spark, sf):
    """Prompt, output and end token tokenised as one text by a tokenizer that joins across their border."""
    t = TK.sft_tokenize(fixture(spark, sf, "f_sft"), CUT_LEN, PIECES)
    return t.select("conv_id", "turn", "prompt_len", _ids_text("input_ids").alias("ids_text"), _ids_text("labels").alias("labels_text"))


@register("pref_collate_padded", with_fixtures(f"""
, t as (select conv_id, turn, list_concat(list_concat([{PIECES.bos_id}], {_piece_sql('instruction')}), [{PIECES.eos_id}]) as p0,
               list_concat({_piece_sql('output')}, [{PIECES.eos_id}]) as c0, list_concat({_piece_sql('instruction')}, [{PIECES.eos_id}]) as r0,
               cast((row_number() over (order by conv_id, turn) - 1) // {PREF_BATCH} as bigint) as batch_id from f_sft),
u as (select conv_id, turn, batch_id, list_slice(p0, greatest(1, len(p0) - {CUT_PROMPT} + 1), len(p0)) as p,
             list_slice(c0, 1, {CUT_COMPLETION}) as c, list_slice(r0, 1, {CUT_COMPLETION}) as r from t),
w as (select *, max(len(p)) over (partition by batch_id) - len(p) as lp, max(len(c)) over (partition by batch_id) - len(c) as rc,
             max(len(r)) over (partition by batch_id) - len(r) as rr from u)
select conv_id, turn, batch_id, cast(lp as int) as prompt_left_pads,
       repeat('{PIECES.pad_id} ', lp) || array_to_string(p, ' ') as prompt_text,
       array_to_string(c, ' ') || repeat(' {PIECES.pad_id}', rc) as chosen_text,
       array_to_string(r, ' ') || repeat(' {PIECES.pad_id}', rr) as rejected_text,
       repeat('0 ', lp) || trim(repeat('1 ', len(p))) as prompt_mask_text,
       trim(repeat('1 ', len(c))) || repeat(' 0', rc) as chosen_mask_text from w
""", "f_sft"))
def q_pref_collate_padded(spark, sf):
    """Prompts of several tokens, cut at their front and padded there; whole arrays are compared."""
    src = fixture(spark, sf, "f_sft").select("conv_id", "turn", F.col("instruction").alias("prompt"), F.col("output").alias("chosen"),
                                             F.col("instruction").alias("rejected"))
    t = TK.preference_tokenize(src, CUT_PROMPT, CUT_COMPLETION, add_special_tokens=True, tokenizer=PIECES)
    c = TK.preference_collate(assign_batches(t, ["conv_id", "turn"], PREF_BATCH, unique=True), pad_id=PIECES.pad_id)
    pads = F.size(F.filter("prompt_attention_mask", lambda x: x == 0))
    return c.select("conv_id", "turn", "batch_id", pads.alias("prompt_left_pads"), _ids_text("prompt_input_ids").alias("prompt_text"),
                    _ids_text("chosen_input_ids").alias("chosen_text"), _ids_text("rejected_input_ids").alias("rejected_text"),
                    _ids_text("prompt_attention_mask").alias("prompt_mask_text"), _ids_text("chosen_attention_mask").alias("chosen_mask_text"))


_BATCH_SQL = f"""
, b as (select *, cast((row_number() over (order by conv_id, turn) - 1) // {SFT_BATCH} as bigint) as batch_id from v)
"""


@register("assign_batches", with_fixtures(f"""
select conv_id, turn, cast((row_number() over (order by conv_id, turn) - 1) // {SFT_BATCH} as bigint) as batch_id from f_sft
""", "f_sft"))
def q_assign_batches(spark, sf):
    return assign_batches(fixture(spark, sf, "f_sft").select("conv_id", "turn"), ["conv_id", "turn"], SFT_BATCH)


def _sft_batched(spark, sf):
    return assign_batches(_sft(spark, sf), ["conv_id", "turn"], SFT_BATCH, unique=True)


@register("sft_collate", with_fixtures(_SFT_SQL + _BATCH_SQL + """
, c as (select *, max(len(ids)) over (partition by batch_id) as w from b)
select conv_id, turn, batch_id, cast(w as int) as padded_len,
       cast(list_sum(ids) as bigint) as ids_sum,
       cast(list_sum(labels) + (-100) * (w - len(ids)) as bigint) as labels_sum,
       cast(len(ids) as bigint) as mask_sum from c
""", "f_sft"))
def q_sft_collate(spark, sf):
    c = TK.sft_collate(_sft_batched(spark, sf))
    return c.select("conv_id", "turn", "batch_id", "padded_len", _isum(F.col("input_ids")).alias("ids_sum"),
                    _isum(F.col("labels")).alias("labels_sum"), _isum(F.col("attention_mask")).alias("mask_sum"))


@register("pack_batches", with_fixtures(_SFT_SQL + _BATCH_SQL + """
select batch_id, cast(count(*) as int) as n_sequences, cast(sum(len(ids)) as int) as total_len,
       cast(sum(list_sum(ids)) as bigint) as ids_sum, cast(sum(len(ids) * (len(ids) - 1) // 2) as bigint) as position_sum
from b group by batch_id
""", "f_sft"))
def q_pack_batches(spark, sf):
    b = _sft_batched(spark, sf).withColumn("_order", F.struct("conv_id", "turn"))
    p = TK.pack_batches(b)
    return p.select("batch_id", "n_sequences", F.size("input_ids").alias("total_len"),
                    _isum(F.col("input_ids")).alias("ids_sum"), _isum(F.col("position_ids")).alias("position_sum"))


def _pref(spark, sf):
    # the tokenised rows keep the pair key plus the trainer's accepted columns
    t = TK.preference_tokenize(fixture(spark, sf, "f_pref"), MAX_PROMPT, None)
    return t.select("pair_id", *TK.keep_signature_columns(t).columns)


_PREF_SQL = f"""
, t as (select pair_id, {tok_sql('prompt')} as p0, {tok_sql('chosen')} as c0, {tok_sql('rejected')} as r0 from f_pref),
u as (select pair_id, list_slice(p0, greatest(1, len(p0) - {MAX_PROMPT} + 1), len(p0)) as p,
             list_concat(c0, [1]) as c, list_concat(r0, [1]) as r from t)
"""


@register("pref_tokenize", with_fixtures(_PREF_SQL + """
select pair_id, cast(len(p) as int) as prompt_len, cast(len(c) as int) as chosen_len, cast(len(r) as int) as rejected_len,
       cast(coalesce(list_sum(p), 0) as bigint) as prompt_sum, cast(list_sum(c) as bigint) as chosen_sum,
       cast(list_sum(r) as bigint) as rejected_sum from u
""", "f_pref"))
def q_pref_tokenize(spark, sf):
    t = _pref(spark, sf)
    return t.select("pair_id", F.size("prompt_input_ids").alias("prompt_len"), F.size("chosen_input_ids").alias("chosen_len"),
                    F.size("rejected_input_ids").alias("rejected_len"), _isum(F.col("prompt_input_ids")).alias("prompt_sum"),
                    _isum(F.col("chosen_input_ids")).alias("chosen_sum"), _isum(F.col("rejected_input_ids")).alias("rejected_sum"))


@register("pair_lengths", with_fixtures(_PREF_SQL + """
select pair_id, cast(len(p) as int) as prompt_len, cast(len(c) as int) as chosen_len, cast(len(r) as int) as rejected_len,
       cast(least(len(c), len(r)) as int) as public_len, cast(greatest(len(c), len(r)) as int) as longest_len from u
""", "f_pref"))
def q_pair_lengths(spark, sf):
    t = _pref(spark, sf)
    c, r = F.size("chosen_input_ids"), F.size("rejected_input_ids")
    return t.select("pair_id", F.size("prompt_input_ids").alias("prompt_len"), c.alias("chosen_len"),
                    r.alias("rejected_len"), F.least(c, r).alias("public_len"), F.greatest(c, r).alias("longest_len"))


_PREF_BATCH_SQL = f"""
, b as (select *, cast((row_number() over (order by pair_id) - 1) // {PREF_BATCH} as bigint) as batch_id from u)
"""


def _pref_batched(spark, sf):
    return assign_batches(_pref(spark, sf), ["pair_id"], PREF_BATCH, unique=True)


@register("pref_collate", with_fixtures(_PREF_SQL + _PREF_BATCH_SQL + """
, w as (select *, max(len(p)) over (partition by batch_id) as pw, max(len(c)) over (partition by batch_id) as cw,
               max(len(r)) over (partition by batch_id) as rw from b)
select pair_id, batch_id, cast(pw as int) as prompt_width, cast(cw as int) as chosen_width, cast(rw as int) as rejected_width,
       cast(pw - len(p) as int) as prompt_left_pads,
       cast(case when pw > len(p) then 0 else p[1] end as int) as prompt_first_id,
       cast(len(p) + len(c) + len(r) as bigint) as mask_sum from w
""", "f_pref"))
def q_pref_collate(spark, sf):
    c = TK.preference_collate(_pref_batched(spark, sf))
    return c.select("pair_id", "batch_id", F.size("prompt_input_ids").alias("prompt_width"),
                    F.size("chosen_input_ids").alias("chosen_width"), F.size("rejected_input_ids").alias("rejected_width"),
                    F.size(F.filter("prompt_attention_mask", lambda x: x == 0)).alias("prompt_left_pads"),
                    F.get(F.col("prompt_input_ids"), 0).alias("prompt_first_id"),
                    (_isum(F.col("prompt_attention_mask")) + _isum(F.col("chosen_attention_mask"))
                     + _isum(F.col("rejected_attention_mask"))).alias("mask_sum"))


@register("pair_stack", with_fixtures(_PREF_SQL + _PREF_BATCH_SQL + """
, s as (select pair_id, batch_id, 0 as side, c as comp from b union all select pair_id, batch_id, 1, r from b),
w as (select *, max(len(comp)) over (partition by batch_id) as cw from s)
select pair_id, side, cast(len(comp) as int) as completion_len, cast(cw as int) as completion_width,
       cast(list_sum(comp) as bigint) as completion_sum from w
""", "f_pref"))
def q_pair_stack(spark, sf):
    s = TK.pad_stacked(TK.stack_pairs(_pref_batched(spark, sf)))
    return s.select("pair_id", "side", _isum(F.col("completion_attention_mask")).cast("int").alias("completion_len"),
                    F.col("completion_width").cast("int").alias("completion_width"),
                    _isum(F.col("completion_input_ids")).alias("completion_sum"))


@register("pair_truncate", with_fixtures(_PREF_SQL + f"""
, s as (select pair_id, 0 as side, p, c as comp from u union all select pair_id, 1, p, r from u),
j as (select pair_id, side, list_concat(p, comp) as ids,
             list_concat(list_transform(p, lambda x: 0), list_transform(comp, lambda x: 1)) as m from s),
k as (select pair_id, side, list_slice(ids, greatest(1, len(ids) - {MAX_LEN} + 1), len(ids)) as ids,
             list_slice(m, greatest(1, len(m) - {MAX_LEN} + 1), len(m)) as m from j)
select pair_id, side, cast(len(ids) as int) as seq_len, cast(list_sum(m) as bigint) as n_loss_tokens,
       cast(list_sum(ids) as bigint) as ids_sum from k
""", "f_pref"))
def q_pair_truncate(spark, sf):
    j = TK.join_and_truncate(TK.stack_pairs(_pref(spark, sf)), MAX_LEN, "keep_end")
    return j.select("pair_id", "side", F.size("input_ids").alias("seq_len"), _isum(F.col("loss_mask")).alias("n_loss_tokens"),
                    _isum(F.col("input_ids")).alias("ids_sum"))


@register("pref_extract_prompt", with_fixtures("""
, x as (select pair_id, string_split(chosen, '') as ca, string_split(rejected, '') as ra from f_pref),
y as (select *, least(len(ca), len(ra)) as m from x),
z as (select *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: ca[i] = ra[i]), false), 0) as k from y),
w as (select *, case when m = 0 then 0 when k = 0 then m - 1
                     when (case when k >= 2 then ca[k - 1] else ca[len(ca)] end) = ' ' then k - 2 else k - 1 end as idx from z)
select pair_id,
       cast(case when idx >= 0 then idx else len(ca) - 1 end as int) as prompt_len,
       cast(case when idx >= 0 then greatest(len(ca) - idx, 0) else 1 end as int) as chosen_len,
       cast(case when idx >= 0 then greatest(len(ra) - idx, 0) else 1 end as int) as rejected_len
from w
""", "f_pref"))
def q_pref_extract_prompt(spark, sf):
    e = TK.implicit_prompt(fixture(spark, sf, "f_pref").drop("prompt"))
    return e.select("pair_id", F.length("prompt").alias("prompt_len"), F.length("chosen").alias("chosen_len"),
                    F.length("rejected").alias("rejected_len"))


@register("chat_render", f"""
select conv_id, cast(count(*) as int) as n_turns,
       string_agg({sql_literal(TK.CHAT_TURN_HEAD)} || role || chr(10) || coalesce(text, '') || {sql_literal(TK.CHAT_TURN_TAIL)}, ''
                  order by turn) as text
from conversations group by conv_id
""")
def q_chat_render(spark, sf):
    return TK.render_chat(read_table(spark, sf, "conversations"))


@register("game_log_sample")
def q_game_log_sample(spark, sf):
    """Qualitative sample table: k pairs in a deterministic hash order (the limit is the feature)."""
    p = fixture(spark, sf, "f_pref")
    policy = F.concat(F.col("prompt"), F.col("chosen"))
    ref = F.concat(F.col("prompt"), F.col("rejected"))
    start = F.length("prompt") + 1
    return (p.orderBy(F.xxhash64("pair_id"), "pair_id").limit(10)
             .select(F.col("prompt").alias("Prompt"), policy.substr(start, F.lit(1 << 30)).alias("Policy"),
                     ref.substr(start, F.lit(1 << 30)).alias("Ref")))
