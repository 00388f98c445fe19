"""Token preparation: golden examples of collation, truncation and packing."""

import pytest
from pyspark.sql import functions as F

from stepwise.functions import templates as T
from stepwise.functions.tokens import object_tokenizer
from stepwise.operators import tokens as TK


def test_preference_collate_golden(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [4, 5], [6]), (0, [7, 8], [9, 10], [11, 12, 13])],
                               "batch_id int, prompt_input_ids array<int>, chosen_input_ids array<int>, rejected_input_ids array<int>")
    rows = TK.preference_collate(df.withColumn("o", F.monotonically_increasing_id())).orderBy("o").collect()
    assert [r["prompt_input_ids"] for r in rows] == [[1, 2, 3], [0, 7, 8]]
    assert [r["prompt_attention_mask"] for r in rows] == [[1, 1, 1], [0, 1, 1]]
    assert [r["chosen_input_ids"] for r in rows] == [[4, 5], [9, 10]]
    assert [r["rejected_input_ids"] for r in rows] == [[6, 0, 0], [11, 12, 13]]
    assert [r["rejected_attention_mask"] for r in rows] == [[1, 0, 0], [1, 1, 1]]


def test_truncation_keeps_prompt_end_and_completion_start(spark):
    df = spark.createDataFrame([([10, 11, 12, 13],)], "ids array<int>")
    r = df.select(TK.keep_last(F.col("ids"), 3).alias("last"), TK.keep_first(F.col("ids"), 3).alias("first"),
                  TK.keep_last(F.col("ids"), 9).alias("all")).collect()[0]
    assert r["last"] == [11, 12, 13] and r["first"] == [10, 11, 12] and r["all"] == [10, 11, 12, 13]


def test_join_and_truncate(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5, 6])], "prompt_input_ids array<int>, completion_input_ids array<int>")
    end = TK.join_and_truncate(df, 4, "keep_end").collect()[0]
    start = TK.join_and_truncate(df, 4, "keep_start").collect()[0]
    assert end["input_ids"] == [3, 4, 5, 6] and end["loss_mask"] == [1, 1, 1, 1]
    assert start["input_ids"] == [1, 2, 3, 4] and start["loss_mask"] == [0, 0, 1, 1]


def test_packing_golden(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4, 5, 6, 7]), (0, 2, [])],
                               "batch_id int, _order int, input_ids array<int>")
    r = TK.pack_batches(df).collect()[0]
    assert r["input_ids"] == [1, 2, 3, 4, 5, 6, 7]
    assert r["position_ids"] == [0, 1, 2, 0, 1, 2, 3]


def test_sft_labels_and_response_start(spark):
    df = spark.createDataFrame([("add two numbers", "the sum is four")], "instruction string, output string")
    r = TK.sft_tokenize(df, max_length=2048).select("*", TK.response_start(F.col("labels")).alias("rs")).collect()[0]
    assert r["input_ids"][-1] == 1                           # end-of-sequence id
    assert r["labels"][:r["prompt_len"]] == [-100] * r["prompt_len"]
    assert r["rs"] == r["prompt_len"]
    short = TK.sft_tokenize(df, max_length=3).collect()[0]
    assert len(short["input_ids"]) == 3 and short["labels"] == [-100, -100, -100]


def test_implicit_prompt(spark):
    df = spark.createDataFrame([("The sky is blue", "The sky is green"), ("abc", "abcd"), ("xa ", "ya")],
                               "chosen string, rejected string")
    rows = TK.implicit_prompt(df).collect()
    assert (rows[0]["prompt"], rows[0]["chosen"], rows[0]["rejected"]) == ("The sky is", " blue", " green")
    assert (rows[1]["prompt"], rows[1]["chosen"], rows[1]["rejected"]) == ("ab", "c", "cd")
    # first characters differ and the chosen text ends in a space: negative index rule
    assert (rows[2]["prompt"], rows[2]["chosen"], rows[2]["rejected"]) == ("xa", " ", "a")


def test_signature_whitelist_and_python_tokenizer(spark):
    from stepwise.functions.tokens import python_tokenizer
    df = spark.createDataFrame([("a b", "c", "d e f")], "prompt string, chosen string, rejected string")
    tok = python_tokenizer(lambda t: [len(w) for w in t.split()])
    t = TK.preference_tokenize(df, max_prompt_length=1, tokenizer=tok)
    kept = TK.keep_signature_columns(t)
    assert kept.columns == ["prompt_input_ids", "chosen_input_ids", "rejected_input_ids"]
    r = kept.collect()[0]
    assert r["prompt_input_ids"] == [1] and r["chosen_input_ids"] == [1, 1] and r["rejected_input_ids"] == [1, 1, 1, 1]


def test_shift_and_roll(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "ids array<int>")
    rows = df.select(TK.shift_right(F.col("ids"), 9).alias("s"), TK.roll(F.col("ids"), 1).alias("r1"),
                     TK.roll(F.col("ids"), -1).alias("rm1")).collect()
    assert (rows[0]["s"], rows[0]["r1"], rows[0]["rm1"]) == ([9, 5, 6], [7, 5, 6], [6, 7, 5])
    assert (rows[1]["s"], rows[1]["r1"], rows[1]["rm1"]) == ([], [], [])


def _split_by_hand(chosen, rejected):
    """The shared prefix as the prompt, character by character."""
    k, least = 0, min(len(chosen), len(rejected))
    for k in range(least):
        if chosen[k] != rejected[k]:
            if chosen[k - 1] == " ":
                k -= 1
            break
    return chosen[:k], chosen[k:], rejected[k:]


def test_implicit_prompt_by_prefix_search(spark):
    import random

    from stepwise.operators.tokens import common_prefix_length, implicit_prompt
    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "b"), (" a", " b"), ("same", "same"), ("ab c", "ab d"), ("é😀 x", "é😀 y"), ("b ", "c "),
             ("x" * 1_000_000 + "a tail", "x" * 1_000_000 + "b tail")]
    for _ in range(200):
        p = "".join(rng.choices("ab é😀", k=rng.randint(0, 12)))
        pairs.append((p + "".join(rng.choices("ab é", k=rng.randint(0, 5))), p + "".join(rng.choices("ab é", k=rng.randint(0, 5)))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, chosen string, rejected string")
    got = {r["i"]: (r["prompt"], r["chosen"], r["rejected"]) for r in implicit_prompt(df).collect()}
    for i, (c, r) in enumerate(pairs):
        assert got[i] == _split_by_hand(c, r), (c[:20], r[:20])
    n = df.select("i", common_prefix_length(F.col("chosen"), F.col("rejected")).alias("n")).collect()
    import os
    assert all(r["n"] == len(os.path.commonprefix(pairs[r["i"]])) for r in n)


def _joining():
    """A caller's tokenizer object, local so that it travels to the workers as a whole."""
    class Joining:
        """Pairs of characters over the whole text, led by a begin id: ids of a joined text differ from those of its parts."""

        pad_token_id, eos_token_id, bos_token_id, eos_token = 90, 91, None, "~"

        def __call__(self, text, add_special_tokens=True):
            ids = [91 if text[i:i + 2] == "~" else sum(map(ord, text[i:i + 2])) for i in range(0, len(text), 2)]
            return {"input_ids": ([92] if add_special_tokens else []) + ids}

    return Joining()


def test_tokenizer_objects_join_across_the_border(spark):
    joining = _joining()
    tok = object_tokenizer(joining)
    assert (tok.pad_id, tok.eos_id, tok.bos_id, tok.eos_token) == (90, 91, None, "~")
    rows = [("a", "xyz"), ("ab", "xyz"), ("", ""), ("a", None)]
    df = spark.createDataFrame(rows, "instruction string, output string")
    for cut in (2048, 20, 3):
        for r in TK.sft_tokenize(df, cut, tok).collect():
            prompt = T.INSTRUCTION_HEAD + r.instruction + T.RESPONSE_HEAD
            full = joining(prompt + (r.output or "") + "~")["input_ids"][:cut]
            n = len(joining(prompt)["input_ids"][:cut])
            assert r.input_ids == full and r.labels == [-100] * min(n, len(full)) + full[n:] and r.prompt_len == n
    pref = spark.createDataFrame([("abcd", "x", "yz")], "prompt string, chosen string, rejected string")
    r = TK.preference_tokenize(pref, None, None, True, tok).first()
    assert r.prompt_input_ids == [195, 199, 91] and r.chosen_input_ids == [120, 91] and r.rejected_input_ids == [243, 91]
    cut = TK.preference_tokenize(pref, 2, 1, True, tok).first()
    assert cut.prompt_input_ids == [199, 91] and cut.chosen_input_ids == [120]


def test_library_tokenizer_objects(spark):
    """An object of the tokenizers library: ids of the joined text, no special ids of its own."""
    public = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    df = spark.createDataFrame([("add two", "four")], "instruction string, output string")
    prompt = T.INSTRUCTION_HEAD + "add two" + T.RESPONSE_HEAD
    r = TK.sft_tokenize(df, 2048, object_tokenizer(lib)).first()
    assert r.input_ids == lib.encode(prompt + "four").ids and r.prompt_len == len(lib.encode(prompt).ids)
