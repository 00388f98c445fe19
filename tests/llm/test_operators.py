"""Operators of the training-data subpackage against brute force, round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from stepwise.llm import (common, decision_lists, language_id, merkle, minhash_join, packing, passages, pieces, quality_ordinal,  # noqa: E402
                          suffix_dedup, tool_calls, url_filters)

EDGE = [(1, "One two three. Four five!\nsix", "en"), (1, "One two three. Four five!\nsix", "en"), (2, None, None), (3, "", "fr"),
        (None, "no id here", "en"), (4, "wörter " * 3000, "de"), (5, "  \n\n ", None), (6, "▁ a  b\t▁", "es")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string")
    return df.withColumns({"kept": F.lit("x"), "n_words": F.lit(0), "score": F.lit("y"), "fingerprint": F.lit(1)})


def _clash(edge):
    """More columns named like those that operators work with."""
    return edge.withColumns({c: F.lit(f"own {c}") for c in OWN_NAMES})


OWN_NAMES = ["_text", "_did", "_th", "_row", "row", "ranges", "_rank", "place", "_cut", "_rest", "_"]


def _carried(df):
    return collections.Counter(df.select("doc_id", "text", *(c for c in OWN_NAMES)).collect())


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


def test_language_gradients_and_held_out():
    rng = np.random.default_rng(0)
    net = language_id._new_network(["a", "b"], 3, rng)
    for k in ("wx", "u", "b", "wo", "bo"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(97, 103, (4, 6)).astype(np.uint8), rng.integers(0, 2, 4)
    _, grads = language_id._loss_gradients(net, x, y)
    for p, g in zip(net.params(), grads):
        for _ in range(8):
            i = tuple(rng.integers(0, s) for s in p.shape)
            was, e = p[i], 1e-4
            p[i] = was + e
            up, _ = language_id._loss_gradients(net, x, y)
            p[i] = was - e
            down, _ = language_id._loss_gradients(net, x, y)
            p[i] = was
            assert abs((up - down) / (2 * e) - g[i]) < 1e-4


def test_language_accuracy_and_edges(spark, sf, edge, none):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    net = language_id.train([r.text[:512] for r in train], [r.lang for r in train], steps=120)
    held = [r for r in rows if not zlib.crc32(str(r.doc_id).encode()) % 5]
    p = language_id.Labeller(net).documents([r.text for r in held])
    assert np.mean([net.langs[k] == r.lang for k, r in zip(p.argmax(1), held)]) > 0.9
    got = language_id.identify(edge, net, ["doc_id"]).collect()
    assert len(got) == len(EDGE) and {r.lang_pred for r in got if r.doc_id in (2, 3, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(none, net, ["doc_id"]).count() == 0
    assert language_id.train([], []) is None and language_id.training_sample(none) == []
    assert {r.lang_pred for r in language_id.identify(edge, None, ["doc_id"]).collect()} == {"und"}


def test_language_sample_holds_every_language(spark):
    rows = [(70 * i + k, f"text {i}", f"l{k:02}") for k in range(70) for i in range(40 if k < 69 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = {f"l{k:02}" for k in range(70)}
    assert collections.Counter(c for _, c in language_id.training_sample(df)) == collections.Counter(r[2] for r in rows)
    small = language_id.training_sample(df, budget=70)
    assert {c for _, c in small} == langs and len(small) <= 140


def test_ordinal_quality(spark, edge, none):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choices(words, k=40))
        grade = i % 3
        rows.append((text + (" rude rude" if grade == 1 else ""), grade) if grade else (" ".join(w + "###" for w in text.split()), 0))
    model = quality_ordinal.train(rows[:450], 3)
    assert (np.diff(model.thresholds) > 0).all()
    f = quality_ordinal.Features()
    pred = [int((model.tails(*f(t)) >= 0.5).sum()) for t, _ in rows[450:]]
    assert np.mean([a == g for a, (_, g) in zip(pred, rows[450:])]) > 0.95
    got = quality_ordinal.score(edge.select("doc_id", "text"), model, ["doc_id"], 3, 2).collect()
    assert len(got) == len(EDGE)
    assert all(r.kept for r in quality_ordinal.score(edge.select("doc_id", "text"), None, ["doc_id"], 3, 2).collect())
    assert quality_ordinal.score(none.select("doc_id", "text"), model, ["doc_id"], 3, 2).count() == 0
    assert quality_ordinal.train([("a", 1)], 3) is None
    clash = _clash(edge)
    for m in (model, None):
        out = quality_ordinal.score(clash, m, clash.columns, 3, 2)
        assert out.columns == [c for c in clash.columns if c != "kept"] + quality_ordinal.RESULTS
        assert _carried(out) == _carried(clash)


def test_ordinal_features_follow_the_number_of_ratings():
    """A word that always goes with a low grade gets a weight from 60 ratings on, one by chance hardly ever from 600."""
    rng = random.Random(3)
    noise = [f"n{i}" for i in range(300)]
    for n in (60, 600):
        data = [(" ".join(rng.choices(noise, k=30)) + (" awful" if i % 3 == 0 else ""), int(i % 3 > 0)) for i in range(n)]
        f = quality_ordinal.Features()
        telling = quality_ordinal._telling_places([(*f(t), g) for t, g in data], 2, 5, quality_ordinal.FALSE_RATE)
        assert telling[quality_ordinal._place("w", "awful")]
        assert sum(telling[quality_ordinal._place("w", w)] for w in noise) <= 2


def test_tool_calls_links_orders_and_validates(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "f", '{"x":1, "a":[1,{"z":2,"b":null}]}', []), (1, 0, "b", "f", '{"x":"s"}', ["a"]),
        (1, 2, "c", "f", '{"x":2}', ["b", "b", "gone"]), (2, 0, "p", "f", '{"x":1}', ["q"]), (2, 1, "q", "f", '{"x":1}', ["p"]),
        (2, 2, "r", "f", '{"x":1}', ["q"]), (3, 0, None, "f", "{}", None), (3, 0, "d", "g", "not json", None),
        (3, 1, "d", "g", "{}", None), (3, 2, "e", "f", '{"x":1,"x":2}', None)],
        "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 3, "a", "ok"), (1, 4, "a", "late"), (3, 1, "zz", "?"), (None, 1, "a", "x")],
                                    "conv_id bigint, turn bigint, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "a", "array", False)],
                                    "name string, param string, type string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(calls.withColumn("json", F.lit(1)), results, schemas).collect()}
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert a.json == '{"arguments":{"a":[1,{"b":null,"z":2}],"x":1},"id":"a","name":"f","result":"ok"}' and a.n_results == 2
    key = lambda r: (r.topo_turn, r.topo_depth)
    assert key(a) == (1, 0) and key(b) == (1, 1) and key(c) == (2, 0)
    assert b.errors == ["type:x"] and c.errors == ["dependency:gone"]
    assert {got[2, k].status for k in "pqr"} == {"cycle"}
    assert got[3, "d"].n_calls == 2 and got[3, "d"].errors == ["unknown_tool"] and got[3, "e"].errors == ["arguments"]
    assert got[3, "zz"].status == "orphan_result" and got[3, None].status == "no_id" and got[None, "a"].status == "no_id"
    assert len(got) == 11
    assert tool_calls.link_tool_calls(calls.where("false"), results.where("false"), schemas).count() == 0


def _brute_pack_ok(pieces_, ids_of, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, ids, total, seq, off in pieces_:
        by_doc[doc].append((start, ids.tolist(), total))
        by_seq[seq].append((off, len(ids)))
    for doc, parts in by_doc.items():
        assert sum((p[1] for p in sorted(parts)), []) == ids_of[doc] and {p[2] for p in parts} == {len(ids_of[doc])}
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return by_seq


@pytest.mark.parametrize("max_open", [3, 1000])
def test_packer_places_every_id_once(max_open):
    rng = np.random.default_rng(2)
    docs = {i: rng.integers(0, 99, rng.integers(1, 70)).tolist() for i in range(300)}
    p = packing.Packer(5, capacity=32, max_open=max_open)
    out = [x for i, ids in docs.items() for x in p.add(i, np.array(ids, "<u4"))] + list(p.finish())
    seqs = _brute_pack_ok(out, docs, 32)
    assert sum(sum(n for _, n in s) < 32 for s in seqs.values()) <= 1


def test_sum_of_squares_choice():
    p = packing.Packer(0, capacity=10)
    p.levels[[4, 7]] = [1, 5]
    size = 3
    options = {}
    for h in (0, 4, 7):
        n = p.levels.copy()
        n[h] -= h > 0
        n[h + size] += 1
        options[h] = int((n[1:10] ** 2).sum())
    assert options[p._level_for(size)] == min(options.values())


def test_chunk_tables_equal_the_libraries(spark, edge, none):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    rng = random.Random(3)
    signs = list("aB  \n\t\r▁éÉ漢😀<|>0.,'sSİΣ\x00\u0301\x85\u00a0") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "word", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(2000)] + [None]
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    table = packing.ChunkTable(path)
    assert [np.frombuffer(b, "<u4").tolist() for b in table.encode(texts)] == [
        whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = SentencePieceProcessor(model_file=path), pieces.ChunkCodec(path)
    assert codec.chunked
    ids = [sp.encode(t or "", add_eos=True) for t in texts]
    assert codec(texts) == [(len(i), " ".join(map(str, i)), sp.decode(i)) for i in ids]
    got = pieces.encode_documents(edge, path, ["doc_id", "kept"], with_ids=True).collect()
    assert sorted((r.ids, r.kept) for r in got) == sorted((" ".join(map(str, sp.encode(t or "", add_eos=True))), "x") for _, t, _ in EDGE)
    assert pieces.encode_documents(none, path, ["doc_id"]).count() == 0
    packed = packing.pack(edge, public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in EDGE}
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_chunks_move_back_from_the_old_table(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, table = Tokenizer.from_file(path), packing.ChunkTable(path)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 2)
    learned = []
    monkeypatch.setattr(table, "_plain", lambda c: learned.append(c) or packing.ChunkTable._plain(c))
    batches = [["one", None, "", "two one."], ["two, 3 four", "naïve İ"], ["one four " + "x" * 70, "x" * 70], ["one", "four"]]
    for texts in batches:
        assert [np.frombuffer(b, "<u4").tolist() for b in table.encode(texts)] == [
            whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert learned.count("four") == 1 and "x" * 70 not in table.chunks


@pytest.mark.parametrize("symbols", [suffix_dedup.BYTES, suffix_dedup.Symbols(np.uint64, str.encode)])
def test_repeated_windows_are_those_of_equal_symbols(symbols):
    """Against all windows compared, with zero symbols and texts that end within a window of another."""
    rng = random.Random(9)
    seen = 0
    for length in (9, 13, 16, 21):
        lines = [[rng.choice((0, 0, 0, 1)) for _ in range(rng.randint(0, 40))] for _ in range(30)]
        lines += [lines[0][:length - 1], [0] * length, [0] * (length + 3), lines[1] + lines[2]]
        times = np.array([rng.randint(1, 2) for _ in lines])
        count = collections.Counter()
        for x, n in zip(lines, times.tolist()):
            for i in range(len(x) - length + 1):
                count[tuple(x[i:i + length])] += n
        flags, text, start = suffix_dedup.repeated_windows([np.array(x, symbols.dtype).tobytes() for x in lines], length, times, symbols)
        assert [f.tolist() for f in flags] == [[count[tuple(x[i:i + length])] > 1 for i in range(max(0, len(x) - length + 1))] for x in lines]
        heads = [tuple(lines[t][a:a + length]) for t, a in zip(text.tolist(), start.tolist())]
        assert sorted(heads) == sorted(count)
        seen += sum(n > 1 for n in count.values())
    assert seen > 20


def test_edited_fingerprints(spark, sf, edge, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    roots = collections.defaultdict(set)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        n = len(r.text)
        k = n // 4
        g = got[r.doc_id]
        edited = r.text[:n - k] + nxt.text[:k]
        assert g.n_chars == n and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g.near_next <= 1 and 0 <= g.near_edited <= 1
        roots[r.text].add(g.fingerprint)
    assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)
    assert np.mean([g.near_edited > g.near_next for g in got.values()]) > 0.95
    few = merkle.edited_fingerprints(edge).collect()
    assert len(few) == len(EDGE) and merkle.edited_fingerprints(none).count() == 0
    assert len({r.fingerprint for r in few if r.doc_id == 1}) == 1
    alone = merkle.edited_fingerprints(edge.where("doc_id = 4")).collect()
    assert alone[0].near_next == 1.0


def _counts_by_hand(text):
    import re
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_decision_lists(spark, edge, none):
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab #|\n\t\x0b\x1cé") for _ in range(rng.randint(0, 60)))
        assert decision_lists.text_counts(t)[:5] == _counts_by_hand(t)
    gen = np.random.default_rng(5)
    stats = {"p": gen.random(900), "q": gen.random(900), "r": gen.integers(0, 9, 900).astype(float)}
    bad = ((stats["p"] > 0.7) & (stats["q"] < 0.5)) | (stats["r"] >= 8)
    rules = decision_lists.learn_rules(stats, bad)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.covers(stats, 900)
    assert (hit == bad).mean() > 0.97 and decision_lists.learn_rules(stats, np.zeros(900, bool)) == []
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(*stats.values())], "p double, q double, r double")
    first = [r[0] for r in df.select(decision_lists.rules_expression(rules)).collect()]
    assert [f is not None for f in first] == hit.tolist()
    counts = decision_lists.with_counts(edge.select("doc_id", "text"), ["doc_id"])
    got = decision_lists.apply_rules(counts, []).collect()
    assert len(got) == len(EDGE) and not any(r.kept for r in got if r.n_words < 50)
    assert decision_lists.with_counts(none.select("doc_id", "text"), ["doc_id"]).count() == 0
    clash = _clash(edge).withColumns({"symbol_share": F.lit("s"), "rule": F.lit("r")})
    out = decision_lists.apply_rules(decision_lists.with_counts(clash, clash.columns), rules[:0])
    assert len(set(out.columns)) == len(out.columns) and _carried(out) == _carried(clash)
    assert {r.symbol_share for r in out.collect()} == {"s"}


def _brute_cut(texts, length):
    c = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i:i + length]] > 1:
                m[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        yield len(t), int(m.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~m])


@pytest.mark.parametrize("sizes", [{}, {"shard_spans": 3, "shard_bytes": 500}])
def test_suffix_dedup_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(150)) for _ in range(4)]
    docs = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 100)
            t += b[a:a + rng.randint(5, 60)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 6)))
        docs.append((i, t))
    docs += [(7, docs[7][1]), (200, None), (None, "a" * 90), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(3))
    got = suffix_dedup.remove_repeats(df, length=24, gram=6, **sizes).collect()
    want = collections.Counter((d, *b) for (d, _), b in zip(docs, _brute_cut([(t or "").encode() for _, t in docs], 24)))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.9])
def test_frequent_grams_make_rows_by_blocks_not_by_windows(spark, monkeypatch, share):
    """Unlike spans of one gram: a passage shorter than the length, and copies with changed letters."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, base = letters(90), letters(200)
    docs = []
    for i in range(300):
        near = "".join(letters(1) if rng.random() < 0.02 else c for c in base)
        docs.append((i, near if rng.random() < share else letters(rng.randint(60, 90)) + passage + letters(rng.randint(60, 90))))
    made = collections.Counter()
    write = suffix_dedup.materialise

    def counted(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, length=100, gram=12, shard_spans=20, shard_bytes=5000).collect()
    want = {(d, *b) for (d, _), b in zip(docs, _brute_cut([t.encode() for _, t in docs], 100))}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert made["repeats"] + made["blocks"] < 5 * made["anchors"]


def _brute_passages(texts, n):
    words = [t.split() for t in texts]
    c = collections.Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if c[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        yield [x for j, x in enumerate(w) if j not in gone], len(gone)


def _planted_passages():
    """Passages of 40 to 64 short and long words in two to five documents each, spaced in several ways."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdéß漢") for _ in range(rng.randint(1, 9)))
    docs = [[word() for _ in range(rng.randint(0, 90))] for _ in range(60)]
    for n in [*range(40, 65), 50, 51, 51]:
        passage = [word() for _ in range(n)]
        for d in rng.sample(docs, rng.randint(2, 5)):
            at = rng.randint(0, len(d))
            d[at:at] = passage
    texts = [rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", " ", "\n\n", "\u3000", "\x85"]) for w in d) for d in docs]
    rows = list(enumerate(texts))
    return [*rows, (3, texts[3]), (100, None), (None, "a " * 70), (101, ""), (102, "x" * 3000 + " y" * 49), (103, "x" * 3000 + " y" * 49)]


@pytest.mark.parametrize("sizes", [{}, {"shard_spans": 3, "shard_words": 200}])
def test_passages_equal_brute_force(spark, sizes, monkeypatch):
    docs = _planted_passages()
    monkeypatch.setattr(passages, "BLOCK", 100)
    for _, t in docs:
        starts, ends, ids = passages.words_of(t or "")
        assert [t[a:b] for a, b in zip(starts, ends)] == (t or "").split()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(3))
    got = passages.remove_passages(df, **sizes).collect()
    want = collections.Counter((d, " ".join(w), n) for (d, _), (w, n) in zip(docs, _brute_passages([t or "" for _, t in docs], 51)))
    assert collections.Counter((r.doc_id, " ".join(r.kept.split()), r.n_removed) for r in got) == want
    assert all(r.kept == (r.text or "") for r in got if not r.n_removed)
    assert passages.remove_passages(df.where("false")).count() == 0


def test_cuts_carry_clashing_columns(spark, edge):
    clash = _clash(edge)
    for out in (passages.remove_passages(clash), suffix_dedup.remove_repeats(clash, as_text=True)):
        assert _carried(out) == _carried(clash) and len(set(out.columns)) == len(out.columns)
    out = language_id.identify(clash, None, clash.columns)
    assert _carried(out) == _carried(clash)


@pytest.mark.parametrize("stage", ["quality_classifier", "quality_rules", "near_dedup", "suffix_array_dedup"])
def test_pipeline_stages_keep_columns(spark, sf, edge, stage):
    """Rows that a stage keeps have their columns as they were; empty tables stay empty."""
    clash = _clash(edge).withColumn("n_chars", F.length("text").cast("long"))
    words = " ".join(f"word{i} tells{i} more" for i in range(60))
    good = clash.where("doc_id = 3").withColumns({"text": F.lit(words), "doc_id": F.lit(77).cast("long")})
    twice = good.withColumns({"doc_id": F.lit(78).cast("long"), "text": F.concat(F.lit("first "), "text")})
    docs = clash.unionByName(good).unionByName(twice).unionByName(twice.withColumn("text", F.lit(words * 2)))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r["_rank"] for r in got} <= {"own _rank"} and {r["_cut"] for r in got} <= {"own _cut"}
    ids = collections.Counter(r.doc_id for r in got)
    assert ids[77] == 1
    if stage == "near_dedup":
        assert 78 not in ids and ids[None] == 1 and ids[1] == 1
    if stage == "quality_rules":
        assert not {1, 2, 3, 5, 6} & set(ids)
    assert run(spark, docs.where("false"), sf).count() == 0


def test_pipeline_cuts_passages_of_over_fifty_words(spark, sf):
    docs = [(d, "en", t, len(t)) for d, t in _planted_passages() if d is not None and t]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string, n_chars long")
    got = corpus_pipeline.suffix_array_dedup(spark, df, sf)
    want = collections.Counter((r[0], " ".join(w)) for r, (w, _) in zip(docs, _brute_passages([r[2] for r in docs], 51)))
    assert got.columns == df.columns
    rows = got.collect()
    assert collections.Counter((r.doc_id, " ".join(r.text.split())) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs, n = [], 0
    for _ in range(12):
        text = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    docs += [(900, None), (901, " "), (902, "Solo"), (903, "solo"), (3, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sig", F.lit(0))
    sets, up = collections.defaultdict(list), {}
    for d, t in docs:
        w = (t or "").lower().split()
        if d is not None:
            up[d] = d
            sets[d].append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    got = minhash_join.near_duplicates(df, shingle_words=2, block=4).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {d: root(d) for d in up}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash_join.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("agree, words", [(34, [845, 1928, 665, 1717, 690, 2231, 486, 3149, 2139, 3454]),
                                          (35, [2125, 3204, 1871, 1610, 2040, 3225, 2151, 621, 1162, 102])])
def test_near_duplicates_link_unlikely_signatures(spark, agree, words):
    w = [f"w{i}" for i in words]
    docs = [(1, " ".join(w[:9])), (2, " ".join(w[:8] + w[9:]))]  # 8 of 10 words shared: exactly 0.8
    sigs = [minhash_join.signature(minhash_join.shingles(t, 1)) for _, t in docs]
    assert int((sigs[0] == sigs[1]).sum()) == agree
    rows = minhash_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=1).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (2, 1, False)]


def test_postings_leave_out_values_shared_by_chance(spark):
    n = minhash_join.COORDINATES
    lone = list(range(n))  # shares each of its values with another class, and no two with the same one
    rows = [(0, 5, lone)] + [(1 + k, 5, [k if c == k else 1000 * (k + 1) + c for c in range(n)]) for k in range(n)]
    near = [5000000 + c for c in range(n)]
    rows += [(100, 5, near), (101, 6, near[:17] + [-c for c in range(1, 31)] + near[47:])]  # 34 of 64 values agree
    posted = minhash_join.postings(spark.createDataFrame(rows, "doc_id long, b int, sig array<int>"), minhash_join.MATCHES).collect()
    assert {r.doc_id for r in posted} == {100, 101}
    assert {r.key for r in posted if r.doc_id == 100} & {r.key for r in posted if r.doc_id == 101}


def test_url_rules_and_cascade(spark):
    rng = random.Random(7)
    universe = [f"h{i}.example.org" for i in range(3000)] + ["", None]
    listed = rng.sample(universe[:3000], 400) + ["absent.example"]
    keys = url_filters.key_universe(spark.createDataFrame([(k,) for k in universe], "key string"),
                                    spark.createDataFrame([(k,) for k in listed * 2], "key string"))
    levels = url_filters.build_cascade(keys)
    assert len(levels) > 1
    df = spark.createDataFrame([(k,) for k in universe], "key string").withColumn("in", url_filters.in_cascade(F.col("key"), levels))
    assert {r.key for r in df.collect() if r["in"]} == set(listed) - {"absent.example"}
    assert url_filters.build_cascade(keys.where("false")) == [] and url_filters.build_cascade(keys, max_bits=64) is None
    pages = spark.createDataFrame([(1, "http://A.COM/x?y"), (1, "http://A.COM/x?y"), (2, None), (3, "no scheme"), (4, "x://b.net"),
                                   (5, "x://bad.org/p#q"), (None, "ftp://com/en/")], "page_id long, url string").withColumn("host", F.lit(1))
    bad = spark.createDataFrame([("bad.org",)], "key string")
    rules = [("allow", "com", "/"), ("block", "com", "/en/"), ("block", "net", "/")]
    want = collections.Counter([(1, "a.com", "/x", "com/", "allow")] * 2 + [
        (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.net", "", None, "allow"),
        (5, "bad.org", "/p", None, "block"), (None, "com", "/en/", "com/en/", "block")])
    for bits in (url_filters.MAX_BITS, 1):
        assert collections.Counter(map(tuple, url_filters.filter_urls(pages, bad, rules, max_bits=bits).collect())) == want


@pytest.fixture
def no_limit(spark):
    """A session without a limit of its own for the bytes of a batch."""
    was = spark.conf.get(common.BATCH_CONF, None)
    spark.conf.unset(common.BATCH_CONF)
    yield
    spark.conf.unset(common.BATCH_CONF) if was is None else spark.conf.set(common.BATCH_CONF, was)


def _batches(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return common.map_batches(df, run, "n bigint, size bigint").collect()


def test_batches_of_long_texts_are_bounded_by_bytes(spark, no_limit):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))  # 15 MB
    got = _batches(rows)
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) <= 1.1 * common.BATCH_BYTES
    assert len(_batches(spark.range(0, 9000, 1, 1))) == 1  # short rows are not cut into more batches
    long = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("x"), 3 * common.BATCH_BYTES).alias("text"))
    assert [r["n"] for r in _batches(long)] == [1, 1, 1]
    spark.conf.set(common.BATCH_CONF, "5m")
    assert 2 * common.BATCH_BYTES < max(r["size"] for r in _batches(rows)) < 3 * common.BATCH_BYTES


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stages_bound_their_batches(spark, sf, edge, no_limit, stage):
    stage[1](spark, edge, sf)
    assert spark.conf.get(common.BATCH_CONF, None) == str(common.BATCH_BYTES)
