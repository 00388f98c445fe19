"""Filter audit, secret scan and hard negatives against brute force, with edge cases."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwise.llm import filter_audit, hard_negatives, secret_scan

LETTERS = "ABCDE"


def fails(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)), not first)


def audit_by_hand(docs, labels):
    """All steps of all orders, filtering the documents themselves."""
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    rows = [(part or "", fails(text or "", i is None or i == smallest[text or ""]),
             any(q == 1 for d, q, _ in labels if d == i is not None), any(t == 1 for d, _, t in labels if d == i is not None)) for i, text, part in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            name, left, gone = "".join(LETTERS[i] for i in order), mine, []
            for step, i in enumerate(order, 1):
                removed = [r for r in left if r[1][i]]
                left = [r for r in left if not r[1][i]]
                shapley[i] += len(removed)
                out[part, name, step] = [len(left), len(removed), sum(r[1][i] for r in gone), sum(r[1][i] and sum(r[1]) == 1 for r in mine),
                                         sum(r[2] for r in removed), sum(r[3] for r in removed)]
                gone = gone + removed
        for (p, name, step), v in out.items():
            if p == part:
                v.append(shapley[LETTERS.index(name[step - 1])])
    return out


def run_audit(docs, labels):
    filters = filter_audit.standard_filters(F.col("text"))
    rows = filter_audit.audit(filter_audit.failure_masks(docs, labels, filters), list(filters)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit_equals_filtering_by_hand(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words[:rng.choice([20, 400])], k=rng.choice([20, 150]))) + rng.choice(["", " #", " A" * 60]) for _ in range(30)]
    docs = [(i, rng.choice(base), rng.choice(["en", "de", None])) for i in range(200)]
    docs += [(None, base[0], "en"), (None, base[0], "en"), (3, docs[3][1], "en"), (3, base[1], "de"), (900, None, "en"), (901, "", ""),
             (902, "\x0b \x1c x y ", "fr"), (903, "wörter " * 20000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 3)] + [(0, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns(
        {"mask": F.lit("x"), "digest": F.lit(1), "good": F.lit(2), "part": F.lit(3), "first": F.lit(4)})
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = run_audit(df, lab)
    assert got == audit_by_hand(docs, labels)
    assert len(got) == 600 * 4
    assert run_audit(df.where("false"), lab) == {}
    assert all(v[4] == 0 and v[5] == 0 for v in run_audit(df, lab.where("false")).values())


def test_gray_walk_survivors():
    counts = np.random.default_rng(0).integers(0, 50, (16, 3))
    alive = filter_audit.survivors_by_subset(counts)
    for s in range(16):
        assert (alive[s] == sum((counts[m] for m in range(16) if not m & s), np.zeros(3, np.int64))).all()


def spans_by_hand(text):
    out = []
    assign = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
    for rank, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
                                                          ("hex", re.compile("[0-9a-f]+"), 0, 32)]):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    base = sorted(out)
    for m in re.finditer(secret_scan.CANDIDATES, text):
        run = m[3]
        if not run or re.search(secret_scan.ALLOW, run):
            continue
        for rank, cls in enumerate(secret_scan.CLASSES, 3):
            if not re.fullmatch(f"{cls.alphabet}{{{cls.window},}}", run):
                continue
            covered = set()
            for w in range(len(run) - cls.window + 1):
                part = run[w:w + cls.window]
                entropy = -sum(c / cls.window * math.log2(c / cls.window) for c in collections.Counter(part).values())
                if entropy >= cls.bits:
                    covered |= set(range(m.start() + w, m.start() + w + cls.window))
            edge = sorted(covered)
            starts = [p for p in edge if p - 1 not in covered]
            ends = [p + 1 for p in edge if p + 1 not in covered]
            out += [(a, rank, b, cls.name) for a, b in zip(starts, ends)]
            break
    return base, sorted(out)


def secret_texts():
    rng = random.Random(3)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(rng.choices(a, k=n))
    hexa = lambda n: key(n, "0123456789abcdef")
    texts = [None, "", " ", "password: short token=longenough1", "secret=api_key: abcdefghij", 'API_KEY = "' + key(30) + '"',
             "Passwd:" + " " * 50 + "'aaaaaaaa.b", "AKIA" + key(12, "ABCDEFGHIJKLMNOP"), "AKIAAKIA" + "X" * 7, "xAKIA" + "Q" * 30,
             hexa(31) + " " + hexa(32) + "g" + hexa(40), "é😀" + key(64) + "😀 " + key(19), "a" * 500, "k" * 20 + key(40) + "z" * 60 + key(40),
             "ABCDEF0123456789" + key(30), "example" + key(40), "Hexa " + key(48, "0123456789ABCDEF"), key(20_000), hexa(10_000),
             "9" * 40, "a-b-c-" * 20, "toſen: " + key(20), "password" * 100 + ":" + key(9), "mytoken=" + key(60)]
    texts += [" ".join(key(rng.randint(1, 40)) if rng.random() < 0.3 else hexa(rng.randint(20, 44)) for _ in range(30)) for _ in range(20)]
    return texts


def test_secret_spans_equal_brute_force(spark):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, "")], "doc_id bigint, text string").withColumns(
        {"spans": F.lit("x"), "start": F.lit(1), "kind": F.lit(2), "value": F.lit(3), "out": F.lit(4)})
    rows = secret_scan.scan(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base, every = spans_by_hand(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base_spans] == base, texts[r.doc_id]
        assert [tuple(s) for s in r.spans] == every, texts[r.doc_id]
        assert r.value == 3 and r.kind == 2
    assert sum(s[3].startswith("entropy") for r in rows for s in r.spans) > 10
    assert secret_scan.scan(df.where("false")).collect() == []


def test_many_matches_in_one_text(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=rng.randint(28, 40))) for _ in range(3000))
    row = secret_scan.scan(spark.createDataFrame([(text,)], "text string")).first()
    base, every = spans_by_hand(text)
    assert [tuple(s) for s in row.base_spans] == base and [tuple(s) for s in row.spans] == every


def negatives_by_hand(rows):
    """``rows``: id -> (label, integer vector)."""
    out = set()
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items() if i != a}
        by = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in by([i for i in score if rows[i][0] == label])[:5]:
            fits = [i for i in score if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(by(fits)[:3], 1)}
    return out


@pytest.mark.parametrize("dim,blocks", [(64, None), (7, (40, 2)), (100, (64, 1))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim, blocks):
    rng = np.random.default_rng(dim)
    if blocks:
        monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    centres = rng.standard_normal((4, dim))
    data = [(i, int(rng.integers(4)), None) for i in range(400)]
    data = [(i, k, (centres[rng.integers(4)] + rng.standard_normal(dim)).astype(np.float32).tolist()) for i, k, _ in data]
    data += [(i, i % 3, data[0][2]) for i in range(400, 460)]  # one very common vector
    bad = [(1000, None, data[0][2]), (1001, 1, None), (1002, 1, [float("nan")] * dim), (1050, 1, [float("inf")] * dim),
           (None, 1, data[0][2]), (1003, 2, [None] * dim), (1004, 2, [1e30] * dim)]
    short = [(1100, 1, [0.5] * (dim - 2)), (1101, 1, [])]
    again = [(50, data[50][1], data[50][2]), (3, 9, data[4][2])]
    df = spark.createDataFrame(data + bad + short + again, "vec_id bigint, label int, embedding array<float>").withColumns(
        {"v": F.lit(1), "anchor": F.lit("x"), "code": F.lit(2), "rest": F.lit(3)})
    rows = {i: (k, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v))) for i, k, v in data + short}
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == negatives_by_hand(rows)
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_intervals_are_certain_and_narrow_the_search(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (500, 64))
    v[:50] = v[0] + rng.integers(-20, 20, (50, 64))
    v[-1] = 0
    turn = hard_negatives.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, along, rest = hard_negatives.encode(v.astype(float), turn)
    import pyarrow as pa
    t = pa.table({"vec_id": np.arange(500), "label": np.zeros(500, np.int64), "v": pa.array(v.tolist(), pa.list_(pa.int32())),
                  "code": pa.array(code.view(np.int64).tolist(), pa.list_(pa.int64())), "along": along, "rest": rest})
    block = hard_negatives.Block(t, 64)
    for q in (v[0], v[7], v[499], v[300]):
        middle, width = hard_negatives.intervals(block, np.arange(500), q, q.astype(float) @ turn)
        assert (np.abs(v @ q - middle) <= width).all()
    middle, width = hard_negatives.intervals(block, np.arange(500), v[0], v[0].astype(float) @ turn)
    sure = (v @ v[0])[hard_negatives.largest(middle, 64)]
    assert (middle + width >= hard_negatives.kth_largest(sure, 5)).sum() < 100
