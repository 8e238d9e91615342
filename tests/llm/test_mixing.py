"""Operator 7: base score and model against brute force, and the model's own laws (proper codes, sums, alone per text)."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kernelweave.llm import op07_mixing

SF = "/root/testdata/sf0.001"
EXTRA = [(9000, None), (9001, ""), (9002, " \n"), (9003, "A a a <end> é"), (9003, "A a a <end> é"), (9004, "never_seen_word"), (9006, "never_seen_word x" * 3), (None, "null id"), (9007, "long " * 40_000)]


_scores: dict = {}


def brute(rows):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(x for k, t in rows if not held(k) for x in token(t))
    n, v = sum(c.values()), len(c)
    return sorted((-1 if k is None else k, held(k), len(token(t)), sum(c[x] > 0 for x in token(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in token(t)), 4)) for k, t in rows)


@pytest.mark.parametrize("words", [1 << 19, 50, 0])
def test_base(spark, words, monkeypatch):
    """Also that the line between broadcast and joined words changes nothing."""
    monkeypatch.setattr(op07_mixing, "HELD", words)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EXTRA
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, hash string, rows int, t string").repartition(3)
    got = op07_mixing.score(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == brute(rows)
    assert all(r["score"] < 0 for r in got)
    scores = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    assert _scores.setdefault("first", scores) == scores
    held = [r for r in got if r["held_out"] and r["n_bytes"] > 500]
    bits = [-r["score"] * math.log2(10) / r["n_bytes"] for r in held]
    assert len(held) > 10 and 0.5 < sum(bits) / len(bits) < 4.5


def test_alone(spark):
    """A text's score doesn't depend on partitions or on the texts around it."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in op07_mixing.score(df.repartition(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in op07_mixing.score(df.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 * abs(one[k]) for k in one)


def test_codes_are_proper():
    for counts in ([5, 1, 1, 9], [1], [1] * 300, [1, 2, 4, 8, 16, 32, 1 << 40]):
        code, length = op07_mixing.huffman(np.array(counts))
        assert len(counts) == 1 or sum(2.0 ** -int(x) for x in length) == 1
        names = [format(int(c), f"0{int(n)}b") if n else "" for c, n in zip(code, length)]
        assert len(set(names)) == len(names) and not any(a != b and b.startswith(a) for a in names for b in names if a)


def test_probabilities_sum_to_one():
    """Over all texts that a code of three bits can tell, whatever the predictors say."""
    rng = np.random.default_rng(1)
    stretch = rng.integers(-90, 90, size=(3, 8))
    rows = [[*(stretch[k, (1 << i) | leaf >> 3 - i] for k in range(3)), i << 1 | leaf >> 2 - i & 1] for i in range(3) for leaf in range(8)]
    got = op07_mixing._mixed(np.array(rows, np.int8), np.array([0, 8, 16, 24]), np.arange(8))
    assert abs(np.exp(got).sum() - 1) < 1e-5


def events(text, codes):
    """Contexts by predictor, node, gate and value of each bit of a text, one after another."""
    tokens, before = [w.encode() + b" " for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())] + [b"\n"], None
    for word in tokens:
        for i, byte in enumerate(word):
            so_far = word[:i]
            contexts = (so_far[-3:], so_far, (so_far, before) if i < op07_mixing.EARLY else None)
            code = codes[word[i - 1] if i else 0x20][byte]
            for d, bit in enumerate(code):
                yield contexts, code[:d], min(d, 7) + (8 if i == 0 else 0), int(bit)
        before = word


def scalar_scores(training, texts):
    """The model bit by bit with dictionaries and numbers alone."""
    pairs = np.zeros((256, 256), np.int64)
    for t in training:
        for w in [w.encode() + b" " for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())] + [b"\n"]:
            for i, byte in enumerate(w):
                pairs[w[i - 1] if i else 0x20, byte] += 1
    codes = [[format(int(c), f"0{int(n)}b") for c, n in zip(*op07_mixing.huffman(np.maximum(x, max(1, int(x.sum()) >> 16))))] for x in pairs]
    seen = Counter((k, c, node, bit) for t in training for contexts, node, _, bit in events(t, codes) for k, c in enumerate(contexts) if c is not None)
    out = []
    for t in texts:
        total = 0.0
        for n, (contexts, node, gate, bit) in enumerate(events(t, codes)):
            if n % op07_mixing.SEGMENT == 0:
                weights = [[x / 15 for x in op07_mixing.START] for _ in range(16)]
                refined = [1 / (1 + math.exp(8 - 16 * i / 23)) for i in range(24)]
            x = [0 if c is None else round(max(-8, min(8, math.log((seen[k, c, node, 1] + 0.4) / (seen[k, c, node, 0] + 0.4)))) * 15) for k, c in enumerate(contexts)]
            w = weights[gate]
            dot = max(-8, min(8, sum(a * b for a, b in zip(w, x))))
            p, cell = 1 / (1 + math.exp(-dot)), int(dot * 23 / 16 + 12)
            q = (p + refined[cell]) / 2
            total += math.log10(q if bit else 1 - q)
            for k in range(3):
                w[k] += (bit - p) * op07_mixing.RATE / 225 * x[k]
            refined[cell] += (bit - refined[cell]) / 32
        out.append(total)
    return out


@pytest.mark.parametrize("segment", [1 << 13, 100])
def test_against_scalar_mixer(segment, monkeypatch):
    monkeypatch.setattr(op07_mixing, "SEGMENT", segment)
    monkeypatch.setattr(op07_mixing, "SLICE", 1000)
    training = ["the cat sat on the mat", "The cat ate. the cat sat on a hat", "été à la plage", "", "a", "mat mat mat cat " * 9]
    texts = [*training, "the bat sat", "zebra", "the cat sat on the mat " * 12, "x" * 150]
    pairs = np.zeros(op07_mixing.PAIRS, np.int64)
    for t in training:
        for w in [w.encode() + b" " for w in t.lower().split()] + [b"\n"]:
            np.add.at(pairs, [(w[i - 1] if i else 0x20) << 8 | c for i, c in enumerate(w)], 1)
    coder = op07_mixing.Coder(pairs, 22)
    n = np.zeros((3, 2 << 22), np.uint32)
    op07_mixing.count(n, op07_mixing.Coded([t.encode() for t in training], coder), coder)
    stretch = np.stack([op07_mixing.stretched(x.astype(float)) for x in n])
    got = op07_mixing.text_scores(coder, stretch, op07_mixing.Coded([t.encode() for t in texts], coder))
    assert np.allclose(got, scalar_scores(training, texts), rtol=1e-3)


def test_counted_pairs(spark):
    """The byte pairs that Spark counts are those of the tokens."""
    texts = ["Ab  c\n", None, "", "\x00é", "ab"]
    got = {r["hash"]: r["n"] for r in op07_mixing.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).filter(f"hash BETWEEN 0 AND {op07_mixing.PAIRS - 1}").collect()}
    want = Counter((w[i - 1] if i else 0x20) << 8 | c for t in texts for w in [*(x.encode() + b" " for x in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())), b"\n"] for i, c in enumerate(w))
    assert got == want


def test_better_than_base_on_held_out_texts(spark):
    rows = op07_mixing.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert rows["s"] > rows["b"]


def test_empty(spark):
    assert op07_mixing.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(2, "held out"), (6, "also")], "doc_id long, text string").filter(op07_mixing.held_out())
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in op07_mixing.score(only).collect())


def test_mixed_together(monkeypatch):
    """Texts of several pieces are mixed in the same steps, and score as they do alone, also where a batch takes no more."""
    pairs = np.ones(op07_mixing.PAIRS, np.int64)
    coder = op07_mixing.Coder(pairs, 16)
    stretch = np.random.default_rng(2).integers(-90, 90, size=(3, 1 << 16)).astype(np.int8)
    pieces = [[b"the cat sat", b"", b"x" * 700], [b"mat " * 300, b"a"], [b"the hat"]]
    alone = [op07_mixing.text_scores(coder, stretch, op07_mixing.Coded([t], coder))[0] for p in pieces for t in p]
    mixed, calls = op07_mixing._mixed, []
    monkeypatch.setattr(op07_mixing, "_mixed", lambda *a: calls.append(len(a[2])) or mixed(*a))
    for batch, most in ((1 << 20, 1), (op07_mixing.SEGMENT, 99)):
        monkeypatch.setattr(op07_mixing, "BATCH", batch)
        calls.clear()
        got = op07_mixing.text_scores(coder, stretch, (op07_mixing.Coded(p, coder) for p in pieces))
        assert np.allclose(got, alone, rtol=1e-5) and (len(calls) == 1 if most == 1 else 1 < len(calls) < most)
