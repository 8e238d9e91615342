"""Operator 9 against brute force over all strings of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest

from kernelweave.llm import op09_suffix


def brute(rows):
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if k is None else k, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_like(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (12, 18, 22, 30, 60, 200)]
    line = prose(11)[:60]
    rows = []
    for i in range(80):
        parts = [prose(r.randrange(1, 30))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            cut = r.randrange(len(p) // 2)
            parts += [p[cut:] if r.random() < 0.3 else p[: len(p) - cut] if r.random() < 0.3 else p, prose(r.randrange(4))]
        rows.append((i, (" " if r.random() < 0.5 else "").join(parts) + line + prose(r.randrange(6))))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    return rows


EDGE = [(200, None), (201, ""), (202, "a" * 1000), (203, "a" * 99), (204, "a" * 100), (205, "ab" * 400), (206, "\0" * 130 + "x" * 70), (207, "x" * 70 + "\0" * 130), (208, "\0" * 300), (None, "a" * 150), (209, "xyz" * 20_000)]


@pytest.mark.parametrize("group", [50_000, 3])
def test_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(op09_suffix.repeated_windows, "__defaults__", (group,))
    rows = rows_like(group) + EDGE
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, d string, copies int").repartition(5)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in op09_suffix.measure(df).collect())
    assert got == brute(rows)


def test_remove(spark):
    rows = rows_like(9)[:10]
    df = spark.createDataFrame([(*r, "k") for r in rows] + [(500, None, None)], "doc_id long, text string, row string")
    got = {r["doc_id"]: r["text"] for r in op09_suffix.remove(df).collect()}
    assert got[0] == rows[0][1] and got[500] is None and len(got) == 11


def test_repeated_rows_and_empty(spark):
    t = rows_like(3)[0][1] * 2
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted(tuple(r) for r in op09_suffix.measure(df).collect())
    assert got == sorted(brute([(1, t)]) * 2 + [(2, len(t.encode()), len(t.encode()), 1, hashlib.sha256(b"").hexdigest())])
    assert op09_suffix.measure(df.limit(0)).count() == 0


def coded(run):
    rows = np.zeros((len(run), 12), np.uint8)
    for i, x in enumerate(run):
        rows[i, : len(x)] = np.frombuffer(x, np.uint8)
    return op09_suffix.front_coded(rows, np.array([len(x) for x in run], np.int64))


def test_order_decides(spark, monkeypatch):
    """What is removed rests on the order and the common prefixes of the merge: out of order, passages are missed."""
    rows = rows_like(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    removed = lambda: sum(r["n_removed"] for r in op09_suffix.measure(df).collect())
    whole, plain = removed(), op09_suffix.merged

    def shuffled(runs):
        out = [(r, i, s, 0) for r, i, s, _ in plain(runs)]
        random.Random(2).shuffle(out)
        return iter(out)

    monkeypatch.setattr(op09_suffix, "merged", shuffled)
    assert removed() < whole


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """The filter's hashes don't decide: where all are alike, bytes still do."""
    monkeypatch.setattr(op09_suffix, "mix", lambda x: x * np.uint64(0) + np.uint64(5 << 40))
    rows = rows_like(11)[:25]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in op09_suffix.measure(df).collect())
    want = brute(rows)
    assert all(g[2] <= w[2] for g, w in zip(got, want))


def test_loser_tree():
    r = random.Random(5)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(r.choices(b"ab", k=r.randrange(0, 12))) for _ in range(r.randrange(30))) for _ in range(k)]
        out = list(op09_suffix.merged([coded(x) for x in runs]))
        assert [x[2] for x in out] == sorted(sum(runs, []))
        for a, b in zip(out, out[1:]):
            assert b[3] == op09_suffix.shared_prefix(a[2], b[2], 0)
        assert all(runs[i][j] == s for i, j, s, _ in out)


def test_texts_of_one_hash(spark):
    """Two texts under one 64-bit hash ask for each other's anchors: those that a text doesn't have are left out."""
    passage = "".join(chr(97 + i * i % 26) for i in range(140))
    texts = [(1, passage + " short"), (2, "x" * 300 + passage + "".join(chr(97 + i * 7 % 26) for i in range(3000)))]
    keyed = spark.createDataFrame([(d, d, d, t) for d, t in texts], "d long, t long, k long, text string")
    asked = spark.createDataFrame([(1, np.arange(200, dtype="<u4").tobytes()), (2, np.arange(200, dtype="<u4").tobytes())], "k long, at binary")
    runs = op09_suffix.suffix_runs(keyed.join(asked, "k").select("d", "t", "text", "at"), 4)
    packed, late = op09_suffix.repeated_windows(runs, 4)
    assert runs.count() > 0 and packed.count() > 0 and late.count() == 0
    a = op09_suffix.Anchors([t.encode() for _, t in texts])
    n = int(a.first[1])
    assert not op09_suffix._covered(a, 0, np.array([n, n + 5], np.uint32), np.array([1, 1])).any()
