"""Operators 11 to 13 against brute force: edge texts, repeated rows, clashing columns, empty tables, forced collisions."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kernelweave.llm import op11_infill, op12_phrases, op13_lines

LONG = "the quick brown fox, été naïve\n" * 3000
EDGE = [None, "", "\n", " \t\n\n", "a", "é" * 100_000, "x" * 50_000, LONG, LONG + "tail", "<P", "<P><", "a<S>b", "x<M", "<S", "a\x0b\x0cb\rc", "ab \x00 cd ef", "𝒳" * 700 + "<P>" + "é" * 9]
LINES = ["A shared line of more than twenty characters", "  a SHARED line of more than twenty characters\t", "short line", "É" * 19 + "a", "é" * 20, "another common line with many words in it", "  twenty code points with a hard space"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["new", "york", "of", "the", "New", "york", "city", "naïve", "a" * 300]
    seps = [" ", " ", " ", "  ", "\t", ". ", "; ", "\n", "\r", "! "]
    out = [(i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(EDGE)]
    out += [(100 + i, "".join(r.choice(words) + r.choice(seps) for _ in range(r.randrange(80))), r.choice(["en", "fr", None, "und"])) for i in range(80)]
    out += [(300 + i, "\n".join(r.choice(LINES) for _ in range(r.randrange(1, 9))), "en") for i in range(40)]
    return out + out[100:110] + [(300, "another text of a known id\n" + LINES[0], "en"), (None, LINES[0] + "\n" + LINES[5], "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit("own"), "k": F.lit(1), "_t": F.lit(2), "places": F.lit(3)}).repartition(5)


# --- fill in the middle --------------------------------------------------------------------------------------------


def brute_infill(key, text):
    t, code = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(code[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(m in t for m in op11_infill.MARKS) or h[2] % 100 >= 90:
        return "plain", n, None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return ("spm", n, a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", n, a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill(docs, rows):
    got = op11_infill.restore(op11_infill.infill(docs)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(repr((k, t, *brute_infill(k, t))) for k, t, _ in rows)
    assert all(r["restored"] == (r["text"] or "") and r["_t"] == 2 for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_parameters(docs):
    assert {r["form"] for r in op11_infill.infill(docs, plain=0).collect()} == {"plain"}
    assert {r["form"] for r in op11_infill.infill(docs.filter("text = 'a'"), plain=100, spm=100).collect()} == {"spm"}
    assert op11_infill.infill(docs.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["<", "P", "S", "M", ">", "é", "a", "𝒳"]), max_size=40), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_infill_with_tiny_chunks(parts, key):
    """Chunks of one byte and more: boundaries inside characters and markers."""
    t = "".join(parts)
    raw = t.encode()
    edge = np.array(sorted({i for i in range(1, len(raw)) if (i * 7919 + key) % 3} | {len(raw)} - {0}), int)
    form, n, a, b, out = op11_infill.transform(raw, edge, str(key), op11_infill.Memo(500), 1, 90, 20)
    assert (form, n, a, b, out.decode()) == brute_infill(key, t)


def test_chunks_are_shared():
    """A passage gives the same chunks behind any beginning, so most of its summaries are found."""
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ,.é") for _ in range(40_000)).encode()
    memo = op11_infill.Memo()
    for head in (b"", b"one", b"another beginning"):
        t = head + text
        e = op11_infill.ends(np.frombuffer(t, np.uint8))
        assert e[-1] == len(t) and (np.diff(e, prepend=0) <= op11_infill.LONGEST).all() and len(e) > 40
        op11_infill.transform(t, e, "1", memo, 1, 90, 20)
    assert memo.made < 1.1 * len(e)


# --- phrases -------------------------------------------------------------------------------------------------------

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows):
    f = defaultdict(Counter)
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f


def brute_phrases(rows, least, top=2000):
    out = []
    for lang, f in brute_counts(rows).items():
        cand, own = {p: c for p, c in f.items() if len(p) > 1 and c >= least}, []
        for p, a in cand.items():
            if any(100 * c >= 50 * a for q, c in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            own.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 10])
def test_phrases(docs, rows, least):
    got = op12_phrases.collocations(docs, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least)


def test_phrases_top_and_empty(docs, rows):
    assert sorted(map(tuple, op12_phrases.collocations(docs, 2, top=3).collect())) == brute_phrases(rows, 2, 3)
    assert op12_phrases.collocations(docs.limit(0)).count() == 0
    assert op12_phrases.collocations(docs.filter("text IS NULL OR trim(text) = ''")).count() == 0


def test_phrases_under_colliding_fingerprints(spark):
    """With few bits left, phrases of two texts share fingerprints and are counted by their words."""
    rows = [(1, "one two one two three four", "en"), (2, "five six five six seven one", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = 0
    for mask in (0, 1, 7, 63):
        got = {(r["n"], r["phrase"]): r["a"] for r in op12_phrases.frequent_phrases(docs, 2, mask).collect() if r["n"]}
        want = {(len(p), " ".join(p)): c for p, c in brute_counts(rows)["en"].items() if c >= 2}
        assert got == want
        found += len(got)
    assert found


def test_bits_come_as_pages(spark):
    """The driver gets the bytes of the table, not a row for each word of it."""
    frequent = spark.range(200_000).select(F.xxhash64("id").alias("k")).cache()
    k = frequent.toPandas().k.to_numpy()
    tracemalloc.start()
    try:
        bits, size = op12_phrases._bits(frequent)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size == 1 << 22 and len(bits) == size >> 3 and peak < 8 * len(bits)
    want = np.zeros(size, bool)
    want[k & (size - 1)] = True
    assert (np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little") == want).all()
    assert op12_phrases._bits(frequent.limit(0)) == (bytes(128), 1024)
    frequent.unpersist()


def test_fingerprints_by_their_definition():
    """Prefix differences give the polynomial of the run itself, wherever it stands."""
    r = op12_phrases.Runs([b"Ab cd  ef.", b"ab\tcd gh"])
    assert [r.words(i, 1) for i in range(len(r.at))] == ["ab", "cd", "ef", "ab", "cd", "gh"] and r.text.tolist() == [0, 0, 0, 1, 1, 1]
    assert r.inside(2).tolist() == [0, 1, 3, 4] and r.inside(3).tolist() == [0, 3] and r.words(3, 3) == "ab cd gh"
    k, chk = r.prints(r.inside(2), 2, np.zeros(2, np.uint64))
    assert k[0] == k[2] and chk[0] == chk[2] and len(set(k.tolist())) == 3
    want = sum((c + 1) * pow(op12_phrases._B, -i, op12_phrases._P) for i, c in enumerate(b"ab cd")) % op12_phrases._P
    assert chk[0] == want


# --- lines ---------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_chars=20, least=3):
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for k, t, _ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(k)
    order = lambda k: (k is not None, k)
    out = []
    for k, t, _ in rows:
        x = (t or "").split("\n")
        stay = [y for y in x if len(key(y)) < min_chars or len(held[key(y)]) < least or max(held[key(y)], key=order) == k]
        out.append((k, len(x), len(x) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [op13_lines.HOT, 3])
def test_lines(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(op13_lines, "HOT", hot)  # with 3, some keys are joined as hot ones
    got = op13_lines.dedup_lines(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "")) for r in got) == brute_lines(rows)
    assert all(r["places"] == 3 and r["_t"] == 2 for r in got) and sum(r["n_dropped"] for r in got) > 50
    assert {r["text"] for r in got if r["doc_id"] == 0} == {None}


def test_lines_parameters(docs, rows):
    got = op13_lines.dedup_lines(docs, min_chars=5, min_documents=2).collect()
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "")) for r in got) == brute_lines(rows, 5, 2)
    assert op13_lines.dedup_lines(docs.limit(0)).count() == 0
