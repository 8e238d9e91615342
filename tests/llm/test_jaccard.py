"""Operator 2 against brute force over all pairs."""

import random
import re

import pytest

from kernelweave.llm import op02_jaccard
from kernelweave.llm.components import components


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                up[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return sorted((-1 if k is None else k, len(sets[i]), low.get(top(i), -1)) for i, (k, _) in enumerate(rows))


def found(spark, rows, schema="doc_id long, text string", extra=()):
    got = op02_jaccard.link(spark.createDataFrame([(*r, *extra) for r in rows], schema)).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(words, k=12))
    rows = []
    for g in range(25):
        base = r.choices(words, k=r.choice([4, 5, 9, 40, 120]))
        for _ in range(r.choice([1, 2, 30])):
            own = list(base)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = r.choice(words)
            own = own[: len(own) - r.choice([0, 0, 0, len(own) // 8])]
            rows.append(" ".join(own) + (" " + passage if g % 3 == 0 else ""))
    rows += rows[:40] + [x.upper() for x in rows[:5]]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \n "), (9, "One"), (8, "one"), (7, "one two"), (7, "one two"), (6, "a b c d e"), (2, "a b c d e f"), (None, "A B C D E"), (11, "x y " * 20_000), (10, "x y " * 19_999), (12, "é É é É é"), (12, "other words under the same id")]
    assert found(spark, rows, "doc_id long, text string, n long, cid string, part string, component_id string", (1, "a", "b", "c")) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
