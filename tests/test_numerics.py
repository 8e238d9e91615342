"""Tiles, triangular factors, exact sums, quadrature rules and decoding by states, each against a plain form."""

import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest

from kernelweave.functions import scalar
from kernelweave.operators import linalg
from kernelweave.plans import grids, signals, solvers


def cells(spark, x, names):
    return spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(x) if not np.isnan(v)], ", ".join(f"{a} long" for a in names) + ", v double")


@pytest.mark.parametrize(("edge", "together"), [(3, 1), (4, 3), (5, 5), (64, 4)])
def test_tiles_2d(spark, edge, together):
    """Step for step as the table of cells, with a hole, over tiles that don't fill the grid."""
    x = np.random.default_rng(edge).normal(size=(11, 8))
    x[5, 4] = np.nan
    grid = plain = cells(spark, x, "ij")
    for _ in range(6):
        plain = solvers.sweep_2d(plain, 9, 6).cache()
    want = {(r["i"], r["j"]): r["v"] for r in plain.collect()}
    got = {(r["i"], r["j"]): r["v"] for r in grids.relax(grid, ["i", "j"], (11, 8), 6, edge=edge, together=together).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("form", ["naive", "blocked", "oblivious"])
def test_tiles_3d(spark, form):
    x = np.random.default_rng(1).normal(size=(5, 6, 7))
    grid = plain = cells(spark, x, "ijk")
    for _ in range(3):
        plain = solvers.heat_3d(plain, (5, 6, 7), form, 2.0).cache()
    want = {(r["i"], r["j"], r["k"]): r["v"] for r in plain.collect()}
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in grids.relax(grid, ["i", "j", "k"], (5, 6, 7), 3, form, 2.0, edge=3, together=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_tiled_jacobi(spark):
    """Ends at the same sweep as the table of cells, also in the middle of sweeps that go together."""
    x = np.zeros((8, 8))
    x[0], x[-1], x[:, 0], x[:, -1] = 1, 10, 1, 1
    grid = cells(spark, x, "ij")
    want, steps = solvers.jacobi_2d(grid, 6, 6, eps=0.1)
    got, own = grids.jacobi(grid, (8, 8), eps=0.1, edge=4, together=4)
    assert own == steps and steps % 4
    assert {(r["i"], r["j"]): round(r["v"], 10) for r in got.collect()} == {(r["i"], r["j"]): round(r["v"], 10) for r in want.collect()}
    none = spark.createDataFrame([], "i long, j long, v double")
    assert grids.jacobi(none, (8, 8), max_iter=3)[0].count() == 0 and grids.relax(none, ["i", "j"], (8, 8), 2).count() == 0
    with pytest.raises(ValueError):
        grids.sweeps(grids.tile(grid, ["i", "j"], (8, 8), 4), (8, 8), 4, 5)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_triangular_factor(spark, tasks):
    x = np.random.default_rng(2).normal(size=(300, 4)) + 7
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "id long, coords array<double>").repartition(tasks)
    r = signals.factor(points)
    a = np.hstack((np.ones((300, 1)), x))
    assert r.shape == (5, 5) and np.allclose(r.T @ r, a.T @ a) and np.allclose(np.tril(r, -1), 0)
    value, loadings, mean = signals.components_qr(points, 3)
    plain, own = signals.components(points, 3)
    assert np.allclose(value, plain) and np.allclose(np.abs(loadings), np.abs(own)) and np.allclose(mean, x.mean(0))
    got = np.array([v["coords"] for v in signals.pca_qr(points.filter("coords IS NOT NULL"), 3).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ loadings)


def test_factor_keeps_small_values(spark):
    """Columns of a condition of 1e9: the smallest variance keeps its digits, which a scatter matrix can't hold."""
    r = np.random.default_rng(3)
    u, _ = np.linalg.qr(r.normal(size=(200, 3)) - 0)
    u -= u.mean(0)
    u, _ = np.linalg.qr(u)
    v, _ = np.linalg.qr(r.normal(size=(3, 3)))
    x = u * [1.0, 1e-4, 1e-9] @ v.T
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, coords array<double>").repartition(3)
    by_factor, by_scatter = signals.components_qr(points, 3)[0][0], signals.components(points, 3)[0][0]
    assert abs(by_factor / 1e-18 - 1) < 1e-5 and abs(by_scatter / 1e-18 - 1) > 0.1
    one = spark.createDataFrame([(1, [2.0, 3.0])], "id long, coords array<double>")
    assert np.allclose(signals.components_qr(one, 2)[0], 0) and np.allclose(signals.components_qr(one, 2)[2], [2, 3])
    assert len(signals.components_qr(one.limit(0), 2)[0]) == 0


@pytest.mark.parametrize("tasks", [1, 4])
def test_exact_sum(spark, tasks):
    r = random.Random(tasks)
    rows = [("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", 0.1), ("b", None), ("c", None), ("d", float("inf")), ("d", 1.0), ("e", 5e-324), ("e", -3e-310), ("f", 1.7e308), ("f", 1.7e308), ("f", -1.7e308), ("g", float("inf")), ("g", float("-inf"))]
    rows += [("h", r.choice([-1, 1]) * 2.0 ** r.uniform(-1070, 1000)) for _ in range(400)] + [("i", 2.0**k) for k in range(-96, 97)] + [("i", -math.nextafter(2.0**k, 0)) for k in range(-96, 97, 32)]
    r.shuffle(rows)
    got = {x["g"]: x["v"] for x in linalg.exact_sum(spark.createDataFrame(rows, "g string, v double").repartition(tasks), "v", ("g",)).collect()}
    for g in "abcefhi":
        assert got[g] == float(sum((Fraction(v) for k, v in rows if k == g and v is not None), Fraction(0))), g
    assert got["a"] == 1.0 and got["d"] == float("inf") and math.isnan(got["g"])
    none = spark.createDataFrame([], "v double")
    assert [tuple(x) for x in linalg.exact_sum(none).collect()] == [(0.0,)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 64, 1000])
def test_legendre_nodes(n):
    x, w = map(np.array, zip(*signals.nodes(n)))
    want, weight = np.polynomial.legendre.leggauss(n)
    assert np.abs(x - want).max() < 1e-15 and np.abs(w - weight).max() < (1e-14 if n <= 64 else 1e-13) and (np.diff(x) > 0).all()
    assert abs(w.sum() - 2) < 1e-13 and abs((w * x ** (2 * n - 2)).sum() * (2 * n - 1) / 2 - 1) < 1e-12


def test_legendre_rules_in_columns(spark):
    orders = spark.createDataFrame([(1,), (2,), (5,), (30,), (5,), (0,), (None,)], "n int")
    got = signals.legendre_rules(orders).orderBy("n", "k").collect()
    for n in (1, 2, 5, 30):
        x, w = np.polynomial.legendre.leggauss(n)
        assert np.abs(np.array([r["x"] for r in got if r["n"] == n]) - x).max() < 1e-14 and np.abs(np.array([r["w"] for r in got if r["n"] == n]) - w).max() < 1e-13
    assert len(got) == 38


def plain_decode(data, codes, limit):
    bits = "".join(format(x, "08b")[::-1] for x in data)
    at, own, longest = 0, [], max(map(len, codes))
    while len(own) < limit and at < len(bits):
        size = next((k for k in range(1, longest + 1) if bits[at : at + k] in codes), None)
        if size is None or at + size > len(bits):
            break
        own.append(codes[bits[at : at + size]])
        at += size
    return own


CODES = [{"0": 5, "10": 6, "110": -7, "111": 8}, {"00": 1, "01": 2, "1": 3}, {"0": 1, "01": 2, "10": 3}, {"0" * k + "1": k for k in range(20)}, {"0": 4}, {"1011": 9, "0": 2}]


@pytest.mark.parametrize("codes", CODES)
def test_decoding_by_states(spark, codes):
    r = random.Random(len(codes))
    rows = [(i, bytes(r.randrange(256) for _ in range(r.randrange(40))), r.choice([0, 1, 5, 10_000])) for i in range(60)] + [(60, None, 4), (61, b"\x00\xff", None), (62, b"\xaa" * 3000, 100_000)]
    got = {x["id"]: x["values"] for x in scalar.huffman_decode(spark.createDataFrame(rows, "id long, bits binary, n int"), codes).collect()}
    assert got == {i: plain_decode(d or b"", codes, k or 0) for i, d, k in rows}


def test_decoding_is_fast():
    """Ten times as fast as bit by bit."""
    r = random.Random(4)
    rows = [bytes(r.randrange(256) for _ in range(2000)) for _ in range(200)]
    machine = scalar.HuffmanTable(CODES[0])
    began = time.perf_counter()
    got = [machine.decode(x, 10**6) for x in rows]
    fast = time.perf_counter() - began
    began = time.perf_counter()
    want = [plain_decode(x, CODES[0], 10**6) for x in rows]
    assert got == want and time.perf_counter() - began > 10 * fast


def test_stacked_lstm(spark):
    """State goes on from window to window of a row: a scalar recurrence over each row's whole stream."""
    from kernelweave.plans import networks

    r = np.random.default_rng(8)
    words, size, layers = 7, 3, []
    embedding, softmax, bias = r.normal(size=(words, size)), r.normal(size=(size, words)), r.normal(size=words)
    for _ in range(2):
        layers.append((r.normal(size=(2 * size, 4 * size)), r.normal(size=4 * size)))
    stream = [int(v) for v in r.integers(0, words, 103)]
    rows = spark.createDataFrame(list(enumerate(stream)), "pos long, word_id long").repartition(3)
    windows = networks.batches(rows, 4, 5)
    got = {(v["row"], v["batch"] * 5 + v["step"]): v["loss"] for v in networks.lstm_losses(windows, embedding, layers, softmax, bias, 0.5).collect()}
    sig, want = lambda x: 1 / (1 + math.exp(-x)), {}
    for row in range(4):
        h, c = ([[0.0] * size for _ in layers] for _ in range(2))
        own = stream[row * 25 : row * 25 + 25]
        for t, (x, y) in enumerate(zip(own[:20], own[1:])):
            v = list(embedding[x])
            for k, (kernel, b) in enumerate(layers):
                z = [b[j] + sum(a * kernel[i][j] for i, a in enumerate(v + h[k])) for j in range(4 * size)]
                c[k] = [c[k][n] * sig(z[2 * size + n] + 0.5) + sig(z[n]) * math.tanh(z[size + n]) for n in range(size)]
                h[k] = v = [math.tanh(c[k][n]) * sig(z[3 * size + n]) for n in range(size)]
            z = [bias[j] + sum(a * softmax[i][j] for i, a in enumerate(v)) for j in range(words)]
            want[row, t] = math.log(sum(map(math.exp, z))) - z[y]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    odd = spark.createDataFrame([(0, 0, 0, None, 1), (0, 0, 1, 99, None), (0, 0, 2, 1, 99)], "batch long, row long, step long, x long, y long")
    out = sorted((v["step"], v["loss"] is None) for v in networks.lstm_losses(odd, embedding, layers, softmax, bias).collect())
    assert out == [(0, False), (1, True), (2, True)]
