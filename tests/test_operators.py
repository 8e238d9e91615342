"""Operators against numpy, closed forms and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import precision, scalar
from kernelweave.operators import linalg, stats
from kernelweave.plans import networks, pagerank, points, results, signals, solvers, svm
from kernelweave.session import scratch
from kernelweave.sources import readers, writers
from kernelweave.streaming import windows


def put(spark, name, text, binary=False):
    path = scratch(spark, name).replace("file:", "")
    with open(path, "wb" if binary else "w") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("damping", [0.85, 0.5])
@pytest.mark.parametrize("norm", ["l1", "l2"])
def test_pagerank(spark, damping, norm):
    m = np.array([[0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0.125, 0.5, 0, 0]])
    s = m.sum(1, keepdims=True)
    a = np.where(s == 0, 0.25, m / np.where(s == 0, 1, s)).T
    p = np.full(4, 0.25)
    for _ in range(300):
        p = damping * a @ p + (1 - damping) / 4
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(4) if m[i, j]], "src long, dst long, w double")
    got = {r["i"]: r["v"] for r in pagerank.pagerank(edges, damping, eps=1e-4, max_iter=30, norm=norm).collect()}
    assert np.allclose([got[i] for i in range(4)], p, atol=1e-3)


def test_kmeans_and_neighbours(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.1, (20, 3)) for c in (0, 3, 6)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, coords array<double>")
    centres, own = points.kmeans(p, 3, centres=[(k, x[20 * k].tolist()) for k in range(3)])
    assert np.allclose(sorted(c[0] for _, c in centres), [x[20 * k : 20 * k + 20, 0].mean() for k in range(3)])
    assert {r["id"] // 20 == r["cluster"] for r in own.collect()} == {True}
    got = points.nearest(p, p.filter("id < 7"), 4, block=3).collect()
    for q in range(7):
        d = ((x - x[q]) ** 2).sum(1)
        assert [r["id"] for r in sorted((g for g in got if g["query"] == q), key=lambda g: g["rank"])] == np.lexsort((np.arange(60), d))[:5].tolist()


def test_support_vectors(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.6, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    y = np.repeat([4.0, 2.0, 7.0], 30)
    p = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, coords array<double>, label double")
    codes = {0: 4.0, 1: 2.0, 2: 7.0}
    for kind, more in (("c_svc", {"c": 10.0}), ("nu_svc", {"nu": 0.2})):
        got = svm.predict_class(p, svm.train(p, kind, **more)).collect()
        assert sum(codes[g["class"]] == y[g["id"]] for g in got) >= 86
    model = svm.train(p, "one_class", nu=0.1)
    dec = svm.decide_pairs(p, model).collect()
    assert 70 <= sum(g["dec"] > 0 for g in dec) <= 86
    line = spark.createDataFrame([(i, [float(i) / 10], 2 * i / 10.0) for i in range(30)], "id long, coords array<double>, label double")
    for kind in ("epsilon_svr", "nu_svr"):
        fit = svm.decide_pairs(line, svm.train(line, kind, c=50.0, name="linear"), name="linear")
        assert max(abs(g["dec"] - 0.2 * g["id"]) for g in fit.collect()) < 0.35
    assert min(g["accuracy"] for g in svm.cross_validate(p, 3, c=10.0).collect()) > 0.85


def test_dual_optimum():
    """The solver's point meets the optimality conditions of the C form."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(40, 2)), np.where(r.random(40) > 0.5, 1.0, -1.0)
    k = svm._gram("rbf", x, x, 0.5, 0.0, 3)
    a, rho = svm.solve(k, y, -np.ones(40), np.full(40, 5.0), eps=1e-5)
    margin = y * (k @ (a * y) - rho)
    assert abs(a @ y) < 1e-9
    assert (margin[a < 1e-9] >= 1 - 1e-3).all() and (margin[a > 5 - 1e-9] <= 1 + 1e-3).all()
    assert np.allclose(margin[(a > 1e-9) & (a < 5 - 1e-9)], 1, atol=1e-3)


def test_platt_and_coupling(spark):
    r = np.random.default_rng(4)
    d = r.normal(size=400) * 3
    t = (r.random(400) < 1 / (1 + np.exp(-1.5 * d + 0.5))).astype(int)
    a, b = svm.platt(spark.createDataFrame(list(zip(map(float, d), map(int, t))), "dec double, label int"))
    assert -2.2 < a < -1.0 and -0.2 < b < 1.2
    p = np.array([0.5, 0.3, 0.2])
    pair = [[float(p[i] / (p[i] + p[j])) if i != j else 0.0 for j in range(3)] for i in range(3)]
    got = svm.couple(spark.createDataFrame([(1, pair)], "id long, r array<array<double>>"), 3).first()["p"]
    assert np.allclose(got, p, atol=1e-3)


def test_solvers(spark):
    r = np.random.default_rng(5)
    q = r.normal(size=(12, 12))
    m, b = q @ q.T + 12 * np.eye(12), r.normal(size=12)
    rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    rhs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")
    want = np.linalg.solve(m, b)
    for precondition in (False, True):
        x, seen = solvers.conjugate_gradient(rows, rhs, 1e-6, 12, precondition)
        assert np.allclose([v["v"] for v in x.orderBy("i").collect()], want, atol=1e-6) and seen[-1] <= 1e-6
    x, seen = solvers.refine(rows, rhs, outer=3, tolerance=1e-7, inner=8)
    assert np.allclose([v["v"] for v in x.orderBy("i").collect()], want, atol=1e-5)


def test_stencil_converges(spark):
    cells = [(i, j, 10.0 if i == 4 else 1.0 if i in (0, 4) or j in (0, 4) else 0.0) for i in range(5) for j in range(5)]
    g, steps = solvers.jacobi_2d(spark.createDataFrame(cells, "i long, j long, v double"), 3, 3, eps=1e-2, max_iter=12)
    a = np.zeros((5, 5))
    for i, j, v in cells:
        a[i, j] = v
    for _ in range(steps):
        a[1:-1, 1:-1] = (a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:]) / 4
    assert all(abs(r["v"] - a[r["i"], r["j"]]) < 1e-12 for r in g.collect()) and steps <= 12


def test_signals(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, coords array<double>")
    value, vector = signals.components(p, 2)
    c = x - x.mean(0)
    assert np.allclose(value, np.linalg.eigvalsh(c.T @ c)[-2:])
    assert np.allclose(sorted(v["coords"][1] for v in signals.pca(p, 2).collect()), sorted(c @ vector[:, 1]))
    s = r.normal(size=16)
    series = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(s)], "key string, pos long, v double")
    bands = {v["band"]: v["energy"] for v in signals.band_energy(signals.haar(series, 4)).collect()}
    assert np.isclose(sum(bands.values()), (s * s).sum()) and np.isclose(bands[0], s.sum() ** 2 / 16)
    z = signals.dft(series.select("key", F.col("pos").alias("n"), F.col("v").alias("re"), F.lit(0.0).alias("im")), 16).orderBy("k").collect()
    assert np.allclose([v["re"] + 1j * v["im"] for v in z], np.fft.fft(s) / 16)
    assert abs(signals.composite(spark, 0.0, 2.0, 50, F.exp).first()["v"] - (np.exp(2) - 1)) < 1e-13
    import math

    got = spark.createDataFrame([(float(v),) for v in (-2, -0.3, 0, 1, 2.5)], "x double").select("x", signals.erf(F.col("x")).alias("y")).collect()
    assert all(abs(v["y"] - math.erf(v["x"])) < 1e-12 for v in got)


def test_precision(spark):
    x = np.float32([0.1, 0.001, 1e-6, 0.75])
    assert np.allclose(precision.decode_e6m10(precision.encode_e6m10(x)), x, rtol=2**-10)
    v = np.float32([1 / 100, 1 / 130, 1 / 700, 0.5, 1e-7])
    code, odd = precision.encode_e3m13(v, 100)
    assert odd.tolist() == [False, False, False, True, True]
    assert np.allclose(precision.decode_e3m13(code, 100, v), v, rtol=2**-12)
    row = spark.createDataFrame([(1.5, -2.25)], "a double, b double").select(precision.to_fixed(F.col("a")).alias("a"), precision.to_fixed(F.col("b")).alias("b"))
    got = row.select(precision.mul_fixed(F.col("a"), F.col("b")).alias("m"), precision.div_fixed(F.col("a"), F.col("b")).alias("d")).first()
    assert got["m"] == -int(3.375 * 8192) and got["d"] == -int(1.5 / 2.25 * 8192)


def test_recurrence_and_decoding(spark):
    r = np.random.default_rng(7)
    w = {"w_x": r.normal(size=(4, 3, 2)), "w_h": r.normal(size=(4, 3, 3)), "bias": r.normal(size=(4, 3)), "peep": r.normal(size=(3, 3))}
    x = r.normal(size=(5, 2))
    s = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "img string, col long, px array<double>")
    h, c, want = np.zeros(3), np.zeros(3), []
    sig = lambda z: 1 / (1 + np.exp(-z))
    for v in x:
        z = w["w_x"] @ v + w["w_h"] @ h + w["bias"]
        i, f = sig(z[0] + w["peep"][0] * c), sig(z[1] + w["peep"][1] * c)
        c = f * c + i * np.tanh(z[3])
        h = sig(z[2] + w["peep"][2] * c) * np.tanh(c)
        want.append(h)
    assert np.allclose([v["h"] for v in networks.recurrent(s, w).orderBy("col").collect()], want)
    both = networks.bidirectional(s, w, w).orderBy("col").collect()
    assert np.allclose(both[4]["h"][3:], networks.recurrent(networks.mirror(s), w).filter("col = 0").first()["h"])
    p = [(0.9, 0.1, 0.0), (0.2, 0.7, 0.1), (0.1, 0.8, 0.1), (0.95, 0.0, 0.05), (0.3, 0.1, 0.6)]
    scores = spark.createDataFrame([("a", i, k, v) for i, q in enumerate(p) for k, v in enumerate(q)], "img string, col long, class int, p double")
    text = networks.text_of(networks.decode(scores), spark.createDataFrame([(0, ""), (1, "x"), (2, "y")], "label int, symbol string"))
    assert text.first()["text"] == "xy"


def test_batches_and_vocabulary(spark):
    stream = [4, 3, 2, 1, 0, 5, 6, 1, 1, 1, 1, 0, 3, 4, 1]
    got = networks.batches(spark.createDataFrame(list(enumerate(stream)), "pos long, word_id int"), 3, 2).collect()
    x, y = np.zeros((2, 3, 2), int), np.zeros((2, 3, 2), int)
    for g in got:
        x[g["batch"], g["row"], g["step"]], y[g["batch"], g["row"], g["step"]] = g["x"], g["y"]
    assert x.tolist() == [[[4, 3], [5, 6], [1, 0]], [[2, 1], [1, 1], [3, 4]]]
    assert y.tolist() == [[[3, 2], [6, 1], [0, 3]], [[1, 0], [1, 1], [4, 1]]]
    words = spark.createDataFrame([(w,) for w in "b a a c b d".split()], "word string")
    assert {r["word"]: r["word_id"] for r in networks.vocabulary(words).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_convolution_by_hand(spark):
    r = np.random.default_rng(8)
    x, w = r.normal(size=(2, 5, 5)), r.normal(size=(3, 2, 3, 3))
    maps = spark.createDataFrame([(0, c, i, j, float(x[c, i, j])) for c in range(2) for i in range(5) for j in range(5)], "img int, ch int, i int, j int, v double")
    got = networks.convolve(maps, w.tolist(), [1.0, 2.0, 3.0], (5, 5)).collect()
    for g in got:
        o, i, j = g["ch"], g["i"], g["j"]
        assert np.isclose(g["v"], (x[:, i : i + 3, j : j + 3] * w[o][:, ::-1, ::-1]).sum() + o + 1)
    assert len(got) == 27


def test_readers_and_writers(spark):
    m = readers.csv_matrix(spark, put(spark, "m", "1,2.5,x\n3,,5\n"))
    assert {(r["i"], r["j"]): r["v"] for r in m.collect()} == {(0, 0): 1, (0, 1): 2.5, (0, 2): 0, (1, 0): 3, (1, 1): 0, (1, 2): 5}
    out = scratch(spark, "out")
    writers.csv_matrix(m, out)
    assert sorted(r["value"] for r in spark.read.text(out).collect())[0].startswith("1.00000000000000000000,2.5")
    with pytest.raises(Exception, match="row width"):
        readers.csv_matrix(spark, put(spark, "m", "1,2\n3\n")).collect()
    assert [r["v"] for r in readers.csv_vector(spark, put(spark, "v", "1,2\n3,4\n")).orderBy("i").collect()] == [3, 4]
    assert sorted(map(tuple, readers.adjacency(spark, put(spark, "a", "0: 1 2 -1\n1: -1\n2: 0 -1\n")).collect())) == [(0, 1), (0, 2), (2, 0)]
    assert sorted(map(tuple, readers.csr_graph(spark, put(spark, "g", "3 4\n0 2 2\n1 2\n0 1\n")).collect())) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    mm = readers.matrix_market(spark, put(spark, "mm", "%%MatrixMarket matrix coordinate real symmetric\n% note\n2 2 2\n1 1 3.0\n2 1 4.5\n"))
    assert sorted(map(tuple, mm.collect())) == [(0, 0, 3.0), (0, 1, 4.5), (1, 0, 4.5)]
    lib = readers.dense_rows(readers.libsvm(spark, put(spark, "l", "1 1:0.5 3:2\n-1 2:1\n")), 3).orderBy("id").collect()
    assert [(r["label"], r["coords"]) for r in lib] == [(1, [0.5, 0, 2]), (-1, [0, 1, 0])]
    assert [r["coords"] for r in readers.points_text(spark, put(spark, "p", "a 1 2\n\nb 3,4\n")).orderBy("id").collect()] == [[1, 2], [3, 4]]
    binary = np.array([2, 3], "<i4").tobytes() + np.arange(6, dtype="<f4").tobytes()
    assert [r["coords"] for r in readers.points_binary(spark, put(spark, "b", binary, True)).orderBy("id").collect()] == [[0, 1, 2], [3, 4, 5]]
    record = bytes([7, *range(12)])
    got = readers.records(spark, put(spark, "r", record * 2, True), 2, 2, 3).collect()
    assert len(got) == 2 and got[0]["label"] == 7 and got[0]["pixels"] == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11]
    assert [r["word"] for r in readers.words(spark, put(spark, "w", "a b\nc\n")).orderBy("pos").collect()] == ["a", "b", "<eos>", "c", "<eos>"]
    assert [r["px"] for r in readers.line_images(spark, put(spark, "img", "1 2\n3 4"), 2).orderBy("col").collect()] == [[1, 2], [3, 4]]
    assert [r["symbol"] for r in readers.alphabet(spark, put(spark, "al", "\n \na\n")).orderBy("label").collect()] == ["", " ", "a"]
    assert readers.config(spark, put(spark, "c", "k 1\nname two words\nk 3\n")) == {"k": "3", "name": "two words"}
    s = readers.sensors(spark, put(spark, "s", "p0, p1\n1,10,2,1,20,2\n2,30,4,2,50,5\n")).orderBy("sensor", "sample").collect()
    assert [(r["sensor"], r["acc"]) for r in s] == [("p0", 10), ("p0", 30), ("p1", 20), ("p1", 50)]
    own = spark.createDataFrame([(10.0, 30.0, 2.0, 4.0), (1.0, 2.0, 3.0, 3.0)], "a double, b double, u double, v double")
    assert [r["p"] for r in own.select(results.power_average(F.col("a"), F.col("b"), F.col("u"), F.col("v")).alias("p")).collect()] == [10.0, None]
    model = spark.createDataFrame([(0.5, [1.0, 0.0, 2.0])], "coef double, coords array<double>")
    path = scratch(spark, "model")
    writers.svm_model(model, path, {"svm_type": "c_svc", "kernel_type": "rbf"})
    head, vectors = readers.svm_model(spark, path)
    assert head["kernel_type"] == "rbf" and vectors.first()["coef"] == [0.5] and vectors.first()["x"] == {1: 1.0, 3: 2.0}


def test_matrix_forms(spark):
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.0), (1, 0, -3.0)], "i long, j long, v double")
    assert linalg.to_sparse(m).count() == 2
    n = linalg.norm_inf(m.withColumn("v", F.col("v") * 1.5), truncate=True).first()
    assert (n["norm_inf"], n["max_nnz"]) == (4.0, 2)
    x = spark.createDataFrame([(0, 1.0), (5, 2.0)], "i long, v double")
    y = spark.createDataFrame([(0, 4.0), (7, 1.0)], "i long, v double")
    assert linalg.dot(x, y).first()["dot"] == 4.0
    assert np.isclose(linalg.sparse_rbf(x, y, 0.1).first()["k"], np.exp(-0.1 * (9 + 4 + 1)))
    assert {r["i"]: r["v"] for r in linalg.axpy(2.0, x, y).collect()} == {0: 6.0, 5: 4.0, 7: 1.0}


def test_votes_and_errors(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 0), (3, 1)], "k int, label int")
    assert {r["k"]: r["vote"] for r in stats.majority(df, ["k"], "label").collect()} == {1: 0, 2: 0, 3: 1}
    t = spark.createDataFrame([("abc", "abd"), ("x", "")], "g string, t string").select(scalar.edit_error(F.col("g"), F.col("t")).alias("e")).collect()
    assert np.isclose(t[0]["e"], 1 / 3) and t[1]["e"] is None


def test_stream_equals_batch(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    import shutil

    folder = scratch(spark, "in").replace("file:", "")
    __import__("os").makedirs(folder)
    shutil.copy("/root/testdata/sf0.001/events.parquet", folder)
    stream = windows.summaries(spark.readStream.schema(schema).parquet(folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("summaries").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.summaries(spark.read.parquet(folder))
    key = lambda r: (str(r["start"]), r["event_type"], r["n"], round(r["mean"], 6))
    assert sorted(map(key, spark.table("summaries").collect())) == sorted(map(key, batch.collect()))


def test_codes_of_many_lengths(spark):
    """A prefix code of one to five bits, read from the lowest bit of each byte; bits that run out end a row."""
    r = np.random.default_rng(8)
    codes = {"0": 7, "10": 1, "110": 300, "1110": -4, "11110": 0, "11111": 9}
    rows = []
    for i in range(40):
        picked = r.choice(list(codes), size=r.integers(0, 30)).tolist()
        bits = "".join(picked)
        bits += "0" * (-len(bits) % 8)
        rows.append((i, bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8)), len(picked), [codes[x] for x in picked]))
    df = spark.createDataFrame(rows, "i int, bits binary, n int, want array<int>")
    assert all(v["values"] == v["want"] for v in scalar.huffman_decode(df, codes).collect())
    cut = spark.createDataFrame([(bytes([0xFF]), 5), (None, 3), (b"", 1)], "bits binary, n int")
    assert [v["values"] for v in scalar.huffman_decode(cut, codes).collect()] == [[9], [], []]


def test_fast_forms(spark):
    x = np.linspace(-4, 4, 81)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", scalar.fast_exp(F.col("x")).alias("e"), scalar.fast_tanh(F.col("x")).alias("t")).collect()
    assert all(abs(v["e"] / np.exp(v["x"]) - 1) < 0.07 and abs(v["t"] - np.tanh(v["x"])) < 0.05 for v in got)


def test_writers(spark):
    lines = lambda path: [r["value"] for r in spark.read.text(path).collect()]
    path = scratch(spark, "out")
    centres = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "cluster int, coords array<double>")
    writers.clusters(centres, spark.createDataFrame([(5, 1), (3, 0)], "id long, cluster int"), path)
    assert sorted(lines(f"{path}.cluster_centres")) == ["0 1.000000 2.000000", "1 3.000000 4.000000"]
    assert sorted(lines(f"{path}.membership")) == ["3 0", "5 1"]
    writers.labels(spark.createDataFrame([(1, 2.0), (0, 3.0)], "id long, label double"), f"{path}-labels")
    assert sorted(lines(f"{path}-labels")) == ["2.0", "3.0"]
    writers.results(spark.createDataFrame([(0, 1, 2, "p0", 3.5)], "dIdx int, pIdx int, rIdx int, Sensor string, Value double"), f"{path}-results")
    assert "0;1;2;p0;3.5" in lines(f"{path}-results")
    writers.log(spark.createDataFrame([(1, 0.5)], "step int, loss double"), f"{path}-log")
    assert "1\t0.5" in lines(f"{path}-log")
    x = spark.createDataFrame([(0, 0.5), (1, 2.0)], "i long, v double")
    writers.csv_vector(x, f"{path}-vector")
    assert [r["v"] for r in readers.csv_vector(spark, f"{path}-vector").orderBy("i").collect()] == [0.5, 2.0]
