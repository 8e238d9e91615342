"""Small operators that no query covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import scalar
from kernelweave.operators import linalg, stats
from kernelweave.plans import networks, points, results, svm
from kernelweave.session import scratch
from kernelweave.sources import readers, writers


def test_strings_and_uniform(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\nx, y,z\n\n")
    assert [r["value"] for r in readers.csv_strings(spark, str(tmp_path / "h.csv")).orderBy("i").collect()] == ["x", " y", "z"]
    v = [r["v"] for r in readers.uniform(spark, 1000, 3).collect()]
    assert len(v) == 1000 and 0 <= min(v) and max(v) < 1 and abs(np.mean(v) - 0.5) < 0.05
    assert v == [r["v"] for r in readers.uniform(spark, 1000, 3).collect()]


def test_accuracy_file(spark):
    path = scratch(spark, "accuracy")
    writers.accuracy(spark.createDataFrame([(0.875,)], "accuracy double"), path)
    assert "0.875" in "".join(r["value"] for r in spark.read.text(path).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 31])
def test_integer_power(spark, n):
    got = spark.range(1).select(scalar.int_power(F.lit(1.5), n).alias("v")).first()["v"]
    assert abs(got - 1.5**n) <= 1e-12 * 1.5**n


def test_crop_and_standardise(spark):
    px = spark.createDataFrame([(0, h, w, 0, float(10 * h + w)) for h in range(6) for w in range(6)], "img int, h int, w int, c int, v double")
    assert {(r["h"], r["w"]): r["v"] for r in networks.crop(px, 1, 4).collect()} == {(h, w): 10.0 * (h + 1) + w + 1 for h in range(3) for w in range(3)}
    x = [1.0, 2.0, 3.0, 6.0]
    got = spark.createDataFrame([(x,), ([5.0] * 4,)], "pixels array<double>").select(networks.standardise(None).alias("p")).collect()
    assert np.allclose(got[0]["p"], (np.array(x) - 3) / np.std(x)) and got[1]["p"] == [0.0] * 4


def test_dense_in_q_format(spark):
    inputs = spark.createDataFrame([(0, k, v) for k, v in enumerate((8192, -4096, 30000))], "img int, k int, v long")
    got = {r["unit"]: r["v"] for r in networks.dense(inputs, [[8192, 8192, 0], [0, 0, 32767]], [100, 32000], q=13).collect()}
    assert got == {0: ((8192 - 4096) * 8192 + (100 << 13)) >> 13, 1: 32767}


def test_single_precision_product(spark):
    m = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 3.0)], "i long, v double")
    assert linalg.spmv(m, x, "single").first()["v"] == float(np.float32(0.1 + 0.2 * 3))


def test_sensor_rows(spark):
    rows = spark.createDataFrame([(0, 0, 0, " p0", 1.0), (0, 0, 1, "p0 ", 3.0), (0, 0, 0, "p1", 9.0)], "dIdx int, pIdx int, rIdx int, Sensor string, Value double")
    assert results.select(rows, "p0 ").count() == 2
    s = results.summary(results.select(rows, "p0"), ["dIdx"]).first()
    assert (s["n"], s["mean"]) == (2, 2.0) and abs(s["std_samp"] - 2**0.5) < 1e-12


def test_places(spark):
    """Ranks of hot keys and null keys against a plain sort."""
    r = np.random.default_rng(1)
    rows = [(["hot", "b", None][min(2, int(k))], int(v)) for k, v in zip(r.integers(0, 6, 300) // 3 * 2, r.permutation(300))]
    got = stats.places(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], "v").collect()
    for g in {x for x, _ in rows}:
        want = sorted(v for x, v in rows if x == g)
        assert sorted((x["place"], x["v"]) for x in got if x["g"] == g) == list(enumerate(want)) and {x["size"] for x in got if x["g"] == g} == {len(want)}


def test_nearest_with_ties_and_nulls(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 3, (200, 2)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None)], "id long, coords array<double>").repartition(6)
    got = points.nearest(rows, rows.filter("id % 20 = 0"), 7, block=4).collect()
    for q in range(0, 200, 20):
        d = ((x - x[q]) ** 2).sum(1)
        assert [(v["id"], v["dist"]) for v in sorted((v for v in got if v["query"] == q), key=lambda v: v["rank"])] == [(int(i), d[i]) for i in np.lexsort((np.arange(200), d))[:8]]
    assert len(got) == 80 and points.nearest(rows, rows.limit(0), 3).count() == 0


def test_classes_are_found(spark):
    """Three separate clouds: every class by its votes, and a point without coords gets none."""
    r = np.random.default_rng(3)
    own = [(i, (r.normal(size=2) * 0.2 + [(0, 0), (3, 0), (0, 3)][i % 3]).tolist(), float(i % 3)) for i in range(90)]
    p = spark.createDataFrame(own, "id long, coords array<double>, label double")
    model = svm.SVC(c=10.0).fit(p)
    assert model.score(p) == 1.0
    assert model.predict(p.unionByName(spark.createDataFrame([(99, None, 0.0)], p.schema))).count() == 90
