"""Layers of image networks and seeded distortions against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from kernelweave.plans import networks


def plain(x, size, stride, f):
    """f over each window of one image, None where a window is beyond the edge."""
    out = []
    for n in x.shape[:2]:
        m = -(-n // stride)
        out.append((m, max((m - 1) * stride + size - n, 0) // 2))
    (h, top), (w, left) = out
    at = lambda i, j, c: x[i, j, c] if 0 <= i < x.shape[0] and 0 <= j < x.shape[1] else None
    return [[f(lambda a, b, c: at(i * stride - top + a, j * stride - left + b, c)) for j in range(w)] for i in range(h)]


def test_layers_against_loops():
    r = np.random.default_rng(4)
    for shape, size in (((7, 5, 3), 5), ((8, 8, 2), 3), ((4, 6, 1), 2)):
        x = r.normal(size=(2, *shape))
        w, b = r.normal(size=(size, size, shape[2], 4)), r.normal(size=4)
        want = [plain(v, size, 1, lambda at: [b[o] + sum((at(i, j, c) or 0) * w[i, j, c, o] for i in range(size) for j in range(size) for c in range(shape[2])) for o in range(4)]) for v in x]
        assert np.allclose(networks.layer_conv(x, w, b), want)
        want = [plain(v, 3, 2, lambda at: [max(y for i in range(3) for j in range(3) if (y := at(i, j, c)) is not None) for c in range(shape[2])]) for v in x]
        assert np.allclose(networks.layer_pool(x, 3, 2), want)
    x = r.normal(size=(1, 1, 1, 12)) * 50
    want = [v / (1 + 0.001 / 9 * sum(x[0, 0, 0, max(0, c - 4) : c + 5] ** 2)) ** 0.75 for c, v in enumerate(x[0, 0, 0])]
    assert np.allclose(networks.layer_normalise(x)[0, 0, 0], want)


def test_image_net(spark):
    r = np.random.default_rng(5)
    layers = [("conv", r.normal(size=(5, 5, 3, 8)), r.normal(size=8)), ("relu",), ("pool",), ("normalise",), ("conv", r.normal(size=(5, 5, 8, 8)), r.normal(size=8)), ("relu",), ("normalise",), ("pool",), ("dense", r.normal(size=(3 * 3 * 8, 10)), r.normal(size=10)), ("relu",), ("dense", r.normal(size=(10, 4)), r.normal(size=4))]
    x = r.normal(size=(150, 12, 12, 3))
    rows = [(i, v.ravel().tolist()) for i, v in enumerate(x)] + [(150, None), (151, [1.0])]
    got = {v["img"]: v["scores"] for v in networks.image_net(spark.createDataFrame(rows, "img long, pixels array<double>").repartition(3), (12, 12, 3), layers).collect()}
    for name, *arguments in layers:
        x = networks.LAYERS[name](x, *arguments)
    assert x.shape == (150, 4) and np.allclose([got[i] for i in range(150)], x) and got[150] is None and got[151] is None


def test_distortions(spark):
    r = np.random.default_rng(6)
    x = r.uniform(0, 255, (40, 8, 8, 3))
    rows = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)] + [(99, None)], "img long, pixels array<double>")
    one, two = ({v["img"]: v["pixels"] for v in networks.distort(rows.repartition(n), (8, 8, 3), 6, seed=3).collect()} for n in (1, 5))
    assert one == two and one[99] is None and one != {v["img"]: v["pixels"] for v in networks.distort(rows, (8, 8, 3), 6, seed=4).collect()}
    assert all(abs(np.mean(one[i])) < 1e-9 and abs(np.std(one[i]) - 1) < 1e-9 for i in range(40))
    plain_rows = {v["img"]: np.array(v["pixels"]).reshape(6, 6, 3) for v in networks.distort(rows.filter("img < 40"), (8, 8, 3), 6, seed=3, brightness=0.0, contrast=(1.0, 1.0), standard=False).collect()}
    places = set()
    for i, v in plain_rows.items():
        fit = [(t, l, m) for t in range(3) for l in range(3) for m in (1, -1) if np.allclose(x[i, t : t + 6, l : l + 6][:, ::m], v)]
        assert len(fit) == 1
        places.add(fit[0])
    assert len(places) > 10  # parts and mirrors of all kinds
    changed = {v["img"]: np.array(v["pixels"]).reshape(6, 6, 3) for v in networks.distort(rows.filter("img < 40"), (8, 8, 3), 6, seed=3, standard=False).collect()}
    for i, v in changed.items():
        ratio = v.std((0, 1)) / plain_rows[i].std((0, 1))
        shift = v.mean((0, 1)) - plain_rows[i].mean((0, 1))
        assert np.allclose(ratio, ratio[0]) and 0.2 <= ratio[0] <= 1.8 and np.allclose(shift, shift[0]) and abs(shift[0]) <= 63
    assert math.isclose(networks._same(32, 3, 2)[0], 16) and networks._same(5, 5, 1)[1:] == (2, 2) and rows.filter(F.col("img") < 0).count() == 0
