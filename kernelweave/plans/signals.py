"""Principal components, wavelets, Fourier transforms and quadrature.

Signals are rows (key, pos, v): a null v adds nothing, as an absent sample does, a null key is a key. Points with null
coords are left out of scatter matrices and factors, and get null coords when projected. Ends of intervals that are null
give a null integral. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.session import prepare


def scatter(points: DataFrame) -> DataFrame:
    """i, j, v: the centred scatter matrix (no division) of points (id, coords).

    A task adds up products of whole batches and sends d^2 rows, whatever its number of points. Null coords are left out.
    """
    prepare(points.sparkSession)

    def run(batches):
        total = None
        for b in batches:
            x = [v for v in b["coords"] if v is not None]
            if x:
                x = np.stack(x).astype(float)
                own = np.array([x.T @ x, np.tile(x.sum(0)[:, None], x.shape[1]), np.full((x.shape[1],) * 2, float(len(x)))])
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape[1:]).reshape(2, -1)
            yield pd.DataFrame({"i": i, "j": j, "ab": total[0].ravel(), "sa": total[1].ravel(), "sb": total[1].T.ravel(), "n": total[2].ravel()})

    parts = points.select("coords").mapInPandas(run, "i int, j int, ab double, sa double, sb double, n double")
    sums = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("ab", "sa", "sb", "n")))
    return sums.select("i", "j", (F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")).alias("v"))


def components(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, loadings in columns) of the k largest, ascending; the largest loading of each is positive.

    The d x d matrix is solved on the driver; d is the number of columns, not of rows.
    """
    rows = scatter(points).collect()
    d = 1 + max((r["i"] for r in rows), default=-1)
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["v"]
    value, vector = np.linalg.eigh(m)
    value, vector = value[-k:], vector[:, -k:]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return value, vector * np.where(sign == 0, 1, sign)


def factor(points: DataFrame, fan: int = 16) -> np.ndarray:
    """Upper triangular R of (1, coords) over all points: Q isn't needed, and R'R is the matrix of products.

    Each task takes Householder steps over its batches and sends one R; ``fan`` of these are stacked and factored again,
    level by level, so no group holds more than ``fan`` triangles, and at most ``fan`` of them come to the driver. Nothing
    is squared on the way: small singular values keep their digits. Null coords are left out; no points give a matrix of
    no columns.
    """
    from pyspark import TaskContext

    spark = prepare(points.sparkSession)

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(parts), mode="r")

    def run(batches):
        r = None
        for b in batches:
            rows = [v for v in b["coords"] if v is not None]
            if rows:
                x = np.stack(rows).astype(float)
                x = np.hstack((np.ones((len(x), 1)), x))
                r = merged([x] if r is None else [r, x])
        if r is not None:
            yield pd.DataFrame({"t": [TaskContext.get().partitionId()], "d": [r.shape[1]], "r": [r.tobytes()]})

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = merged([np.frombuffer(x).reshape(-1, d) for x, d in zip(pdf.r, pdf.d)])
        return pd.DataFrame({"t": [pdf.t.iloc[0] // fan], "d": [r.shape[1]], "r": [r.tobytes()]})

    kind, tasks = "t long, d int, r binary", points.rdd.getNumPartitions()
    parts = points.select("coords").mapInPandas(run, kind)
    while tasks > fan:
        parts, tasks = parts.groupBy(F.floor(F.col("t") / fan)).applyInPandas(stack, kind), -(-tasks // fan)
    last = [np.frombuffer(x["r"]).reshape(-1, x["d"]) for x in parts.collect()]
    return merged(last) if last else np.zeros((1, 1))


def components_qr(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variances, loadings in columns, mean) as ``components`` has them, from R: the part of R behind its first row and
    column is the triangle of the centred points, and its singular values are the roots of the variances."""
    r = factor(points)
    if r.shape[1] < 2:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    _, s, v = np.linalg.svd(r[1:, 1:] if len(r) > 1 else np.zeros((1, r.shape[1] - 1)))
    value = np.zeros(r.shape[1] - 1)
    value[: len(s)] = s * s
    value, vector = value[::-1][-k:], v.T[:, ::-1][:, -k:]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return value, vector * np.where(sign == 0, 1, sign), r[0, 1:] / r[0, 0]


def pca_qr(points: DataFrame, k: int) -> DataFrame:
    """id, coords on the k largest components, found without squaring the points; one pass finds mean and loadings."""
    _, loadings, mean = components_qr(points, k)
    return project(points, loadings, list(map(float, mean)))


def project(points: DataFrame, loadings: np.ndarray, mean: list[float] | None = None) -> DataFrame:
    """id, coords: the points on the given loadings, one dot product of arrays each."""
    mean = mean or [r["m"] for r in points.select(F.posexplode("coords").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()]
    centred = F.zip_with("coords", F.array(*map(F.lit, map(float, mean))), lambda x, y: x - y)
    dot = lambda col: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, map(float, col))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return points.select("id", F.array(*(dot(loadings[:, j]) for j in range(loadings.shape[1]))).alias("coords"))


def pca(points: DataFrame, k: int) -> DataFrame:
    return project(points, components(points, k)[1])


def haar(signal: DataFrame, levels: int | None = None) -> DataFrame:
    """key, band, pos, v: full-depth Haar transform of signals (key, pos, v) whose length is a power of two.

    A coefficient of level L at place p is a signed sum over 2^L samples. A sample gives its part of each level as a row of
    one scan, and one aggregate with partial sums adds them up.
    """
    n = levels if levels is not None else 8
    parts = []
    for level in range(1, n + 1):
        width, half = 1 << level, 1 << (level - 1)
        sign = F.when(F.col("pos") % width < half, 1.0).otherwise(-1.0)
        parts.append((level, width, sign))
    parts.append((0, 1 << n, F.lit(1.0)))
    rows = F.array(*(F.struct(F.lit(band).alias("band"), F.expr(f"pos div {width}").cast("long").alias("pos"), (sign * F.col("v") / float(np.sqrt(width))).alias("v")) for band, width, sign in parts))
    each = signal.select("key", F.explode(rows).alias("r")).select("key", "r.*")
    return each.groupBy("key", "band", "pos").agg(F.sum("v").alias("v"))


def band_energy(coefficients: DataFrame) -> DataFrame:
    """key, band, energy: sum of squares of each band."""
    return coefficients.groupBy("key", "band").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def channel_features(samples: DataFrame, k: int = 9, bands: int = 4, scale: float = 1e5) -> DataFrame:
    """id, coords: band energies of the principal components of windows (window, t, coords over channels).

    All windows share the components' loadings. Of each component the energies of the ``bands`` finest Haar bands, finest
    first, divided by ``scale``, stand next to each other, components from the largest to the smallest. The number of
    samples a window is a power of two.
    """
    points = samples.select(F.struct("window", "t").alias("id"), "coords")
    size = samples.agg(F.max("t")).first()[0] + 1
    series = pca(points, k).select("id.window", "id.t", F.posexplode(F.reverse("coords")).alias("c", "v"))
    coefficients = haar(series.select(F.struct("window", "c").alias("key"), F.col("t").alias("pos"), "v"), int(size).bit_length() - 1)
    energy = band_energy(coefficients).filter(F.col("band").between(1, bands))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("key.c") * bands + F.col("band")).alias("at"), (F.col("energy") / scale).alias("v"))))  # k * bands rows a window
    return energy.groupBy(F.col("key.window").alias("id")).agg(F.transform(ordered, lambda x: x["v"]).alias("coords"))


def dft(signal: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """key, k, re, im of signals (key, n, re, im) of length ``n`` by a join with the frequencies; forward is scaled by 1/n.

    n * n products a signal: for short windows. ``fft`` is the form for long ones.
    """
    sign = 1.0 if inverse else -1.0
    turn = F.lit(sign * 2 * np.pi / n) * ((F.col("n") * F.col("k")) % n)
    each = signal.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    re = F.sum(F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn))
    im = F.sum(F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn))
    unit = 1.0 if inverse else 1.0 / n
    return each.groupBy("key", "k").agg((re * unit).alias("re"), (im * unit).alias("im"))


def _factors(n: int) -> list[int]:
    out, r = [], 2
    while n > 1:
        while n % r == 0:
            out.append(r)
            n //= r
        r = r + 1 if r * r <= n else max(n, r + 1)
    return out


def fft(signal: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """key, k, re, im: transforms of length ``n`` of rows (key, n, re, im), n from 0; forward scaled by 1/n.

    One stage a prime factor r: rows hold the transforms of the subsequences of every S-th value; r of those make one of
    every S/r-th value. A stage is an explode to r rows and an aggregate, so a transform is never one group, and the work
    is n times the sum of the factors. Absent rows count as 0; a null counts as 0.
    """
    apart, size = n, 1
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    out = signal.select("key", F.col("n").cast("long").alias("g"), F.lit(0).cast("long").alias("k"), value("re"), value("im"))
    for r in _factors(n):
        apart, size = apart // r, size * r
        step = F.lit(size // r)
        places = F.sequence(F.col("k"), F.col("k") + (r - 1) * step, step)
        part = out.select("key", "g", F.explode(places).alias("k"), "re", "im")
        turn = F.lit((1 if inverse else -1) * 2 * np.pi / size) * ((F.expr(f"g div {apart}") * F.col("k")) % size)
        re, im = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn), F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
        out = part.groupBy("key", (F.col("g") % apart).alias("g"), "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    unit = 1.0 if inverse else 1.0 / n
    return out.select("key", "k", (F.col("re") * unit).alias("re"), (F.col("im") * unit).alias("im"))


def fft_axes(cells: DataFrame, sizes: dict[str, int], inverse: bool = False) -> DataFrame:
    """key, the axes, re, im: the transform along each axis in turn of rows (key, axes, re, im); two axes, three or more."""
    out = cells.select("key", *(F.col(c).cast("long").alias(c) for c in sizes), "re", "im")
    for axis, n in sizes.items():
        others = [c for c in sizes if c != axis]
        lines = out.select(F.struct("key", *others).alias("key"), F.col(axis).alias("n"), "re", "im")
        out = fft(lines, n, inverse).select("key.*", F.col("k").alias(axis), "re", "im")
    return out.select("key", *sizes, "re", "im")


def windows_of(series: DataFrame, size: int, drop_short: bool = True) -> DataFrame:
    """key (series, window), pos, v of non-overlapping windows of (key, pos, v) by integer division."""
    out = series.select(F.struct("key", F.expr(f"pos div {size}").alias("w")).alias("key"), (F.col("pos") % size).alias("pos"), "v")
    return out.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter(F.col("n") == size).drop("n") if drop_short else out


def nodes(n: int) -> list[tuple[float, float]]:
    """Gauss-Legendre nodes and weights on [-1, 1], ascending: Newton steps on all roots of P_n at once.

    The first guess is Tricomi's; P_n and its derivative come from the three-term recurrence. Roots are made symmetric.
    """
    x = np.cos(np.pi * (np.arange(n, 0, -1) - 0.25) / (n + 0.5)) * (1 - (1 - 1 / n) / (8 * n * n))
    for _ in range(100):
        before, p = np.ones(n), x.copy()
        for k in range(2, n + 1):
            before, p = p, ((2 * k - 1) * x * p - (k - 1) * before) / k
        slope = n * (before - x * p) / (1 - x * x)
        step = p / slope
        x = x - step
        if np.abs(step).max() < 1e-15:
            break
    x, w = (x - x[::-1]) / 2, 2 / ((1 - x * x) * slope * slope)
    return list(zip(map(float, x), map(float, (w + w[::-1]) / 2)))


def legendre_rules(orders: DataFrame, steps: int = 6) -> DataFrame:
    """n, k, x, w: the nodes (ascending from k = 0) and weights of each order n of a table, all in columns.

    A row a node; Newton steps and the recurrence are folds, so the table of orders can have any number of rows. Null
    orders and those below 1 give nothing.
    """
    each = orders.select(F.col("n").cast("int").alias("n")).filter("n >= 1").distinct().select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    n = F.col("n").cast("double")
    guess = F.cos(np.pi * (n - F.col("k") - 0.25) / (n + 0.5)) * (1 - (1 - 1 / n) / (8 * n * n))

    def values(x: Column) -> Column:
        """p and slope of P_n at x."""
        first = F.struct(F.lit(1.0).alias("b"), x.alias("p"))
        degrees = F.when(F.col("n") >= 2, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>"))
        both = F.aggregate(degrees, first, lambda s, k: F.struct(s["p"].alias("b"), (((2 * k - 1) * x * s["p"] - (k - 1) * s["b"]) / k).alias("p")))
        return F.aggregate(F.array(both), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("d")), lambda s, v: F.struct(v["p"].alias("p"), (n * (v["b"] - x * v["p"]) / (1 - x * x)).alias("d")))

    def newton(x: Column) -> Column:
        return F.aggregate(F.array(values(x)), x, lambda s, v: s - v["p"] / v["d"])

    root = each.withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), guess, lambda x, _: newton(x)))
    return root.withColumn("d", values(F.col("x"))["d"]).select("n", "k", "x", (2 / ((1 - F.col("x") * F.col("x")) * F.col("d") * F.col("d"))).alias("w"))


def integrate(intervals: DataFrame, f: Callable[[Column], Column], n: int = 20) -> Column:
    """Integral of ``f`` over columns a to b of each row: a sum of n terms in one projection, no join."""
    mid, half = (F.col("a") + F.col("b")) / 2, (F.col("b") - F.col("a")) / 2
    terms = [F.lit(w) * f(mid + half * F.lit(x)) for x, w in nodes(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return half * total


def integrate_2d(f: Callable[[Column, Column], Column], n: int = 8) -> Column:
    """Integral of ``f`` over [a, b] x [c, d] of each row by the tensor rule."""
    mx, hx, my, hy = (F.col("a") + F.col("b")) / 2, (F.col("b") - F.col("a")) / 2, (F.col("c") + F.col("d")) / 2, (F.col("d") - F.col("c")) / 2
    grid = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(wx * wy).alias("w")) for x, wx in nodes(n) for y, wy in nodes(n)))
    return hx * hy * F.aggregate(grid, F.lit(0.0), lambda s, p: s + p["w"] * f(mx + hx * p["x"], my + hy * p["y"]))


def composite(spark: SparkSession, a: float, b: float, splits: int, f: Callable[[Column], Column], n: int = 20) -> DataFrame:
    """One row: the integral over equal sub-intervals, summed by Spark."""
    step = (b - a) / splits
    parts = spark.range(splits).select((F.lit(a) + F.col("id") * step).alias("a"), (F.lit(a) + (F.col("id") + 1) * step).alias("b"))
    return parts.select(integrate(parts, f, n).alias("v")).agg(F.sum("v").alias("v"))


def genz(kind: int, x: Column, u: Column, a: Column) -> Column:
    """Test integrands: 1 oscillatory, 2 product peak, 3 corner peak, 4 Gaussian, 5 continuous, 6 discontinuous."""
    return {
        1: lambda: F.cos(2 * np.pi * u + a * x),
        2: lambda: 1 / (F.pow(a, -2.0) + (x - u) * (x - u)),
        3: lambda: F.pow(1 + a * x, -2.0),
        4: lambda: F.exp(-a * a * (x - u) * (x - u)),
        5: lambda: F.exp(-a * F.abs(x - u)),
        6: lambda: F.when(x > u, 0.0).otherwise(F.exp(a * x)),
    }[kind]()


def genz_exact(kind: int, u: Column, a: Column) -> Column:
    """Closed forms of the integrals over [0, 1]; kind 4 by the error function."""
    return {
        1: lambda: (F.sin(2 * np.pi * u + a) - F.sin(2 * np.pi * u)) / a,
        2: lambda: a * (F.atan(a * (1 - u)) + F.atan(a * u)),
        3: lambda: 1 / (1 + a),
        4: lambda: float(np.sqrt(np.pi)) / (2 * a) * (erf(a * (1 - u)) + erf(a * u)),
        5: lambda: (2 - F.exp(-a * u) - F.exp(-a * (1 - u))) / a,
        6: lambda: (F.exp(a * u) - 1) / a,
    }[kind]()


def erf(x: Column) -> Column:
    """Error function by the integral of its own definition (24 nodes; error below 1e-12 for |x| < 3)."""
    h = x / 2
    total = None
    for p, w in nodes(24):
        y = h + h * F.lit(p)
        t = F.lit(w) * F.exp(-y * y)
        total = t if total is None else total + t
    return float(2 / np.sqrt(np.pi)) * h * total
