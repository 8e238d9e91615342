"""Matrices as (i, j, v) rows, vectors as (i, v) rows; every operator is joins, aggregates and column expressions.

``precision='single'`` stores values as FLOAT; sums run in DOUBLE and are narrowed once at the end.

A null key meets no other in a join; a null value adds nothing to a sum, and where two vectors are put together it counts
as 0, like an absent one. Repeated entries are added up by products and sums and kept by the others. Empty tables give
empty tables, and forms that return one row give 0 (``dot``, ``exact_sum``) or null (norms).
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.session import prepare


def narrow(c: Column, precision: str = "double") -> Column:
    """Round a value to the storage width."""
    return c.cast("float").cast("double") if precision == "single" else c.cast("double")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def to_sparse(m: DataFrame) -> DataFrame:
    return m.filter("v <> 0")


def to_dense(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """All cells of rows (i) by cols (j), zero where ``m`` has none. The dense form is what is asked for, so the
    result has |rows| * |cols| cells; prefer the sparse form everywhere else."""
    return rows.join(cols).join(m, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def flatten(m: DataFrame, width: int) -> DataFrame:
    return m.select((F.col("i") * width + F.col("j")).alias("k"), "v")


def unflatten(m: DataFrame, width: int) -> DataFrame:
    return m.select(F.expr(f"k div {width}").alias("i"), (F.col("k") % width).alias("j"), "v")


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def normalise_rows(m: DataFrame) -> DataFrame:
    """Each row divided by its sum; rows that sum to 0 are left out, ``dangling`` names them."""
    sums = row_sums(m).filter("v <> 0").withColumnRenamed("v", "s")
    # a join and not a window, so that a row with a third of all entries can be split
    return m.join(sums, "i").select("i", "j", (F.col("v") / F.col("s")).alias("v"))


def dangling(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """Nodes (i) without a row in ``m`` or whose row sums to exactly 0."""
    return nodes.select("i").join(row_sums(m).filter("v <> 0"), "i", "left_anti")


def diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i = j").select("i", "v")


def mirror(m: DataFrame) -> DataFrame:
    """A triangle of a symmetric matrix made whole."""
    return m.unionByName(transpose(m.filter("i <> j")))


def spmv(m: DataFrame, x: DataFrame, precision: str = "double") -> DataFrame:
    """y = M x; rows without a product are absent."""
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(narrow(F.sum(F.col("v") * F.col("x")), precision).alias("v"))


def axpy(a: float | Column, x: DataFrame, y: DataFrame, precision: str = "double") -> DataFrame:
    """a * x + y; entries that are absent on one side count as 0."""
    return _zip(x, y, lambda p, q: narrow((a if isinstance(a, Column) else F.lit(float(a))) * p + q, precision))


def xpby(x: DataFrame, b: float, y: DataFrame, precision: str = "double") -> DataFrame:
    return _zip(x, y, lambda p, q: narrow(p + F.lit(float(b)) * q, precision))


def scale(a: float, x: DataFrame) -> DataFrame:
    return x.select("i", (F.lit(float(a)) * F.col("v")).alias("v"))


def fill(x: DataFrame, value: float) -> DataFrame:
    return x.select("i", F.lit(float(value)).alias("v"))


def _zip(x: DataFrame, y: DataFrame, f) -> DataFrame:
    both = x.select("i", F.col("v").alias("p")).join(y.select("i", F.col("v").alias("q")), "i", "full_outer")
    return both.select("i", f(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: dot. Entries on one side alone add nothing, so an inner join is the merge of two sparse vectors."""
    return x.select("i", F.col("v").alias("p")).join(y.select("i", F.col("v").alias("q")), "i").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """One row: l1, l2, linf."""
    return x.agg(F.sum(F.abs("v")).alias("l1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), F.max(F.abs("v")).alias("linf"))


def deltas(x: DataFrame, y: DataFrame) -> DataFrame:
    """Norms of x - y."""
    return norms(xpby(x, -1.0, y))


def norm_inf(m: DataFrame, truncate: bool = False) -> DataFrame:
    """Largest row sum of absolute values and largest number of entries in a row; ``truncate`` cuts values to integers first."""
    v = F.abs(F.col("v").cast("long") if truncate else F.col("v"))
    return m.groupBy("i").agg(F.sum(v).cast("double").alias("s"), F.count("*").alias("n")).agg(F.max("s").alias("norm_inf"), F.max("n").alias("max_nnz"))


def sparse_rbf(x: DataFrame, y: DataFrame, gamma: float) -> DataFrame:
    """exp(-gamma |u - v|^2) of two keyed sparse vectors (i, v): an absent side counts as 0."""
    return _zip(x, y, lambda p, q: (p - q) * (p - q)).agg(F.exp(-gamma * F.sum("v")).alias("k"))


def exact_sum(df: DataFrame, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, ``value``: the sum of all values, rounded once, so partitions and order play no part.

    A double is cut into whole multiples of powers of 2^32 (three at most, each exact); these are added as decimals, which
    merge without rounding, and one row a key puts some 70 of them together in whole numbers. Nulls are left out; NaN and
    infinities give what a plain sum gives. Without keys there is one row, 0 where there is nothing to add.
    """
    prepare(df.sparkSession)
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    tiny = F.abs(v) < 2.0**-500  # shifted by whole bins, so that no bin lies below the smallest double
    rows = df.select(*keys, F.when(odd, v).alias("odd"), F.when(~odd & (v != 0), F.when(tiny, v * 2.0**512).otherwise(v)).alias("x"), F.when(tiny, -16).otherwise(0).alias("shift"))
    rows = rows.withColumn("b", F.floor(F.log2(F.abs("x")) / 32).cast("int"))
    pieces, rest = [], F.col("x")
    for k in range(3):
        unit = F.pow(F.lit(2.0), 32.0 * (F.col("b") - k))
        rows = rows.withColumn(f"q{k}", (rest / unit).cast("long")).withColumn(f"r{k}", rest - F.col(f"q{k}") * unit)
        rest = F.col(f"r{k}")
        pieces.append(F.struct((F.col("b") - k + F.col("shift")).alias("bin"), F.col(f"q{k}").cast("decimal(20,0)").alias("q")))
    bins = rows.select(*keys, "odd", F.explode_outer(F.filter(F.array(*pieces), lambda p: p["q"] != 0)).alias("p"))
    sums = bins.groupBy(*keys, "p.bin").agg(F.sum("p.q").alias("q"), F.sum("odd").alias("odd"))
    at = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "q")))  # a row a bin
    whole = sums.groupBy(*keys).agg(F.sum("odd").alias("odd"), F.count("odd").alias("odds"), at.alias("bins"))

    def run(batches):
        for b in batches:
            out = []
            for odd, odds, own in zip(*(b.column(c).to_pylist() for c in ("odd", "odds", "bins"))):
                total = sum((Fraction(int(p["q"])) * Fraction(2) ** (32 * p["bin"]) for p in own), Fraction(0))
                try:
                    out.append(odd if odds else float(total))  # float() rounds to the nearest
                except OverflowError:
                    out.append(float("inf") if total > 0 else float("-inf"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, value])

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return whole.mapInArrow(run, f"{kinds}`{value}` double")
