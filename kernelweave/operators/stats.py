"""Aggregates, votes, encodings and window-shaped helpers.

Null values are left out of sums, means and extremes; a null key is a key of its own where rows are grouped, and meets no
other where tables are joined (so a null label has a fold but no class code). Sorts put nulls first. Empty tables give
empty tables; forms that return one row give counts of 0 and null ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.session import stored


def arg_min(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """The label of the smallest value of each key; the smaller label on ties."""
    best = F.min(F.struct(value, label))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{label}").alias(label), F.col(f"b.{value}").alias(value))


def arg_max(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """The label of the largest value of each key; the smaller label on ties."""
    best = F.min(F.struct((-F.col(value)).alias("neg"), label))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{label}").alias(label), (-F.col("b.neg")).alias(value))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """tp, tn, fp, fn, sensitivity, specificity and accuracy of 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = {"tp": F.count_if(t & g), "tn": F.count_if(~t & ~g), "fp": F.count_if(~t & g), "fn": F.count_if(t & ~g)}
    out = df.agg(*(v.alias(k) for k, v in n.items()))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return out.select("*", ratio("tp", "fn").alias("sensitivity"), ratio("tn", "fp").alias("specificity"), F.try_divide((F.col("tp") + F.col("tn")).cast("double"), sum((F.col(k) for k in n), F.lit(0)).cast("double")).alias("accuracy"))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Share of exact matches and mean squared error."""
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(truth) - F.col(guess), 2)).alias("mse"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample and population standard deviation; a single row has sample deviation 0."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_samp"), F.stddev_pop(value).alias("std_pop"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Count of each integer from the smallest to the largest, zero where there is none.

    The integers are a range that Spark deals to partitions, so a far value costs rows, not memory. Null values count
    nowhere; without values there are no bins.
    """
    counts = df.groupBy(F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("n")).filter("bin IS NOT NULL")
    a, z = counts.agg(F.min("bin"), F.max("bin")).first()
    every = df.sparkSession.range(a, z + 1) if a is not None else df.sparkSession.range(0)
    return every.withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def order_stats(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Smallest, upper-middle (position n div 2 of the sorted values) and largest value of each key; null values count first.

    Ranks come from a sort over all tasks, so a key of any size is no task's alone, and one filter.
    """
    ranked = places(df.select(*keys, value, *([order] if order not in (*keys, value) else [])), keys, value, order)
    mid = F.max(F.when(F.col("place") == F.expr("size div 2"), F.col(value)))
    return ranked.groupBy(*keys).agg(F.min(value).alias("low"), mid.alias("median"), F.max(value).alias("high"))


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """Rows with their place (from 0) in the given order: a sort over all tasks, and a prefix sum over tasks alone."""
    rows = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    task, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(task.alias("_t")).agg(F.count("*").alias("_s"))  # one row a task of the sort
    before = sizes.select("_t", F.coalesce(F.sum("_s").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.withColumn("_t", task).join(F.broadcast(before), "_t").withColumn(name, F.col("_b") + place).drop("_m", "_t", "_b")


def places(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows with their ``place`` (from 0) within their keys in the given order, and the keys' ``size``.

    One sort of all rows by keys and order; a key's first number is an aggregate of one row a key, joined back. So no
    window holds a key's rows. Null keys are keys.
    """
    rows = numbered(df, *keys, *order, name="_n")
    sizes = rows.groupBy(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).agg(F.min("_n").alias("_first"), F.count("*").alias("size"))
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return rows.join(sizes, on).withColumn("place", F.col("_n") - F.col("_first")).drop("_n", "_first", *(f"_{i}" for i in range(len(keys))))


def prefix_sum(df: DataFrame, order: str, value: str, name: str = "before", block: int = 1 << 16) -> DataFrame:
    """Rows with the sum of ``value`` over all rows before them by the whole number ``order``.

    Sums within blocks of ``order``, and a prefix sum over one row a block, so no task holds all rows.
    """
    at = F.floor(F.col(order) / block)
    rows = df.withColumn("_k", at)
    sizes = rows.groupBy("_k").agg(F.sum(value).alias("_s"))
    before = sizes.select("_k", F.coalesce(F.sum("_s").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_o", own).join(before, "_k").withColumn(name, F.col("_b") + F.col("_o")).drop("_k", "_o", "_b")


def assign_ranges(points: DataFrame, starts: DataFrame, at: str, name: str, keys: tuple[str, ...] = (), block: int = 1 << 16) -> DataFrame:
    """Rows of ``points`` with the ``name`` of the last of ``starts`` (at, name) that isn't behind them, else null.

    Both are one sorted stream, cut into blocks of ``block`` values of the whole number ``at``. Within a block a window
    carries the last start forward; what a block begins with is the last start of the blocks before, found over one row a
    block. A range of any length is spread over blocks, and nothing is made for places that hold no point. Of starts at
    one place the largest ``name`` counts. ``keys`` keep streams apart. A null ``at`` gets null; null names are no starts.
    """
    k, g = F.floor(F.col(at) / block).alias("k"), [f"g{i}" for i in range(len(keys))]
    named = [F.col(c).alias(x) for c, x in zip(keys, g)]
    own = starts.filter(F.col(at).isNotNull() & F.col(name).isNotNull()).select(*named, F.col(at).alias("a"), F.col(name).alias("s"), k, F.lit(0).alias("p"))
    rows = points.drop(name).select(*named, F.col(at).alias("a"), k, F.lit(1).alias("p"), F.struct("*").alias("row"))
    both = rows.unionByName(own, allowMissingColumns=True)
    inside = F.last("s", ignorenulls=True).over(Window.partitionBy(*g, "k").orderBy("a", "p", "s").rowsBetween(Window.unboundedPreceding, 0))
    last = both.groupBy(*g, "k").agg(F.max(F.when(F.col("p") == 0, F.struct("a", "s")))["s"].alias("l"))  # a row a block that holds any
    before = last.withColumn("b", F.last("l", ignorenulls=True).over(Window.partitionBy(*(g or [F.lit(0)])).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    joined = both.withColumn("i", inside).filter("p = 1").alias("x").join(before.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*g, "k")], "left")
    return joined.select("x.row.*", F.when(F.col("x.a").isNotNull(), F.coalesce("x.i", "y.b")).alias(name))


def first_seen_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Codes 0, 1, ... of the values of a column in order of first appearance (one row a value)."""
    first = df.groupBy(column).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return numbered(first, "first", column, name="code")


def group_classes(df: DataFrame, label: str, order: str) -> DataFrame:
    """Rows with their class code (first seen), place within the class and place in class order."""
    codes = first_seen_codes(df, label, order)
    own = prefix_sum(codes, "code", "n", "start").select(label, F.col("code").cast("long").alias("code"), "start")
    return places(df, [label], order).drop("size").join(own, label).withColumn("position", F.col("start") + F.col("place")).drop("start")


def folds(df: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """Contiguous folds within each class, the last takes the remainder, nothing is shuffled."""
    fold = F.least(F.floor(F.col("place") / F.greatest(F.floor(F.col("size") / k), F.lit(1))), F.lit(k - 1)).cast("long")
    return places(df, [label], order).withColumn("fold", fold).drop("place", "size")


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """1 where more than half of the 0/1 labels are 1; a tie is 0."""
    return df.groupBy(*keys).agg((2 * F.sum(label) > F.count("*")).cast("int").alias("vote"))


def one_vs_one(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of pairwise decisions (ci, cj, dec): dec > 0 is for ci, else cj; most votes win, smaller class on ties."""
    votes = decisions.select(*keys, F.when(F.col("dec") > 0, F.col("ci")).otherwise(F.col("cj")).alias("class"))
    return arg_max(votes.groupBy(*keys, "class").agg(F.count("*").alias("votes")), keys, "votes", "class")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], column: str) -> Column:
    """The last non-null value so far."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, keys: list[str], order: list[str], above: Column) -> DataFrame:
    """Number the runs of rows with equal ``above`` within each key (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(above.eqNullSafe(F.lag(above).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur more than once, by all given columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def working_set(df: DataFrame, q: int) -> DataFrame:
    """q / 2 rows of ``up`` with the smallest and q / 2 of ``low`` with the largest f, the latter not chosen already."""
    a = df.filter("up").orderBy("f", "i").limit(q // 2)
    b = df.filter("low").join(a.select("i"), "i", "left_anti").orderBy(F.desc("f"), F.desc("i")).limit(q // 2)
    return a.withColumn("side", F.lit("up")).unionByName(b.withColumn("side", F.lit("low")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate with the union of all columns; absent ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
