"""Measurement records: parse, unpivot, summarise, join sensors, tabulate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.operators import stats
from kernelweave.session import stored
from kernelweave.sources import readers


def power_average(acc1: Column, acc2: Column, up1: Column, up2: Column) -> Column:
    """Mean between two samples of an accumulating counter; null where no update lies between."""
    return F.try_divide((acc2 - acc1).cast("double"), (up2 - up1).cast("double"))


def summary(long: DataFrame, keys: list[str], value: str = "Value") -> DataFrame:
    return stats.moments(long, keys, value)


def select(long: DataFrame, sensor: str) -> DataFrame:
    """Rows of one sensor; blanks around names don't count."""
    return long.filter(F.trim("Sensor") == sensor.strip())


def energy(long: DataFrame, power0: str, power1: str, time: str) -> DataFrame:
    """dIdx, pIdx, rIdx, energy = (P0 + P1) * t / 1000, joined by run and not by position: one conditional aggregate."""
    name = F.trim("Sensor")
    of = lambda s: F.max(F.when(name == s, F.col("Value")))
    wide = long.groupBy("dIdx", "pIdx", "rIdx").agg(of(power0).alias("p0"), of(power1).alias("p1"), of(time).alias("t"))
    return wide.filter("p0 IS NOT NULL AND p1 IS NOT NULL AND t IS NOT NULL").select("dIdx", "pIdx", "rIdx", ((F.col("p0") + F.col("p1")) * F.col("t") / 1000).alias("energy"))


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, value of lines like ``# key: value``; other lines are left out."""
    key = F.regexp_extract(column, r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$", 1)
    return lines.select("*", key.alias("_k"), F.regexp_extract(column, r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$", 2).alias("_v")).filter("_k <> ''").drop(column).withColumnsRenamed({"_k": "key", "_v": "value"})


def tabulate(frames: list[DataFrame]) -> DataFrame:
    return stats.union_all(frames)


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """dIdx, pIdx, rIdx, Sensor, Value of a folder of measurements, three files each: ``..d_p_r_header.csv`` (sensor names),
    ``.._data.csv`` (two lines of three fields a sensor: time, accumulator, updates) and ``.._time.csv`` (clock, wall).

    A value is the accumulator's growth an update, null where there was no update; the two times come as sensors
    TIME_CLOCK and TIME_WALL. An error: data of other than two lines, a width that isn't three times the header's, counters that
    fall, or measurements of different numbers of sensors. Files are read side by side and meet in one aggregate.
    """
    name = r"(\d+)_(\d+)_(\d+)_(header|data|time)\.csv$"
    at = lambda k: F.regexp_extract("file", name, k)
    rows = readers.lines(spark, path).filter(F.rlike("file", F.lit(name)) & (F.trim("value") != ""))
    keys = ["dIdx", "pIdx", "rIdx"]
    rows = rows.select(*(at(k + 1).cast("int").alias(c) for k, c in enumerate(keys)), at(4).alias("kind"), "line", F.posexplode(F.split("value", ",")).alias("k", "t"))
    rows = stored(rows, "measurements")
    header = rows.filter("kind = 'header'").select(*keys, F.col("k").alias("s"), F.trim("t").alias("Sensor"))
    data = rows.filter("kind = 'data'").withColumns({"v": readers.number(F.col("t")), "s": F.expr("k div 3").cast("int"), "f": F.col("k") % 3})
    first = F.min("line").over(Window.partitionBy(*keys))
    cell = lambda r, f: F.max(F.when((F.col("late") == r) & (F.col("f") == f), F.col("v")))
    growth = data.withColumn("late", (F.col("line") > first).cast("int")).groupBy(*keys, "s").agg(F.count_distinct("line").alias("lines"), F.count("*").alias("cells"), *(cell(r, f).alias(c) for c, r, f in (("a1", 0, 1), ("a2", 1, 1), ("u1", 0, 2), ("u2", 1, 2))))
    both = header.join(growth, [*keys, "s"], "full_outer")
    bad = F.when(F.col("Sensor").isNull() | F.col("cells").isNull() | (F.col("cells") % 3 != 0), "data must have three fields a sensor").when((F.col("lines") != 2) | (F.col("cells") != 6), "data must have two lines").when((F.col("a2") < F.col("a1")) | (F.col("u2") < F.col("u1")), "a counter falls")
    value = F.try_divide(F.col("a2") - F.col("a1"), F.col("u2") - F.col("u1"))
    sensors = both.select(*keys, "Sensor", F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(value).alias("Value"))
    times = rows.filter("kind = 'time' AND k < 2").select(*keys, F.when(F.col("k") == 0, "TIME_CLOCK").otherwise("TIME_WALL").alias("Sensor"), readers.number(F.col("t")).alias("Value"))
    sizes = header.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"))  # one row
    checked = sensors.crossJoin(F.broadcast(sizes)).filter(F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.lit("numbers of sensors differ")).cast("boolean")))
    return checked.drop("low", "high").unionByName(times)


def measurement_summary(spark: SparkSession, path: str) -> DataFrame:
    """dIdx, pIdx, Sensor, n, mean, dev (sample deviation, null for one) over the repetitions of a folder of measurements."""
    rows = measurements(spark, path)
    return rows.groupBy("dIdx", "pIdx", "Sensor").agg(F.count("Value").alias("n"), F.avg("Value").alias("mean"), F.nullif(F.stddev_samp("Value"), F.lit(float("nan"))).alias("dev"))


def tabularise(spark: SparkSession, path: str) -> DataFrame:
    """file, line and a column for each field, of CSV files with ``#`` lines among the data.

    ``# key: value`` holds for all data lines that follow in its file until the key comes again; ``# a, b, c`` names the
    fields of those that follow. Fields come in order of first appearance by file and line, as text, null where a line
    has none; a field of the header wins over a key of the same name. Data lines before any header have keys only.

    What holds at a line is the last start before it, carried forward through blocks of lines, so a file may have any
    number of lines. The driver sees the names of the fields.
    """
    rows = readers.lines(spark, path).select("file", "line", F.trim("value").alias("value")).filter("value <> ''")
    mark = F.startswith("value", F.lit("#"))
    rest, key = F.trim(F.expr("substring(value, 2)")), r"^(.*?)\s*:\s*(.*?)$"
    rows = stored(rows.select("file", "line", mark.alias("mark"), F.when(mark, rest).otherwise(F.col("value")).alias("value")), "lines")
    held = rows.filter("mark").withColumns({"key": F.regexp_extract("value", key, 1), "own": F.rlike("value", F.lit(key))})
    sticky = held.filter("own").select("file", "line", "key", F.regexp_extract("value", key, 2).alias("v"))
    heads = held.filter("NOT own").select("file", F.col("line").alias("head"), F.split("value", r"\s*,\s*").alias("names"))
    data = rows.filter("NOT mark").select("file", "line", F.split("value", r"\s*,\s*").alias("cells"))
    seen = sticky.select("file", "line", F.lit(0).alias("k"), F.col("key").alias("name")).unionByName(heads.select("file", F.col("head").alias("line"), F.posexplode("names").alias("k", "name")))
    names = [r["name"] for r in seen.groupBy("name").agg(F.min(F.struct("file", "line", "k")).alias("at")).orderBy("at").collect()]  # columns of the result
    named = stats.assign_ranges(data, heads.select("file", F.col("head").alias("line"), "head"), "line", "head", ("file",)).join(heads, ["file", "head"], "left")
    pairs = named.select("file", "line", F.explode(F.filter(F.arrays_zip("names", "cells"), lambda p: p["names"].isNotNull() & p["cells"].isNotNull())).alias("p")).select("file", "line", F.col("p.names").alias("name"), F.col("p.cells").alias("v"), F.lit(1).alias("from"))
    asked = data.select("file", "line").join(sticky.select("file", "key").distinct(), "file")  # as many cells as the result has
    keyed = stats.assign_ranges(asked, sticky.select("file", "key", "line", F.col("line").alias("at")), "line", "at", ("file", "key")).filter("at IS NOT NULL")
    kept = keyed.join(sticky.select("file", "key", F.col("line").alias("at"), "v"), ["file", "key", "at"]).select("file", "line", F.col("key").alias("name"), "v", F.lit(0).alias("from"))
    cells = pairs.unionByName(kept).groupBy("file", "line").pivot("name", names).agg(F.max_by("v", "from")) if names else data.select("file", "line")
    return data.select("file", "line").join(cells, ["file", "line"], "left") if names else cells
