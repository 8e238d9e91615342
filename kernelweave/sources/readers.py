"""Readers of matrices, graphs, points, models and records; each returns a DataFrame with a fixed schema.

Text formats go through Spark's text reader; line numbers come from (file, block, order in the block), never from one
task. Binary formats are read by byte ranges (``sources/ranges``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.operators import stats
from kernelweave.session import prepare, stored
from kernelweave.sources import ranges


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value: numbering is a prefix sum over blocks plus the place within a block."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("m")) - 1
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return raw.withColumn("place", place).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), "value")


def number(c: Column) -> Column:
    """Text to number as C does it: the leading number, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1).try_cast("double"), F.lit(0.0))


def csv_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """i, j, v; a row whose width differs from the first row's is an error."""
    cells = lines(spark, path).filter("trim(value) <> ''").select(F.col("line").alias("i"), F.split("value", f"\\Q{sep}\\E").alias("c"))
    width = F.broadcast(cells.orderBy("i").limit(1).select(F.size("c").alias("w")))
    checked = cells.crossJoin(width).withColumn("c", F.when(F.size("c") == F.col("w"), F.col("c")).otherwise(F.raise_error(F.lit("row width differs from the first row's"))))
    return checked.select("i", F.posexplode("c").alias("j", "t")).select("i", "j", number(F.col("t")).alias("v"))


def csv_vector(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """i, v of the last line."""
    last = lines(spark, path).filter("trim(value) <> ''").orderBy(F.desc("line")).limit(1)
    return last.select(F.posexplode(F.split("value", f"\\Q{sep}\\E")).alias("i", "t")).select("i", number(F.col("t")).alias("v"))


def csv_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """i, value: the fields of the last line as text."""
    last = lines(spark, path).filter("trim(value) <> ''").orderBy(F.desc("line")).limit(1)
    return last.select(F.posexplode(F.split("value", f"\\Q{sep}\\E")).alias("i", "value"))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines ``id: j j ... -1``."""
    parts = spark.read.text(path).select(F.split("value", ":").alias("p")).filter(F.size("p") == 2)
    ids = F.split(F.trim(F.col("p")[1]), r"\s+")
    return parts.select(F.trim(F.col("p")[0]).try_cast("long").alias("src"), F.explode(ids).alias("d")).select("src", F.col("d").try_cast("long").alias("dst")).filter("dst >= 0")


def csr_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of ``n e``, n row pointers and e column ids in one file of numbers (row pointers may also number n + 1).

    A column id at place k belongs to the row whose pointers enclose k: the last row start is carried forward through
    blocks of places, so a row of any length is rows of a table and never an array. No numbers give no edges.
    """
    tokens = lines(spark, path).select("line", F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("c", "t"))
    before = stats.prefix_sum(tokens.groupBy("line").agg(F.count("*").alias("m")), "line", "m", "b").select("line", "b")
    at = stored(tokens.join(before, "line").select((F.col("b") + F.col("c")).alias("k"), F.col("t").cast("long").alias("x")), "numbers")
    n, e, total = at.agg(F.max(F.when(F.col("k") == 0, F.col("x"))), F.max(F.when(F.col("k") == 1, F.col("x"))), F.count("*")).first()
    if not n or not e:
        return spark.createDataFrame([], "src long, dst long")
    starts = at.filter((F.col("k") >= 2) & (F.col("k") < n + 2)).select((F.col("k") - 2).alias("src"), F.col("x").alias("k"))
    ids = at.filter(F.col("k") >= total - e).select((F.col("k") - (total - e)).alias("k"), F.col("x").alias("dst"))
    return stats.assign_ranges(ids, starts, "k", "src").filter("src IS NOT NULL").select("src", "dst")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """i, j, v (from 0) of a coordinate file; a symmetric one is made whole."""
    rows = lines(spark, path)
    banner = rows.filter("line = 0").first()["value"].lower().split()
    if "coordinate" not in banner:
        raise ValueError("only coordinate files")
    body = rows.filter("NOT startswith(value, '%') AND trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    first = F.broadcast(body.agg(F.min("line").alias("size_line")))
    cells = body.crossJoin(first).filter("line > size_line")
    value = F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0))
    out = cells.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), value.alias("v"))
    return out.unionByName(out.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")) if "symmetric" in banner else out


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """row_id, label, x MAP<INT, DOUBLE> of lines ``label index:value ...``."""
    rows = lines(spark, path).filter("trim(value) <> ''").select("line", F.split(F.trim("value"), r"\s+").alias("p"))
    pairs = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda t: F.struct(F.split(t, ":")[0].cast("int"), F.split(t, ":")[1].cast("double")))
    return rows.select(F.col("line").alias("row_id"), F.col("p")[0].cast("double").alias("label"), F.map_from_entries(pairs).alias("x"))


def dense_rows(sparse: DataFrame, width: int) -> DataFrame:
    """id, coords, label of libsvm rows with absent features as 0."""
    at = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.col("x")[i], F.lit(0.0)))
    return sparse.select(F.col("row_id").alias("id"), at.alias("coords"), "label")


def points_text(spark: SparkSession, path: str) -> DataFrame:
    """id (place in the file), coords of lines ``name c1 c2 ...``; the name is dropped, blank lines are skipped."""
    rows = lines(spark, path).filter("trim(value) <> ''").select("file", "line", F.split(F.trim("value"), r"[ ,\t]+").alias("p"))
    return rows.select(F.col("line").alias("id"), F.transform(F.slice("p", F.lit(2), F.size("p")), lambda t: t.cast("float").cast("double")).alias("coords"))


def points_binary(spark: SparkSession, path: str, **options) -> DataFrame:
    """id, coords of int32 n, int32 d and n * d float32: by byte ranges, ids run through all files in path order."""
    return _binary(spark, path, "points", options)


def _binary(spark: SparkSession, path: str, kind: str, options: dict) -> DataFrame:
    """By byte ranges where Arrow opens the path; from a store that only Spark reads, a file is one row of 2 GB at most."""
    if ranges.readable(path):
        return ranges.read_records(spark, path, kind, **options)
    prepare(spark)
    raw = spark.read.format("binaryFile").load(path)
    first = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)

    def counts(parts):
        for p in parts:
            n = [ranges._layout(kind, data[:16], len(data), options).count for data in p["content"]]
            yield pd.DataFrame({"path": p["path"], "n": n})

    sizes = raw.select("path", "content").mapInPandas(counts, "path string, n long")  # a row a file
    numbered = sizes.select("path", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("number"))

    def run(parts):
        for p in parts:
            for data, number in zip(p["content"], p["number"]):
                own = ranges._layout(kind, data[:16], len(data), options)
                yield ranges._batch(kind, data[own.offset : own.offset + own.size * own.count], number, own, options).to_pandas()

    return raw.join(F.broadcast(numbered), "path").select("content", "number").mapInPandas(run, ranges.SCHEMAS[kind])


def labelled_table(spark: SparkSession, path: str) -> DataFrame:
    """row_id, features of a table file: ``rows cols``, a line of categories per column, then rows of numbers."""
    rows = lines(spark, path)
    cols = int(rows.filter("line = 0").first()["value"].split()[1])
    body = rows.filter((F.col("line") > cols) & (F.trim("value") != ""))
    return body.select((F.col("line") - cols - 1).alias("row_id"), F.transform(F.split(F.trim("value"), r"[\s,]+"), number).alias("features"))


def table_categories(spark: SparkSession, path: str) -> DataFrame:
    """col, code, value of a table file's category lines (``count,value,value,...``); numeric columns have none."""
    rows = lines(spark, path)
    cols = int(rows.filter("line = 0").first()["value"].split()[1])
    parts = rows.filter((F.col("line") >= 1) & (F.col("line") <= cols)).select((F.col("line") - 1).alias("col"), F.split("value", ",").alias("p"))
    named = parts.filter(number(F.col("p")[0]) > 0).select("col", F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("code", "value"))
    return named.select("col", "code", "value")


def encode_table(rows: DataFrame, columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with numbers, dictionary col, code, value). A column of numbers alone stays as it is; the values of another
    become codes in order of first appearance. One pass tells which columns are numeric."""
    numeric = rows.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()), F.lit(True)).alias(c) for c in columns)).first()
    out, found = rows, []
    for k, c in enumerate(columns):
        if numeric[c]:
            out = out.withColumn(c, F.col(c).try_cast("double"))
        else:
            codes = stats.first_seen_codes(rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("value"), order), "value", order).select("value", F.col("code").cast("double").alias("_code"))
            out = out.join(codes.withColumnRenamed("value", c), c, "left").drop(c).withColumnRenamed("_code", c)
            found.append(codes.select(F.lit(k).alias("col"), F.col("_code").cast("int").alias("code"), "value"))
    empty = rows.sparkSession.createDataFrame([], "col int, code int, value string")
    return out.select(*rows.columns), stats.union_all([empty, *found])


def csr_rows(spark: SparkSession, indptr: list[int], indices: list[int], data: list[float], labels: list[float]) -> DataFrame:
    """row_id, label, x MAP<INT, DOUBLE> of compressed rows in memory; feature numbers start at 1 as in a LIBSVM file."""
    rows = [(i, float(labels[i]), {int(indices[k]) + 1: float(data[k]) for k in range(indptr[i], indptr[i + 1])}) for i in range(len(indptr) - 1)]
    return spark.createDataFrame(rows, "row_id long, label double, x map<int,double>")


def array_rows(spark: SparkSession, values, labels) -> DataFrame:
    """id, coords, label of an array of rows in memory."""
    return spark.createDataFrame([(i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(values, labels))], "id long, coords array<double>, label double")


def truths(spark: SparkSession, path: str) -> DataFrame:
    """img, truth: the last line of each file of a folder, in no order; sort by ``img`` for a listing."""
    rows = lines(spark, path).withColumn("img", F.element_at(F.split("file", "/"), -1))
    return rows.groupBy("img").agg(F.max_by("value", "line").alias("truth"))


def lstm_weights(spark: SparkSession, path: str, inputs: int = 25, cells: int = 100, classes: int = 110) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(weights of one direction, output weights or none) of a text file of numbers.

    Four matrices of cells x (1 + inputs + cells) come first (input, forget, output and cell gate: bias, inputs, cells),
    then three vectors of peepholes, then, where the file has them, classes x (1 + 2 cells) output weights. Another count
    is an error. The file is a model of bounded size and is read to the driver.
    """
    x = np.array([float(v) for r in lines(spark, path).orderBy("line").collect() for v in r["value"].split()])
    width, tail = 1 + inputs + cells, classes * (1 + 2 * cells)
    n = 4 * cells * width + 3 * cells
    if len(x) not in (n, n + tail):
        raise ValueError(f"{len(x)} numbers; {n} or {n + tail} are expected")
    gates = x[: 4 * cells * width].reshape(4, cells, width)
    own = {"bias": gates[:, :, 0], "w_x": gates[:, :, 1 : 1 + inputs], "w_h": gates[:, :, 1 + inputs :], "peep": x[4 * cells * width : n].reshape(3, cells)}
    return own, x[n:].reshape(-1, 1 + 2 * cells)


def records(spark: SparkSession, path: str, height: int = 32, width: int = 32, depth: int = 3, **options) -> DataFrame:
    """id, label, pixels (height, width, depth order) of records of one label byte and depth * height * width bytes."""
    return _binary(spark, path, "records", {"height": height, "width": width, "depth": depth, **options})


def floats(spark: SparkSession, path: str, width: int, **options) -> DataFrame:
    """row, v: raw float32 values as rows of ``width``."""
    return _binary(spark, path, "floats", {"width": width, **options})


def idx_images(spark: SparkSession, path: str, pad: int = 2, **options) -> DataFrame:
    """img, pixels of an idx3 file: values on -1..1, ``pad`` pixels of -1 around."""
    return _binary(spark, path, "idx", {"pad": pad, **options})


def words(spark: SparkSession, path: str) -> DataFrame:
    """pos, word: newline becomes ``<eos>``, cut at white space."""
    parts = lines(spark, path).select("line", F.concat(F.filter(F.split("value", r"\s+"), lambda x: x != ""), F.array(F.lit("<eos>"))).alias("w"))
    return stats.prefix_sum(parts.withColumn("n", F.size("w")), "line", "n", "b").select("b", F.posexplode("w").alias("c", "word")).select((F.col("b") + F.col("c")).alias("pos"), "word")


def line_images(spark: SparkSession, path: str, height: int = 25) -> DataFrame:
    """img, col, px of files of white-space separated numbers, ``height`` a column; the directory's files in name order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("img"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("p"))
    n = F.size("p")
    checked = raw.withColumn("p", F.when(n % height == 0, F.col("p")).otherwise(F.raise_error(F.lit("length is no multiple of the height"))))
    cols = checked.filter(F.size("p") > 0).select("img", "p", F.explode(F.sequence(F.lit(0), F.expr(f"size(p) div {height}") - 1)).alias("col"))
    return cols.select("img", "col", F.transform(F.slice("p", (F.col("col") * height + 1).cast("int"), F.lit(height)), lambda t: t.cast("double")).alias("px"))


def alphabet(spark: SparkSession, path: str) -> DataFrame:
    """label, symbol: the line number is the label, blank lines count."""
    return lines(spark, path).select(F.col("line").cast("int").alias("label"), F.col("value").alias("symbol"))


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """Key and rest of each line; later keys win."""
    rows = lines(spark, path).filter("trim(value) <> '' AND NOT startswith(value, '#')").select("line", F.split(F.trim("value"), r"\s+", 2).alias("p")).orderBy("line").collect()
    return {r["p"][0]: (r["p"][1] if len(r["p"]) > 1 else "") for r in rows}


def svm_model(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(header, support vectors: coef ARRAY<DOUBLE>, x MAP<INT, DOUBLE>); a kernel's name is read from its value."""
    rows = lines(spark, path)
    cut = rows.filter("trim(value) = 'SV'").agg(F.min("line")).first()[0]
    head = {r["value"].split(" ", 1)[0]: r["value"].split(" ", 1)[-1] for r in rows.filter(F.col("line") < cut).collect()}
    body = rows.filter(F.col("line") > cut).filter("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    pairs = F.transform(F.filter("p", lambda t: F.contains(t, F.lit(":"))), lambda t: F.struct(F.split(t, ":")[0].cast("int"), F.split(t, ":")[1].cast("double")))
    return head, body.select(F.transform(F.filter("p", lambda t: ~F.contains(t, F.lit(":"))), lambda t: t.cast("double")).alias("coef"), F.map_from_entries(pairs).alias("x"))


def sensors(spark: SparkSession, path: str) -> DataFrame:
    """sensor, sample, t, acc, up of a CSV with a header of names and rows of three fields a sensor."""
    rows = lines(spark, path).filter("trim(value) <> ''")
    names = rows.filter("line = 0").select(F.split("value", ",").alias("names"))
    body = rows.filter("line > 0").select((F.col("line") - 1).cast("int").alias("sample"), F.posexplode(F.split("value", ",")).alias("k", "t"))
    cells = body.groupBy("sample", F.expr("k div 3").alias("s")).agg(*(F.max(F.when(F.col("k") % 3 == i, F.col("t").try_cast("double"))).alias(c) for i, c in enumerate(("t", "acc", "up"))))
    return cells.crossJoin(F.broadcast(names)).select(F.trim(F.get("names", F.col("s").cast("int"))).alias("sensor"), "sample", "t", "acc", "up")


def uniform(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """i, v: uniform numbers."""
    return spark.range(n).select(F.col("id").alias("i"), F.rand(seed).alias("v"))


def _register_steps(state: int, taps: int, n: int) -> np.ndarray:
    """The next ``n`` states of a shift register: one step shifts right and, where a one falls out, flips the taps."""
    out = np.empty(n, np.int64)
    for k in range(n):
        state = (state >> 1) ^ (taps if state & 1 else 0)
        out[k] = state
    return out


def register_after(state: int, steps: int, taps: int, bits: int = 32) -> int:
    """The state after any number of steps. A step is linear over GF(2): a matrix of bits, whose columns are what it makes
    of each bit; its powers of two are found by squaring, so ``steps`` costs its logarithm."""
    column = [(1 << k >> 1) ^ (taps if k == 0 else 0) for k in range(bits)]

    def apply(matrix: list[int], v: int) -> int:
        out = 0
        while v:
            low = v & -v
            out ^= matrix[low.bit_length() - 1]
            v ^= low
        return out

    while steps:
        if steps & 1:
            state = apply(column, state)
        column, steps = [apply(column, v) for v in column], steps >> 1
    return state


def shift_register(spark: SparkSession, n: int, seed: int = 1, taps: int = 0xB4BCD35C, bits: int = 32, tasks: int | None = None, block: int = 1 << 16) -> DataFrame:
    """i, v of the first ``n`` states behind ``seed`` of a linear feedback shift register; v is signed where bit 31 is set.

    Blocks start at states that are jumped to, so tasks need nothing of each other and their number changes nothing.
    """
    prepare(spark)

    def run(parts):
        for p in parts:
            for b in p["id"]:
                first = int(b) * block
                v = _register_steps(register_after(seed, first, taps, bits), taps, min(block, n - first))
                yield pd.DataFrame({"i": np.arange(first, first + len(v)), "v": np.where(v >= 1 << 31, v - (1 << 32), v)})

    return spark.range(0, -(-n // block), 1, tasks).mapInPandas(run, "i long, v long")


def step_signal(spark: SparkSession, n: int, at: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """i, v: ``low`` before place ``at`` and ``high`` from it on."""
    return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") < at, F.lit(float(low))).otherwise(F.lit(float(high))).alias("v"))


def box_grid(spark: SparkSession, shape: tuple[int, ...], inner: float = 0.0, outer: float = 1.0, top: float | None = None, bottom: float | None = None) -> DataFrame:
    """i, j (, k), v of a grid with one value inside and one on its faces; ``top`` and ``bottom`` are those of the first axis."""
    axes, place, size = "ijk"[: len(shape)], F.col("id"), int(np.prod(shape))
    cols = []
    for a, n in zip(axes[::-1], shape[::-1]):
        cols.append((place % n).cast("long").alias(a))
        place = F.floor(place / n)
    cells = spark.range(size).select(*cols[::-1])
    face = F.lit(False)
    for a, n in zip(axes, shape):
        face = face | (F.col(a) == 0) | (F.col(a) == n - 1)
    value = F.when(face, float(outer)).otherwise(float(inner))
    value = F.when(F.col("i") == shape[0] - 1, float(bottom)).otherwise(value) if bottom is not None else value
    return cells.withColumn("v", F.when(F.col("i") == 0, float(top)).otherwise(value) if top is not None else value)
