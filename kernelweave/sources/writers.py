"""Writers; each lets Spark write in parallel, one file a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_matrix(m: DataFrame, path: str, sep: str = ",") -> None:
    """One line a row of (i, j, v), all cells given, numbers with 20 digits after the point."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: F.format_string("%.20f", x["v"])), sep)
    m.groupBy("i").agg(row.alias("value")).orderBy("i").select("value").write.text(path)


def csv_vector(x: DataFrame, path: str, sep: str = ",") -> None:
    csv_matrix(x.select(F.lit(0).alias("i"), F.col("i").alias("j"), "v"), path, sep)


def clusters(centres: DataFrame, members: DataFrame, path: str) -> None:
    """``path.cluster_centres`` (id coords) and ``path.membership`` (id cluster)."""
    coords = F.array_join(F.transform("coords", lambda x: F.format_string("%f", x)), " ")
    centres.orderBy("cluster").select(F.concat_ws(" ", "cluster", coords).alias("value")).write.text(f"{path}.cluster_centres")
    members.orderBy("id").select(F.concat_ws(" ", "id", "cluster").alias("value")).write.text(f"{path}.membership")


def svm_model(models: DataFrame, path: str, header: dict[str, str]) -> None:
    """A header and lines ``coef index:value ...``; numbers with 16 and 8 digits."""
    pairs = F.zip_with("coords", F.sequence(F.lit(1), F.size("coords")), lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), F.format_string("%.8g", v))))
    body = models.select(F.concat_ws(" ", F.format_string("%.16g", "coef"), F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " ")).alias("value"))
    head = models.sparkSession.createDataFrame([(0, "\n".join([*(f"{k} {v}" for k, v in header.items()), "SV"]))], "o int, value string")
    head.unionByName(body.withColumn("o", F.lit(1))).repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)  # the format is one file


def labels(predictions: DataFrame, path: str, column: str = "label") -> None:
    predictions.orderBy("id").select(F.col(column).cast("string").alias("value")).write.text(path)


def results(long: DataFrame, path: str) -> None:
    """dIdx;pIdx;rIdx;Sensor;Value."""
    long.select("dIdx", "pIdx", "rIdx", "Sensor", "Value").write.option("sep", ";").option("header", True).csv(path)


def log(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def accuracy(value: DataFrame, path: str) -> None:
    """The first column of one row with four digits."""
    value.limit(1).select(F.format_string("%.4f", value.columns[0]).alias("value")).write.text(path)
