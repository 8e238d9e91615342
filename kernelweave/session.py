"""Session helpers shared by all operators: worker import path, shared scratch tables, table reading."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure that a shared checkpoint folder is known.

    ``spark.checkpoint.dir`` is used as the cluster sets it. Where it is unset, a local master gets a temporary folder;
    on a cluster that is an error, for executors would write to disks that nobody else reads.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kernelweave-"))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing lazy reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of results that are written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
