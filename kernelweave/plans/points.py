"""Clustering and nearest neighbours over points (id, coords ARRAY<DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.operators import stats
from kernelweave.session import discard, prepare, stored


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def first_rows(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """Starting centres: the k rows with the smallest ids."""
    return [(i, list(map(float, r["coords"]))) for i, r in enumerate(points.orderBy("id").limit(k).collect())]


def assign(points: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """id, coords, cluster, dist: the nearest centre, the smaller number on ties. A projection, no join: centres are k rows."""
    each = F.array(*(F.struct(squared(F.col("coords"), F.array(*map(F.lit, c))).alias("dist"), F.lit(k).alias("cluster")) for k, c in centres))
    return points.withColumn("_b", F.array_min(each)).select("id", "coords", F.col("_b.cluster").alias("cluster"), F.col("_b.dist").alias("dist"))


def centroids(assigned: DataFrame) -> DataFrame:
    """cluster, dim, v, n: mean of each coordinate by partial and final aggregation over (cluster, dim) rows."""
    long = assigned.select("cluster", F.posexplode("coords").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.avg("x").alias("v"), F.count("*").alias("n"))


def kmeans(points: DataFrame, k: int, threshold: float = 0.001, max_iter: int = 500, centres: list | None = None) -> tuple[list[tuple[int, list[float]]], DataFrame]:
    """(centres, assigned points). Stops when no more than ``threshold`` of the points change; an empty cluster keeps its centre.

    Only k centres reach the driver in a step; memberships stay in the shared folder.
    """
    spark = prepare(points.sparkSession)
    centres = centres or first_rows(points, k)
    before: DataFrame | None = None
    total = points.count()
    own = assign(points, centres)
    for _ in range(max_iter):
        own = stored(assign(points, centres), "members")
        changed = total if before is None else own.select("id", "cluster").join(before.select("id", F.col("cluster").alias("c")), "id").filter("c <> cluster").count()
        old = dict(centres)
        for r in centroids(own).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("c")).collect():
            old[r["cluster"]] = [x["v"] for x in r["c"]]
        if before is not None:
            discard(before)
        centres, before = sorted(old.items()), own
        if not total or changed / total <= threshold:
            break
    return centres, own


def kmeans_steps(points: DataFrame, k: int, steps: int) -> DataFrame:
    """cluster, dim, v, n after a fixed number of steps."""
    centres = first_rows(points, k)
    for s in range(steps):
        found = centroids(assign(points, centres))
        if s == steps - 1:
            return found
        own = dict(centres)
        for r in found.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("c")).collect():
            own[r["cluster"]] = [x["v"] for x in r["c"]]
        centres = sorted(own.items())
    raise ValueError("steps must be at least 1")


def nearest(points: DataFrame, queries: DataFrame, k: int, block: int = 1 << 16, block_bytes: int = 16 << 20) -> DataFrame:
    """query, id, dist, rank (from 0) of the k + 1 nearest points of each query row, by (dist, id).

    Queries are numbered by a sort over all tasks and come in blocks of at most ``block`` rows and ``block_bytes``, each broadcast to one pass
    over all points; the driver sees one block at a time and no list of ids. A task keeps its own best k + 1 of each query
    as arrays, so k + 1 rows a task and query are shuffled and no table of pairs is made. Null coords are nobody's
    neighbour and get no rows; coords of another length are an error.
    """
    spark = prepare(points.sparkSession)
    rows = stats.numbered(queries.filter("coords IS NOT NULL").select("id", F.col("coords").cast("array<double>").alias("coords")), "id")
    n, width = rows.agg(F.count("*"), F.max(F.size("coords"))).first()
    out: DataFrame | None = None
    step = max(1, min(block, block_bytes // (8 * max(1, width or 1))))
    for s in range(0, n, step):
        part = rows.filter(F.col("n").between(s, s + step - 1)).select("id", "coords").toPandas()  # one block
        held = spark.sparkContext.broadcast((part["id"].to_numpy(), np.stack(part["coords"].to_numpy())))

        def run(batches, held=held):
            name, q = held.value
            ids, dist = np.zeros((len(name), k + 1), np.int64), np.full((len(name), k + 1), np.inf)
            for b in batches:
                own = [v for v in zip(b["id"], b["coords"]) if v[1] is not None]
                if not own:
                    continue
                x, at = np.stack([v[1] for v in own]).astype(np.float64), np.array([v[0] for v in own], np.int64)
                for i in range(len(name)):
                    d = ((x - q[i]) ** 2).sum(1)
                    near = np.flatnonzero(d <= dist[i, -1])  # ties with the last are looked at too
                    if len(near) > k + 1:
                        near = near[d[near] <= np.partition(d[near], k)[k]]
                    if len(near):
                        kept = np.isfinite(dist[i])
                        both, who = np.concatenate((dist[i, kept], d[near])), np.concatenate((ids[i, kept], at[near]))
                        best = np.lexsort((who, both))[: k + 1]
                        dist[i, : len(best)], ids[i, : len(best)] = both[best], who[best]
            found = np.isfinite(dist)
            if found.any():
                yield pd.DataFrame({"query": np.repeat(name, found.sum(1)), "id": ids[found], "dist": dist[found]})

        found = points.select("id", "coords").mapInPandas(run, "query long, id long, dist double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query long, id long, dist double, rank int")
    w = Window.partitionBy("query").orderBy("dist", "id")
    return out.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") <= k)


def knn_votes(points: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, vote: majority of the 0/1 labels of ranks 1 to k (rank 0 is the query itself); a tie is 0."""
    found = nearest(points, queries, k).filter("rank > 0")
    return stats.majority(found.join(labels.select("id", "label"), "id"), ["query"], "label")


def knn_evaluate(points: DataFrame, labels: DataFrame, samples: int | DataFrame, k: int) -> DataFrame:
    """Confusion counts of query rows (or of the first ``samples`` rows) voted on by all rows."""
    queries = points.orderBy("id").limit(samples) if isinstance(samples, int) else samples
    votes = knn_votes(points, labels, queries, k)
    return stats.confusion(votes.join(labels.select(F.col("id").alias("query"), "label"), "query"), "label", "vote")
