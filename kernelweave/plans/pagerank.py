"""PageRank over an edge table. Dangling mass is one scalar a step, never n^2 edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.functions.precision import join_e3m13, quantise, split_e3m13
from kernelweave.operators import linalg
from kernelweave.session import discard, stored


def pagerank(
    edges: DataFrame,
    damping: float = 0.85,
    iterations: int | None = None,
    eps: float = 1e-6,
    max_iter: int = 200,
    norm: str = "l2",
    redistribute_leak: bool = False,
    codec: str | None = None,
) -> DataFrame:
    """i, v of every node of ``edges`` (src, dst, optional w).

    Each step is written to the shared folder: a step reads the last ranks several times, so without the cut the plan
    would grow as a power of the steps. The step before the last one is deleted. Stops after ``iterations``, or else when the change is at most ``eps``, measured
    by ``norm``. ``redistribute_leak`` gives what the ranks lost to rounding
    back to all nodes in equal parts and renormalises, as the 16-bit forms do, their sums being exact whatever the order;
    ``codec`` rounds ranks to such a form:
    'half', 'e6m10', 'single', or 'e3m13', where ranks are held as codes and a table of exceptions that are joined.
    """
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    m = edges.groupBy("src", "dst").agg(F.sum(w).alias("v"))
    nodes = m.select(F.col("src").alias("i")).union(m.select(F.col("dst").alias("i"))).distinct()
    out = linalg.row_sums(m.select(F.col("src").alias("i"), "v")).withColumnRenamed("v", "out")
    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a source of many edges is dealt in copies of at most a quarter of a task's share; few nodes have more than one
    limit = m.count() / (4 * tasks) + 1
    copies = F.greatest(F.ceil(F.col("edges") / limit), F.lit(1)).cast("int")
    degree = m.groupBy(F.col("src").alias("i")).agg(F.count("*").alias("edges")).select("i", copies.alias("copies"))
    nodes = nodes.join(out, "i", "left").join(degree, "i", "left")
    nodes = stored(nodes.select("i", (F.coalesce("out", F.lit(0.0)) == 0).alias("loose"), F.coalesce("copies", F.lit(1)).alias("copies")), "nodes")
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))  # one row
    share = linalg.normalise_rows(m.select(F.col("src").alias("i"), F.col("dst").alias("j"), "v"))
    # edges are dealt by source once and kept so: in a step only the ranks move. What is lost is dealt again from the stored table
    a = stored(linalg.transpose(share), "edges").join(nodes.select(F.col("i").alias("j"), "copies"), "j")
    a = a.select("i", "j", F.pmod(F.hash("i"), F.col("copies")).alias("copy"), "v").repartition(tasks, "j", "copy").persist()

    def received(rank: DataFrame) -> DataFrame:
        """i, v: what each node gets over its edges."""
        sent = rank.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("v").alias("r"))
        return a.join(sent, ["j", "copy"]).groupBy("i").agg(F.sum(F.col("v") * F.col("r")).alias("v"))

    n_nodes = nodes.count()
    # ranks carry whether their node is loose, so the lost mass of a step is a filter and a sum
    rank = stored(nodes.crossJoin(n).select("i", "loose", "copies", (1 / F.col("n")).alias("v")), "rank")
    for _ in range(iterations if iterations is not None else max_iter):
        lost = F.broadcast(rank.filter("loose").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("lost")))
        new = nodes.join(received(rank), "i", "left").crossJoin(lost).crossJoin(n)
        new = new.select("i", "loose", "copies", (damping * (F.coalesce("v", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - damping) / F.col("n")).alias("v"))
        if redistribute_leak:
            new = stored(new, "rank")
            if codec:  # the leak is the small rest of a large sum
                exact = linalg.exact_sum(new).select(F.col("v").alias("s"))
                total = F.broadcast(exact.crossJoin(n.select(F.col("n").alias("c"))))  # one row each
            else:
                total = F.broadcast(new.agg(F.sum("v").alias("s"), F.count("*").alias("c")))
            new = new.crossJoin(total).select("i", "loose", "copies", (F.col("v") + (1 - F.col("s")) / F.col("c")).alias("v"))
            # every rank got the same part, so the new total is known without another pass
            spread = F.broadcast(total.select((F.col("s") + (1 - F.col("s"))).alias("t")))
            new = new.crossJoin(spread).select("i", "loose", "copies", (F.col("v") / F.col("t")).alias("v"))
        if codec == "e3m13":
            codes, exceptions = split_e3m13(stored(new, "rank"), n_nodes)
            new = join_e3m13(stored(codes, "codes"), stored(exceptions, "exceptions"), n_nodes).join(nodes, "i")
        elif codec:
            new = quantise(new, codec)
        new = stored(new, "rank")
        if iterations is None:
            if (linalg.deltas(new, rank).first()[norm] or 0.0) <= eps:
                a.unpersist()
                return new.select("i", "v")
        discard(rank)
        rank = new
    a.unpersist()
    return rank.select("i", "v")
