"""Named queries over the given tables, each with its SQL where SQL can express it.

Numbers are rounded so that the order of sums doesn't show; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.functions import precision, scalar
from kernelweave.operators import linalg, stats
from kernelweave.plans import grids, networks, pagerank as pr, points as pts, results, signals, solvers, svm
from kernelweave.session import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


# --- graphs and matrices -------------------------------------------------------------------------------------------


def part_graph(spark: SparkSession, d: str) -> DataFrame:
    """src (part), dst (supplier): key ranges overlap, so parts are even and suppliers odd."""
    return table(spark, d, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct()


def supply(spark: SparkSession, d: str) -> DataFrame:
    """i (part), j (supplier), v (quantity)."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def balances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


def revenue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i")).agg(F.sum("l_extendedprice").alias("v"))


_GRAPH = "e AS (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem)"
_SUPPLY = "m AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _exponent_sql(source: str, name: str, keys: str) -> str:
    """A named subquery with e, the largest power of two that isn't above v."""
    e, two = "floor(log2(v))", "CAST(2 AS DOUBLE)"
    return f"{name} AS (SELECT {keys}, v, CASE WHEN v < pow({two}, {e}) THEN {e} - 1 WHEN v >= pow({two}, {e} + 1) THEN {e} + 1 ELSE {e} END AS e FROM {source})"


def _pagerank_sql(steps: int, leak: bool, tail: str, bits: int = 0) -> str:
    out = [f"WITH {_GRAPH}", "nodes AS (SELECT src AS i FROM e UNION SELECT dst FROM e)", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)", "w AS (SELECT src, dst, 1 / CAST(count(*) OVER (PARTITION BY src) AS DOUBLE) AS v FROM e)", "r0 AS (SELECT i, 1 / n AS v FROM nodes, n)"]
    for k in range(1, steps + 1):
        p, c = f"r{k - 1}", f"q{k}" if leak else f"r{k}"
        out.append(f"l{k} AS (SELECT coalesce(sum(v), 0) AS lost FROM {p} WHERE i NOT IN (SELECT src FROM e))")
        out.append(f"s{k} AS (SELECT dst AS i, sum(w.v * {p}.v) AS v FROM w JOIN {p} ON {p}.i = w.src GROUP BY dst)")
        out.append(f"{c} AS (SELECT nodes.i, CAST(0.85 AS DOUBLE) * (coalesce(s{k}.v, 0) + lost / n) + (1 - CAST(0.85 AS DOUBLE)) / n AS v FROM nodes LEFT JOIN s{k} USING (i), l{k}, n)")
        if leak:
            out.append(f"t{k} AS (SELECT i, v + (1 - sum(v) OVER ()) / n AS v FROM {c}, n)")
            out.append(f"{'u' if bits else 'r'}{k} AS (SELECT i, v / sum(v) OVER () AS v FROM t{k})")
        if bits:  # ranks in single precision, then rounded to bits of mantissa
            out.append(f"f{k} AS (SELECT i, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM u{k})")
            out.append(_exponent_sql(f"f{k}", f"x{k}", "i"))
            out.append(f"r{k} AS (SELECT i, floor(v / pow(CAST(2 AS DOUBLE), e - {bits}) + 0.5) * pow(CAST(2 AS DOUBLE), e - {bits}) AS v FROM x{k})")
    return ", ".join(out) + " " + tail.format(last=f"r{steps}")


@query(_pagerank_sql(5, False, "SELECT i AS node, round(v, 10) AS rank FROM {last} ORDER BY 2 DESC, 1 LIMIT 20"))
def pagerank_top(spark, d):
    ranks = pr.pagerank(part_graph(spark, d), iterations=5)
    return ranks.select(F.col("i").alias("node"), F.round("v", 10).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


@query(_pagerank_sql(3, True, "SELECT i AS node, round(v, 10) AS rank FROM {last}"))
def pagerank_leak(spark, d):
    return pr.pagerank(part_graph(spark, d), iterations=3, redistribute_leak=True).select(F.col("i").alias("node"), F.round("v", 10).alias("rank"))


@query(_pagerank_sql(3, True, "SELECT i AS node, round(v, 10) AS v FROM {last}", 10))
def pagerank_16bit(spark, d):
    """Ranks held in the 16-bit form with 6 bits of exponent, leak redistributed each step."""
    return pr.pagerank(part_graph(spark, d), iterations=3, redistribute_leak=True, codec="e6m10").select(F.col("i").alias("node"), F.round("v", 10).alias("v"))


@query(_pagerank_sql(3, True, "SELECT i AS node, round(v, 10) AS v FROM {last}", 13))
def pagerank_exceptions(spark, d):
    """Ranks held in the 16-bit form with 3 bits of exponent and a table of exceptions, leak redistributed each step."""
    return pr.pagerank(part_graph(spark, d), iterations=3, redistribute_leak=True, codec="e3m13").select(F.col("i").alias("node"), F.round("v", 10).alias("v"))


@query(f"WITH {_GRAPH} SELECT i AS node FROM (SELECT src AS i FROM e UNION SELECT dst FROM e) WHERE i NOT IN (SELECT src FROM e)")
def dangling_nodes(spark, d):
    e = part_graph(spark, d)
    nodes = e.select(F.col("src").alias("i")).union(e.select(F.col("dst").alias("i"))).distinct()
    return linalg.dangling(nodes, e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))).select(F.col("i").alias("node"))


@query(f"WITH {_SUPPLY} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 8) AS v FROM m")
def row_normalise(spark, d):
    return linalg.normalise_rows(supply(spark, d)).select("i", "j", rnd("v", 8).alias("v"))


@query(f"WITH {_SUPPLY} SELECT i, round(sum(m.v * s_acctbal), 2) AS v FROM m JOIN supplier ON s_suppkey = j GROUP BY i")
def spmv(spark, d):
    return linalg.spmv(supply(spark, d), balances(spark, d)).select("i", rnd("v", 2).alias("v"))


@query(f"WITH {_SUPPLY} SELECT i AS j, j AS i, v FROM m WHERE v <> 50")
def transpose_sparse(spark, d):
    shifted = linalg.transpose(supply(spark, d)).withColumn("v", F.col("v") - 50)
    return linalg.to_sparse(shifted).withColumn("v", F.col("v") + 50)


@query("""WITH m AS (SELECT CAST(c_nationkey AS BIGINT) AS i, c_custkey % 10 AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL)
SELECT r.i, c.j, round(coalesce(v, 0), 4) AS v, r.i * 10 + c.j AS k FROM (SELECT DISTINCT i FROM m) r CROSS JOIN (SELECT DISTINCT j FROM m) c LEFT JOIN m ON m.i = r.i AND m.j = c.j""")
def sparse_to_dense(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") % 10).alias("j")).agg(F.sum("c_acctbal").alias("v"))
    dense = linalg.to_dense(m, m.select("i").distinct(), m.select("j").distinct())
    back = linalg.unflatten(linalg.flatten(dense, 10), 10)
    return back.select("i", "j", rnd("v", 4).alias("v"), (F.col("i") * 10 + F.col("j")).alias("k"))


@query("""WITH x AS (SELECT s_suppkey AS i, s_acctbal AS p FROM supplier), y AS (SELECT l_suppkey AS i, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1)
SELECT i, round(CAST(0.5 AS DOUBLE) * coalesce(p, 0) + coalesce(q, 0), 3) AS v FROM x FULL JOIN y USING (i)""")
def axpy(spark, d):
    return linalg.axpy(0.5, balances(spark, d), revenue(spark, d)).select("i", rnd("v", 3).alias("v"))


@query("""WITH x AS (SELECT s_suppkey AS i, s_acctbal AS p FROM supplier), y AS (SELECT l_suppkey AS i, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1),
d AS (SELECT coalesce(p, 0) - coalesce(q, 0) AS v FROM x FULL JOIN y USING (i))
SELECT round((SELECT sum(p * q) FROM x JOIN y USING (i)) / 1e6, 2) AS dot, round(sum(abs(v)), 1) AS l1, round(sqrt(sum(v * v)), 2) AS l2, round(max(abs(v)), 3) AS linf FROM d""")
def dot_and_norms(spark, d):
    x, y = balances(spark, d), revenue(spark, d)
    norms = linalg.deltas(x, y).select(rnd("l1", 1).alias("l1"), rnd("l2", 2).alias("l2"), rnd("linf", 3).alias("linf"))
    return linalg.dot(x, y).select(rnd(F.col("dot") / 1e6, 2).alias("dot")).crossJoin(norms)  # one row each


@query(f"WITH {_SUPPLY}, r AS (SELECT CAST(sum(abs(CAST(v AS BIGINT))) AS DOUBLE) AS s, count(*) AS n FROM m GROUP BY i) SELECT max(s) AS norm_inf, max(n) AS max_nnz FROM r")
def norm_inf(spark, d):
    return linalg.norm_inf(supply(spark, d), truncate=True)


@query("""WITH m AS (SELECT l_partkey % 100 AS i, l_suppkey % 100 AS j, sum(l_quantity) AS v FROM lineitem WHERE l_partkey % 100 >= l_suppkey % 100 GROUP BY ALL),
s AS (SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m WHERE i <> j) SELECT s.i, s.j, s.v, d.v AS diagonal FROM s LEFT JOIN m d ON d.i = s.i AND d.j = s.i""")
def symmetric_mirror(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("i"), (F.col("l_suppkey") % 100).alias("j")).agg(F.sum("l_quantity").alias("v")).filter("i >= j")
    return linalg.mirror(m).join(linalg.diagonal(m).withColumnRenamed("v", "diagonal"), "i", "left").select("i", "j", "v", "diagonal")


@query("""WITH a AS (SELECT l_suppkey AS i, sum(l_quantity) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS i, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT round(exp(-1e-8 * sum((coalesce(p, 0) - coalesce(q, 0)) * (coalesce(p, 0) - coalesce(q, 0)))), 8) AS k FROM a FULL JOIN r USING (i)""")
def sparse_rbf(spark, d):
    of = lambda f: table(spark, d, "lineitem").filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("i")).agg(F.sum("l_quantity").alias("v"))
    return linalg.sparse_rbf(of("A"), of("R"), 1e-8).select(rnd("k", 8).alias("k"))


@query("""SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total,
round(CAST(sum(CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18, 2))) AS DOUBLE), 2) AS signed FROM lineitem GROUP BY l_returnflag""")
def exact_totals(spark, d):
    """Sums that don't depend on order; the signed one goes through values that cancel at a size of 1e16."""
    l = table(spark, d, "lineitem")  # noqa: E741
    total = linalg.exact_sum(l, "l_extendedprice", ("l_returnflag",)).withColumnRenamed("l_extendedprice", "total")
    terms = l.select("l_returnflag", F.explode(F.array(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")), F.col("l_orderkey") * 1e10, F.col("l_orderkey") * -1e10)).alias("v"))
    signed = linalg.exact_sum(terms, "v", ("l_returnflag",)).withColumnRenamed("v", "signed")
    return total.join(signed, "l_returnflag").select("l_returnflag", rnd("total", 2).alias("total"), rnd("signed", 2).alias("signed"))


@query("""WITH s AS (SELECT CAST(floor(c_acctbal * 10) AS BIGINT) AS k, max(c_custkey) AS customer FROM customer GROUP BY 1), o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 3) AS BIGINT) AS k FROM orders)
SELECT o_orderkey, customer FROM o ASOF LEFT JOIN s ON o.k >= s.k""")
def range_assignment(spark, d):
    """Each order's place among the starts that customers give, carried forward through blocks."""
    starts = table(spark, d, "customer").select(F.floor(F.col("c_acctbal") * 10).alias("k"), F.col("c_custkey").alias("customer"))
    points = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 3).alias("k"))
    return stats.assign_ranges(points, starts, "k", "customer", block=1 << 12).select("o_orderkey", "customer")


def graph_system(spark, d):
    e = table(spark, d, "lineitem").select((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")).distinct()
    m = solvers.laplacian(e)
    return m, m.select("i").distinct().select("i", (F.col("i") % 7 - 3).cast("double").alias("v"))


_CG = f"""WITH {_GRAPH}, b0 AS (SELECT src AS i, dst AS j FROM e UNION SELECT dst, src FROM e),
m AS (SELECT i, j, CAST(-1 AS DOUBLE) AS v FROM b0 UNION ALL SELECT i, i, CAST(count(*) + 1 AS DOUBLE) FROM b0 GROUP BY i),
s0 AS (SELECT i, CAST(0 AS DOUBLE) AS x, CAST(i % 7 - 3 AS DOUBLE) AS r, CAST(i % 7 - 3 AS DOUBLE) AS p FROM (SELECT DISTINCT i FROM m)),
q1 AS (SELECT m.i, sum(m.v * s0.p) AS q FROM m JOIN s0 ON s0.i = m.j GROUP BY m.i), a1 AS (SELECT sum(r * r) AS rr, sum(p * q) AS pq FROM s0 JOIN q1 USING (i)),
u1 AS (SELECT i, x + rr / pq * p AS x, r - rr / pq * q AS r, p, rr FROM s0 JOIN q1 USING (i), a1), n1 AS (SELECT sum(r * r) AS new FROM u1),
s1 AS (SELECT i, x, r, r + new / rr * p AS p FROM u1, n1),
q2 AS (SELECT m.i, sum(m.v * s1.p) AS q FROM m JOIN s1 ON s1.i = m.j GROUP BY m.i), a2 AS (SELECT sum(r * r) AS rr, sum(p * q) AS pq FROM s1 JOIN q2 USING (i))
SELECT i, round(x + rr / pq * p, 8) + 0 AS v FROM s1 JOIN q2 USING (i), a2"""


@query(_CG)
def conjugate_gradient(spark, d):
    m, b = graph_system(spark, d)
    return solvers.cg_steps(m, b, 2).select("i", rnd("v", 8).alias("v"))


# --- grids ---------------------------------------------------------------------------------------------------------


def grid_2d(spark, d, n=16):
    inner = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % n + 1).alias("i"), (F.col("l_suppkey") % n + 1).alias("j")).agg(F.avg("l_quantity").alias("v"))
    side = spark.range(n + 2)
    top = [side.select(F.lit(r).cast("long").alias("i"), F.col("id").alias("j"), F.lit(x).alias("v")) for r, x in ((0, 1.0), (n + 1, 10.0))]
    left = [side.filter(F.col("id").between(1, n)).select(F.col("id").alias("i"), F.lit(c).cast("long").alias("j"), F.lit(1.0).alias("v")) for c in (0, n + 1)]
    return stats.union_all([inner, *top, *left])


def _stencil_sql(steps: int, n: int = 16) -> str:
    out = [f"WITH g0 AS (SELECT l_partkey % {n} + 1 AS i, l_suppkey % {n} + 1 AS j, avg(l_quantity) AS v FROM lineitem GROUP BY ALL UNION ALL SELECT 0, k, 1.0 FROM range(0, {n + 2}) t(k) UNION ALL SELECT {n + 1}, k, 10.0 FROM range(0, {n + 2}) t(k) UNION ALL SELECT k, c, 1.0 FROM range(1, {n + 1}) t(k), (VALUES (0), ({n + 1})) c(c))"]
    for s in range(1, steps + 1):
        out.append(f"g{s} AS (SELECT a.i, a.j, CASE WHEN a.i BETWEEN 1 AND {n} AND a.j BETWEEN 1 AND {n} THEN 0.25 * (SELECT sum(b.v) FROM g{s - 1} b WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1) ELSE a.v END AS v FROM g{s - 1} a)")
    return ", ".join(out) + f" SELECT i, j, round(v, 8) AS v FROM g{steps}"


@query(_stencil_sql(3))
def jacobi_2d(spark, d):
    g = grid_2d(spark, d)
    for _ in range(3):
        g = solvers.sweep_2d(g, 16, 16)
    return g.select("i", "j", rnd("v", 8).alias("v"))


_HEAT = """WITH g AS (SELECT l_partkey % 6 AS i, l_suppkey % 6 AS j, CAST(l_linenumber AS BIGINT) % 7 AS k, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT a.i, a.j, a.k, a.v, sum(b.v) AS s FROM g a LEFT JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY ALL)
SELECT i, j, k, round(CASE WHEN i BETWEEN 1 AND 4 AND j BETWEEN 1 AND 4 AND k BETWEEN 1 AND 5 THEN s / 6 - v / 4 ELSE v END, 7) AS naive,
round(CASE WHEN i BETWEEN 1 AND 4 AND j BETWEEN 1 AND 4 AND k BETWEEN 1 AND 5 THEN s - 6 * v / 4 ELSE v END, 7) AS blocked,
round(CASE WHEN i BETWEEN 1 AND 4 AND j BETWEEN 1 AND 4 AND k BETWEEN 1 AND 5 THEN (s - 6 * v) / 4 ELSE v END, 7) + 0 AS oblivious FROM s"""


@query(_HEAT)
def heat_3d(spark, d):
    g = stored(table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 6).alias("i"), (F.col("l_suppkey") % 6).alias("j"), (F.col("l_linenumber").cast("long") % 7).alias("k")).agg(F.avg("l_quantity").alias("v")), "grid")
    sums = solvers.neighbour_sums(g)
    return sums.select("i", "j", "k", *(rnd(solvers.heat_value((6, 6, 7), f, 2.0), 7).alias(f) for f in ("naive", "blocked", "oblivious")))


@query(_stencil_sql(5))
def jacobi_tiled(spark, d):
    """Five sweeps in tiles of five cells a side, three and two of them for a shuffle."""
    g = grids.relax(grid_2d(spark, d), ["i", "j"], (18, 18), 5, edge=5, together=3)
    return g.select("i", "j", rnd("v", 8).alias("v"))


def _heat_sql(steps: int) -> str:
    out = ["WITH g0 AS (SELECT l_partkey % 6 AS i, l_suppkey % 6 AS j, CAST(l_linenumber AS BIGINT) % 7 AS k, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"]
    for s in range(1, steps + 1):
        inner = "a.i BETWEEN 1 AND 4 AND a.j BETWEEN 1 AND 4 AND a.k BETWEEN 1 AND 5"
        out.append(f"g{s} AS (SELECT a.i, a.j, a.k, CASE WHEN {inner} THEN coalesce(sum(b.v), 0) / 6 - a.v / 4 ELSE a.v END AS v FROM g{s - 1} a LEFT JOIN g{s - 1} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY a.i, a.j, a.k, a.v)")
    return ", ".join(out) + f" SELECT i, j, k, round(v, 7) + 0 AS v FROM g{steps}"


@query(_heat_sql(3))
def heat_tiled(spark, d):
    """Three steps of the 3-D form in tiles of four cells a side, with one shuffle."""
    g = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 6).alias("i"), (F.col("l_suppkey") % 6).alias("j"), (F.col("l_linenumber").cast("long") % 7).alias("k")).agg(F.avg("l_quantity").alias("v"))
    return grids.relax(g, ["i", "j", "k"], (6, 6, 7), 3, "naive", 2.0, edge=4, together=3).select("i", "j", "k", rnd("v", 7).alias("v"))


# --- points --------------------------------------------------------------------------------------------------------


def embeddings(spark, d, label: bool = False) -> DataFrame:
    coords = F.transform("embedding", lambda x: x.cast("double"))
    own = F.concat(coords, F.array((F.col("label") >= 5).cast("double"))) if label else coords
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), own.alias("coords"), (F.col("label") >= 5).cast("int").alias("label"))


def _kmeans_sql(steps: int, k: int = 4) -> str:
    out = ["WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, e AS c FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"]
    for s in range(1, steps + 1):
        out.append(f"a{s} AS (SELECT id, e, first(cluster ORDER BY dist, cluster) AS cluster FROM (SELECT id, e, cluster, list_distance(e, c) AS dist FROM p, c{s - 1}) GROUP BY id, e)")
        out.append(f"m{s} AS (SELECT cluster, dim, avg(x) AS v, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(0, len(e))) AS dim FROM a{s}) GROUP BY cluster, dim)")
        out.append(f"c{s} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{s - 1} o LEFT JOIN (SELECT cluster, list(v ORDER BY dim) AS c FROM m{s} GROUP BY cluster) m USING (cluster))")
    return ", ".join(out) + f" SELECT cluster, CAST(dim AS BIGINT) AS dim, round(v, 7) + 0 AS v, n FROM m{steps}"


@query(_kmeans_sql(2))
def kmeans(spark, d):
    found = pts.kmeans_steps(embeddings(spark, d), 4, 2)
    return found.select(F.col("cluster").cast("long").alias("cluster"), F.col("dim").cast("long").alias("dim"), rnd("v", 7).alias("v"), "n")


@query("""WITH p AS (SELECT vec_id AS id, list_append(CAST(embedding AS DOUBLE[]), CAST(CAST(label >= 5 AS INTEGER) AS DOUBLE)) AS e, CAST(label >= 5 AS INTEGER) AS l FROM embeddings),
q AS (SELECT * FROM p WHERE id % 100 = 0),
r AS (SELECT q.id, q.l AS truth, p.l, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, p.e), p.id) AS r FROM q, p),
v AS (SELECT id, truth, CAST(2 * sum(l) > count(*) AS INTEGER) AS vote FROM r WHERE r BETWEEN 2 AND 11 GROUP BY id, truth),
c AS (SELECT count(*) FILTER (truth = 1 AND vote = 1) AS tp, count(*) FILTER (truth <> 1 AND vote <> 1) AS tn, count(*) FILTER (truth <> 1 AND vote = 1) AS fp, count(*) FILTER (truth = 1 AND vote <> 1) AS fn FROM v)
SELECT tp, tn, fp, fn, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS accuracy FROM c""")
def knn(spark, d):
    """The rows whose id is divisible by 100, voted on by all rows, K = 10, the label being one of the coordinates."""
    p = embeddings(spark, d, label=True)
    return pts.knn_evaluate(p, p.select("id", "label"), p.filter("id % 100 = 0"), 10)


@query("""WITH p AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i, vec_id FROM embeddings),
a AS (SELECT a.i, b.i AS j, sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*) AS v FROM p a JOIN p b USING (vec_id) GROUP BY a.i, b.i) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 5) + 0 AS v FROM a""")
def scatter(spark, d):
    return signals.scatter(embeddings(spark, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rnd("v", 5).alias("v"))


@query("""WITH p AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i, vec_id FROM embeddings),
a AS (SELECT a.i, b.i AS j, sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*) AS v FROM p a JOIN p b USING (vec_id) GROUP BY a.i, b.i) SELECT round(sum(v) FILTER (i = j), 4) AS total, round(sum(v * v), 3) AS squares FROM a""")
def pca_spectrum(spark, d):
    """Sum of the components' variances and of their squares: the trace and the squared norm of the scatter matrix."""
    p = embeddings(spark, d)
    each = signals.pca(p, 64).select(F.posexplode("coords").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v") * F.col("v")).alias("w"))
    return each.agg(rnd(F.sum("w"), 4).alias("total"), rnd(F.sum(F.col("w") * F.col("w")), 3).alias("squares"))


@query(SQL["pca_spectrum"])
def pca_qr(spark, d):
    """The same two invariants from the triangular factor: sums of the variances and of their squares."""
    value, _, _ = signals.components_qr(embeddings(spark, d), 64)
    return spark.createDataFrame([(float(v),) for v in value], "w double").agg(rnd(F.sum("w"), 4).alias("total"), rnd(F.sum(F.col("w") * F.col("w")), 3).alias("squares"))


@query()
def pca(spark, d):
    return signals.pca(embeddings(spark, d), 9)


# --- support vectors -----------------------------------------------------------------------------------------------


def _few(spark, d, n=8):
    return [([float(x) for x in r["coords"]], 1.0 if r["label"] else -1.0) for r in embeddings(spark, d).orderBy("id").limit(n).collect()]


_SV = """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id AS sv, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label >= 5 THEN CAST(1 AS DOUBLE) ELSE -1 END AS c FROM embeddings ORDER BY vec_id LIMIT 8),
k AS (SELECT id, sv, c, list_inner_product(v, e) AS uv, list_inner_product(v, v) AS vv, list_inner_product(e, e) AS ee FROM p, s)"""


@query(_SV + """ SELECT id, round(sum(CAST(CAST(uv AS FLOAT) AS DOUBLE)), 4) + 0 AS linear, round(sum(CAST(CAST(pow(0.5 * uv + 1, 3) AS FLOAT) AS DOUBLE)), 4) + 0 AS poly,
round(sum(CAST(CAST(exp(-0.5 * (vv + ee - 2 * uv)) AS FLOAT) AS DOUBLE)), 4) + 0 AS rbf, round(sum(CAST(CAST(tanh(0.5 * uv + 1) AS FLOAT) AS DOUBLE)), 4) + 0 AS sigmoid FROM k GROUP BY id""")
def svm_kernels(spark, d):
    vectors, p = [(v, 1.0) for v, _ in _few(spark, d)], embeddings(spark, d)
    own = {"linear": {}, "poly": {"coef0": 1.0}, "rbf": {}, "sigmoid": {"coef0": 1.0}}
    return p.select("id", *(rnd(svm.decision(vectors, 0.0, name, **more), 4).alias(name) for name, more in own.items()))


@query(_SV + " SELECT id, round(sum(c * CAST(CAST(exp(-0.5 * (vv + ee - 2 * uv)) AS FLOAT) AS DOUBLE)) - CAST(0.125 AS DOUBLE), 5) + 0 AS dec FROM k GROUP BY id")
def svm_decision(spark, d):
    return svm.decide(embeddings(spark, d), _few(spark, d), 0.125).select("id", rnd("dec", 5).alias("dec"))


@query()
def svm_classify(spark, d):
    """One-vs-one C-SVC over the ten labels, trained and applied on all rows."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("coords"), F.col("label").cast("double").alias("label"))
    return svm.predict_class(p, svm.train(p, c=10.0, gamma=0.5))


@query("""SELECT kind, n, round(total * n, 6) AS total, true AS bounded FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM embeddings), (VALUES ('c_svc', 0.0), ('nu_svc', 0.0), ('one_class', 0.1), ('epsilon_svr', 0.0), ('nu_svr', 0.0)) k(kind, total)""")
def svm_dual_sums(spark, d):
    """What each kind's coefficients must keep: their sum, and that none is beyond its bound."""
    p = stored(embeddings(spark, d), "points")
    n, out = p.count(), []
    for kind, bound, more in (("c_svc", 2.0, {"c": 2.0}), ("nu_svc", None, {"nu": 0.1}), ("one_class", 1.0, {"nu": 0.1}), ("epsilon_svr", 2.0, {"c": 2.0}), ("nu_svr", 2.0, {"c": 2.0, "nu": 0.2})):
        m = svm.train(p, kind, **more)
        top = F.lit(True) if bound is None else F.max(F.abs("coef")) <= bound + 1e-9
        out.append(m.agg(rnd(F.sum("coef"), 6).alias("total"), top.alias("bounded")).select(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), "total", "bounded"))
    return stats.union_all(out)



@query("""WITH r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT id, label, CAST(least(r // greatest(n // 5, 1), 4) AS BIGINT) AS fold FROM r""")
def folds(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return stats.folds(p, "label", "id", 5).select("id", "label", "fold")


@query("""WITH c AS (SELECT label, min(vec_id) AS f, count(*) AS n FROM embeddings GROUP BY label), o AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS code, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT vec_id AS id, CAST(code AS BIGINT) AS code, CAST(start + row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS position FROM embeddings JOIN o USING (label)""")
def group_classes(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return stats.group_classes(p, "label", "id").select("id", "code", F.col("position").cast("long").alias("position"))


@query("""WITH a AS (SELECT s_suppkey AS i, s_acctbal AS f, s_nationkey < 16 AS up, s_nationkey > 8 AS low FROM supplier), x AS (SELECT * FROM a WHERE up ORDER BY f, i LIMIT 8),
y AS (SELECT * FROM a WHERE low AND i NOT IN (SELECT i FROM x) ORDER BY f DESC, i DESC LIMIT 8) SELECT i, f, 'up' AS side FROM x UNION ALL SELECT i, f, 'low' FROM y""")
def working_set(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("f"), (F.col("s_nationkey") < 16).alias("up"), (F.col("s_nationkey") > 8).alias("low"))
    return stats.working_set(s, 16).select("i", "f", "side")


@query("""WITH v AS (SELECT doc_id, CASE WHEN quality > 0 THEN 0 ELSE 1 END AS c FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic > 0 THEN 0 ELSE 2 END FROM labels UNION ALL SELECT doc_id, CASE WHEN quality > toxic THEN 1 ELSE 2 END FROM labels),
n AS (SELECT doc_id, c, count(*) AS n FROM v GROUP BY ALL) SELECT doc_id, first(c ORDER BY n DESC, c) AS "class", max(n) AS votes FROM n GROUP BY doc_id""")
def one_vs_one(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    pair = lambda i, j, dec: l.select("doc_id", F.lit(i).alias("ci"), F.lit(j).alias("cj"), dec.alias("dec"))
    return stats.one_vs_one(stats.union_all([pair(0, 1, F.col("quality")), pair(0, 2, F.col("toxic")), pair(1, 2, F.col("quality") - F.col("toxic"))]), ["doc_id"])


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)
SELECT tp, tn, fp, fn, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS accuracy FROM c""")
def confusion(spark, d):
    return stats.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT round(avg(CAST(l_discount = l_tax AS DOUBLE)), 8) AS accuracy, round(avg(pow(l_discount - l_tax, 2)), 9) AS mse FROM lineitem")
def accuracy_mse(spark, d):
    return stats.errors(table(spark, d, "lineitem"), "l_discount", "l_tax").select(rnd("accuracy", 8).alias("accuracy"), rnd("mse", 9).alias("mse"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std_samp, round(stddev_pop(value), 6) AS std_pop FROM events GROUP BY event_type")
def moments(spark, d):
    return stats.moments(table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", *(rnd(c).alias(c) for c in ("mean", "std_samp", "std_pop")))


@query("""WITH c AS (SELECT CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1), b AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM c) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "events").select(F.floor("value").alias("value")), "value")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, min(value) AS low, max(value) FILTER (r = n // 2 + 1) AS median, max(value) AS high FROM r GROUP BY user_id""")
def order_stats(spark, d):
    return stats.order_stats(table(spark, d, "events").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id")


@query("""SELECT l_suppkey, arg_min(l_partkey, (l_extendedprice, l_partkey)) AS l_partkey, min(l_extendedprice) AS low FROM lineitem GROUP BY l_suppkey""")
def arg_min(spark, d):
    return stats.arg_min(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_partkey").withColumnRenamed("l_extendedprice", "low")


@query("""SELECT l_suppkey, arg_min(l_partkey, (-l_extendedprice, l_partkey)) AS l_partkey, max(l_extendedprice) AS high FROM lineitem GROUP BY l_suppkey""")
def arg_max(spark, d):
    return stats.arg_max(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_partkey").withColumnRenamed("l_extendedprice", "high")


@query("SELECT event_type, min(event_id) AS first, count(*) AS n, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS code FROM events GROUP BY event_type")
def dictionary(spark, d):
    return stats.first_seen_codes(table(spark, d, "events"), "event_type", "event_id").select("event_type", "first", "n", F.col("code").cast("long").alias("code"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_rows(spark, d):
    return stats.repeated(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def fill_forward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", F.col("value")).alias("x"))
    return e.select("event_id", stats.fill_forward(e, ["user_id"], ["ts", "event_id"], "x").alias("carried"))


@query("""WITH c AS (SELECT event_id, user_id, ts, value > 20 AS open, CASE WHEN (value > 20) = lag(value > 20) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM i WHERE open GROUP BY ALL""")
def islands(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") > 20).alias("open"))
    return stats.islands(e, ["user_id"], ["ts", "event_id"], F.col("open")).filter("open").groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT l_orderkey AS r, l_linenumber AS p, max(l_quantity) AS a, max(l_tax) AS b, max(l_discount) AS t FROM lineitem GROUP BY ALL)
SELECT 0 AS "dIdx", p AS "pIdx", r AS "rIdx", round((a + b) * t / 1000, 9) AS energy FROM w""")
def energy(spark, d):
    long = table(spark, d, "lineitem").groupBy(F.lit(0).alias("dIdx"), F.col("l_linenumber").alias("pIdx"), F.col("l_orderkey").alias("rIdx")).agg(F.max("l_quantity").alias("a"), F.max("l_tax").alias("b"), F.max("l_discount").alias("t"))
    long = long.unpivot(["dIdx", "pIdx", "rIdx"], [F.col("a").alias(" a"), "b", "t"], "Sensor", "Value")
    return results.energy(long, "a", "b", "t").withColumn("energy", rnd("energy", 9))


@query("""SELECT event_id, event_type AS key, CAST(value AS VARCHAR) AS value FROM events""")
def key_values(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("#  "), "event_type", F.lit(" :  "), F.col("value").cast("string"), F.lit(" ")).alias("value"))
    return results.key_values(e)


# --- text ----------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT '<eos>' FROM part), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS BIGINT) AS word_id FROM c""")
def vocabulary(spark, d):
    p = table(spark, d, "part")
    return networks.vocabulary(p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_brand", F.lit("<eos>")))).alias("word")))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), v AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS id FROM c),
s AS (SELECT event_id AS pos, id, (SELECT count(*) // 20 FROM events) AS len FROM events JOIN v USING (event_type)), a AS (SELECT pos // len AS r, pos % len AS c, id, len FROM s WHERE pos < len * 20)
SELECT x.c // 25 AS batch, x.r AS row, x.c % 25 AS step, CAST(x.id AS BIGINT) AS x, CAST(y.id AS BIGINT) AS y FROM a x JOIN a y ON y.r = x.r AND y.c = x.c + 1 WHERE x.c < ((x.len - 1) // 25) * 25""")
def token_batches(spark, d):
    """Event types as tokens in order of event_id, in batches of 20 rows and windows of 25 steps."""
    e = table(spark, d, "events")
    v = networks.vocabulary(e.select(F.col("event_type").alias("word")))
    return networks.batches(e.withColumnRenamed("event_type", "word").join(v, "word").select(F.col("event_id").alias("pos"), "word_id"), 20, 25)


@query("""SELECT round(exp(sum(l_extendedprice / 10000) / sum(l_quantity)), 8) AS perplexity FROM lineitem""")
def perplexity(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 10000).alias("cost"), F.col("l_quantity").alias("steps"))  # noqa: E741
    return networks.perplexity(l, "cost", "steps").select(rnd("perplexity", 8).alias("perplexity"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _small_model() -> tuple:
    """Embedding, two layers of two cells, softmax and its bias: numbers from a sine."""
    w = np.round(np.sin(np.arange(1, 200)), 3)
    take = iter(np.split(w, np.cumsum([10, 32, 8, 32, 8, 10, 5])))
    e = next(take).reshape(5, 2)
    layers = [(next(take).reshape(4, 8), next(take)) for _ in range(2)]
    return e, layers, next(take).reshape(2, 5), next(take)


def _lstm_sql() -> str:
    e, layers, softmax, bias = _small_model()
    num, sig = lambda x: f"CAST({float(x)!r} AS DOUBLE)", lambda x: f"(1 / (1 + exp(-({x}))))"
    pick = lambda k: "CASE x " + " ".join(f"WHEN {i} THEN {num(e[i, k])}" for i in range(5)) + " END"
    names = [f"{s}{k}{n}" for k in range(2) for s in "hc" for n in range(2)]
    src = f"SELECT s.r, t.p, t.y, {', '.join(names)}, {', '.join(f'{pick(k)} AS v{k}' for k in range(2))} FROM s JOIN t ON t.r = s.r AND t.p = s.p + 1 WHERE t.y IS NOT NULL"
    for k, (kernel, b) in enumerate(layers):
        into = [f"v{2 * k}", f"v{2 * k + 1}", f"h{k}0", f"h{k}1"]
        gate = lambda j: " + ".join([num(b[j]), *(f"{num(kernel[i, j])} * {into[i]}" for i in range(4))])
        src = f"SELECT *, {', '.join(f'{gate(j)} AS g{j}' for j in range(8))} FROM ({src})"
        src = f"SELECT * EXCLUDE (g0, g1, g2, g3, g4, g5), {', '.join(f'c{k}{n} * {sig(f'g{4 + n}')} + {sig(f'g{n}')} * tanh(g{2 + n}) AS d{k}{n}' for n in range(2))} FROM ({src})"
        src = f"SELECT * EXCLUDE (g6, g7), {', '.join(f'tanh(d{k}{n}) * {sig(f'g{6 + n}')} AS v{2 * k + 2 + n}' for n in range(2))} FROM ({src})"
    z = [" + ".join([num(bias[j]), *(f"{num(softmax[n, j])} * v{4 + n}" for n in range(2))]) for j in range(5)]
    loss = "ln(" + " + ".join(f"exp({x})" for x in z) + ") - CASE y " + " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(z)) + " END"
    state = "v2, v3, d00, d01, v4, v5, d10, d11"
    code = "CASE c_mktsegment " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_SEGMENTS)) + " END"
    return (
        f"WITH RECURSIVE t AS (SELECT r, p, x, lead(x) OVER (PARTITION BY r ORDER BY p) AS y FROM (SELECT CAST(c_nationkey AS BIGINT) AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p, {code} AS x FROM customer)), "
        f"s(r, p, {', '.join(names)}, loss) AS (SELECT DISTINCT r, CAST(-1 AS BIGINT), {', '.join('CAST(0 AS DOUBLE)' for _ in names)}, CAST(0 AS DOUBLE) FROM t UNION ALL SELECT r, p, {state}, {loss} FROM ({src})) "
        "SELECT r AS row, CAST(count(*) - 1 AS BIGINT) AS steps, round(sum(loss), 6) AS loss FROM s GROUP BY r"
    )


@query(_lstm_sql())
def lstm_language_model(spark, d):
    """Customers' segments as tokens, a nation a row, in windows of eight steps; two layers of two cells."""
    code = F.array_position(F.array(*map(F.lit, _SEGMENTS)), F.col("c_mktsegment")) - 1
    w = Window.partitionBy("row").orderBy("c_custkey")  # 25 rows of the batch
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("row"), "c_custkey", F.when(code >= 0, code).alias("x"))
    t = t.withColumn("p", F.row_number().over(w) - 1).withColumn("y", F.lead("x").over(w)).filter("y IS NOT NULL")
    found = networks.lstm_losses(t.select(F.expr("p div 8").alias("batch"), "row", (F.col("p") % 8).alias("step"), "x", "y"), *_small_model())
    return found.groupBy("row").agg(F.count("*").alias("steps"), rnd(F.sum("loss"), 6).alias("loss"))


@query("""SELECT a.p_partkey, round(CAST(levenshtein(a.p_name, b.p_name) AS DOUBLE) / length(b.p_name), 8) AS error FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def edit_error(spark, d):
    p = table(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("truth"))
    return p.select("p_partkey", "p_name").join(nxt, "p_partkey").select("p_partkey", rnd(scalar.edit_error(F.col("p_name"), F.col("truth")), 8).alias("error"))


# --- functions and precision ---------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT l_returnflag, least(CAST(floor(l_discount * 8192 + 0.5) AS BIGINT), 32767) AS a, least(CAST(floor(l_tax * 8192 + 0.5) AS BIGINT), 32767) AS b FROM lineitem)
SELECT l_returnflag, CAST(sum(a * b) AS BIGINT) >> 13 AS dot, CAST(sum((a * b) >> 13) AS BIGINT) AS muls, CAST(sum((a << 13) // nullif(b, 0)) AS BIGINT) AS divs FROM q GROUP BY l_returnflag""")
def fixed_point(spark, d):
    q = table(spark, d, "lineitem").select("l_returnflag", precision.to_fixed(F.col("l_discount")).alias("a"), precision.to_fixed(F.col("l_tax")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return q.groupBy("l_returnflag").agg(precision.dot_fixed(a, b).alias("dot"), F.sum(precision.mul_fixed(a, b)).alias("muls"), F.sum(precision.div_fixed(a, b)).alias("divs"))


_QUARTERS = """WITH x AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) - 25 AS a FROM lineitem), q AS (SELECT unnest(range(8, 15)) AS q), t AS (SELECT q, k, CAST(k AS BIGINT) << 0 AS kk,
CAST(trunc(exp(CAST(k AS DOUBLE) / 4) * (1 << q)) AS BIGINT) AS ev, CAST(trunc((exp(CAST(k + 1 AS DOUBLE) / 4) - exp(CAST(k AS DOUBLE) / 4)) * 4 * (1 << q)) AS BIGINT) AS es,
CAST(trunc(tanh(CAST(k AS DOUBLE) / 4) * (1 << q)) AS BIGINT) AS tv, CAST(trunc((tanh(CAST(k + 1 AS DOUBLE) / 4) - tanh(CAST(k AS DOUBLE) / 4)) * 4 * (1 << q)) AS BIGINT) AS ts FROM q, (SELECT unnest(range(-4, 4)) AS k)),
v AS (SELECT q.q, CAST(floor(CAST(a * (1 << q.q) AS DOUBLE) / 16) AS BIGINT) AS x FROM x, q), p AS (SELECT v.q, x, least(greatest(CAST(floor(CAST(x AS DOUBLE) / (1 << (v.q - 2))) AS BIGINT), -4), 3) AS k FROM v),
y AS (SELECT p.q, x, ev + CASE WHEN x < -(1 << p.q) OR p.k = 3 THEN 0 ELSE (es * (x - p.k * (1 << (p.q - 2)))) >> p.q END AS e, tv + CASE WHEN x < -(1 << p.q) OR p.k = 3 THEN 0 ELSE (ts * (x - p.k * (1 << (p.q - 2)))) >> p.q END AS t FROM p JOIN t ON t.q = p.q AND t.k = p.k)
SELECT CAST(q AS BIGINT) AS q, x, ((e + 32768) & 65535) - 32768 AS e, ((t + 32768) & 65535) - 32768 AS t FROM y"""


@query(_QUARTERS)
def fixed_tables(spark, d):
    """exp and tanh by straight pieces in each Q format, of quantities brought to -1.5 .. 1.6."""
    a = table(spark, d, "lineitem").select((F.col("l_quantity").cast("long") - 25).alias("a")).distinct()
    each = [a.select(F.lit(q).cast("long").alias("q"), F.floor(F.col("a") * (1 << q) / 16).cast("long").alias("x")) for q in range(8, 15)]
    return stats.union_all([x.select("q", "x", precision.exp_fixed(F.col("x"), q).alias("e"), precision.tanh_fixed(F.col("x"), q).alias("t")) for q, x in zip(range(8, 15), each)])


@query("""SELECT event_id, round(exp(value / 100) / sum(exp(value / 100)) OVER (PARTITION BY user_id), 8) AS p FROM events""")
def softmax(spark, d):
    return table(spark, d, "events").select("event_id", rnd(scalar.softmax(F.col("value") / 100, ["user_id"]), 8).alias("p"))


@query("""SELECT user_id, round(ln(sum(exp(value / 100))) - sum(CASE WHEN event_type = 'error' THEN value / 100 ELSE 0 END), 6) + 0 AS loss FROM events GROUP BY user_id""")
def log_loss(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("value") / 100).alias("z"), (F.col("event_type") == "error").alias("hit"))
    return scalar.log_loss(e, ["user_id"], "z", "hit").select("user_id", rnd("loss").alias("loss"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 4000 - 12 AS x FROM lineitem), i AS (SELECT *, floor(184 * greatest(-25, least(25, x)) + 16249) AS i FROM x)
SELECT l_orderkey, l_linenumber, round(pow(CAST(2 AS DOUBLE), floor(i / 128) - 127) * (1 + (i - 128 * floor(i / 128)) / 128), 6) AS fast, round(1 / (1 + exp(-x)), 8) AS sigmoid, round(greatest(x, 0), 8) AS relu, round(greatest(0, least(1, 0.2 * x + 0.5)), 8) AS hard FROM i""")
def activations(spark, d):
    x = F.col("l_extendedprice") / 4000 - 12
    forms = {"fast": rnd(scalar.fast_exp(x), 6), "sigmoid": rnd(scalar.sigmoid(x), 8), "relu": rnd(scalar.relu(x), 8), "hard": rnd(scalar.hard_sigmoid(x), 8)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in forms.items()))


@query(f"""WITH {_SUPPLY}, s AS (SELECT i, j, CAST(CAST(v / sum(v) OVER (PARTITION BY i) AS FLOAT) AS DOUBLE) AS v FROM m), {_exponent_sql("s", "x", "i, j")}
SELECT i, j, round_even(v / pow(CAST(2 AS DOUBLE), greatest(e, -14) - 10), 0) * pow(CAST(2 AS DOUBLE), greatest(e, -14) - 10) AS v FROM x""")
def half_precision(spark, d):
    """Shares of suppliers in a part's quantity, rounded to half precision."""
    return precision.quantise(linalg.normalise_rows(supply(spark, d)), "half")


# --- signals -------------------------------------------------------------------------------------------------------


def series(spark, d) -> DataFrame:
    """key (user), pos, v of the events of each user in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("pos"), F.col("value").alias("v"))


_WINDOWS = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events),
w AS (SELECT user_id, pos // {n} AS w, pos % {n} AS pos, v FROM s QUALIFY count(*) OVER (PARTITION BY user_id, pos // {n}) = {n})"""


def _haar_sql(levels: int) -> str:
    parts = [f"SELECT user_id, w, {l} AS band, sum(c * c) AS energy FROM (SELECT user_id, w, pos // {1 << l} AS p, sum(CASE WHEN pos % {1 << l} < {1 << (l - 1)} THEN v ELSE -v END) / sqrt({1 << l}) AS c FROM w GROUP BY ALL) GROUP BY ALL" for l in range(1, levels + 1)]  # noqa: E741
    parts.append(f"SELECT user_id, w, 0, sum(c * c) FROM (SELECT user_id, w, sum(v) / sqrt({1 << levels}) AS c FROM w GROUP BY ALL) GROUP BY ALL")
    return f"WITH {_WINDOWS.format(n=1 << levels)} SELECT user_id, CAST(w AS BIGINT) AS w, CAST(band AS INTEGER) AS band, round(energy, 8) AS energy FROM (" + " UNION ALL ".join(parts) + ")"


@query(_haar_sql(4))
def wavelet_energy(spark, d):
    """Haar energies by band of windows of 16 events of a user."""
    found = signals.band_energy(signals.haar(signals.windows_of(series(spark, d), 16), 4))
    return found.select(F.col("key.key").alias("user_id"), F.col("key.w").cast("long").alias("w"), F.col("band").cast("int").alias("band"), rnd("energy", 8).alias("energy"))


@query(f"""WITH {_WINDOWS.format(n=8)} SELECT user_id, CAST(w AS BIGINT) AS w, CAST(k AS INTEGER) AS k, round(sum(v * cos(2 * pi() / 8 * ((pos * k) % 8))) / 8, 6) + 0 AS re, round(-sum(v * sin(2 * pi() / 8 * ((pos * k) % 8))) / 8, 6) + 0 AS im FROM w, range(0, 8) t(k) GROUP BY user_id, w, k""")
def fourier(spark, d):
    s = signals.windows_of(series(spark, d), 8)
    found = signals.dft(s.select("key", F.col("pos").alias("n"), F.col("v").alias("re"), F.lit(0.0).alias("im")), 8)
    return found.select(F.col("key.key").alias("user_id"), F.col("key.w").cast("long").alias("w"), "k", rnd("re").alias("re"), rnd("im").alias("im"))


@query(f"""WITH {_WINDOWS.format(n=12)}, t AS (SELECT user_id, w, k, round(sum(v * cos(2 * pi() / 12 * ((pos * k) % 12))) / 12, 6) + 0 AS re, round(-sum(v * sin(2 * pi() / 12 * ((pos * k) % 12))) / 12, 6) + 0 AS im FROM w, range(0, 12) t(k) GROUP BY user_id, w, k)
SELECT t.user_id, CAST(t.w AS BIGINT) AS w, CAST(k AS BIGINT) AS k, re, im, round(v, 6) + 0 AS again FROM t JOIN w ON w.user_id = t.user_id AND w.w = t.w AND pos = k""")
def fft_round_trip(spark, d):
    """Transforms of length 12 in stages of 2, 2 and 3, and the values that come back."""
    s = signals.windows_of(series(spark, d), 12).select("key", F.col("pos").alias("n"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    there = signals.fft(s, 12)
    back = signals.fft(there.withColumnRenamed("k", "n"), 12, inverse=True).select("key", "k", rnd("re").alias("again"))
    return there.join(back, ["key", "k"]).select(F.col("key.key").alias("user_id"), F.col("key.w").cast("long").alias("w"), "k", rnd("re").alias("re"), rnd("im").alias("im"), "again")


@query(f"""WITH {_WINDOWS.format(n=12)}, g AS (SELECT *, pos // 4 AS x, pos % 4 AS y FROM w)
SELECT user_id, CAST(w AS BIGINT) AS w, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, round(sum(v * cos(2 * pi() * (x * a / CAST(3 AS DOUBLE) + y * b / CAST(4 AS DOUBLE)))) / 12, 6) + 0 AS re, round(-sum(v * sin(2 * pi() * (x * a / CAST(3 AS DOUBLE) + y * b / CAST(4 AS DOUBLE)))) / 12, 6) + 0 AS im
FROM g, range(0, 3) s(a), range(0, 4) t(b) GROUP BY user_id, w, a, b""")
def fft_2d(spark, d):
    """Twelve events of a user as a grid of 3 by 4."""
    s = signals.windows_of(series(spark, d), 12).select("key", F.expr("pos div 4").alias("x"), (F.col("pos") % 4).alias("y"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    found = signals.fft_axes(s, {"x": 3, "y": 4})
    return found.select(F.col("key.key").alias("user_id"), F.col("key.w").cast("long").alias("w"), "x", "y", rnd("re").alias("re"), rnd("im").alias("im"))


@query(f"""WITH {_WINDOWS.format(n=12)}, g AS (SELECT *, pos // 6 AS x, (pos // 2) % 3 AS y, pos % 2 AS z FROM w)
SELECT user_id, CAST(w AS BIGINT) AS w, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, CAST(c AS BIGINT) AS z, round(sum(v * cos(2 * pi() * (x * a / CAST(2 AS DOUBLE) + y * b / CAST(3 AS DOUBLE) + z * c / CAST(2 AS DOUBLE)))) / 12, 6) + 0 AS re,
round(-sum(v * sin(2 * pi() * (x * a / CAST(2 AS DOUBLE) + y * b / CAST(3 AS DOUBLE) + z * c / CAST(2 AS DOUBLE)))) / 12, 6) + 0 AS im FROM g, range(0, 2) s(a), range(0, 3) t(b), range(0, 2) u(c) GROUP BY user_id, w, a, b, c""")
def fft_3d(spark, d):
    """Twelve events of a user as a block of 2 by 3 by 2."""
    s = signals.windows_of(series(spark, d), 12).select("key", F.expr("pos div 6").alias("x"), F.expr("pos div 2 % 3").alias("y"), (F.col("pos") % 2).alias("z"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    found = signals.fft_axes(s, {"x": 2, "y": 3, "z": 2})
    return found.select(F.col("key.key").alias("user_id"), F.col("key.w").cast("long").alias("w"), "x", "y", "z", rnd("re").alias("re"), rnd("im").alias("im"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size % 10 AS DOUBLE) / 10 + 0.05 AS u, p_retailprice / 1000 AS a FROM part)
SELECT p_partkey, round((sin(2 * pi() * u + a) - sin(2 * pi() * u)) / a, 8) + 0 AS f1, round(a * (atan(a * (1 - u)) + atan(a * u)), 8) AS f2, round(1 / (1 + a), 8) AS f3, round((2 - exp(-a * u) - exp(-a * (1 - u))) / a, 8) AS f5, round((exp(a * u) - 1) / a, 8) AS f6 FROM p""")
def quadrature(spark, d):
    """Integrals over [0, 1] by 20 nodes a piece against closed forms; pieces meet at u, where f5 and f6 break."""
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 10).cast("double") / 10 + 0.05).alias("u"), (F.col("p_retailprice") / 1000).alias("p"))
    two = p.withColumn("piece", F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.col("u").alias("b")), F.struct(F.col("u").alias("a"), F.lit(1.0).alias("b"))))).select("p_partkey", "u", "p", "piece.a", "piece.b")
    each = two.select("p_partkey", *(signals.integrate(two, lambda x, k=k: signals.genz(k, x, F.col("u"), F.col("p"))).alias(f"f{k}") for k in (1, 2, 3, 5, 6)))
    return each.groupBy("p_partkey").agg(*(rnd(F.sum(f"f{k}"), 8).alias(f"f{k}") for k in (1, 2, 3, 5, 6)))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size % 10 AS DOUBLE) / 10 AS u, CAST(p_retailprice AS DOUBLE) / 1000 AS a FROM part),
z AS (SELECT p_partkey, a, a * (1 - u) AS y, a * u AS x FROM p), t AS (SELECT p_partkey, a, (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest(q, 1e-12)) - lgamma(n + 1)) / (2 * n + 1) AS term
FROM (SELECT p_partkey, a, y AS q FROM z UNION ALL SELECT p_partkey, a, x FROM z), range(0, 60) s(n)) SELECT p_partkey, round(sum(term) / any_value(a), 7) AS v FROM t GROUP BY p_partkey""")
def quadrature_gauss(spark, d):
    """The Gaussian integrand by nodes; the SQL sums the power series of its integral."""
    p = table(spark, d, "part").select("p_partkey", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), ((F.col("p_size") % 10).cast("double") / 10).alias("u"), (F.col("p_retailprice") / 1000).alias("p"))
    return p.select("p_partkey", rnd(signals.integrate(p, lambda x: signals.genz(4, x, F.col("u"), F.col("p"))), 7).alias("v"))


@query("""SELECT p_partkey, round((sin(p_retailprice / 1000) / (p_retailprice / 1000)) * (1 - exp(-CAST(p_size AS DOUBLE) / 10)) / (CAST(p_size AS DOUBLE) / 10), 7) + 0 AS v FROM part WHERE p_size > 0""")
def quadrature_2d(spark, d):
    p = table(spark, d, "part").filter("p_size > 0").select("p_partkey", (F.col("p_retailprice") / 1000).alias("s"), (F.col("p_size").cast("double") / 10).alias("t"), *(F.lit(x).alias(c) for c, x in zip("abcd", (0.0, 1.0, 0.0, 1.0))))
    return p.select("p_partkey", rnd(signals.integrate_2d(lambda x, y: F.cos(F.col("s") * x) * F.exp(-F.col("t") * y), 12), 7).alias("v"))


# --- networks ------------------------------------------------------------------------------------------------------

_KERNEL = [[[[0.5, -0.25, 0.125], [1.0, 0.0, -1.0], [0.25, 0.75, -0.5]]], [[[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]]]
_BIAS = [0.125, -0.25]
_TAPS = ", ".join(f"({o}, {a}, {b}, CAST({_KERNEL[o][0][2 - a][2 - b]} AS DOUBLE))" for o in range(2) for a in range(3) for b in range(3))
_UNITS = [[((u * 7 + k * 3) % 5 - 2) / 4 for k in range(18)] for u in range(3)]
_ROWS = ", ".join(f"({u}, {k}, CAST({_UNITS[u][k]} AS DOUBLE))" for u in range(3) for k in range(18))


@query("""SELECT n, 2.0 AS weights, CASE WHEN n > 1 THEN round(CAST(2 AS DOUBLE) / 3, 10) ELSE 0.0 END AS second, CASE WHEN n > 1 THEN round(CAST(2 AS DOUBLE) / (2 * n - 1), 10) ELSE 2.0 END AS highest FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n FROM lineitem)""")
def legendre_orders(spark, d):
    """Rules of all orders that quantities name: the integrals of 1, x^2 and x^(2n-2), which they give exactly."""
    rules = signals.legendre_rules(table(spark, d, "lineitem").select(F.col("l_quantity").alias("n")))
    x, w = F.col("x"), F.col("w")
    power = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.pow(F.abs(x), 2.0 * F.col("n") - 2))
    return rules.groupBy(F.col("n").cast("long").alias("n")).agg(rnd(F.sum(w), 10).alias("weights"), rnd(F.sum(w * x * x), 10).alias("second"), rnd(F.sum(w * power), 10).alias("highest"))



def images(spark, d) -> DataFrame:
    """The 64 numbers of an embedding as an 8 x 8 map."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("k", "v"))
    return p.select("img", F.lit(0).alias("ch"), F.expr("k div 8").cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.col("v").cast("double").alias("v"))


_CONV = f"""WITH t(o, a, b, w) AS (VALUES {_TAPS}), p AS (SELECT vec_id AS img, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS k FROM embeddings), x AS (SELECT img, {{value}} AS v, k // 8 AS i, k % 8 AS j FROM p),
c AS (SELECT img, o AS ch, i - a AS i, j - b AS j, sum(v * {{weight}}) AS s FROM x, t WHERE i - a BETWEEN 0 AND 5 AND j - b BETWEEN 0 AND 5 GROUP BY ALL)"""


@query(_CONV.format(value="v", weight="w") + f""", q AS (SELECT img, ch, i // 2 AS i, j // 2 AS j, max(greatest(s + CASE WHEN ch = 0 THEN 0.125 ELSE -0.25 END, 0)) AS v FROM c GROUP BY ALL), r(u, k, w) AS (VALUES {_ROWS})
SELECT img, CAST(u AS INTEGER) AS unit, round(sum(v * w) + u, 6) + 0 AS v FROM q JOIN r ON r.k = ch * 9 + i * 3 + j GROUP BY img, u""")
def convolution_net(spark, d):
    """Convolution, rectifier, pooling and a dense layer."""
    c = networks.activate(networks.convolve(images(spark, d), _KERNEL, _BIAS, (8, 8)), scalar.relu)
    out = networks.dense(networks.flat(networks.pool(c, 2), (3, 3)), _UNITS, [0.0, 1.0, 2.0])
    return out.select("img", F.col("unit").cast("int").alias("unit"), rnd("v").alias("v"))


_SAME = [[[0.5, -0.25], [0.25, 0.5], [0.125, 0.25]], [[-0.5, 0.125], [1.0, 0.5], [0.25, -1.0]], [[0.75, 0.25], [-0.25, 0.5], [0.5, 0.125]]]
_SAME_SQL = ", ".join(f"({o}, {a}, {b}, {_SAME[a][b][o]})" for o in range(2) for a in range(3) for b in range(3))


@query(f"""WITH t(o, a, b, w) AS (VALUES {_SAME_SQL}), x AS (SELECT vec_id AS img, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS k FROM embeddings),
c AS (SELECT img, o, k // 8 + 1 - a AS i, k % 8 + 1 - b AS j, sum(v * w) AS s FROM x, t WHERE k // 8 + 1 - a BETWEEN 0 AND 7 AND k % 8 + 1 - b BETWEEN 0 AND 7 GROUP BY ALL),
r AS (SELECT img, o, i, j, greatest(s + CASE WHEN o = 0 THEN 0.125 ELSE -0.25 END, 0) AS v FROM c),
p AS (SELECT img, o, y.i, y.j, max(v) AS v FROM r, (SELECT unnest(range(0, 4)) AS i) y0, LATERAL (SELECT y0.i AS i, unnest(range(0, 4)) AS j) y WHERE r.i BETWEEN 2 * y.i AND 2 * y.i + 2 AND r.j BETWEEN 2 * y.j AND 2 * y.j + 2 GROUP BY ALL),
n AS (SELECT img, o, i, j, v / pow(1 + CAST(0.001 AS DOUBLE) / 9 * sum(v * v) OVER (PARTITION BY img, i, j), CAST(0.75 AS DOUBLE)) AS v FROM p)
SELECT img, round(sum(v * (i * 8 + j * 2 + o + 1)), 5) + 0 AS score, round(sum(v), 6) + 0 AS total FROM n GROUP BY img""")
def image_layers(spark, d):
    """Convolution with an output for every place, rectifier, overlapping pooling, normalisation over channels, a dense layer."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    weights = np.array(_SAME)[:, :, None, :]
    last = np.stack((np.arange(1.0, 33.0), np.ones(32)), 1)
    layers = [("conv", weights, np.array([0.125, -0.25])), ("relu",), ("pool", 3, 2), ("normalise",), ("dense", last, np.zeros(2))]
    out = networks.image_net(rows, (8, 8, 1), layers)
    return out.select("img", rnd(F.col("scores")[0], 5).alias("score"), rnd(F.col("scores")[1], 6).alias("total"))


@query(_CONV.format(value="CAST(greatest(least(floor(v * 8192 + 0.5), 32767), -32768) AS BIGINT)", weight="CAST(w * 8192 AS BIGINT)") + """
SELECT img, CAST(ch AS INTEGER) AS ch, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(greatest(least(floor((s + CASE WHEN ch = 0 THEN 1024 ELSE -2048 END * 8192) / 8192.0), 32767), -32768) AS BIGINT) AS v FROM c""")
def convolution_fixed(spark, d):
    fixed = lambda w: [[[[int(x * 8192) for x in r] for r in m] for m in o] for o in w]
    q = images(spark, d).withColumn("v", precision.to_fixed(F.col("v")).cast("long"))
    out = networks.convolve(q, fixed(_KERNEL), [1024, -2048], (8, 8), q=13)
    return out.select("img", *(F.col(c).cast("int").alias(c) for c in ("ch", "i", "j")), F.col("v").cast("long").alias("v"))


@query()
def line_recogniser(spark, d):
    """A bidirectional pass over each user's events, class scores and decoded labels, with fixed weights."""
    s = series(spark, d).select(F.col("key").alias("img"), F.col("pos").alias("col"), F.array(F.col("v") / 100, F.sin("v"), F.cos("v")).alias("px"))
    r = np.random.default_rng(0)
    weights = lambda: {"w_x": r.normal(size=(4, 6, 3)), "w_h": r.normal(size=(4, 6, 6)) / 4, "bias": r.normal(size=(4, 6)), "peep": r.normal(size=(3, 6))}
    hidden = networks.bidirectional(s, weights(), weights())
    scores = networks.class_scores(hidden, r.normal(size=(5, 12)).tolist(), [1.0, 0.0, 0.0, 0.0, 0.0])
    return networks.decode(scores)


@query("""WITH r AS (SELECT event_id, (event_id * 7919) % 65536 AS x FROM events) SELECT event_id, CAST((x // 256) % 256 AS INTEGER) AS b0, CAST(x % 256 AS INTEGER) AS b1 FROM r""")
def huffman(spark, d):
    """Bytes decoded by a flat code table: bits are read from the lowest, so a byte's code is its bits reversed."""
    codes = {format(b, "08b")[::-1]: b for b in range(256)}
    e = table(spark, d, "events").select("event_id", F.unhex(F.lpad(F.hex((F.col("event_id") * 7919) % 65536), 4, "0")).alias("bits"), F.lit(2).alias("n"))
    return scalar.huffman_decode(e, codes).select("event_id", F.col("values")[0].alias("b0"), F.col("values")[1].alias("b1"))
