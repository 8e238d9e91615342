"""Iterative solvers and stencils on (i, j, v) tables. Loops either make one lazy plan of a fixed number of steps or
write each step to the shared folder and stop at a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import linalg
from kernelweave.session import discard, stored


def jacobi_preconditioner(m: DataFrame):
    """x -> x / diagonal of ``m``."""
    d = linalg.diagonal(m).groupBy("i").agg(F.max("v").alias("d"))
    return lambda x: x.join(d, "i", "left").select("i", (F.col("v") / F.coalesce("d", F.lit(1.0))).alias("v"))


def _number(df: DataFrame, column: str) -> float:
    return float(df.first()[column] or 0.0)


def _drop(*tables: DataFrame) -> None:
    """Delete those of the tables that were stored."""
    for t in tables:
        if getattr(t, "stored_at", None):
            discard(t)


def conjugate_gradient(m: DataFrame, b: DataFrame, tolerance: float = 1e-8, max_iter: int = 200, precondition: bool = False, step_check: int = 10, precision: str = "double") -> tuple[DataFrame, list[float]]:
    """(x, residual norms). Symmetric positive definite ``m``; every ``step_check`` steps the true residual is computed,
    and the search starts anew where it is more than ten times the tolerance away from the carried one.

    A step writes q, x, r and p (and z with a preconditioner) and deletes the last ones.
    """
    inverse = jacobi_preconditioner(m) if precondition else None
    x, r = linalg.fill(b, 0.0), stored(b.select("i", "v"), "r")
    z = stored(inverse(r), "z") if inverse else r
    p, own_p, rz = z, False, _number(linalg.dot(r, z), "dot")
    seen = [_number(linalg.norms(r), "l2")]
    for step in range(1, max_iter + 1):
        if seen[-1] <= tolerance or rz == 0:
            break
        q = stored(linalg.spmv(m, p, precision), "q")
        alpha = rz / _number(linalg.dot(p, q), "dot")
        new_x = stored(linalg.axpy(alpha, p, x, precision), "x")
        new_r = linalg.xpby(b, -1.0, linalg.spmv(m, new_x, precision)) if step % step_check == 0 else linalg.axpy(-alpha, q, r, precision)
        new_r = stored(new_r, "r")
        seen.append(_number(linalg.norms(new_r), "l2"))
        new_z = stored(inverse(new_r), "z") if inverse else new_r
        new = _number(linalg.dot(new_r, new_z), "dot") if inverse else seen[-1] ** 2
        restart = step % step_check == 0 and seen[-1] > 10 * tolerance and seen[-1] > seen[-2]
        new_p = new_z if restart else stored(linalg.xpby(new_z, new / rz, p, precision), "p")
        _drop(q, x, *((p,) if own_p else ()), r, *((z,) if inverse else ()))
        x, r, z, p, own_p, rz = new_x, new_r, new_z, new_p, not restart, new
    return x, seen


def cg_steps(m: DataFrame, b: DataFrame, steps: int) -> DataFrame:
    """x after a fixed number of steps ; scalars are one-row aggregates joined in, nothing reaches the driver."""
    m = stored(m, "matrix")
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p"))
    for s in range(steps):
        q = linalg.spmv(m, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        last, state = state, stored(state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "cg")
        _drop(last)
        joined = state
        a = F.broadcast(state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq")))
        state = state.crossJoin(a).select("i", (F.col("x") + F.col("rr") / F.col("pq") * F.col("p")).alias("x"), (F.col("r") - F.col("rr") / F.col("pq") * F.col("q")).alias("r"), "p", "rr")
        if s < steps - 1:
            last, state = joined, stored(state, "cg")
            _drop(last)
            last = state
            new = F.broadcast(state.agg(F.sum(F.col("r") * F.col("r")).alias("new")))
            state = state.crossJoin(new).select("i", "x", "r", (F.col("r") + F.col("new") / F.col("rr") * F.col("p")).alias("p"))
            state = stored(state, "cg")
            _drop(last)
    return state.select("i", F.col("x").alias("v"))


def refine(m: DataFrame, b: DataFrame, outer: int = 5, tolerance: float = 1e-10, inner: int = 50) -> tuple[DataFrame, list[float]]:
    """Iterative refinement: inner solves in single precision, residuals and solution in double."""
    single = m.withColumn("v", linalg.narrow(F.col("v"), "single"))
    x, r, seen = linalg.fill(b, 0.0), stored(b.select("i", "v"), "r"), []
    for _ in range(outer):
        seen.append(_number(linalg.norms(r), "l2"))
        if seen[-1] <= tolerance:
            break
        d, _ = conjugate_gradient(single, r, tolerance=max(tolerance, 1e-4 * seen[-1]), max_iter=inner, precision="single")
        last = (d, x, r)
        x = stored(linalg.axpy(1.0, d, x), "x")
        r = stored(linalg.xpby(b, -1.0, linalg.spmv(m, x)), "r")
        _drop(*last)
    return x, seen


def laplacian(edges: DataFrame, shift: float = 1.0) -> DataFrame:
    """(i, j, v) of D - A + shift * I of an undirected graph given by edges (a, b)."""
    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j")).union(edges.select(F.col("b"), F.col("a"))).filter("i <> j").distinct()
    diagonal = both.groupBy("i").agg((F.count("*") + F.lit(shift)).cast("double").alias("v")).select("i", F.col("i").alias("j"), "v")
    return both.select("i", "j", F.lit(-1.0).alias("v")).unionByName(diagonal)


def sweep_2d(grid: DataFrame, nx: int, ny: int) -> DataFrame:
    """One Jacobi sweep of (i, j, v): inner cells become a quarter of the sum of their neighbours.

    Each cell sends its value to its neighbours and one aggregate adds them up: one shuffle with partial sums.
    """
    moves = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (0, 0))))
    sent = grid.withColumn("m", F.explode(moves)).select((F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), "v", ((F.col("m.di") == 0) & (F.col("m.dj") == 0)).alias("own"))
    total = sent.groupBy("i", "j").agg(F.sum(F.when(~F.col("own"), F.col("v"))).alias("s"), F.max(F.when(F.col("own"), F.col("v"))).alias("o"))
    inner = F.col("i").between(1, nx) & F.col("j").between(1, ny)
    return total.filter("o IS NOT NULL").select("i", "j", F.when(inner, 0.25 * F.col("s")).otherwise(F.col("o")).alias("v"))


def jacobi_2d(grid: DataFrame, nx: int, ny: int, eps: float = 1e-4, max_iter: int = 100_000) -> tuple[DataFrame, int]:
    """(grid, steps) when the change falls below ``eps`` of the first change; ``plans/grids`` has the form in tiles."""
    first, held = None, None
    for step in range(1, max_iter + 1):
        new = stored(sweep_2d(grid, nx, ny), "grid")
        both = new.join(grid.withColumnRenamed("v", "o"), ["i", "j"])
        change = _number(both.agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("o"), 2))).alias("d")), "d")
        first = change if first is None else first
        if held is not None:
            discard(held)
        grid = held = new
        if change <= eps * first:
            return grid, step
    return grid, max_iter


def neighbour_sums(grid: DataFrame) -> DataFrame:
    """i, j, k, s (sum of the neighbours), o (the cell itself) of a 3-D grid (i, j, k, v): one aggregate with partial sums."""
    steps = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (0, 0, 0))
    moves = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip("abc", s))) for s in steps))
    at = grid.withColumn("m", F.explode(moves))
    sent = at.select(*((F.col(x) + F.col(f"m.{c}")).alias(x) for x, c in zip("ijk", "abc")), "v", ((F.col("m.a") == 0) & (F.col("m.b") == 0) & (F.col("m.c") == 0)).alias("own"))
    return sent.groupBy("i", "j", "k").agg(F.sum(F.when(~F.col("own"), F.col("v"))).alias("s"), F.max(F.when(F.col("own"), F.col("v"))).alias("o")).filter("o IS NOT NULL")


def heat_value(n: tuple[int, int, int], form: str = "naive", fac: float = 1.0) -> Column:
    """New value of (i, j, k, s, o): 'naive' s/6 - o/fac^2, 'blocked' s - 6 o / fac^2, 'oblivious' (s - 6 o)/fac^2; outer cells stay."""
    s, o, f2 = F.col("s"), F.col("o"), fac * fac
    new = {"naive": s / 6 - o / f2, "blocked": s - 6 * o / f2, "oblivious": (s - 6 * o) / f2}[form]
    inner = F.col("i").between(1, n[0] - 2) & F.col("j").between(1, n[1] - 2) & F.col("k").between(1, n[2] - 2)
    return F.when(inner, new).otherwise(o)


def heat_3d(grid: DataFrame, n: tuple[int, int, int], form: str = "naive", fac: float = 1.0) -> DataFrame:
    """One step of (i, j, k, v) on inner cells; a null value or an absent cell counts as no neighbour."""
    return neighbour_sums(grid).select("i", "j", "k", heat_value(n, form, fac).alias("v"))
