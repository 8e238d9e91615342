"""Grids in tiles with ghost cells: several sweeps of a stencil for one shuffle.

A tile is one row: its number and its cells as an array of ``edge`` cells a side, absent ones as NaN. For s sweeps each
tile sends strips s cells wide to its neighbours (corners too), and one grouping by tile puts them around the tile; after
s sweeps over that larger array the tile's own cells are exact, for a wrong value at the rim moves one cell a sweep. So
s sweeps cost one shuffle of the strips and the tiles, where a table of cells needs s. The largest array is (edge + 2 s)
cells a side, whatever the size of the grid.

Cells of a grid are rows (axes..., v); axes begin at 0. Inner cells, those not at 0 or at the last place of an axis, are
swept; the others stay. A cell that isn't there counts as zero and stays absent. A null value is an absent cell. An
empty grid gives an empty grid; of cells at one place any one counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.session import discard, prepare, stored

_TILE = "t long, cells binary"

#: new value of a cell of value o whose neighbours sum to s
RULES: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "mean": lambda s, o, f2: 0.25 * s,
    "naive": lambda s, o, f2: s / 6 - o / f2,
    "blocked": lambda s, o, f2: s - 6 * o / f2,
    "oblivious": lambda s, o, f2: (s - 6 * o) / f2,
}


def _tiles_of(shape: tuple[int, ...], edge: int) -> tuple[int, ...]:
    return tuple(-(-n // edge) for n in shape)


def tile(grid: DataFrame, axes: list[str], shape: tuple[int, ...], edge: int) -> DataFrame:
    """t, cells of a table of cells (axes..., v); cells outside ``shape`` are left out."""
    prepare(grid.sparkSession)
    number, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    inside = F.col("v").isNotNull()
    for a, n, m in zip(axes, shape, _tiles_of(shape, edge)):
        number = number * m + F.expr(f"`{a}` div {edge}")
        place = place * edge + F.col(a) % edge
        inside = inside & F.col(a).between(0, n - 1)
    size = edge ** len(axes)

    def pack(table: pa.Table) -> pa.Table:
        cells = np.full(size, np.nan)
        cells[table["p"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"t": table["t"].slice(0, 1), "cells": pa.array([cells.tobytes()], pa.binary())})

    return grid.filter(inside).select(number.alias("t"), place.alias("p"), F.col("v").cast("double").alias("v")).groupBy("t").applyInArrow(pack, _TILE)


def untile(tiles: DataFrame, axes: list[str], shape: tuple[int, ...], edge: int) -> DataFrame:
    """The cells of tiles."""
    counts = _tiles_of(shape, edge)

    def run(batches):
        for b in batches:
            for t, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(raw)
                at = np.flatnonzero(~np.isnan(cells))
                own = np.unravel_index(t, counts)
                places = [pa.array(x * edge + y) for x, y in zip(own, np.unravel_index(at, (edge,) * len(axes)))]
                yield pa.RecordBatch.from_arrays([*places, pa.array(cells[at])], names=[*axes, "v"])

    return tiles.select("t", "cells").mapInArrow(run, ", ".join(f"`{a}` long" for a in axes) + ", v double")


def _neighbours(x: np.ndarray) -> np.ndarray:
    """Sum of the cells next to each along the axes."""
    out = np.zeros_like(x)
    for axis in range(x.ndim):
        low, high = [slice(None)] * x.ndim, [slice(None)] * x.ndim
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        out[tuple(high)] += x[tuple(low)]
        out[tuple(low)] += x[tuple(high)]
    return out


def sweeps(tiles: DataFrame, shape: tuple[int, ...], edge: int, steps: int, rule: str = "mean", fac: float = 1.0) -> DataFrame:
    """t, cells, changes: ``steps`` sweeps (at most ``edge``) with one shuffle; changes are each sweep's sum of squared steps."""
    if not 1 <= steps <= edge:
        raise ValueError("a tile's neighbours hold the cells of at most edge sweeps")
    counts, dims, new_value = _tiles_of(shape, edge), len(shape), RULES[rule]
    moves = list(itertools.product((-1, 0, 1), repeat=dims))
    cut = {-1: slice(0, steps), 0: slice(None), 1: slice(edge - steps, edge)}
    put = {-1: slice(steps + edge, None), 0: slice(steps, steps + edge), 1: slice(0, steps)}

    def send(batches):
        for b in batches:
            target, move, piece = [], [], []
            for t, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells, own = np.frombuffer(raw).reshape((edge,) * dims), np.unravel_index(t, counts)
                for k, m in enumerate(moves):
                    at = [int(x + y) for x, y in zip(own, m)]
                    if all(0 <= x < n for x, n in zip(at, counts)):
                        target.append(int(np.ravel_multi_index(at, counts)))
                        move.append(k)
                        piece.append(np.ascontiguousarray(cells[tuple(cut[y] for y in m)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array(move, pa.int32()), pa.array(piece, pa.binary())], names=["t", "m", "piece"])

    def meet(table: pa.Table) -> pa.Table:
        pieces = dict(zip(table["m"].to_pylist(), table["piece"].to_pylist()))
        if moves.index((0,) * dims) not in pieces:  # no cells of its own
            return pa.table({"t": pa.array([], pa.int64()), "cells": pa.array([], pa.binary()), "changes": pa.array([], pa.list_(pa.float64()))})
        t = table["t"][0].as_py()
        x = np.full((edge + 2 * steps,) * dims, np.nan)
        for k, raw in pieces.items():
            at = tuple(put[y] for y in moves[k])
            x[at] = np.frombuffer(raw).reshape(x[at].shape)
        swept = ~np.isnan(x)
        for axis, (own, n) in enumerate(zip(np.unravel_index(t, counts), shape)):
            place = own * edge - steps + np.arange(x.shape[axis])
            swept &= ((place >= 1) & (place <= n - 2)).reshape([-1 if a == axis else 1 for a in range(dims)])
        centre, changes = (slice(steps, steps + edge),) * dims, []
        for _ in range(steps):
            o = np.nan_to_num(x)
            after = np.where(swept, new_value(_neighbours(o), o, fac * fac), x)
            changes.append(float(np.nansum((after[centre] - x[centre]) ** 2)))
            x = after
        return pa.table({"t": pa.array([t]), "cells": pa.array([np.ascontiguousarray(x[centre]).tobytes()], pa.binary()), "changes": pa.array([changes], pa.list_(pa.float64()))})

    return tiles.select("t", "cells").mapInArrow(send, "t long, m int, piece binary").groupBy("t").applyInArrow(meet, _TILE + ", changes array<double>")


def relax(grid: DataFrame, axes: list[str], shape: tuple[int, ...], steps: int, rule: str = "mean", fac: float = 1.0, edge: int = 64, together: int = 8) -> DataFrame:
    """The cells after ``steps`` sweeps, ``together`` of them for a shuffle; older tiles are deleted."""
    tiles, done = stored(tile(grid, axes, shape, edge), "tiles"), 0
    while done < steps:
        s = min(together, edge, steps - done)
        after = stored(sweeps(tiles, shape, edge, s, rule, fac), "tiles")
        discard(tiles)
        tiles, done = after, done + s
    return untile(tiles, axes, shape, edge)


def jacobi(grid: DataFrame, shape: tuple[int, int], eps: float = 1e-4, max_iter: int = 100_000, edge: int = 512, together: int = 8) -> tuple[DataFrame, int]:
    """(grid, sweeps) of (i, j, v) when the change of a sweep is at most ``eps`` of that of the first, or after ``max_iter``."""
    axes, done, first = ["i", "j"], 0, None
    tiles = stored(tile(grid, axes, shape, edge), "tiles")
    while done < max_iter:
        s = min(together, edge, max_iter - done)
        after = stored(sweeps(tiles, shape, edge, s), "tiles")
        change: Column = F.sqrt(F.sum("c"))
        each = after.select(F.posexplode("changes").alias("p", "c")).groupBy("p").agg(change.alias("c")).orderBy("p").collect()  # a row a sweep
        first = (each[0]["c"] if each else 0.0) if first is None else first
        hit = next((r["p"] + 1 for r in each if r["c"] <= eps * first), None if each else 1)
        if hit is not None and hit < s and each:  # it ended within these sweeps: once more, as far as that
            discard(after)
            after = stored(sweeps(tiles, shape, edge, hit), "tiles")
        discard(tiles)
        tiles, done = after, done + (hit or s)
        if hit is not None:
            break
    return untile(tiles, axes, shape, edge), done
