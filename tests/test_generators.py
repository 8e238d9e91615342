"""Tables of straight pieces, logarithms by the exponent field, generators that jump ahead."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import precision, scalar
from kernelweave.sources import readers

#: fixed values of the 8-bit tables: value at the start of each piece, and slopes
EXP_8 = [94, 120, 155, 199, 256, 328, 422, 541], [106, 137, 176, 226, 290, 373, 479]
TANH_8 = [-194, -162, -118, -62, 0, 62, 118, 162], [129, 177, 222, 250, 250, 222, 177]


def test_pieces(spark):
    assert precision._quarters(math.exp, 8) == ([-256, -192, -128, -64, 0, 64, 128, 192], *EXP_8)
    assert precision._quarters(math.tanh, 8)[1:] == TANH_8
    x = list(range(-400, 400)) + [None]
    df = spark.createDataFrame([(v,) for v in x], "x int")
    got = [tuple(r) for r in df.select("x", precision.exp_fixed(F.col("x"), 8), precision.tanh_fixed(F.col("x"), 8)).collect()]
    for v, e, t in got:
        for own, (values, slopes) in ((e, EXP_8), (t, TANH_8)):
            k = None if v is None else min(max(v >> 6, -5), 3)
            assert own == (None if v is None else values[0] if k == -5 else values[-1] if k == 3 else values[k + 4] + (slopes[k + 4] * (v - 64 * k) >> 8))
    assert spark.range(1).select(precision.exp_fixed(F.lit(16384), 14)).first()[0] == -30852  # wraps around
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (-9, 0, 4, 5, 9, 10, 77)], "x int").select(precision.piecewise(F.col("x"), [0, 5, 10], [3, 8, 9], [16, 4], 4)).collect()] == [3, 3, 7, 8, 9, 9, 9]


def test_fast_logarithm(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([10.0 ** r.uniform(-6, 6, 300), 2.0 ** np.arange(-20, 20), np.nextafter(2.0 ** np.arange(-20, 20), 0)])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(0.0,), (-1.0,), (None,)], "x double")
    got = [v[0] for v in rows.select(scalar.fast_log(F.col("x"))).collect()]
    want = [((struct.unpack("<I", struct.pack("<f", v))[0] >> 16) - 16249.0) / 184.0 for v in x]
    assert got == want + [None] * 3 and max(abs(g - math.log(v)) for g, v in zip(got, x)) < 0.1
    power = [v[0] for v in rows.filter("x > 0.01 AND x < 100").select(scalar.fast_pow(F.col("x"), F.lit(1.5)) / F.pow("x", F.lit(1.5))).collect()]
    assert max(abs(p - 1) for p in power) < 0.15


@pytest.mark.parametrize("tasks", [1, 7])
def test_shift_register(spark, tasks):
    n = 1_000_000
    got = readers.shift_register(spark, n, tasks=tasks)
    want = readers._register_steps(1, 0xB4BCD35C, n)
    assert got.rdd.getNumPartitions() == tasks
    v = got.orderBy("i").toPandas()
    assert (v.i.to_numpy() == np.arange(n)).all() and (v.v.to_numpy() == want.astype(np.int32)).all()


def test_jumps():
    state = 1
    for k in range(200):
        assert readers.register_after(1, k, 0xB4BCD35C) == state
        state = int(readers._register_steps(state, 0xB4BCD35C, 1)[0])
    assert readers.register_after(9, 2**40, 0b1001, 4) == readers.register_after(9, 2**40 % 15, 0b1001, 4)


def test_signals_and_grids(spark):
    assert [r["v"] for r in readers.step_signal(spark, 5, 3, 1.0, 4.0).orderBy("i").collect()] == [1, 1, 1, 4, 4]
    got = {(r["i"], r["j"]): r["v"] for r in readers.box_grid(spark, (4, 3), 0.0, 1.0, top=5.0, bottom=10.0).collect()}
    assert len(got) == 12 and got[0, 0] == 5 and got[3, 1] == 10 and got[1, 1] == 0 and got[2, 2] == 1
    three = {(r["i"], r["j"], r["k"]): r["v"] for r in readers.box_grid(spark, (3, 3, 3), 7.0, 2.0).collect()}
    assert len(three) == 27 and three[1, 1, 1] == 7 and sum(three.values()) == 7 + 52
