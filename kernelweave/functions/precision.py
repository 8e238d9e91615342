"""Narrow number formats in plain columns: fixed point by shifts, 16-bit floats by powers of two; bit views for arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saturate(c: Column, bits: int = 16) -> Column:
    return F.greatest(F.least(c, F.lit((1 << (bits - 1)) - 1)), F.lit(-(1 << (bits - 1))))


def to_fixed(c: Column, q: int = 13, bits: int = 16) -> Column:
    """Round to the nearest multiple of 2^-q, saturated."""
    return saturate(F.floor(c * float(1 << q) + 0.5).cast("long"), bits)


def from_fixed(c: Column, q: int = 13) -> Column:
    return c / F.lit(float(1 << q))


def mul_fixed(a: Column, b: Column, q: int = 13) -> Column:
    return F.shiftright(a.cast("long") * b.cast("long"), q)


def div_fixed(a: Column, b: Column, q: int = 13) -> Column:
    """(a << q) / b, cut towards zero; null where b is 0."""
    x = F.try_divide(F.shiftleft(a.cast("long"), q).cast("double"), b.cast("double"))
    return (F.signum(x) * F.floor(F.abs(x))).cast("long")


def dot_fixed(a: Column, b: Column, q: int = 13) -> Column:
    """Aggregate: sum of products in 64 bits, one shift at the end."""
    return F.shiftright(F.sum(a.cast("long") * b.cast("long")), q)


def encode_e6m10(x: np.ndarray) -> np.ndarray:
    """Unsigned 16 bits of a positive float32 below 2: rounded at bit 13, sign and two top exponent bits dropped."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(4096)) >> np.uint32(13)).astype(np.uint16)


def decode_e6m10(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint32) | np.uint32(1 << 16)) << np.uint32(13)).view(np.float32)


def encode_e3m13(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes relative to 1/n, and which values are exceptions (exponent code 7: looked up in a side table)."""
    bits = x.astype(np.float32).view(np.uint32)
    low = int(np.float32(1 / n).view(np.uint32) >> np.uint32(23)) - 3
    e = ((bits + np.uint32(512)) >> np.uint32(23)).astype(np.int64) - low
    odd = (e < 0) | (e > 6)
    m = ((bits + np.uint32(512)) >> np.uint32(10)) & np.uint32(0x1FFF)
    code = np.where(odd, 7 << 13, np.clip(e, 0, 6) << 13 | m).astype(np.uint16)
    return code, odd


def decode_e3m13(code: np.ndarray, n: int, exceptions: np.ndarray) -> np.ndarray:
    """Values of codes; those of exponent code 7 are taken from ``exceptions``, aligned with the codes."""
    low = int(np.float32(1 / n).view(np.uint32) >> np.uint32(23)) - 3
    e, m = (code.astype(np.uint32) >> np.uint32(13)), code.astype(np.uint32) & np.uint32(0x1FFF)
    return np.where(e == 7, exceptions, ((e + np.uint32(low)) << np.uint32(23) | m << np.uint32(10)).view(np.float32))


def exponent(x: Column) -> Column:
    """Largest e with 2^e <= x, of positive numbers; the logarithm alone may miss it next to a power of two."""
    e = F.floor(F.log2(x))
    return F.when(x < F.pow(F.lit(2.0), e), e - 1).when(x >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)


def round_mantissa(x: Column, bits: int) -> Column:
    """Positive numbers rounded to ``bits`` of mantissa, ties upwards."""
    unit = F.pow(F.lit(2.0), exponent(x) - bits)
    return F.floor(x / unit + 0.5) * unit


def _half(x: Column) -> Column:
    unit = F.pow(F.lit(2.0), F.greatest(exponent(F.abs(x)), F.lit(-14)) - 10)
    rounded = F.rint(x / unit) * unit  # ties to even
    return F.when(x == 0, x).when(F.abs(rounded) > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(rounded)


#: what becomes of a number in single precision
_CODECS = {
    "single": lambda x: x,
    "half": _half,
    "e6m10": lambda x: F.when(x < 2.0**-63, 2.0**-63).otherwise(round_mantissa(x, 10)),
    "e3m13": lambda x: F.when(x == 0, x).otherwise(round_mantissa(x, 13)),
}


def quantise(x: DataFrame, codec: str, column: str = "v") -> DataFrame:
    """Round a column to a narrow form and back: 'half', 'e6m10', 'e3m13', 'single'; plain columns. Null stays null.

    'e6m10' is for numbers from 0 to 2, 'e3m13' for numbers from 0 on; another name is an error.
    """
    if codec not in _CODECS:
        raise ValueError(f"unknown form {codec!r}; known are {', '.join(_CODECS)}")
    return x.withColumn(column, _CODECS[codec](F.col(column).cast("float").cast("double")))


def split_e3m13(x: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (i, v) as 16-bit codes (i, code) and a side table of exceptions (i, exponent).

    A code is three bits of exponent, relative to that of 1/n less 3, and 13 bits of mantissa. Exponent 7 says that the
    exponent stands among the exceptions; so it does for numbers below the range and for the one whose code would be 0,
    which is the code of 0.
    """
    low = int(np.frexp(np.float32(1 / n))[1]) - 1 - 3
    v = quantise(x.select("i", "v"), "e3m13").withColumn("e", F.when(F.col("v") > 0, exponent(F.col("v"))))
    m = F.col("v") / F.pow(F.lit(2.0), F.col("e")) * 8192 - 8192
    e = F.col("e") - low
    plain = e.between(0, 6) & ~((e == 0) & (m == 0))
    code = F.when(F.col("v") == 0, 0).when(plain, e * 8192 + m).otherwise(7 * 8192 + m).cast("int")
    return v.select("i", code.alias("code")), v.filter((F.col("v") > 0) & ~plain).select("i", F.col("e").cast("int").alias("exponent"))


def join_e3m13(codes: DataFrame, exceptions: DataFrame, n: int) -> DataFrame:
    """Rows (i, v) of codes, with the exponents of exceptions looked up by a join."""
    low = int(np.frexp(np.float32(1 / n))[1]) - 1 - 3
    e = F.floor(F.col("code") / 8192)
    e = F.when(e == 7, F.col("exponent")).otherwise(e + low)
    v = F.when(F.col("code") == 0, 0.0).otherwise((1 + F.col("code") % 8192 / 8192) * F.pow(F.lit(2.0), e))
    return codes.join(exceptions, "i", "left").select("i", v.alias("v"))


def wrapped(c: Column, bits: int = 16) -> Column:
    """A whole number as a signed one of so many bits: what is beyond comes in again at the other end."""
    half = 1 << (bits - 1)
    return F.pmod(c.cast("long") + half, F.lit(1 << bits)) - half


def piecewise(x: Column, points: list[int], values: list[int], slopes: list[int], q: int) -> Column:
    """Whole-number interpolation: below the first point its value, from the last point on the last value, and between
    two points value + (slope * distance >> q). The piece is found by halving, so its cost is the log of their number.

    ``slopes`` has one entry fewer than ``points``; a null x gives null.
    """

    def piece(low: int, high: int) -> Column:
        if low == high:
            if low < 0:
                return F.lit(values[0]).cast("long")
            if low == len(points) - 1:
                return F.lit(values[-1]).cast("long")
            return F.lit(values[low]) + F.shiftright(F.lit(slopes[low]) * (x.cast("long") - points[low]), q)
        mid = (low + high + 1) // 2
        return F.when(x < points[mid], piece(low, mid - 1)).otherwise(piece(mid, high))

    return F.when(x.isNotNull(), piece(-1, len(points) - 1))


def _quarters(f, q: int) -> tuple[list[int], list[int], list[int]]:
    """Points at quarters from -1 to .75, f there, and the slopes between them, in Q format, cut towards zero."""
    at = [k / 4 for k in range(-4, 4)]
    return [k << (q - 2) for k in range(-4, 4)], [int(f(a) * (1 << q)) for a in at], [int((f(b) - f(a)) * 4 * (1 << q)) for a, b in zip(at, at[1:])]


def exp_fixed(x: Column, q: int) -> Column:
    """exp of a number in Q format by straight pieces over [-1, .75], constant outside, as a signed 16-bit number."""
    return wrapped(piecewise(x, *_quarters(math.exp, q), q))


def tanh_fixed(x: Column, q: int) -> Column:
    """tanh of a number in Q format, as ``exp_fixed``."""
    return wrapped(piecewise(x, *_quarters(math.tanh, q), q))
