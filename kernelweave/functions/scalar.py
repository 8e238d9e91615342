"""Scalar functions as column expressions: activations, their fast approximations, text and Huffman helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.session import prepare


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def hard_sigmoid(x: Column) -> Column:
    """Piecewise linear: 0.2 x + 0.5 cut to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * x + 0.5))


def softmax(x: Column, keys: list[str]) -> Column:
    """exp(x) over its sum within ``keys``; the largest is not taken off first."""
    return F.exp(x) / F.sum(F.exp(x)).over(Window.partitionBy(*keys))


def log_loss(scores: DataFrame, keys: list[str], score: str, is_target: str) -> DataFrame:
    """keys, loss: softmax cross-entropy by log-sum-exp around the largest score."""
    top = scores.withColumn("_m", F.max(score).over(Window.partitionBy(*keys)))
    return top.groupBy(*keys).agg((F.max("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m")))) - F.sum(F.when(F.col(is_target), F.col(score)).otherwise(0.0))).alias("loss"))


def fast_exp(x: Column) -> Column:
    """Exponential by writing the exponent field of a float: 184 x + 16249 in the upper 16 bits, x cut to -25..25.

    The bits e * 2^23 + m stand for 2^(e - 127) * (1 + m / 2^23), so powers of two express them in plain columns.
    """
    i = F.floor(184.0 * F.greatest(F.lit(-25.0), F.least(F.lit(25.0), x)) + 16249.0)  # upper half: 8 bits of exponent, 7 of mantissa
    return F.pow(F.lit(2.0), F.floor(i / 128) - 127) * (1 + F.pmod(i, F.lit(128)) / 128)


def fast_tanh(x: Column) -> Column:
    e = fast_exp(2 * x)
    return (e - 1) / (e + 1)


def fast_log(x: Column) -> Column:
    """Logarithm by reading the exponent field of a float: (upper 16 bits - 16249) / 184; null where x isn't positive."""
    x = x.cast("float").cast("double")
    e = F.floor(F.log2(x))  # one off next to a power of two, mended below
    e = F.when(x < F.pow(F.lit(2.0), e), e - 1).when(x >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)
    upper = (e + 127) * 128 + F.floor((x / F.pow(F.lit(2.0), e) - 1) * 128)
    return F.when(x > 0, (upper - 16249.0) / 184.0)


def fast_pow(base: Column, power: Column) -> Column:
    """exp(log(base) * power), both by the exponent field."""
    return fast_exp(fast_log(base) * power)


def edit_error(guess: Column, truth: Column) -> Column:
    """Edit distance in characters over the length of the truth; null where the truth is empty."""
    return F.try_divide(F.levenshtein(guess, truth).cast("double"), F.length(truth).cast("double"))


def int_power(x: Column, n: int) -> Column:
    """Exponentiation by squaring: about 2 log2 n products, no floating ``pow``."""
    out = F.lit(1.0)
    while n:
        if n & 1:
            out = out * x
        x, n = x * x, n >> 1
    return out


class HuffmanTable:
    """A code as a finite-state machine over bytes: state and byte give the symbols that end there and the next state.

    States are the inner nodes of the code's tree (the root is 0); bits come from the lowest of a byte. Where one code
    begins another the shorter one is read. A bit that no code has leads to state ``dead``, in which nothing is read.
    """

    def __init__(self, codes: dict[str, int]):
        inner: list[dict[str, int]] = [{}]  # node -> bit -> node
        leaf: dict[tuple[int, str], int] = {}
        for bits in sorted(filter(None, codes), key=len):
            at = 0
            for bit in bits[:-1]:
                if (at, bit) in leaf:
                    break  # a shorter code is read first
                if bit not in inner[at]:
                    inner.append({})
                    inner[at][bit] = len(inner) - 1
                at = inner[at][bit]
            else:
                leaf.setdefault((at, bits[-1]), codes[bits])
        self.dead = len(inner)
        step = np.full((self.dead + 1, 2), self.dead, np.int32)
        symbol = np.zeros((self.dead + 1, 2), np.int32)
        ends = np.zeros((self.dead + 1, 2), bool)
        for node, ahead in enumerate(inner):
            for bit, target in ahead.items():
                step[node, int(bit)] = target
        for (node, bit), own in leaf.items():
            step[node, int(bit)], symbol[node, int(bit)], ends[node, int(bit)] = 0, own, True
        # eight steps at once for every state and byte
        state = np.repeat(np.arange(self.dead + 1)[:, None], 256, 1)
        byte = np.arange(256)[None, :].repeat(self.dead + 1, 0)
        count = np.zeros(state.shape, np.int8)
        symbols = np.zeros((*state.shape, 8), np.int32)
        rows, cols = np.indices(state.shape)
        for k in range(8):
            bit = byte >> k & 1
            found = ends[state, bit]
            at = rows[found], cols[found]
            symbols[(*at, count[at])] = symbol[state, bit][found]
            count += found
            state = step[state, bit]
        self.table = [[(tuple(symbols[s, b, : count[s, b]].tolist()), int(state[s, b])) for b in range(256)] for s in range(self.dead + 1)]

    def decode(self, data: bytes, limit: int) -> list[int]:
        """At most ``limit`` symbols: one look at the table a byte, which is faster than steps over many rows at once."""
        out: list[int] = []
        own = self.table[0]
        for byte in data:
            symbols, ahead = own[byte]
            out += symbols
            if len(out) >= limit or ahead == self.dead:
                break
            own = self.table[ahead]
        return out[:limit]


def huffman_decode(packed: DataFrame, codes: dict[str, int], column: str = "bits", n: str = "n") -> DataFrame:
    """``values`` ARRAY<INT> of rows with packed bytes (bits from the lowest of each byte) and how many symbols to read.

    ``codes`` maps bit strings to symbols (the code table, bounded). A finite-state machine takes a byte a step. Null bytes or a null number give an empty array; bits that no code has end a row.
    """
    prepare(packed.sparkSession)
    machine = HuffmanTable(codes)

    def run(batches):
        for b in batches:
            limits = [0 if pd.isna(v) else max(0, int(v)) for v in b[n]]
            yield b.assign(values=[machine.decode(x or b"", k) for x, k in zip(b[column], limits)])

    return packed.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema) + ", values array<int>")
