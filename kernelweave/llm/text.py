"""Vectorised text kernels used inside Spark tasks: chunked byte buffers, word spans, word and shingle hashes.

All hashes are 64-bit and depend on the bytes of a word alone, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that one numpy pass handles; a longer text is a chunk of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: for [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased bytes
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n, kept per worker and grown by doubling."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, CHUNK + (CHUNK >> 3))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
        if m > 8 * CHUNK:  # tables of one very long text are not kept
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of at most ``limit`` bytes together, or one longer text. Null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def column_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


class Words:
    """Words of a chunk: ``start`` and ``end`` in ``data``, and ``first``: for each text the index of its first word.

    The texts are joined by one separator byte, so no word crosses two texts.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, seps: np.ndarray = SPACE):
        joined = b" ".join(texts)
        self.raw = joined.lower() if lower else joined  # bytes.lower() changes A-Z alone
        self.data = np.frombuffer(self.raw, np.uint8)
        edge = np.ones(len(self.data) + 2, np.int8)
        edge[1:-1] = seps[self.data]
        step = np.diff(edge)
        self.start, self.end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        self.text_end = self.text_start + size
        self.first = np.concatenate((np.searchsorted(self.start, self.text_start), [len(self.start)]))
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self.data)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; the last n - 1 runs wrap and are the caller's to leave out."""
    total = np.zeros(len(h), np.uint64)
    for j in range(n):
        total[: len(h) - j] += h[j:] * _MULT[j]
    return mix(total + np.uint64(n))
