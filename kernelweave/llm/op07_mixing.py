"""Language-model scoring by logistic context mixing over bits.

A text is the bytes of its tokens: each word and a blank, then one end. A byte is coded by a Huffman code that its last
byte chooses, and each bit of it has three predictors, looked up by a hash of their context and of the code bits before:
the last three bytes of the word, the word so far, and, in the first EARLY bytes of a word, the word so far with the word
before it. Their estimates meet in
the logistic domain under weights that a gate chooses (depth of the bit, and whether a word begins); the mix is refined
by an adaptive map from predicted to observed probability. Weights and map start alike and learn after every bit, so a
text's score doesn't depend on other texts of its task, on partitions or on their order. After each SEGMENT bits of a
text they start anew (contexts go on), which bounds the length of what can only be done bit by bit; the bits of all the
segments in some megabytes of text are mixed at once. What depends on a word alone is found once for each word of a
chunk (words are told apart by 64-bit hashes).

What Spark gathers from all whole training texts: how often each word occurs (the base score), each pair of bytes, and
for each context slot each bit. Slots grow with the training bytes from 2^MIN_SLOTS to 2^MAX_SLOTS a predictor, the
bound of what is broadcast; a slot holds the sum of the contexts that share it. The code is one for bytes, so the number
of different words doesn't change it. Counts of at most HELD frequent words are broadcast for the base score, others are
joined to the texts' words by a shuffle after each text has gathered its own; where that line is drawn changes no result.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. Null text: only the end. Equal
rows get equal results, each its own row. Without training texts the base is 0 a token and every slot is even.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import Words, chunks, column_bytes, mix, powers
from kernelweave.session import prepare, release, stored, table

HELD = 1 << 19
MIN_SLOTS, MAX_SLOTS = 16, 22
SLICES = 64
ORDERS = 3
SEGMENT = 1 << 13
EARLY = 4
DEPTHS = 8
GATES = 2 * DEPTHS
TOP = 20
BINS = 24
UNIT = 15.0  # a byte holds logistics from -8 to 8, so that the tables stay in the cache
PAIRS = 1 << 16  # hashes below it stand for pairs of bytes in the table of counts
END = PAIRS  # hash of the end
END_BYTE = 0x0A  # no word has it
BLANKS = b" \t\n\x0b\x0c\r"
PIECE = 4 << 20
TOGETHER = 3  # pieces whose segments are mixed at once: a step costs the less a bit the more it has, until its state leaves the cache
BATCH = 24 << 20  # bits of segments that are mixed at once, four bytes each
RUN = 16  # steps of the mixing that are laid out at a time
SLICE = 1 << 18  # bits that are laid out at a time: what numpy works on stays in the cache
START = (0.30, 0.45, 0.30)  # weights at the start of a segment
RATE = 0.03


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(training: DataFrame) -> DataFrame:
    """hash, n of all tokens of all texts; hashes below PAIRS count the pairs of bytes that are coded."""

    def run(batches):
        held, size, n_texts, pairs = [], 0, 0, np.zeros(PAIRS, np.int64)
        for b in batches:
            for _, part in chunks(column_bytes(b)):
                w = Words(part)
                held.append(w.hashes())
                size += len(w.start)
                n_texts += len(part)
                inside = np.zeros(len(w.data) + 2, np.int8)
                inside[w.start + 1] += 1
                inside[w.end + 1] -= 1
                inside = np.cumsum(inside, dtype=np.int8).astype(bool)  # by place in the text behind one blank
                data = np.where(inside, np.concatenate(([0x20], w.data, [0x20])), 0x20).astype(np.uint16)
                pairs += np.bincount((data[:-1] << np.uint16(8) | data[1:])[inside[:-1] | inside[1:]], minlength=PAIRS)
            if size > 2_000_000:
                yield from out(held)
                held, size = [], 0
        pairs[0x20 << 8 | END_BYTE] = n_texts
        own = np.flatnonzero(np.append(pairs, n_texts))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.append(pairs, n_texts)[own])], names=["hash", "n"])
        yield from out(held)

    def out(held):
        if held:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["hash", "n"])

    return training.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and length of each symbol; a single symbol has an empty code."""
    n = len(counts)
    length = np.zeros(n, np.int64)
    if n > 1:
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up = np.zeros(2 * n - 1, np.int64)
        for node in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
        depth = np.zeros(2 * n - 1, np.int64)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[up[node]] + 1
        length = depth[:n]
    code, value, last = np.zeros(n, np.uint32), 0, 0
    for i in np.lexsort((np.arange(n), length)).tolist():
        value <<= int(length[i]) - last
        last = int(length[i])
        code[i] = value
        value += 1
    return code, length


class Frequent:
    """Counts of frequent words, found by hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        # where the words of each first TOP bits begin, and how many steps the fullest such group takes
        self.jump = np.searchsorted(self.words >> np.uint64(64 - TOP), np.arange((1 << TOP) + 1, dtype=np.uint64))
        self.reach = int(np.diff(self.jump).max(initial=0))

    def find(self, token: np.ndarray) -> np.ndarray:
        """Count of each word, 0 for others; binary search within a group of equal first bits."""
        at = self.jump.take((token >> np.uint64(64 - TOP)).astype(np.int64))
        padded = np.append(self.words, np.uint64(2**64 - 1))
        for _ in range(self.reach):
            at += padded.take(at) < token
        padded[-1] = 0
        return np.where(padded.take(at) == token, np.append(self.counts, 0).take(at), 0)


class Coder:
    """Codes of bytes after each byte before them, and slots of their bits in tables of 2^slots entries."""

    def __init__(self, pairs: np.ndarray, slots: int):
        self.slots = slots
        # no code grows beyond some 20 bits
        found = [huffman(np.maximum(n, max(1, int(n.sum()) >> 16))) for n in pairs.reshape(256, 256)]
        code, self.length = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in range(2))
        self.first = np.cumsum(self.length) - self.length
        pair = np.repeat(np.arange(PAIRS), self.length)
        depth = np.arange(len(pair)) - self.first[pair]
        left = self.length[pair] - depth
        self.node = (code[pair] >> left | 1 << depth).astype(np.uint32) * np.uint32(0x2C1B3C6D)
        self.kind = (np.minimum(depth, DEPTHS - 1) << 1 | code[pair] >> left - 1 & 1).astype(np.int8)

    def slot(self, x: np.ndarray) -> np.ndarray:
        """Slots of hashes of context and node; ``x`` is overwritten."""
        x *= np.uint32(0x297A2D39)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x >>= np.uint32(32 - self.slots)
        return x


def _within(stop: np.ndarray, a: int, z: int) -> tuple[slice, np.ndarray]:
    """Which of the runs that end at ``stop`` meet a to z, and how much of each."""
    own = slice(int(np.searchsorted(stop, a, "right")), int(np.searchsorted(stop, z)) + 1)
    return own, np.diff(np.minimum(stop[own], z), prepend=a)


class Coded:
    """Tokens of texts, and the bits of each different one.

    ``token``, ``text`` (of each token) and ``begin`` (first token of each text); ``words`` are the different tokens and
    ``word`` numbers that of each token. Bits of words: ``kind`` (gate and value), ``near`` and ``so_far`` (hashes of contexts that lie within the word, with the
    node), ``first`` and ``size`` of each word, ``early`` of them in its first bytes. ``stop``: where the bits of each token end, all tokens one after another.
    """

    def __init__(self, texts: list[bytes], coder: Coder):
        w = Words(texts)
        self.n_tokens = w.count + 1
        total = int(self.n_tokens.sum())
        last = np.cumsum(self.n_tokens) - 1
        self.begin = last + 1 - self.n_tokens
        self.text = np.repeat(np.arange(len(texts)), self.n_tokens)
        is_word = np.ones(total, bool)
        is_word[last] = False
        self.token = np.full(total, END, np.uint64)
        self.token[is_word] = w.hashes()
        order = np.argsort(self.token)  # np.unique takes twice the time for the first of equal ones, and any will do
        token = self.token.take(order)
        new = np.append(True, token[1:] != token[:-1])
        self.words, at, self.word = token[new], order[new], np.empty(total, np.int64)
        self.word[order] = np.cumsum(new) - 1
        start, size = np.zeros(total, np.int64), np.ones(total, np.int64)
        start[is_word], size[is_word] = w.start, w.end - w.start + 1
        start, size = start[at], size[at]
        stop = np.cumsum(size)
        n = int(stop[-1])
        begin = np.repeat(stop - size, size)
        place = np.arange(n) - begin
        data = np.append(w.data, np.uint8(0x20)).take(np.repeat(start, size) + place)
        data[stop - 1] = np.where(self.words == END, END_BYTE, 0x20)
        up, down = powers(n + 1)
        hashed = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=hashed[1:])
        so_far = (mix((hashed[:-1] - hashed[begin]) * down[begin] + place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        near = np.zeros(n, np.uint32)
        for j in range(1, 4):
            near[j:] |= np.where(place[j:] >= j, data[:-j].astype(np.uint32) << np.uint32(8 * (j - 1)), np.uint32(0))
        near = near * np.uint32(0xC2B2AE3D) + np.uint32(1)
        pair = data.astype(np.int64) | 0x20 << 8
        pair[1:] = np.where(place[1:] > 0, data[1:].astype(np.int64) | data[:-1].astype(np.int64) << 8, pair[1:])
        length = coder.length.take(pair)
        ends = np.cumsum(length)
        byte = np.repeat(np.arange(n), length)
        path = (coder.first.take(pair) - ends + length).take(byte)
        path += np.arange(len(path))
        node = coder.node.take(path)
        self.kind = coder.kind.take(path)
        self.kind += np.where(place == 0, np.int8(2 * DEPTHS), np.int8(0)).take(byte)
        self.near, self.so_far = near.take(byte), so_far.take(byte)
        self.near ^= node
        self.so_far ^= node
        self.size = np.diff(ends[stop - 1], prepend=0)
        self.first = np.cumsum(self.size) - self.size
        self.early = ends[np.minimum(stop, stop - size + EARLY) - 1] - self.first
        self.stop = np.cumsum(self.size.take(self.word))
        before = np.zeros(total, np.uint64)
        before[1:] = self.token[:-1]
        before[self.begin] = 0
        self.before = (before >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(7)


def count_bits(training: DataFrame, coder) -> DataFrame:
    """slice, stretch (packed int8, in 1/UNIT): the logistic of how often bit 1 came in each slot of a slice.

    A task's counts of a slice are one row; rows of a slice are added up in groups of tasks first, as many as the root of
    their number, and then together. A group's rows pass one by one, so what it holds is the counts of one slice, however many tasks there are.
    """
    from pyspark import TaskContext

    slots = 1 << coder.value.slots
    width, groups = ORDERS * slots // SLICES, math.isqrt(training.rdd.getNumPartitions()) + 1

    def run(batches):
        n, own = np.zeros((ORDERS, 2 * slots), np.uint32), coder.value
        for b in batches:
            for _, part in chunks(column_bytes(b), PIECE >> 1):
                count(n, Coded(part, own), own)
        for s, x in enumerate(n.reshape(SLICES, 2 * width)):
            yield row(s, TaskContext.get().partitionId() % groups, x)

    def row(s, group, x):
        packed = zstandard.ZstdCompressor(level=1).compress(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([group], pa.int64()), pa.array([packed], pa.binary())], names=["slice", "merged", "counts"])

    def added(batches, kind):
        out = np.zeros(2 * width, np.uint64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")):
                out += np.frombuffer(zstandard.decompress(x.as_py()), kind)
        return out

    def some(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(key[0].as_py(), key[1].as_py(), added(batches, np.uint32))

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([stretched(added(batches, np.uint64).astype(np.float64)).tobytes()], pa.binary())], names=["slice", "stretch"])

    kind = "slice long, merged long, counts binary"
    counts = training.select("text").mapInArrow(run, kind).groupBy("slice", "merged").applyInArrow(some, kind)
    return counts.groupBy("slice").applyInArrow(total, "slice long, stretch binary")


def count(n: np.ndarray, coded: Coded, coder: Coder) -> None:
    """Add the bits of texts to the counts of bits 0 and 1 of each slot by predictor."""
    one = np.uint32(1)
    times = np.repeat(np.bincount(coded.word, minlength=len(coded.size)), coded.size).astype(np.uint32)
    bit = (coded.kind & 1).view(np.uint8)
    for k, x in enumerate((coded.near, coded.so_far)):
        np.add.at(n[k], coder.slot(x.copy()) << one | bit, times)
    both = np.empty((len(bit), 2), np.uint32)
    both[:, 0], both[:, 1] = coded.so_far, bit
    both = both.view(np.int64).reshape(-1)
    for a in range(0, len(coded.word), SLICE >> 3):
        word = coded.word[a : a + (SLICE >> 3)]
        early = coded.early.take(word)
        stop = np.cumsum(early)
        at = np.repeat(coded.first.take(word) - stop + early, early)
        at += np.arange(len(at))
        row = both.take(at).view(np.uint32).reshape(-1, 2)
        x = np.repeat(coded.before[a : a + len(word)], early)
        x ^= row[:, 0]
        x = coder.slot(x)
        x <<= one
        x |= row[:, 1]
        x.sort()  # neighbours in memory are read together
        np.add.at(n[2], x, one)


def stretched(n: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.log((n[1::2] + 0.4) / (n[0::2] + 0.4)), -8, 8) * UNIT).astype(np.int8)


def text_scores(coder: Coder, stretch: np.ndarray, pieces: Coded | Iterable[Coded]) -> np.ndarray:
    """log10 probability of each text of the pieces, one piece after another.

    Of a piece only the laid out bits are kept; segments of several pieces are mixed together, up to BATCH bits.
    """
    packed, filled = np.empty(BATCH + RUN, np.int32), 0
    texts, sizes, found, n_texts = [], [], [], 0

    def mixed():
        text, size = np.concatenate(texts), np.concatenate(sizes)
        order = np.argsort(-size, kind="stable")  # longer segments first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        active = len(size) - np.cumsum(np.bincount(size, minlength=int(size.max()) + 1))[:-1]  # segments with more than n bits
        bounds = np.concatenate(([0], np.cumsum(active)))
        found.append((text, _mixed(packed[: filled + RUN].view(np.int8).reshape(-1, ORDERS + 1), bounds, place, (np.cumsum(size) - size)[order])))
        texts.clear()
        sizes.clear()

    for coded in [pieces] if isinstance(pieces, Coded) else pieces:
        known = _known(coder, stretch, coded)
        stop = coded.stop[coded.begin + coded.n_tokens - 1]
        start = stop - np.diff(stop, prepend=0)
        n_parts = -(-(stop - start) // SEGMENT)
        text = np.repeat(np.arange(len(stop)), n_parts)
        begin = start[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)) * SEGMENT
        end = np.minimum(begin + SEGMENT, stop[text])
        i = 0
        while i < len(text):
            j = int(np.searchsorted(end, begin[i] + BATCH - filled, "right"))
            if j > i:
                _laid_out(coder, stretch, coded, known, int(begin[i]), int(end[j - 1]), packed[filled : filled + int(end[j - 1] - begin[i])])
                filled += int(end[j - 1] - begin[i])
                texts.append(text[i:j] + n_texts)
                sizes.append((end - begin)[i:j])
                i = j
            else:
                mixed()
                filled = 0
        n_texts += len(stop)
        del coded, known
    if texts:
        mixed()
    out = np.zeros(n_texts)
    for text, x in found:
        out += np.bincount(text, weights=x, minlength=n_texts)
    return out / np.log(10)


def _known(coder: Coder, stretch: np.ndarray, coded: Coded) -> np.ndarray:
    """What the bits of words have in any place: two stretches, a mask of early bits, gate and value; and the hash for the third."""
    known = np.empty((len(coded.kind), 2), np.uint32)
    parts = known.view(np.int8)
    parts[:, 0] = stretch[0].take(coder.slot(coded.near.copy()))
    parts[:, 1] = stretch[1].take(coder.slot(coded.so_far.copy()))
    early = np.zeros(len(known) + 1, np.int8)
    early[coded.first] = -1
    np.add.at(early, coded.first + coded.early, np.int8(1))
    parts[:, 2] = np.cumsum(early[:-1], dtype=np.int8)
    parts[:, ORDERS] = coded.kind
    known[:, 1] = coded.so_far
    return known.view(np.int64).reshape(-1)


def _laid_out(coder: Coder, stretch: np.ndarray, coded: Coded, known: np.ndarray, base: int, end: int, packed: np.ndarray) -> None:
    """Bits from ``base`` to ``end`` of a piece, one after another: of each three stretches and a byte of gate and value."""
    for a in range(base, end, SLICE):
        z = min(a + SLICE, end)
        own, size = _within(coded.stop, a, z)
        word = coded.word[own]
        path = np.repeat(coded.first.take(word) - coded.stop[own] + coded.size.take(word), size)
        path += np.arange(a, z)
        row = known.take(path).view(np.uint32).reshape(-1, 2)
        x = np.repeat(coded.before[own], size)
        x ^= row[:, 1]
        out = packed[a - base : z - base]
        out[:] = row[:, 0].view(np.int32)
        out.view(np.int8)[2 :: ORDERS + 1] &= stretch[2].take(coder.slot(x))


def _mixed(packed: np.ndarray, bounds: np.ndarray, place: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each segment: one bit of each at a time.

    Segments are ordered by falling length, ``place`` is that of each, and the n-th bits of all make up the n-th of
    ``bounds``. Bits lie in that order, or those of a segment one after another from its ``start`` and RUN more behind all. RUN steps have the
    segments that the first has: what a segment does behind its end changes nothing but its own weights and counts as 1.
    Probabilities p are held as 2p - 1, the tanh of half their logistic, and weights and stretches are scaled so that their
    product is that half and a weight moves by error times stretch.
    """
    n, lanes, active = len(place), ORDERS + 1, np.diff(bounds)
    size = np.searchsorted(-active, -np.arange(n))
    unit = np.float32(math.sqrt(RATE) / UNIT / 2)
    weights = np.tile(np.array([*(x / math.sqrt(RATE) for x in START), 0], np.float32), GATES * n).view(np.complex128)  # four lanes each
    refined = np.tile(np.tanh(np.linspace(-4, 4, BINS)).astype(np.float32), n)
    own, out, words = np.arange(n), np.zeros(n), packed.view(np.int32).reshape(-1)
    windows = None if start is None else np.lib.stride_tricks.sliding_window_view(words, RUN)
    # whole arrays, for numpy is slower with a number and an array
    arrays = [np.full(n, x, np.float32) for x in (-4, 4, (BINS - 1) / 8, BINS / 2, 31 / 32)]
    arrays += [own * BINS, np.empty(n, np.complex128), np.empty((n, lanes), np.float32), np.zeros((n, lanes), np.float32), np.empty(n, np.complex64), *np.empty((3, n), np.float32), np.empty(n, np.int64)]
    for first in range(0, len(active), RUN):
        m, k = int(active[first]), min(RUN, len(active) - first)
        low, high, bins, middle, slow, cells, ws, product, error, half, dot, p, r, cell = (x[:m] for x in arrays)
        w, left, right = ws.view(np.float32).reshape(m, lanes), product.view(np.complex64)[:, 0], product.view(np.complex64)[:, 1]
        real, imag, error_0, error_1, error_2 = half.real, half.imag, *error[:, :ORDERS].T
        if start is None:
            word = words.take(bounds[first : first + k, None] + own[:m], mode="clip")
        else:
            word = np.ascontiguousarray(windows[start[:m] + first].T[:k])
        x = word.view(np.int8).reshape(k, m, lanes) * unit
        x[:, :, ORDERS] = 0
        kind = word >> 24
        y = ((kind & 1) * 2 - 1).astype(np.float32)
        rows = (kind >> 1).astype(np.int64)
        rows *= n
        rows += own[:m]
        part, q = y / np.float32(32), np.empty((k, m), np.float32)
        for xs, row, ys, ps, qs in zip(x, rows, y, part, q):
            weights.take(row, out=ws, mode="clip")
            np.multiply(w, xs, out=product)
            np.add(left, right, out=half)
            np.add(real, imag, out=dot)
            np.maximum(dot, low, out=dot)
            np.minimum(dot, high, out=dot)
            np.tanh(dot, out=p)
            np.multiply(dot, bins, out=dot)
            np.add(dot, middle, out=dot)
            np.copyto(cell, dot, casting="unsafe")
            np.add(cell, cells, out=cell)
            refined.take(cell, out=r, mode="clip")
            np.add(p, r, out=qs)
            np.subtract(ys, p, out=error_0)
            error_1[:] = error_0
            error_2[:] = error_0
            np.multiply(error, xs, out=product)
            np.add(w, product, out=w)
            weights[row] = ws
            np.multiply(r, slow, out=r)
            np.add(r, ps, out=r)
            refined[cell] = r
        q *= y
        q += np.float32(2)
        q *= np.float32(0.25)  # probability of what the bit is
        over = int(np.searchsorted(-size, -(first + k), "right"))
        if over < m:
            q[:, over:][np.arange(first, first + k)[:, None] >= size[over:m]] = 1
        for i in range(0, k, 8):  # the product of eight can't vanish
            out[:m] += np.log(np.multiply.reduce(q[i : i + 8], axis=0))
    return out[place]


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (those that are coded) of each row."""
    spark = prepare(documents.sparkSession)
    training = documents.filter(~held_out())
    counts = stored(count_words(training), "words")
    words = counts.filter(f"hash < 0 OR hash >= {PAIRS}")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bins = sorted(words.groupBy(F.floor(F.log2("n") * 32).alias("bin")).count().collect(), reverse=True)  # some 2,000 rows at most
    least, held = 1 << 62, 0
    for r in bins:
        held += r["count"]
        if held > HELD:
            break
        least = r["bin"]
    is_frequent = F.floor(F.log2("n") * 32) >= least
    top = words.filter(is_frequent).toPandas()  # at most HELD rows
    pairs = np.zeros(PAIRS, np.int64)
    for r in counts.filter(f"hash >= 0 AND hash < {PAIRS}").collect():  # at most PAIRS rows
        pairs[r["hash"]] = r["n"]
    slots = min(max(int(pairs.sum() >> 3).bit_length(), MIN_SLOTS), MAX_SLOTS)
    coder = spark.sparkContext.broadcast(Coder(pairs, slots))
    frequent = spark.sparkContext.broadcast(Frequent(top.hash.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.int64)))
    slices = sorted(count_bits(training, coder).collect())
    stretch = np.frombuffer(b"".join(r["stretch"] for r in slices), np.int8) if slices else np.zeros(ORDERS << slots, np.int8)
    tables = spark.sparkContext.broadcast(stretch.reshape(ORDERS, 1 << slots))
    release(spark)
    floor = float(np.log10(n_all + 0.5 * (n_kinds + 1)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def base(part, coded, first):
        """Columns of whole texts, and places, hashes and counts of their words that aren't frequent."""
        n, text = len(part), coded.text
        times = frequent.value.find(coded.words)
        known = (times > 0).take(coded.word)
        score = np.bincount(text, weights=np.where(times > 0, np.log10(times + 0.5), 0).take(coded.word), minlength=n)
        n_known = np.bincount(text[known], minlength=n)
        size = np.fromiter((len(x.translate(None, BLANKS)) for x in part), np.int64, n) + coded.n_tokens  # a byte behind each word, and the end
        odd = np.flatnonzero(~known)
        pair, times = np.unique(text[odd] * len(coded.words) + coded.word[odd], return_counts=True)
        owner, word = np.divmod(pair, len(coded.words))
        return (coded.n_tokens, n_known, score), size, owner + first, coded.words[word].view(np.int64), times, first

    def run(batches):
        for b in batches:
            ids, t, held = b.column(0), b.column(2), []

            def pieces(parts):
                for i, part in parts:
                    coded = Coded(part, coder.value)
                    held.append(base(part, coded, i))
                    yield coded
                    del coded

            parts = chunks(column_bytes(b), PIECE >> 1)
            while some := list(islice(parts, TOGETHER)):
                model = text_scores(coder.value, tables.value, pieces(some))
                for whole, size, owner, words, times, first in held:
                    n, m = len(size), len(owner)
                    rows, zero = pa.array(np.concatenate((np.arange(n) + first, owner))), np.zeros(m, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), t.take(rows), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(words)]), *(pa.array(np.concatenate(x)) for x in ((np.zeros(n, np.int64), times), (np.ones(n, np.int64), zero), (whole[0], zero), (whole[1], zero), (whole[2], zero.astype(float)), (model[:n], zero.astype(float)), (size, zero)))],
                        names=["doc_id", "t", "hash", "k", "rows", "n_tokens", "n_known", "base", "model", "n_bytes"],
                    )
                    model = model[n:]
                held.clear()

    found = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    rows = found.select("doc_id", "text", "t").mapInArrow(lambda bs: run(b.select(["doc_id", "text", "t"]) for b in bs), f"doc_id {kind}, t long, hash long, k long, rows long, n_tokens long, n_known long, base double, model double, n_bytes long")
    rows = stored(rows, "scores")
    whole = rows.filter("rows = 1").groupBy("doc_id", "t").agg(F.sum("rows").alias("rows"), *(F.first(x).alias(x) for x in ("n_tokens", "n_known", "base", "model", "n_bytes")))
    rare = words.filter(~is_frequent).select("hash", "n")
    light = rows.filter("rows = 0").select("doc_id", "t", "hash", "k").join(rare, "hash", "left")
    n = F.coalesce("n", F.lit(0))
    light = light.groupBy(F.col("doc_id").alias("d2"), F.col("t").alias("t2")).agg(F.sum(F.col("k") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("met"))
    both = whole.join(light, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    base = F.col("base") + F.coalesce(F.col("more") / F.col("rows"), F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)
    known = (F.col("n_known") + F.coalesce(F.col("met") / F.col("rows"), F.lit(0))).cast("long")
    result = both.select("doc_id", held_out().alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("model").alias("score"), "n_bytes", "rows")
    return result.withColumn("rows", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).drop("rows")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).drop("n_bytes")
