"""Exact substring dedup: remove each byte covered by a string of ``SPAN`` bytes that also starts earlier.

Suffixes of all bytes of a corpus can't be exchanged, so only those are sorted that can decide something:

1. Filter. In each window of SPAN bytes the smallest hash of GRAM bytes is its anchor (leftmost on ties), so equal
   windows have equal anchors at equal places; an anchor owns a run of windows. Hashes of the anchors' grams are counted
   in buckets; a gram that stands in one place only has no repeated window and is left here. Grams that repeat within a
   task are told there and sent once a task. The filter can only let too much through.
2. Sort. Tasks sort the suffixes that start at the anchors that are left (as long as their windows reach) and exchange
   them front-coded: length of the prefix shared with the suffix before, then the rest. A loser tree combines the runs by
   the prefix lengths they already know and compares bytes only beyond them.
3. Decision. Windows that start f bytes before their anchors are equal where the suffixes share SPAN - f bytes, that is,
   where no neighbour in the merged order between them shares less, and where the f bytes before are equal, read off the
   common prefixes of the reversed bytes in the same way. Of equal windows all but the first by place are repeated.
   Bytes decide; hashes don't. A gram with more than ``GROUP`` suffixes is not decided in one piece: its windows leave the
   task as Arrow batches while the runs are still being merged, and a keyed aggregate, which Spark splits, decides them.
4. The repeated windows are joined with the texts and cut out.

Order: doc_id (null first), then a hash of the text, then the start; so rows of one id with other texts are ordered
somehow but always alike, and equal rows count as one document and get equal results. Null text is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import chunks, column_bytes, mix, powers
from kernelweave.session import prepare, release, stored, table

SPAN, GRAM = 100, 50
SHIFT = SPAN - GRAM  # an anchor lies at most so far behind the start of its window
GROUP = 200_000
PER_BUCKET = 500_000
KNOWN = np.uint32(1 << 31)  # marks a gram that its task has several times
PLACE = np.dtype([("d", "<i8"), ("t", "<i8"), ("i", "<u4")])  # document, text hash, index of the anchor in its text
LEAN = np.dtype([("t", "<i8"), ("i", "<u4")])  # hash of document and text, index: enough for the filter
SENT = np.dtype([("fp", "S6"), ("place", LEAN)])
INFO = np.dtype([("place", PLACE), ("near", "u1"), ("far", "u1")])  # least and largest distance from a window's start to its anchor


class Anchors:
    """Anchors of the texts of a chunk: ``at``, ``lo`` and ``hi`` (first and last owned window) in the joined bytes."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.size, self.stop = size, np.cumsum(size)
        self.start = self.stop - size
        n = len(data)
        if n < SPAN:
            self.at = self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.fp = np.zeros(0, np.uint64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        low = (gram & ~np.uint64((1 << 31) - 1)) | np.arange(len(gram), dtype=np.uint64)  # hash first, then place
        reach, width = 1, SHIFT + 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if width > reach:
            low = np.minimum(low[: -(width - reach)], low[width - reach :])
        owner = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
        window = np.arange(len(owner))
        doc = np.searchsorted(self.stop, window, "right")
        inside = window + SPAN <= self.stop[doc]
        owner, window, doc = owner[inside], window[inside], doc[inside]
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        cut = np.flatnonzero(cut)
        self.at, self.lo, self.doc = owner[cut], window[cut], doc[cut]
        self.hi = window[np.concatenate((cut[1:], [len(owner)])) - 1] if len(cut) else self.lo
        self.fp = gram[self.at]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _keyed(documents: DataFrame) -> DataFrame:
    """d (doc_id, null smallest), t (hash of the text), k (hash of both), text."""
    own = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t"), "text")
    return own.withColumn("k", F.xxhash64("d", "t"))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of equal keys."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.concatenate((first[1:], [len(key)])).astype(np.int64)


def _by_part(place: np.ndarray, mask: np.ndarray | None, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Places (and masks), packed, by part of documents."""
    part = np.abs(place["t"] % parts)
    order = np.argsort(part, kind="stable")
    place, part, mask = place[order], part[order], None if mask is None else mask[order]
    for a, z in zip(*_runs(part)) if len(part) else ():
        yield int(part[a]), place[a:z].tobytes(), b"" if mask is None else mask[a:z].tobytes()


def _collected(found: DataFrame, kind: np.dtype = PLACE) -> DataFrame:
    """The document of each place (d and t, or the hash t alone), at (packed anchor indexes), masks (packed) from packed rows by part."""
    names = [x for x in kind.names if x != "i"]

    def collect(key, found):
        place = np.frombuffer(b"".join(found["places"].to_pylist()), kind)
        mask = np.frombuffer(b"".join(found["masks"].to_pylist()), "<i8")
        order = np.lexsort([place[x] for x in reversed(names)])
        place, mask = place[order], mask[order] if len(mask) else mask
        first, end = _runs(place[names]) if len(place) else (np.zeros(0, np.int64),) * 2
        at = np.ascontiguousarray(place["i"])
        cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(first.tolist(), end.tolist())], pa.binary())
        return pa.table([*(pa.array(np.ascontiguousarray(place[x][first])) for x in names), cut(at), cut(mask)], names=[*names, "at", "masks"])

    return found.groupBy("part").applyInArrow(collect, f"{', '.join(f'{x} long' for x in names)}, at binary, masks binary")


def repeats(keyed: DataFrame, buckets: int) -> DataFrame:
    """k, at (packed indexes of the anchors whose gram stands elsewhere too): the filter."""

    def send(batches):
        held, size = [], 0
        for b in batches:
            k = b.column(0).to_numpy()
            for i, part in chunks(column_bytes(b)):
                a = Anchors(part)
                x = np.zeros(len(a.at), LEAN)
                x["t"] = k[i + a.doc]
                x["i"] = np.arange(len(a.at)) - a.first[a.doc]
                held.append((a.fp, x))
                size += len(x)
            if size > 1_000_000:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    def pack(held):
        fp, place = (np.concatenate([x[k] for x in held]) for k in range(2))
        order = np.argsort(fp, kind="stable")
        fp, place = fp[order], place[order]
        first, end = _runs(fp)
        several = end - first > 1
        told = place[np.repeat(several, end - first)]
        for p, places, _ in _by_part(told, None, buckets):
            yield block(-1 - p, places)
        fp, place = fp[first], place[first]
        place["i"] |= np.where(several, KNOWN, np.uint32(0))
        bucket = ((fp >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sent = np.zeros(len(fp), SENT)
        sent["fp"], sent["place"] = _six(fp[order]).view("S6").reshape(-1), place[order]
        for a, z in zip(*_runs(bucket[order])):
            yield block(int(bucket[order[a]]), sent[a:z].tobytes())

    def block(bucket, data):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "block"])

    def meet(key, found):
        raw = b"".join(found["block"].to_pylist())
        if key[0].as_py() < 0:
            return answer([(-1 - key[0].as_py(), raw, b"")])
        x = np.frombuffer(raw, np.uint8).reshape(-1, SENT.itemsize)
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, :6] = x[:, :6]
        fp, place = wide.view("<u8").reshape(-1), np.ascontiguousarray(x[:, 6:]).view(LEAN).reshape(-1)
        order = np.argsort(fp, kind="stable")
        first, end = _runs(fp[order])
        place = place[order[np.repeat(end - first > 1, end - first)]]
        return answer(_by_part(place[place["i"] < KNOWN], None, buckets))  # the others are told already

    def answer(rows):
        rows = list(rows)
        return pa.table([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "places", "masks"])

    met = keyed.select("k", "text").mapInArrow(send, "bucket long, block binary").groupBy("bucket").applyInArrow(meet, "part long, places binary, masks binary")
    return _collected(met, LEAN).select(F.col("t").alias("k"), "at")


# --- suffix runs -------------------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # the first difference by halving: slices compare at C speed
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def decoded(lcp: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for k, n in zip(lcp, sizes):
        last = last[:k] + rests[at : at + n]
        at += n
        yield last, k


def merged(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, index in it, suffix, prefix shared with the suffix before) of all runs in order, by a loser tree.

    Each node holds the loser of its match with the prefix length it shares with the winner. Of two heads that were
    both compared with the last winner, the one that shares more with it is smaller; bytes are compared only when both
    share equally much, and only beyond what is known.
    """
    k = len(runs)
    if not k:
        return
    heads: list[tuple[bytes, int] | None] = []
    streams = [decoded(*r) for r in runs]
    lcps, index = [0] * k, [0] * k
    for s in streams:
        heads.append(next(s, None))
    text: list[bytes | None] = [h[0] if h else None for h in heads]
    tree = [-1] * k  # tree[1..k-1] hold losers

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length then is relative to the winner."""
        if text[a] is None:
            return b, a
        if text[b] is None:
            return a, b
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)  # the loser's shared prefix with the winner stays its length
        x = shared_prefix(text[a], text[b], lcps[a])
        if text[a][x : x + 1] <= text[b][x : x + 1]:
            lcps[b] = x
            return a, b
        lcps[a] = x
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser = match(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return w

    winner = build(1) if k > 1 else 0
    while text[winner] is not None:
        yield winner, index[winner], text[winner], lcps[winner]
        after = next(streams[winner], None)
        index[winner] += 1
        text[winner], lcps[winner] = after if after else (None, 0)
        node = (winner + k) // 2
        while node >= 1 and k > 1:
            w, tree[node] = match(winner, tree[node])
            winner = w
            node //= 2


def _rank(place: np.ndarray) -> np.ndarray:
    """Rank of each place by document, text hash and index; equal places share one."""
    order = np.lexsort((place["i"], place["t"], place["d"]))
    new = np.ones(len(place), bool)
    new[1:] = place[order][1:] != place[order][:-1]
    rank = np.empty(len(place), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _full(info: np.ndarray) -> np.ndarray:
    """Mask of all windows of an anchor."""
    one = np.int64(1)
    return (one << (info["far"].astype(np.int64) + 1)) - (one << info["near"].astype(np.int64))


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row of bytes shares with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


def front_coded(right: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Of sorted suffixes (rows of bytes, with their sizes): prefix lengths shared with the one before, sizes of the rests, the rests."""
    lcp = np.minimum(_shared(right), np.minimum(size, np.concatenate(([0], size[:-1]))))
    place = np.arange(right.shape[1])
    rest = right[(place >= lcp[:, None]) & (place < size[:, None])]
    return lcp.astype(np.uint8).tobytes(), (size - lcp).astype(np.uint8).tobytes(), rest.tobytes()


_RUN = ("lcp", "sizes", "rests", "lefts", "info", "copies")


def suffix_runs(asked: DataFrame, parts: int) -> DataFrame:
    """part and a sorted run of the suffixes at the anchors in question: front-coded, with the bytes before each, reversed.

    Anchors of a task with equal windows go as one; those that aren't the first are ``copies``, told on the spot.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            index = [np.frombuffer(x, "<u4") for x in b.column(3).to_pylist()]
            for i, texts in chunks(column_bytes(b)):
                a = Anchors(texts)
                for j, m in enumerate(np.diff(a.first).tolist()):  # a text with the same 64 bits can ask for more anchors
                    index[i + j] = index[i + j][index[i + j] < m]
                n = np.fromiter(map(len, index[i : i + len(texts)]), np.int64, len(texts))
                doc = np.repeat(np.arange(len(texts)), n)
                if not len(doc):
                    continue
                own = np.concatenate(index[i : i + len(texts)]).astype(np.int64)
                q = a.first[doc] + own
                info = np.zeros(len(q), INFO)
                info["place"]["d"], info["place"]["t"], info["place"]["i"] = d[i + doc], t[i + doc], own
                info["near"], info["far"] = a.at[q] - a.hi[q], a.at[q] - a.lo[q]
                data = np.concatenate((np.frombuffer(a.raw, np.uint8), np.zeros(SPAN, np.uint8)))
                right = data[a.at[q][:, None] + np.arange(SPAN)]
                right[np.arange(SPAN) >= SPAN - info["near"].astype(np.int64)[:, None]] = 0
                left = data[a.at[q][:, None] - 1 - np.arange(SHIFT)]
                left[np.arange(SHIFT) >= info["far"][:, None]] = 0
                held.append(((a.fp[q] >> np.uint64(20)) % np.uint64(parts), right, left, info))
                size += len(q)
            if size > 400_000:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    pack = lambda x: zstandard.ZstdCompressor(level=1).compress(x)

    def out(held):
        part, right, left, info = (np.concatenate([x[k] for x in held]) for k in range(4))
        bytes_of = lambda x: np.ascontiguousarray(x).view(f"S{x.shape[1]}").reshape(-1)
        # numpy takes zero bytes at the end for none, so sizes break ties
        order = np.lexsort((_rank(info["place"]), bytes_of(left), info["far"], -info["near"].astype(np.int64), bytes_of(right), part))
        part, right, left, info = part[order], right[order], left[order], info[order]
        same = np.zeros(len(part), bool)
        same[1:] = (part[1:] == part[:-1]) & (info["near"][1:] == info["near"][:-1]) & (info["far"][1:] == info["far"][:-1])
        same &= (_shared(right) == SPAN) & (_shared(left) == SHIFT)
        again = same.copy()
        again[1:] &= info["place"][1:] != info["place"][:-1]  # equal rows are one document
        begin = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
            keep = np.flatnonzero(~same[s:e]) + s
            own = info[keep]
            lefts = left[keep][np.arange(SHIFT) < own["far"][:, None]]
            lcp, sizes, rests = front_coded(right[keep], SPAN - own["near"].astype(np.int64))
            row = (lcp, sizes, pack(rests), pack(lefts.tobytes()), own.tobytes(), info[s:e][again[s:e]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(part[s])], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["part", *_RUN])

    return asked.mapInArrow(run, f"part long, {', '.join(f'{x} binary' for x in _RUN)}")


def decide(lcp: np.ndarray, left: np.ndarray, info: np.ndarray) -> np.ndarray:
    """Mask of repeated windows of each suffix, in merged order: ``lcp`` is the prefix shared with the one before."""
    n = len(info)
    rank, mask = _rank(info["place"]), np.zeros(n, np.int64)
    order = np.lexsort(left.T[::-1])
    before = _shared(left[order])
    near, far = info["near"].astype(np.int64), info["far"].astype(np.int64)
    for f in range(SHIFT + 1):
        own = np.flatnonzero((near <= f) & (far >= f))
        if len(own) < 2:
            continue
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(before < f)
        key = np.cumsum(lcp < SPAN - f)[own] * (n + 1) + group[own]
        by = np.lexsort((rank[own], key))
        own, key = own[by], key[by]
        first, end = _runs(key)
        again = rank[own] != np.repeat(rank[own[first]], end - first)
        mask[own[again]] |= np.int64(1) << np.int64(f)
    return mask


def repeated_windows(runs: DataFrame, parts: int, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Packed masks by part of documents, and rows (d, t, i, mask) of grams that were too large to hold.

    Bit f of a mask is set where the window that starts f bytes before an anchor is repeated.
    """

    kinds = {"part": pa.int64(), "places": pa.binary(), "masks": pa.binary(), "d": pa.int64(), "t": pa.int64(), "i": pa.int64(), "f": pa.int32(), "window": pa.binary()}

    def row(n, **cols):
        return pa.RecordBatch.from_arrays([cols.get(k, pa.nulls(n, t)) for k, t in kinds.items()], names=list(kinds))

    def handed_on(own, suffixes, left, info):
        """The windows of suffixes as bytes, a batch for some suffixes and each distance."""
        for s in range(0, len(own), 4096):
            x = own[s : s + 4096]
            right = np.frombuffer(b"".join(y.ljust(SPAN, b"\0") for y in suffixes[s : s + 4096]), np.uint8).reshape(-1, SPAN)
            before = left[x][:, ::-1]
            for f in range(SHIFT + 1):
                at = np.flatnonzero((info["near"][x] <= f) & (info["far"][x] >= f))
                if len(at):
                    windows = np.hstack((before[at, SHIFT - f :], right[at, : SPAN - f]))
                    place = info["place"][x[at]]
                    data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, SPAN * (len(at) + 1), SPAN, np.int32)), pa.py_buffer(np.ascontiguousarray(windows))])
                    yield row(len(at), **{k: pa.array(np.ascontiguousarray(place[k]).astype(np.int64)) for k in "dti"}, f=pa.array(np.full(len(at), f, np.int32)), window=data)

    def combine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: [] for k in _RUN}
        for b in batches:
            for k in _RUN:
                found[k] += b.column(b.schema.get_field_index(k)).to_pylist()
        coded = [(lcp, sizes, zstandard.decompress(rests)) for lcp, sizes, rests in zip(*(found[k] for k in ("lcp", "sizes", "rests")))]
        infos = [np.frombuffer(x, INFO) for x in found["info"]]
        info = np.concatenate(infos)
        left = np.zeros((len(info), SHIFT), np.uint8)
        left[np.arange(SHIFT) < info["far"][:, None]] = np.frombuffer(b"".join(map(zstandard.decompress, found["lefts"])), np.uint8)
        start = np.cumsum([0, *map(len, infos)]).tolist()
        told = np.frombuffer(b"".join(found["copies"]), INFO)
        del found
        places, masks = [told["place"]], [_full(told)]
        at, lcps, right, grams = [], [], [], []

        def solve(a, z):
            own = np.array(at[a:z], np.int64)
            mask = decide(np.array(lcps[a:z], np.int64), left[own], info[own])
            places.append(info["place"][own[mask != 0]])
            masks.append(mask[mask != 0])

        def flush():
            """Grams up to the last bound: several at once, and one that is too large by its windows."""
            a = 0
            for i, z in enumerate([*grams, len(at)]):
                end = grams[i - 1] if i else 0
                if z - end > group:
                    if end > a:
                        solve(a, end)
                    yield from handed_on(np.array(at[end:z], np.int64), right[end:z], left, info)
                    a = z
            if len(at) > a:
                solve(a, len(at))
            at.clear(), lcps.clear(), right.clear(), grams.clear()

        large = False  # the gram at hand has handed on windows already
        for r, i, suffix, lcp in merged(coded):
            if lcp < GRAM and at:  # a new gram
                if large:
                    yield from handed_on(np.array(at, np.int64), right, left, info)
                    at.clear(), lcps.clear(), right.clear()
                elif len(at) > group:
                    yield from flush()
                else:
                    grams.append(len(at))
                large = False
            elif lcp < GRAM:
                large = False
            at.append(start[r] + i)
            lcps.append(lcp)
            right.append(suffix)
            begun = grams[-1] if grams else 0
            if len(at) - begun > group:  # no more of it is held
                if begun:
                    solve(0, begun)
                yield from handed_on(np.array(at[begun:], np.int64), right[begun:], left, info)
                at.clear(), lcps.clear(), right.clear(), grams.clear()
                large = True
        if large:
            yield from handed_on(np.array(at, np.int64), right, left, info)
        else:
            yield from flush()
        for p, x, y in _by_part(np.concatenate(places), np.concatenate(masks), parts):
            yield row(1, part=pa.array([p]), places=pa.array([x], pa.binary()), masks=pa.array([y], pa.binary()))

    both = runs.groupBy("part").applyInArrow(combine, "part long, places binary, masks binary, d long, t long, i long, f int, window binary")
    both = stored(both, "windows")
    rest = both.filter("window IS NOT NULL")
    first = rest.groupBy("window", "f").agg(F.min(F.struct("d", "t", "i")).alias("first"))
    late = rest.join(first, ["window", "f"]).filter(F.struct("d", "t", "i") > F.col("first"))
    late = late.groupBy("d", "t", "i").agg(F.bit_or(F.expr("shiftleft(1L, f)")).alias("mask"))
    return both.filter("window IS NULL").select("part", "places", "masks"), late


# --- cutting -----------------------------------------------------------------------------------------------------


def _covered(a: Anchors, k: int, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flags of the removed bytes of text k of a chunk."""
    edge = np.zeros(int(a.size[k]) + 1, np.int32)
    known = index < a.first[k + 1] - a.first[k]
    index, mask = index[known], mask[known]
    at = a.at[int(a.first[k]) + index.astype(np.int64)] - int(a.start[k])
    row, f = np.nonzero((mask[:, None] >> np.arange(SHIFT + 1)) & 1)
    np.add.at(edge, at[row] - f, 1)
    np.add.at(edge, at[row] - f + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(documents: DataFrame, masks: DataFrame, late: DataFrame, out, schema: str) -> DataFrame:
    """Join the repeated windows with the texts and apply ``out(text, flags)``; other columns of ``documents`` go along."""
    late = late.groupBy("d", "t").agg(F.collect_list(F.struct("i", "mask")).alias("late"))
    ranges = masks.join(late, ["d", "t"], "full_outer").hint("shuffle_hash")
    whole = F.struct(*documents.columns).alias("row")
    joined = documents.select(whole).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("row.text").alias("t")).join(ranges, ["d", "t"], "left")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            at, masks, late = (b.column(k).to_pylist() for k in (2, 3, 4))
            for i, part in chunks(column_bytes(b)):
                a, rows = Anchors(part), []
                for k, text in enumerate(part):
                    index, mask = np.frombuffer(at[i + k] or b"", "<u4"), np.frombuffer(masks[i + k] or b"", "<i8")
                    if late[i + k]:
                        index = np.concatenate((index, np.array([x["i"] for x in late[i + k]], np.uint32)))
                        mask = np.concatenate((mask, np.array([x["mask"] for x in late[i + k]], np.int64)))
                    rows.append(out(text, _covered(a, k, index, mask) if len(index) else None))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), *(pa.array([r[j] for r in rows]) for j in range(len(names)))], names=["row", *names])

    lean = joined.select("row", F.col("row.text").alias("text"), "at", "masks", "late")
    kind = lean.schema["row"].dataType.simpleString()
    return lean.mapInArrow(run, f"row {kind}, {schema}")


def _found(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = prepare(documents.sparkSession)
    keyed = _keyed(documents)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(math.ceil(size / (SHIFT + 2) * 2 / PER_BUCKET), 8)  # anchors make about 2 / (SHIFT + 2) of the bytes
    asked = stored(repeats(keyed, buckets), "repeats")
    release(spark)
    texts = keyed.join(asked.hint("shuffle_hash"), "k").select("d", "t", "text", "at")
    packed, late = repeated_windows(suffix_runs(texts, buckets), buckets)
    masks, late = stored(_collected(packed), "masks"), stored(late, "late")
    release(spark)
    return masks, late


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def out(text, flags):
        if flags is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        starts = int(flags[0]) + int(np.count_nonzero(flags[1:] & ~flags[:-1]))
        return len(text), int(flags.sum()), starts, hashlib.sha256(np.frombuffer(text, np.uint8)[~flags].tobytes()).hexdigest()

    found = _found(documents)
    return _cut(documents.select("doc_id", "text"), *found, out, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(documents: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out; bytes that no longer make a code point become U+FFFD."""

    def out(text, flags):
        return ((text if flags is None else np.frombuffer(text, np.uint8)[~flags].tobytes()).decode("utf-8", "replace"),)

    cut = _cut(documents, *_found(documents), out, "kept string")
    return cut.select(*(F.when(F.col("row.text").isNull(), None).otherwise(F.col("kept")).alias("text") if c == "text" else F.col(f"row.{c}") for c in documents.columns))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
