"""Fill-in-middle transformation: cut points in code points, found by content-defined chunks whose counts are remembered.

A text is handled as UTF-8 bytes. A rolling hash over the last 16 bytes cuts it into chunks of some 500 bytes, so that a
passage that several texts share falls into the same chunks wherever it stands. A chunk's summary (code points, whether
a marker stands in it, and its first and last two bytes, since a marker can lie across a boundary) is kept in a table of
bounded bytes, whose keys are the chunks themselves: a summary is used only for a chunk of equal content. Adding up the
counts of a text's chunks gives its length and the chunk that holds each cut; only those chunks are looked into.

Where the two cuts fall, and in which order the parts stand, follows from SHA-256 of the seed and the key of a row, so
a row gives the same output in every run and any partitioning. No row moves between tasks.

Null and empty texts: an empty plain output. A null key is hashed as no digits. Repeated rows give repeated outputs. A
text that holds a marker is left plain, so every output can be turned back. Other columns stay as they are; columns
called form, output, prefix_chars or middle_chars are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import chunks, mix
from kernelweave.session import prepare, table

MARKS = ("<P>", "<S>", "<M>")
_MARKS = tuple(m.encode() for m in MARKS)
LONGEST = 1 << 14  # bytes of a chunk in which the hash finds no end
KEPT = 32 << 20  # bytes of remembered chunks in a worker, twice at most
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_LATER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_OUT = ("form", "n", "prefix_chars", "middle_chars", "output")


def ends(data: np.ndarray, bits: int = 9) -> np.ndarray:
    """Ends of chunks: after each byte at which the hash of the last 16 bytes begins with ``bits`` zeros."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):  # sums over windows of twice the width
        older = np.zeros_like(h)
        older[width:] = h[:-width] if len(h) > width else 0
        h = h + older * np.uint32(pow(0x9E3779B1, width, 1 << 32))
    found = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    edge = np.unique(np.concatenate((found, [len(data)])))
    gap = np.diff(edge, prepend=0)
    if (gap > LONGEST).any():  # the same distance from the last end, so equal stretches are cut alike
        edge = np.unique(np.concatenate([edge, *(np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(edge[gap > LONGEST], gap[gap > LONGEST]))]))
    return edge[edge > 0]


def summary(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    """Code points that begin in the chunk, whether it holds a marker, its first and its last two bytes."""
    return len(chunk.translate(None, _LATER)), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:]


class Memo:
    """Summaries by content; when the young half is full it becomes the old one, and what isn't asked for again goes."""

    def __init__(self, limit: int = KEPT):
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.size, self.limit, self.made = 0, limit, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found, self.made = summary(chunk), self.made + 1
            if self.size + len(chunk) > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = found
            self.size += len(chunk) + 200
        return found


def _byte_of(chunk: bytes, k: int) -> int:
    """Where the k-th code point that begins in the chunk begins; its length where there are only k."""
    begins = np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
    return int(begins[k]) if k < len(begins) else len(chunk)


def draws(key: str, seed: int) -> list[int]:
    code = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(code[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: bytes, edge: np.ndarray, key: str, memo: Memo, seed: int, plain: int, spm: int) -> tuple[str, int, int | None, int | None, bytes]:
    """(form, code points, code points of prefix and middle, output) of a text whose chunks end at ``edge``."""
    at = [0, *edge.tolist()]
    total, counts, marked, tail = 0, [0], False, b""
    for s, e in zip(at, at[1:]):
        n, own, head, last = memo.of(text[s:e])
        marked = marked or own or any(m in tail + head for m in _MARKS)
        tail = (tail + last)[-2:] if e - s < 2 else last
        total += n
        counts.append(total)
    h = draws(key, seed)
    if not total or marked or h[2] % 100 >= plain:
        return "plain", total, None, None, text
    low, high = sorted((h[0] % (total + 1), h[1] % (total + 1)))

    def byte(k: int) -> int:
        if k == total:
            return len(text)
        c = int(np.searchsorted(counts, k, "right")) - 1
        return at[c] + _byte_of(text[at[c] : at[c + 1]], k - counts[c])

    a, b = byte(low), byte(high)
    p, s, m = _MARKS
    if h[3] % 100 < spm:
        return "spm", total, low, high - low, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return "psm", total, low, high - low, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


_memo = Memo()


def infill(documents: DataFrame, key: str = "doc_id", seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """The documents with form, n, prefix_chars, middle_chars and output.

    ``plain``: per cent of texts that are transformed at all; ``spm``: per cent of those whose suffix comes first.
    """
    prepare(documents.sparkSession)
    rows = documents.drop(*_OUT)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at, of = rows.columns.index("text"), rows.columns.index(key)

    def run(batches):
        for b in batches:
            keys = b.column(of).to_pylist()
            found = []
            for i, part in chunks(b.column(at).cast(pa.binary()).to_pylist()):
                data = np.frombuffer(b"".join(part), np.uint8)
                stop = np.cumsum([len(t) for t in part])
                for j, t in enumerate(part):
                    k = keys[i + j]
                    found.append(transform(t, ends(data[stop[j] - len(t) : stop[j]]) if t else np.zeros(0, int), "" if k is None else str(k), _memo, seed, plain, spm))
            form, n, prefix, middle, out = zip(*found) if found else ((),) * 5
            own = [pa.array(form, pa.string()), pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, *_OUT])

    return rows.mapInArrow(run, f"{fields}, form string, n long, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame, name: str = "restored") -> DataFrame:
    """The rows of (form, output, ...) with the text they came from; a null output gives null."""
    part = F.split("output", "<[PSM]>")
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return transformed.withColumn(name, text)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(infill(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS h FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
o AS (SELECT doc_id, t, n, form, a, b, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
