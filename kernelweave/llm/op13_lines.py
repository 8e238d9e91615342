"""Line deduplication: normalised lines are exploded and hashed, documents counted per hash, frequent lines dropped.

A line's key is the line without blanks at both ends and with A-Z in lower case. A key of at least ``min_chars`` code
points that stands in at least ``min_documents`` documents loses all its lines, except those in the document with the
largest id. Keys are known by 128 bits of BLAKE2b. Texts never move with their lines: a row of the exploded table is
(document, hash, positions), the positions to drop come back as one row a document, and the text is put together again
from the lines that stay, by position.

A key may stand in a third of all documents. Documents are counted by aggregates that combine before they shuffle. For
the way back, a key that holds more than one in ``HOT`` of all rows is hot; there are fewer than ``HOT`` of these, so
their table is broadcast (4 MB at most), and every other key is joined by shuffle.

A document is a key value: rows of the same id count once, each loses its own lines. A null id is a document of its
own, smaller than any other. Null and empty texts are one empty line, and give null and an empty text. Repeated rows
give repeated rows. Other columns stay as they are; columns called n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import column_bytes
from kernelweave.session import prepare, stored, table

BLANK = b" \t\n\x0b\x0c\r"
_LATER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
HOT = 100_000


def _keyed(documents: DataFrame, key: str) -> DataFrame:
    """_op13_k, _op13_t: what names a text among the rows of all ids."""
    return documents.withColumns({"_op13_k": F.col(key), "_op13_t": F.xxhash64("text")})


def explode_lines(documents: DataFrame, key: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """_k, _t, h (hash of a key), at (positions) of each key of ``min_chars`` code points or more of each text."""
    rows = _keyed(documents, key).select(F.col("_op13_k").alias("_k"), F.col("_op13_t").alias("_t"), "text")

    def run(batches):
        for b in batches:
            row, name, at, size = [], [], [], []
            for i, t in enumerate(column_bytes(b)):
                if t is None or len(t) < min_chars:
                    continue
                own: dict[bytes, list[int]] = {}
                for p, line in enumerate(t.lower().split(b"\n")):  # bytes.lower() changes A-Z alone
                    if len(line) >= min_chars:
                        line = line.strip(BLANK)
                        if len(line) >= min_chars and len(line.translate(None, _LATER)) >= min_chars:
                            own.setdefault(hashlib.blake2b(line, digest_size=16).digest(), []).append(p)
                row += [i] * len(own)
                for h, places in own.items():
                    name.append(h)
                    at += places
                    size.append(len(places))
            row = pa.array(row, pa.int64())
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(name, pa.binary()), places], names=["_k", "_t", "h", "at"])

    return rows.mapInArrow(run, f"_k {documents.schema[key].dataType.simpleString()}, _t long, h binary, at array<int>")


def frequent_lines(lines: DataFrame, min_documents: int = 3) -> DataFrame:
    """h, n (documents), rows, last (largest id) of keys in at least ``min_documents`` documents."""
    by_document = lines.groupBy("h", "_k").agg(F.count("*").alias("rows"))
    return by_document.groupBy("h").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("_k").alias("last")).filter(F.col("n") >= min_documents)


def dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """_k, _t, places: positions of the lines that go, one row a text."""
    share = max(1, frequent.agg(F.sum("rows")).first()[0] or 0) / HOT
    hot = F.broadcast(frequent.filter(F.col("rows") > share).select("h", "last"))  # fewer than HOT rows of a hash and an id
    cold = frequent.filter(F.col("rows") <= share).select("h", "last")
    gone = lines.join(hot, "h").unionByName(lines.join(F.broadcast(frequent.filter(F.col("rows") > share).select("h")), "h", "left_anti").join(cold, "h"))
    return gone.filter(~F.col("_k").eqNullSafe(F.col("last"))).groupBy("_k", "_t").agg(F.flatten(F.collect_list("at")).alias("places"))


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_documents: int = 3, key: str = "doc_id") -> DataFrame:
    """The documents without dropped lines, with n_lines (before) and n_dropped; ``n_chars`` is left as it is."""
    prepare(documents.sparkSession)
    rows = documents.drop("n_lines", "n_dropped")
    lines = stored(explode_lines(rows, key, min_chars).dropDuplicates(["_k", "_t", "h"]), "lines")  # repeated rows once
    gone = dropped_places(lines, stored(frequent_lines(lines, min_documents), "frequent"))
    g = gone.select(F.col("_k").alias("_op13_gk"), F.col("_t").alias("_op13_gt"), F.col("places").alias("_op13_places"))
    both = _keyed(rows, key).join(g, F.col("_op13_k").eqNullSafe(F.col("_op13_gk")) & (F.col("_op13_t") == F.col("_op13_gt")), "left").select(*rows.columns, "_op13_places")
    at, n = rows.columns.index("text"), len(rows.columns)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for b in batches:
            texts, places = b.column(at).cast(pa.binary()).to_pylist(), b.column(n).to_pylist()
            count = [1 if t is None else t.count(b"\n") + 1 for t in texts]
            for i, own in enumerate(places):
                if own:
                    stays = np.ones(count[i], bool)
                    stays[own] = False
                    parts = texts[i].split(b"\n")
                    texts[i] = b"\n".join([parts[j] for j in np.flatnonzero(stays)])
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if j == at else b.column(j) for j in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array([len(x or ()) for x in places], pa.int64())], names=[*b.schema.names[:n], "n_lines", "n_dropped"])

    return both.mapInArrow(run, f"{fields}, n_lines long, n_dropped long")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, i, x[i] AS line FROM (SELECT r, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT r, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN f USING (k)),
s AS (SELECT r, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)
"""
