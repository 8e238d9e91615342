"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its hashed words and word pairs, and those of the words' endings with letters and digits made
alike (2^BITS slots), each distinct slot weighted 1/sqrt(number of slots), and a constant. Scoring is a sparse dot product over the whole text. Training runs over at most ``max_rows``
labelled rows (documented bound; the rows with the smallest hashed key, so the choice doesn't depend on partitions)
outside the held-out fifth; labels, lang, source and doc_id never enter a feature. The model is 2^BITS float32 values
at any input size, which is what is collected and broadcast.

Null label: not used for training. Null or empty text: only the constant counts. Without any training row each score
is 0.5. Several labels of one document count as one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import Words, chunks, column_bytes, grams, mix
from kernelweave.session import prepare, table

BITS = 18
CONSTANT = 0  # slot of the constant


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text one after another, and how many each text has."""
    w = Words(texts)
    doc = w.text_of_word()
    same = np.flatnonzero(doc[1:] == doc[:-1])
    slot, owner = [], []
    for h in (w.hashes(), _endings(w)):
        slot += [h, grams(h, 2)[same]]
        owner += [doc, doc[same]]
    key = np.concatenate(owner) << BITS | (np.concatenate(slot) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(np.concatenate((key, np.arange(len(texts)) << BITS | CONSTANT)))
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=len(texts))


_KIND = np.arange(256, dtype=np.uint64)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0x61
_KIND[0x30:0x3A] = 0x30


def _endings(w: Words) -> np.ndarray:
    """Hash of the last three bytes of each word, letters and digits each made alike."""
    kind, code = _KIND[w.data], np.zeros(len(w.start), np.uint64)
    for j in range(1, 4):
        at = w.end - j
        code = code * np.uint64(256) + np.where(at >= w.start, kind[np.maximum(at, 0)], np.uint64(0))
    return mix(code + np.uint64(1 << 32))


class FTRL:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: float, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum() * x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, max_rows: int = 20_000, epochs: int = 3) -> np.ndarray:
    """Weights from rows of (doc_id, text, label 0/1). Slots are found by all tasks; one task runs the updates."""
    prepare(labelled.sparkSession)

    def slots(batches):
        for b in batches:
            for i, part in chunks(column_bytes(b)):
                at, size = features(part)
                stop = np.cumsum(size)
                rows = [at[e - n : e].astype("<i4").tobytes() for e, n in zip(stop, size)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(rows, pa.binary()), b.column(2).slice(i, len(part))], names=["order", "slots", "label"])

    def fit(pdf):
        import pandas as pd

        model = FTRL()
        pdf = pdf.sort_values(["order", "label"], kind="stable")
        for epoch in range(epochs):
            for at, y in zip(pdf.slots, pdf.label):
                at = np.frombuffer(at, "<i4")
                model.update(at, 1 / np.sqrt(len(at)), int(y))
        return pd.DataFrame({"weights": [model.weights(slice(None)).astype("<f4").tobytes()]})

    rows = labelled.select(F.xxhash64(F.col("doc_id").cast("string")).alias("order"), "text", F.col("label").cast("int").alias("label")).mapInArrow(slots, "order long, slots binary, label int")
    found = rows.orderBy("order", "label").limit(max_rows).groupBy(F.lit(1).alias("one")).applyInPandas(fit, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros(1 << BITS, np.float32)


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score. One map over the whole texts, no shuffle."""
    spark = prepare(documents.sparkSession)
    held = spark.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        for b in batches:
            for i, part in chunks(column_bytes(b)):
                at, size = features(part)
                stop = np.cumsum(size)
                total = np.concatenate(([0.0], np.cumsum(held.value[at])))
                x = (total[stop] - total[stop - size]) / np.sqrt(size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(1 / (1 + np.exp(-x)))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def is_held_out(key: str = "doc_id", rest: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == rest, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """Training rows: at most ``max_rows`` labels outside the held-out fifth, joined with their texts."""
    own = labels.filter(F.col(label).isin(0, 1) & ~is_held_out()).select("doc_id", F.col(label).alias("label"))
    some = own.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "label").limit(max_rows)
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most max_rows small rows


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(labelled(docs, table(spark, sf_dir, "labels")))
    return score(docs, weights).select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
