"""Byte-level BPE encoding and decoding.

A text is cut at special tokens, then into pieces by the vocabulary's pattern; each piece is merged with a segment
tree over the ranks of its adjacent pairs: the root holds the leftmost pair of lowest rank, a merge changes three
leaves, each in logarithmic time, until the root holds no pair. Pieces that were met before come from a table that
each worker keeps and empties when it reaches ``CACHE`` entries, so memory stays bounded; long pieces aren't kept.

The vocabulary file is a parameter. Null text counts as empty: no ids, decoded to the empty text. One map over whole
texts, no shuffle; repeated rows are encoded alike; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.session import prepare, table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of byte-level vocabularies
CACHE = 1_000_000
NONE = 1 << 62


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {ord(s): b for b, s in symbols.items()}
        as_bytes = lambda s: bytes(back[ord(c)] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.table = [b""] * size
        for s, i in vocab.items():
            self.table[i] = s.encode() if s in self.special else as_bytes(s)
        for s, i in self.special.items():
            self.table[i] = s.encode()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        #: (left id, right id) as left << 20 | right -> rank << 20 | merged id
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.piece = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece. Leaf i of the tree holds rank << 40 | i of the pair that starts at symbol i."""
        ids, n, merge = [self.byte_id[b] for b in data], len(data), self.merge
        if n < 2:
            return ids
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            if (m := merge.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = (m >> 20) << 40 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFFFF
            j = after[i]
            ids[i] = merge[ids[i] << 20 | ids[j]] & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                m = merge.get(ids[i] << 20 | ids[k])
                put(i, NONE if m is None else (m >> 20) << 40 | i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                m = merge.get(ids[h] << 20 | ids[i])
                put(h, NONE if m is None else (m >> 20) << 40 | h)
        return [x for x in ids if x >= 0]

    def of_piece(self, piece: str) -> bytes:
        found = np.array(self.merged(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, kept = [], self.kept
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                for p in self.piece.findall(part):
                    out.append(kept.get(p) or self.of_piece(p))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int> of each row."""
    return _map(documents, vocabulary, text, key, lambda e, t: {"ids": np.frombuffer(e.encode(t), "<u4").astype(np.int32)}, pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key, text of each row's ``ids``; null ids give null."""
    prepare(encoded.sparkSession)

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [None if x is None else e.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def digests(documents: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids again."""

    def one(e: Encoder, t: str) -> dict:
        ids = e.encode(t)
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(e.decode(ids).encode()).hexdigest()}

    return _map(documents, vocabulary, text, key, one, pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _map(documents: DataFrame, vocabulary: str, text: str, key: str, one, schema: pa.Schema, ddl: str) -> DataFrame:
    prepare(documents.sparkSession)

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [one(e, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in schema)], names=[key, *schema.names])

    return documents.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, {ddl}")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
