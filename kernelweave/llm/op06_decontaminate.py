"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Texts stream through the automaton and the longest match that ends at each word is tracked. A match of ``window``
words or more marks its last ``window`` words; an item of fewer words is marked where it occurs whole. Positions at
which the automaton can only be at its root or one word deep (the pair of words occurs in no item) are skipped with
sorted arrays before the stream starts; this changes no match.

Different texts reach the tasks in blocks of about BLOCK bytes, fetched and broadcast one at a time, and a worker holds
one automaton. Where there are several, a task gathers GROUP bytes of rows and passes each block over them. Every
block sees the untouched texts and the hits of all are united before anything is cut or judged, so results don't
depend on the blocks. Up to ROUND bytes of items there is no shuffle; beyond it, blocks come in rounds of that size, whose
hits are stored and joined with the texts at the end. Time is linear in the text, however often it repeats itself.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null or empty texts have no words, items
without words are left out, equal items each count by their own id. Extra columns are kept by ``remove``.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import NOT_WORD, Words, chunks, column_bytes
from kernelweave.session import prepare, stored, table

WINDOW = 10
BLOCK = 1 << 20
GROUP = 64 << 20
ROUND = 64 << 20


class Automaton:
    """Generalised suffix automaton of sequences of word ids: ``next``, ``link`` and ``len`` of each state."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int = WINDOW):
        """From different texts, each with the names of the items that have it."""
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        w = Words([t for _, t in items], seps=NOT_WORD)
        self.vocab, ids = np.unique(w.hashes(), return_inverse=True)
        self.seqs = [ids[w.first[i] : w.first[i + 1]].tolist() for i in range(len(items))]
        for s in self.seqs:
            last = 0
            for c in s:
                last = self._add(last, c)
        pairs = {a * len(self.vocab) + b for s in self.seqs for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.shortest = min([window, *(len(s) for s in self.seqs if s)])
        #: of each state, the state of its suffix of exactly ``window`` words, from that of its link
        self.up = [0] * len(self.len)
        by_size = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for state in by_size:
            if self.len[state] >= window:
                self.up[state] = self.up[self.link[state]] or state
        self.whole: dict[int, tuple[int, set[str]]] = {}  # state -> size and names of the short items that it spells
        self.owner: dict[int, set[str]] = {}  # state of a window -> items that have it
        for (names, _), s in zip(items, self.seqs):
            state, n = 0, 0
            for c in s:
                state, n = self.step(state, n, c)
                if n >= window:
                    self.owner.setdefault(self.up[state], set()).update(names)
            if 0 < len(s) < window:
                self.whole.setdefault(state, (len(s), set()))[1].update(names)
        #: of each state, the nearest of itself and its suffixes that spells a short item, 0 where none does
        self.ends = [0] * len(self.len)
        for state in by_size:
            self.ends[state] = state if state in self.whole else self.ends[self.link[state]]

    def _add(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._copy(last, q, c)
        cur = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._copy(p, q, c)
        return cur

    def _copy(self, p: int, q: int, c: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that still matches after the word c."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.len[state]
        if c in self.next[state]:
            return self.next[state][c], n + 1
        return 0, 0

    def stream(self, words: list[int], at: int, edge: np.ndarray, items: set[str], met: set[int]) -> None:
        """Mark hit words of a run that starts at word ``at`` and collect its items; ``met`` are states that were met.

        ``edge`` counts begins less ends of hits. A step follows at most ``window`` links beyond those that it leaves.
        """
        state, n, window = 0, 0, self.window
        for i, c in enumerate(words, at + 1):
            state, n = self.step(state, n, c)
            if n >= window:
                edge[i - window] += 1
                edge[i] -= 1
                if (own := self.up[state]) not in met:
                    met.add(own)
                    items |= self.owner[own]
            s = self.ends[state]
            while s:
                size, names = self.whole[s]
                if size <= n:
                    edge[i - size] += 1
                    edge[i] -= 1
                    if -s not in met:
                        met.add(-s)
                        items |= names
                s = self.ends[self.link[s]]

    def scan(self, texts: list[bytes]) -> tuple[Words, np.ndarray, list[set[str]]]:
        w = Words(texts, seps=NOT_WORD)
        h = w.hashes()
        edge, items, met = np.zeros(len(h) + 1, np.int64), [set() for _ in texts], [set() for _ in texts]
        if not len(h) or not len(self.vocab):
            return w, np.zeros(len(h), bool), items
        ids = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        known = self.vocab[ids] == h
        doc = w.text_of_word()
        glued = np.zeros(len(h), bool)  # word i and the next stand together in an item
        if len(self.pairs) and len(h) > 1:
            key = ids[:-1] * len(self.vocab) + ids[1:]
            p = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            glued[:-1] = known[:-1] & known[1:] & (doc[:-1] == doc[1:]) & (self.pairs[p] == key)
        begins = known.copy()
        begins[1:] &= ~glued[:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(known & ~glued) + 1
        for i in np.flatnonzero(end - start >= self.shortest).tolist():
            self.stream(ids[start[i] : end[i]].tolist(), int(start[i]), edge, items[doc[start[i]]], met[doc[start[i]]])
        return w, np.cumsum(edge[:-1]) > 0, items


def blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Iterator[list[tuple[list[str], bytes]]]:
    """The different texts, each with the names of its items, in blocks of about BLOCK bytes, one fetched at a time.

    One longer text may make a block of its own. Spark gathers them into a stored table first.
    """
    own = benchmark.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    own = stored(own.groupBy("t").agg(F.collect_set("k").alias("k")), "items")
    n = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK))
    own = own.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(n)))
    for i in range(n):
        yield [(sorted(r["k"]), r["t"].encode()) for r in own.filter(F.col("b") == i).collect()]


def _rounds(benchmark: DataFrame) -> Iterator[list[tuple[str, Broadcast]]]:
    """Broadcast blocks, as many at a time as ROUND bytes hold."""
    sc, held = benchmark.sparkSession.sparkContext, []
    for block in blocks(benchmark):
        if len(held) * BLOCK >= ROUND:
            yield held
            held = []
        held.append((uuid.uuid4().hex, sc.broadcast(block)))
    yield held


_built: dict[str, Automaton] = {}


def automaton(name: str, held: Broadcast, window: int) -> Automaton:
    """The automaton of a block, built once in each worker; the last one is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(held.value, window)
        held.__dict__.pop("_value", None)  # a worker holds no texts of other blocks
    return _built[name]


def _groups(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _united(batches: Iterable[pa.RecordBatch], held: list[tuple[str, Broadcast]], window: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict[int, np.ndarray], dict[int, set[str]]]]:
    """Each batch with its number of words a row, and hit words and items, over all blocks, of the rows that have any."""
    for group in _groups(batches, limit if len(held) > 1 else 0):
        found = [(b, np.zeros(b.num_rows, np.int64), {}, {}) for b in group]
        for name, block in held:
            auto = automaton(name, block, window)
            for b, count, hits, items in found:
                for i, part in chunks(column_bytes(b)):
                    w, hit, names = auto.scan(part)
                    count[i : i + len(part)] = w.count
                    for k in np.unique(np.searchsorted(w.first, np.flatnonzero(hit), "right") - 1).tolist():
                        own = np.flatnonzero(hit[w.first[k] : w.first[k + 1]])
                        hits[i + k] = np.union1d(hits[i + k], own) if i + k in hits else own
                        items.setdefault(i + k, set()).update(names[k])
        held = held[::-1]  # the next group begins with the automaton that is built
        yield from found


def _keyed(documents: DataFrame, key: str) -> DataFrame:
    return documents.withColumns({"_op6_d": F.coalesce(F.col(key).cast("string"), F.lit("")), "_op6_t": F.xxhash64("text")})


def _with_hits(documents: DataFrame, benchmark: DataFrame, window: int, key: str):
    """A table and a function that turns its batches into those of ``documents`` with their hits, as ``_united`` does.

    Where the items are more than a round holds, the hits of each round are stored and joined with the texts by key and
    text hash; otherwise no row moves.
    """
    rounds, limit = _rounds(benchmark), GROUP
    held, other = next(rounds), next(rounds, None)
    if other is None:
        return documents, lambda batches: _united(batches, held, window, limit)
    lean, found = _keyed(documents, key).select("_op6_d", "_op6_t", "text"), None
    for own in itertools.chain((held, other), rounds):

        def run(batches, own=own):
            for b, _, hits, items in _united(batches, own, window, limit):
                at = pa.array(sorted(hits), pa.int64())
                places, names = pa.array([hits[k].tolist() for k in sorted(hits)], pa.list_(pa.int64())), pa.array([sorted(items[k]) for k in sorted(hits)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), places, names], names=["_op6_d", "_op6_t", "_op6_hits", "_op6_items"])

        part = stored(lean.mapInArrow(run, "_op6_d string, _op6_t long, _op6_hits array<bigint>, _op6_items array<string>"), "hits")
        found = part if found is None else found.unionByName(part)
        for _, block in own:
            block.unpersist()
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    united = found.groupBy("_op6_d", "_op6_t").agg(union("_op6_hits"), union("_op6_items"))
    n = len(documents.columns)

    def from_joined(batches):
        for b in batches:
            rows, hits, items = pa.RecordBatch.from_arrays(b.columns[:n], names=b.schema.names[:n]), b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            count = [Words(part, seps=NOT_WORD).count for _, part in chunks(column_bytes(rows))]
            yield rows, np.concatenate(count) if count else np.zeros(0, np.int64), {k: np.array(x) for k, x in enumerate(hits) if x}, {k: set(x) for k, x in enumerate(items) if x}

    return _keyed(documents, key).join(united, ["_op6_d", "_op6_t"], "left").select(*documents.columns, "_op6_hits", "_op6_items"), from_joined


def _spans(text: bytes, hits: np.ndarray) -> list[tuple[int, int]]:
    """Bytes of the runs of hit words."""
    w = Words([text], seps=NOT_WORD)
    cut = np.flatnonzero(np.diff(hits) > 1)
    return [(int(w.start[hits[s]]), int(w.end[hits[e]])) for s, e in zip([0, *(cut + 1)], [*cut, len(hits) - 1])]


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, items array<string>, spans array<struct<start,end>> (bytes of the UTF-8 text) of each row."""
    prepare(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    table, hits_of = _with_hits(documents.select(F.col(key), "text"), benchmark, window, key)

    def run(batches):
        for b, count, hits, items in hits_of(batches):
            texts, rows = b.column(1), range(b.num_rows)
            n_hit = np.zeros(b.num_rows, np.int64)
            spans: list[list[dict[str, int]]] = [[] for _ in rows]
            for k, own in hits.items():
                n_hit[k] = len(own)
                spans[k] = [{"start": s, "end": e} for s, e in _spans(texts[k].as_py().encode(), own)]
            names = pa.array([sorted(items.get(k, ())) for k in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(count), pa.array(n_hit), names, pa.array(spans, span)], names=[key, "text", "n_words", "n_hit", "items", "spans"])

    return table.mapInArrow(run, f"{key} {kind}, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def remove(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The documents without hit spans; a document of which more than ``coverage`` of the words is hit goes whole.

    Columns stay as they are; n_chars, if there is one, is counted anew where spans went.
    """
    prepare(documents.sparkSession)
    schema = documents.schema
    at, chars = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else -1
    table, hits_of = _with_hits(documents, benchmark, window, key)

    def run(batches):
        for rows, count, hits, _ in hits_of(batches):
            if hits:
                texts, counts = rows.column(at).to_pylist(), rows.column(chars).to_pylist() if chars >= 0 else []
                n = np.zeros(rows.num_rows, np.int64)
                for k, own in hits.items():
                    n[k] = len(own)
                    raw, out, done = texts[k].encode(), [], 0
                    for start, end in _spans(raw, own):
                        out.append(raw[done:start])
                        done = end
                    texts[k] = b"".join([*out, raw[done:]]).decode()
                    if chars >= 0:
                        counts[k] = len(texts[k])
                cols = [pa.array(texts, pa.string()) if j == at else pa.array(counts, rows.column(j).type) if j == chars else c for j, c in enumerate(rows.columns)]
                rows = pa.RecordBatch.from_arrays(cols, names=rows.schema.names).filter(pa.array(n <= coverage * count))
            yield rows

    return table.mapInArrow(run, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, occ.n, item_id FROM occ JOIN win USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
