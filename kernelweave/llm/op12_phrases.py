r"""Phrase collocations: Rabin-Karp fingerprints count every n-gram, texts verify them, frequent phrases alone are made.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\x0A-\x0D]`` and those into words ``[^\x20\x09]+``; everything
is counted for each language. A task puts the words of a megabyte of text behind each other, one space between, and
builds prefix polynomials over these bytes, modulo 2^64 and modulo the prime 2^31 - 1; the fingerprint of a run of words
is a difference of two prefixes, whatever its length. Rows (fingerprint, count, pointer to a text) are aggregated by a
shuffle. A run counts only where both runs of one word less in it are frequent, which loses nothing; a table of bits in
front tells that, and lets too much through at worst.

Then each frequent fingerprint goes back to the texts of its smallest and largest pointer (32 bits; texts that share one
are all read). Those texts are read again,
the run with that fingerprint is looked up and its words come out. Where the two differ, one fingerprint stands for
several phrases, and it is counted anew from the words of all texts. What this can't see is a phrase that shares all
95 bits with another and stands only in texts between the two pointers: some 1e-4 expected cases in 1e13 phrases.

Counts of parts and of longer phrases are joined by the words themselves; scores are exact decimals (counts to 1e15).

Null lang: ``und``. Null and empty texts hold no words. A text counts as often as it has rows, with the same id or
not. A language or a phrase in a third of all rows is counted in the tasks before anything is shuffled, and a language
is no key of any grouping but the last, which ranks the first ``top`` of 32 parts of it. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.llm.text import chunks, column_bytes, mix, powers
from kernelweave.session import discard, prepare, release, stored, table

BLOCK = 2_000_000  # runs that a task holds before it adds up equal ones
BATCH = 1 << 17  # rows of a batch that it passes on
PARTS = 32  # parts of a language that are ranked by themselves first
MAX_BITS = 1 << 28  # bits of a table of frequent runs: 32 MB
PAGE = 1 << 13  # 64-bit words of it that are put together at a time: 64 KB
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_P, _B = (1 << 31) - 1, 1_812_433_253 % ((1 << 31) - 1)
_ROW = "k long, chk int, c int, d int"


class Runs:
    """Words of several texts, one space between: ``at`` and ``size`` in ``data``; ``piece`` and ``text`` of each word."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).lower()  # bytes.lower() changes A-Z alone
        raw = np.frombuffer(joined, np.uint8)
        cut = _BREAK[raw]
        edge = np.ones(len(raw) + 2, np.int8)
        edge[1:-1] = cut | _GAP[raw]
        step = np.diff(edge)
        start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.size = end - start
        self.at = np.cumsum(self.size + 1) - self.size - 1
        keep = edge[1:] == 0  # bytes of words
        keep[end] = True  # and one byte after each, which becomes the space
        flat = np.append(raw, np.uint8(32))
        flat[end] = 32
        self.data = flat[keep]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(first, start, "right") - 1
        self.piece = np.cumsum(cut)[start] if len(start) else start
        self._prefixes()

    def _prefixes(self) -> None:
        n, x = len(self.data), self.data.astype(np.uint64) + np.uint64(1)
        self.up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.up[:n], out=self.total[1:])
        up, down = _primes(n + 1)
        self.other = np.zeros(n + 1, np.uint64)
        term = x * down[:n] % np.uint64(_P)
        np.cumsum(term, out=self.other[1:])  # below 2^31 each: no overflow in 2^33 bytes
        self.up_p = up

    def inside(self, n: int) -> np.ndarray:
        """First words of the runs of n words within a piece."""
        if len(self.at) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])

    def prints(self, first: np.ndarray, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (64 bits, with the language's salt) and check (31 bits) of runs of n words."""
        s, e = self.at[first], self.at[first + n - 1] + self.size[first + n - 1]
        k = mix((self.total[e] - self.total[s]) * self.down[s] + (e - s).astype(np.uint64))
        k = mix(k + salt[self.text[first]] + np.uint64(n))
        chk = (self.other[e] - self.other[s]) % np.uint64(_P) * self.up_p[s] % np.uint64(_P)
        return k.view(np.int64), chk.astype(np.int32)

    def words(self, first: int, n: int) -> str:
        last = first + n - 1
        return self.data[self.at[first] : self.at[last] + self.size[last]].tobytes().decode()


_tables: dict[str, np.ndarray] = {}


def _primes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo the prime, by doubling; kept unless one very long text asked for them."""
    if "up" not in _tables or len(_tables["up"]) < n:
        made = []
        for base in (_B, pow(_B, -1, _P)):
            x = np.ones(1, np.uint64)
            while len(x) < max(n, 1 << 21):
                x = np.concatenate((x, x * np.uint64(pow(base, len(x), _P)) % np.uint64(_P)))
            made.append(x)
        if n > 1 << 23:
            return made[0], made[1]
        _tables["up"], _tables["down"] = made
    return _tables["up"], _tables["down"]


def _salt(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang if lang is not None else "und").encode(), digest_size=8).digest(), "little")


def _salts(langs: list[str | None]) -> np.ndarray:
    known = {x: _salt(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _bit(k: np.ndarray, size: int) -> np.ndarray:
    return (k.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)


def added_up(k: np.ndarray, chk: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal (k, chk) together: counts added, the smallest pointer kept. Equal rows can be left where a k has two checks."""
    order = np.argsort(k)
    k, chk = k[order], chk[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (chk[1:] != chk[:-1])))) if len(k) else np.zeros(0, int)
    return k[new], chk[new], np.add.reduceat(c[order], new, dtype=np.int32) if len(new) else c[:0], np.minimum.reduceat(d[order], new) if len(new) else d[:0]


def _texts(documents: DataFrame) -> DataFrame:
    """lang, text, h (hash of both), d: a pointer of 32 bits that follows from h."""
    h = F.xxhash64(F.coalesce("lang", F.lit("und")), "text")
    return documents.filter("text IS NOT NULL").select("lang", "text", h.alias("h"), h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("d"))


def _counted(rows: DataFrame, size: int, bits: tuple | None = None, mask: int = -1) -> DataFrame:
    """k, chk, c, d of the runs of ``size`` words, added up within blocks of a task; with words, those of a language as k of size 0.

    ``bits`` (broadcast bytes, number of bits) lets a run through where both runs of one word less are known.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            salts, d = _salts(b.column(0).to_pylist()), b.column(2).to_numpy()
            for i, part in chunks(column_bytes(b)):
                r, own, at = Runs(part), salts[i : i + len(part)], d[i : i + len(part)]
                first = r.inside(size)
                if bits is None:
                    count = np.bincount(r.text, minlength=len(part))
                    held.append((mix(own).view(np.int64), np.zeros(len(part), np.int32), count.astype(np.int32), at))
                else:
                    less = r.inside(size - 1)
                    table_, slot = np.frombuffer(bits[0].value, np.uint8), _bit(r.prints(less, size - 1, own)[0] & mask, bits[1])
                    known = np.zeros(len(r.at) + 1, bool)
                    known[less] = table_[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                    first = first[known[first] & known[first + 1]]
                k, chk = r.prints(first, size, own)
                held.append((k & mask, chk & mask, np.ones(len(k), np.int32), at[r.text[first]]))
                n += len(k) + len(part)
                if n >= BLOCK:
                    yield from _as_batches(held)
                    n = 0
        yield from _as_batches(held)

    return rows.select("lang", "text", "d").mapInArrow(run, _ROW)


def _as_batches(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        cols = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        cols = added_up(*cols)
        for s in range(0, len(cols[0]), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + BATCH]) for c in cols], names=["k", "chk", "c", "d"])


def _frequent(counted: DataFrame, least: int, name: str) -> DataFrame:
    """k, chk, a, low, high (pointers) of fingerprints with ``least`` occurrences or more.

    A fingerprint has a row a block of a task, whatever its count, so rows are dealt before they are aggregated.
    """
    whole = counted.repartition("k").groupBy("k", "chk").agg(F.sum("c").alias("a"), F.min("d").alias("low"), F.max("d").alias("high"))
    return stored(whole.filter(F.col("a") >= least), name)


def _bits(frequent: DataFrame) -> tuple[bytes, int]:
    """Bits of the frequent fingerprints: 16 a fingerprint, ``MAX_BITS`` at most, so its size has a bound.

    Tasks put the words of the table into pages of ``PAGE``, so the driver gets bytes and no row for each word.
    """
    size = min(MAX_BITS, max(1 << 10, 1 << (16 * frequent.count()).bit_length()))
    page = min(PAGE, size >> 6)
    slot = F.col("k").bitwiseAND(F.lit(size - 1))
    words = frequent.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("w"))

    def pack(own: pa.Table) -> pa.Table:
        out = np.zeros(page, np.int64)
        out[own["i"].to_numpy() & (page - 1)] = own["w"].to_numpy()
        return pa.table({"p": pa.array(own["p"][:1].to_numpy()), "bits": pa.array([out.tobytes()], pa.binary())})

    paged = words.withColumn("p", F.floor(F.col("i") / page)).groupBy("p").applyInArrow(pack, "p long, bits binary")
    got = {r["p"]: r["bits"] for r in paged.toArrow().to_pylist()}
    return b"".join(got.get(p, bytes(page << 3)) for p in range((size >> 6) // page)), size


def _looked_up(rows: DataFrame, frequent: DataFrame, sizes: tuple[int, ...], mask: int) -> DataFrame:
    """k, chk, lang, n, phrase of the frequent fingerprints, from the texts of their two pointers; n is 0 for a language."""
    asked = frequent.select("k", "chk", F.explode(F.array_distinct(F.array("low", "high"))).alias("d"))
    asked = asked.groupBy("d").agg(F.collect_list("k").alias("ks"), F.collect_list("chk").alias("chks"))  # at most the runs of the texts of d
    asked = rows.select("h", "d").distinct().join(asked, "d").select("h", "ks", "chks")
    rows = rows.select("h", "lang", "text").dropDuplicates(["h"]).join(asked, "h").select("lang", "text", "ks", "chks")  # equal texts once, before they move

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            out = [[], [], [], [], []]
            for i, part in chunks(column_bytes(b)):
                r, own = Runs(part), _salts(langs[i : i + len(part)])
                flat = b.slice(i, len(part))
                ks, chks = (np.asarray(x.flatten()) for x in (flat.column(2), flat.column(3)))
                of = np.repeat(np.arange(len(part)), np.asarray(flat.column(2).value_lengths()))
                tables = [(0, np.arange(len(part)), mix(own).view(np.int64), np.zeros(len(part), np.int32), np.arange(len(part)))]
                for size in sizes:
                    first = r.inside(size)
                    tables.append((size, first, *(x & mask for x in r.prints(first, size, own)), r.text[first]))
                for size, first, k, chk, text in tables:
                    order = np.lexsort((k, text))
                    key = np.rec.fromarrays((text[order], k[order]), names="t,k")
                    want = np.rec.fromarrays((of, ks), names="t,k")
                    s = np.searchsorted(key, want, "left")
                    e = np.searchsorted(key, want, "right")
                    for j in np.flatnonzero(e > s).tolist():
                        seen = set()
                        for p in order[s[j] : e[j]].tolist():
                            if chk[p] == chks[j]:
                                phrase = r.words(int(first[p]), size) if size else ""
                                if phrase not in seen:  # two phrases of one text can share a fingerprint
                                    seen.add(phrase)
                                    for x, v in zip(out, (int(ks[j]), int(chks[j]), langs[i + int(of[j])], size, phrase)):
                                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()))], names=["k", "chk", "lang", "n", "phrase"])

    found = rows.mapInArrow(run, "k long, chk int, lang string, n int, phrase string")
    return found.select("k", "chk", F.coalesce("lang", F.lit("und")).alias("lang"), "n", "phrase").distinct()


def _anew(rows: DataFrame, doubtful: DataFrame, sizes: tuple[int, ...], mask: int, least: int) -> DataFrame:
    """lang, n, phrase, a of all phrases under doubtful fingerprints, counted by their words."""

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, part in chunks(column_bytes(b)):
                r, own = Runs(part), _salts(langs[i : i + len(part)])
                for size in sizes:
                    first = r.inside(size)
                    k, chk = r.prints(first, size, own)
                    names = [r.words(int(f), size) for f in first.tolist()]
                    lang = [langs[i + int(t)] for t in r.text[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(k & mask), pa.array(chk & mask), pa.array(lang, pa.string()), pa.array(np.full(len(first), size, np.int32)), pa.array(names, pa.string())], names=["k", "chk", "lang", "n", "phrase"])

    every = rows.mapInArrow(run, "k long, chk int, lang string, n int, phrase string")
    every = every.withColumn("lang", F.coalesce("lang", F.lit("und"))).groupBy("k", "chk", "lang", "n", "phrase").agg(F.count("*").alias("a"))
    return every.join(doubtful, ["k", "chk"], "left_semi").filter(F.col("a") >= least).select("lang", "n", "phrase", "a")


def frequent_phrases(documents: DataFrame, least: int = 10, mask: int = -1) -> DataFrame:
    """lang, n (words), phrase, a of all phrases of one to three words that occur ``least`` times or more in a language.

    n is 0 for the number of words of a language. ``mask`` keeps some bits of the fingerprints only, for tests.
    """
    spark = prepare(documents.sparkSession)
    rows = _texts(documents)
    levels, held = [], None
    for size in (1, 2, 3):
        bits = None
        if levels:
            content, n = _bits(levels[-1])
            held = spark.sparkContext.broadcast(content)
            bits = (held, n)
        levels.append(_frequent(_counted(rows, size, bits, mask), least, f"runs-{size}"))
        if held is not None:
            held.destroy()  # what it let through is stored
        release(spark)
    frequent = levels[0].unionByName(levels[1]).unionByName(levels[2])
    found = stored(_looked_up(rows, frequent, (1, 2, 3), mask), "phrases")
    release(spark)
    names = found.groupBy("k", "chk").agg(F.count("*").alias("names"))
    doubtful = stored(names.filter("names > 1").select("k", "chk"), "doubtful")
    sure = found.join(frequent.select("k", "chk", "a"), ["k", "chk"]).join(F.broadcast(doubtful) if doubtful.count() < 100_000 else doubtful, ["k", "chk"], "left_anti")
    out = sure.select("lang", "n", "phrase", "a")
    if doubtful.limit(1).count():
        out = out.unionByName(_anew(rows, doubtful, (1, 2, 3), mask, least))
    out = stored(out, "counts")
    for done in (*levels, found, doubtful):
        discard(done)
    return out


def collocations(documents: DataFrame, least: int = 10, longer_share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of each language.

    A phrase goes where ``longer_share`` per cent or more of its occurrences fall to a longer candidate that holds it.
    """
    counts = frequent_phrases(documents, least)
    part = counts.filter("n > 0").select("lang", F.col("phrase").alias("p"), F.col("a").alias("f"))
    words = F.split("phrase", " ")
    cand = counts.filter("n > 1").select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), words.alias("w"))
    cand = cand.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    cut = cand.join(part.withColumnsRenamed({"p": "left", "f": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"p": "right", "f": "r"}), ["lang", "right"])
    score = F.expr("cast(1000000 AS decimal(7,0)) * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) div (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    three = counts.filter("n = 3").select("lang", "a", F.split("phrase", " ").alias("w"))
    inner = three.select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < longer_share * F.col("a")))
    best_first = (F.desc("score"), F.desc("a"), "phrase")
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))  # the first of a language are among the first of its parts
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best_first))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    total = counts.filter("n = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM u, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x AND l.m = k JOIN f r ON r.lang = k.lang AND r.phrase = y AND r.m = k.m - k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * b.a)
SELECT z.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
