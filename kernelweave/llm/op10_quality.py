"""Quality rules: fixed counts per text and a perplexity band per language.

The language model is a modified Kneser-Ney n-gram model (order 4), one for each value of ``lang``, null among them.
Its symbols are 64 units of UTF-8 bytes (letters, capitals, digits, kinds of space, single punctuation marks and
symbols, ranges of other bytes), so an n-gram is a code of 24 bits. Spark counts the n-grams of all whole texts (those of
a task are counted before the shuffle) and the texts that have them; each language's counts, at most 2^25 rows at any
corpus size, become sorted arrays of codes with log probabilities and back-off weights, looked up by binary search. The
model is over n-grams that two texts of the language or more have: what one text alone has would only make that text
likely to itself. Nothing else is left out, at any size.

A second model of the same form, over eight classes of units (letters and digits, capitals, space, punctuation,
symbols), is held beside it: a corpus has enough noise in symbols for the first to learn it, but a symbol among letters
stays rare by class, and a passage in another language doesn't show there.

A third is over words: runs of ORDER words, each as one of 48 classes (how it begins, the mark it ends with, its
length), counted, smoothed and stored alike. Byte units see little across a blank; this model sees the order of words, and
a text whose words are shuffled, so that sentences begin and end anywhere, is far above its language's band. Classes
and not words, because in a table of word n-grams nearly every run of a text is new.

Models of at most HELD bytes together are broadcast; beyond that, documents meet the model of their language in
parts of about PART bytes each, so that a language with a third of all rows is many groups. Both give equal rows.

Bands: log perplexities of a language have median m and median absolute deviation d over all documents with words,
exact over values rounded to four digits; accepted is m - low * s to m + high * s with s = max(1.4826 d, floor) over
units, and up to m + class_high * s over classes. Over whole texts of sf0.1, 5 in 1,000 and fewer of a language's clean
texts lie 16 or more above m over units, and nineteen in twenty texts of another of its languages 38 or more. Over words
the upper bound is m + word_high * s + word_spread / sqrt(n_words), since the mean over few words varies more; on sf0.1 it
takes 5 of 8,208 clean texts, and 553 of 600 copies with shuffled words that are put among them.

Null text: no words, base_failed. Empty tables give empty results. Repeated rows are judged alike.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.text import SPACE, Words, chunks, column_bytes, grams
from kernelweave.session import prepare, stored, table

ORDER, BITS = 4, 6
UNITS = 1 << BITS
HELD = 64 << 20
PART = 64 << 20
#: fixed values: punctuation and symbols that are units of their own
_MARKS, _SIGNS = ".,;:!?'\"()-/", "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in _SIGNS]] = True


def _unit(b: int) -> int:
    """0 stands before a text; 1 to 26 letters; then capitals, digits, three kinds of space, marks, signs, others, bytes of other scripts."""
    c = chr(b)
    if b >= 0xC0:
        return 61 + min(2, (b - 0xC0) >> 4)
    if b >= 0x80:
        return 53 + (b & 7)
    if c in _MARKS:
        return 32 + _MARKS.index(c)
    if c in _SIGNS:
        return 44 + _SIGNS.index(c)
    if SPACE[b]:
        return 29 if c == " " else 30 if c == "\n" else 31
    return b - 0x60 if c.islower() else 27 if c.isupper() else 28 if c.isdigit() else 52


_UNIT = np.array([_unit(b) for b in range(256)], np.uint8)
WORD = 1 << BITS * ORDER  # added to the codes of runs of words
# how a word begins: small letter, capital, digit, other; the mark it ends with: none, comma, end of a sentence, other
_BEGIN = np.full(256, 3, np.int64)
_BEGIN[[*range(0x61, 0x7B), *range(0xC3, 0x100)]], _BEGIN[0x41:0x5B], _BEGIN[0x30:0x3A] = 0, 1, 2
_FINISH = np.zeros(256, np.int64)
_FINISH[0x2C], _FINISH[[0x2E, 0x21, 0x3F]], _FINISH[[ord(c) for c in ";:)\"'"]] = 1, 2, 3
_CLASS = np.full(UNITS, 1, np.int64)  # letters, digits and bytes of other scripts
_CLASS[0], _CLASS[27], _CLASS[29:32], _CLASS[32:43], _CLASS[44:52], _CLASS[[43, 52]] = 0, 2, 4, 5, 7, 6
_LEAD = np.zeros(256, bool)  # bytes that begin a code point
_LEAD[[*range(0x00, 0x80), *range(0xC0, 0x100)]] = True


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a chunk."""
    w = Words(texts, lower=False)
    bounds = np.stack((w.text_start, w.text_end), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[bounds[:, 1]] - total[bounds[:, 0]]

    n_words = w.count.astype(np.int64)
    out = {"n_words": n_words, "word_chars": per_text(_LEAD[w.data] & ~SPACE[w.data]), "n_symbols": per_text(_SYMBOL[w.data])}
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    repeat = np.zeros(len(texts), np.int64)
    if len(w.start) >= 3:
        g, doc = grams(w.hashes(), 3), w.text_of_word()
        ok = np.zeros(len(g), bool)
        ok[:-2] = doc[2:] == doc[:-2]
        at = np.flatnonzero(ok)
        order = at[np.lexsort((g[at], doc[at]))]
        same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(g) + 2, bool)
        for j in range(3):
            hit[order[twice] + j] = True
        repeat = np.bincount(doc, weights=hit[: len(doc)], minlength=len(texts)).astype(np.int64)
    out["n_repeat_words"] = repeat
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the texts set apart by ORDER - 1 zeros in front of each: units, start and end of each text."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size + ORDER - 1)
    units = _UNIT[data]
    for j in range(1, ORDER):
        units[end - size - j] = 0
    return units, end - size, end


def _codes(units: np.ndarray) -> np.ndarray:
    """The ORDER units that end at each position as one integer."""
    out = units.astype(np.int32)
    for j in range(1, ORDER):
        out[j:] |= units[:-j].astype(np.int32) << (BITS * j)
    return out


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER classes that end at each word of a text (zeros stand before it), and each text's first word."""
    w = Words(texts, lower=False)
    if not len(w.start):
        return np.zeros(0, np.int32), w.first
    first, second = w.data[w.start], w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    begin = np.where((first == 0xC3) & (second < 0x9F), 1, _BEGIN[first])  # accented capitals
    unit = 1 + (begin * 4 + _FINISH[w.data[w.end - 1]]) * 3 + np.digitize(w.end - w.start, [4, 8])
    units = np.zeros(len(unit) + (ORDER - 1) * len(texts), np.uint8)
    at = np.arange(len(unit)) + (ORDER - 1) * (w.text_of_word() + 1)
    units[at] = unit
    return _codes(units)[at], w.first


def _classes(codes: np.ndarray) -> np.ndarray:
    """The classes of the ORDER units of each code, in the same layout."""
    return sum(_CLASS[codes >> BITS * j & UNITS - 1] << BITS * j for j in range(ORDER))


def language() -> F.Column:
    """The language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def count_grams(documents: DataFrame) -> DataFrame:
    """language, code, n, texts: how often each run of ORDER units occurs and in how many texts; a text starts with zeros.

    Codes of runs of words have ``WORD`` added.
    """

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            kind = np.array(b.column(0).to_pylist(), object)
            for i, part in chunks(column_bytes(b)):
                own = kind[i : i + len(part)]
                for lang in set(own.tolist()):
                    units, start, end = _joined([t for t, x in zip(part, own) if x == lang])
                    place = np.arange(len(units))
                    text = np.searchsorted(end, place, "right")
                    inside = place >= start[np.minimum(text, len(start) - 1)]
                    words, first = word_codes([t for t, x in zip(part, own) if x == lang])
                    owner = np.repeat(np.arange(len(start)), np.diff(first))
                    both = np.concatenate(((text << BITS * ORDER + 1 | _codes(units))[inside], owner << BITS * ORDER + 1 | WORD | words))
                    own_code, n = np.unique(both, return_counts=True)
                    held.setdefault(lang, []).append(_merge([np.stack((own_code & 2 * WORD - 1, n, np.ones_like(n)))]))
                    if len(held[lang]) >= 16:
                        held[lang] = [_merge(held[lang])]
            if sum(x.shape[1] for parts in held.values() for x in parts) > 8_000_000:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held):
        for lang, parts in held.items():
            u, *counts = _merge(parts)
            for i in range(0, len(u), 65536):
                m = len(u[i : i + 65536])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(u[i : i + m].astype(np.int32)), *(pa.array(n[i : i + m]) for n in counts)], names=["language", "code", "n", "texts"])

    counted = documents.select(language().alias("language"), "text").mapInArrow(run, "language string, code int, n long, texts long")
    return counted.groupBy("language", "code").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of codes and counts as one, each code once."""
    both = np.concatenate(parts, 1)
    both = both[:, np.argsort(both[0], kind="stable")]
    first = np.flatnonzero(np.diff(both[0], prepend=-1))
    return np.stack((both[0, first], *(np.add.reduceat(n, first) for n in both[1:]))) if len(first) else both


def fit(documents: DataFrame) -> DataFrame:
    """language, model (packed orders over units, over classes and over words) of each language."""

    def build(key, found):
        codes, n, texts = (found[k].to_numpy().astype(np.int64) for k in ("code", "n", "texts"))
        order = np.argsort(codes)
        order = order[texts[order] > 1]
        codes, n = codes[order], n[order]
        word = codes >= WORD
        words, codes, times, n = codes[word] - WORD, codes[~word], n[word], n[~word]
        model = pickle.dumps((kneser_ney(codes, n), kneser_ney(*_merge([np.stack((_classes(codes), n))])), kneser_ney(words, times)), protocol=5)
        return pa.table({"language": pa.array([key[0].as_py()]), "model": pa.array([model], pa.binary())})

    counted = count_grams(documents).groupBy("language").applyInArrow(build, "language string, model binary")
    return stored(counted, "models")


def kneser_ney(code: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..ORDER: sorted codes, their log10 probabilities, sorted contexts, log10 back-off weights.

    From sorted codes and counts of the highest order; a lower order counts the different units that stand before.
    """
    levels = [(code, count)]
    for n in range(ORDER - 1, 0, -1):
        levels.append(np.unique(levels[-1][0] & ((1 << BITS * n) - 1), return_counts=True))
    out: list = []
    for n, (code, count) in enumerate(reversed(levels), 1):
        c = [int((count == k).sum()) for k in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        d = [0.0] + [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k - 0.05) if c[k] and c[k + 1] else 0.5 * k for k in (1, 2, 3)]
        ctx, at = np.unique(code >> BITS, return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(ctx))
        seen = count - np.array(d)[np.minimum(count, 3)]
        gamma = 1 - np.bincount(at, weights=seen, minlength=len(ctx)) / total  # what was discounted
        lower = 10 ** _look(out, code & ((1 << BITS * (n - 1)) - 1)) if n > 1 else np.full(len(code), 1 / UNITS)
        p = seen / total[at] + gamma[at] * lower
        out.append((code.astype(np.int32), np.log10(p).astype(np.float32), ctx.astype(np.int32), np.log10(np.maximum(gamma, 1e-9)).astype(np.float32)))
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _look(orders: list, code: np.ndarray) -> np.ndarray:
    """log10 probability of the last unit of each code given those before it."""
    out = np.zeros(len(code), np.float64)
    left, code = np.arange(len(code)), code.astype(np.int32)
    for n in range(len(orders), 0, -1):
        keys, logp, ctx, back = orders[n - 1]
        at, hit = _find(keys, code)
        out[left[hit]] += logp[at[hit]] if len(keys) else 0
        left, code = left[~hit], code[~hit]
        at, hit = _find(ctx, code >> BITS)
        out[left[hit]] += back[at[hit]] if len(ctx) else 0
        code = code & ((1 << BITS * (n - 1)) - 1)
    out[left] += np.log10(1 / UNITS)
    return out


_PERPLEXITIES = ["log_perplexity", "log_class_perplexity", "log_word_perplexity"]
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(b: pa.RecordBatch, model_of) -> pa.RecordBatch:
    """Counts and log10 perplexities (a byte, a byte, a word) of rows (doc_id, t, language, text)."""
    kind, out = np.array(b.column(2).to_pylist(), object), {k: [] for k in _COUNTS}
    ppl, shape, order = (np.zeros(b.num_rows) for _ in range(3))
    for i, part in chunks(column_bytes(b)):
        for k, v in base_counts(part).items():
            out[k].append(v)
        units, start, end = _joined(part)
        codes, lang = _codes(units), kind[i : i + len(part)]
        words, first = word_codes(part)
        for x in set(lang.tolist()):
            own = np.flatnonzero(lang == x)
            size = (end - start)[own]
            stop = np.cumsum(size)
            if not stop[-1]:
                continue
            at = np.concatenate([np.arange(start[j], end[j]) for j in own])
            u, back = np.unique(codes[at], return_inverse=True)
            by_unit, by_class, by_word = model_of(x)
            for into, logp in ((ppl, _look(by_unit, u)), (shape, _look(by_class, _classes(u)))):
                some = size > 0  # each text is added up alone, so its neighbours don't show in the last digits
                into[i + own[some]] = -np.add.reduceat(logp[back], (stop - size)[some]) / size[some]
            n = np.diff(first)[own]
            if n.any():
                u, back = np.unique(words[np.concatenate([np.arange(first[j], first[j + 1]) for j in own])], return_inverse=True)
                order[i + own[n > 0]] = -np.add.reduceat(_look(by_word, u)[back], (np.cumsum(n) - n)[n > 0]) / n[n > 0]
    cols = [pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64)) for k in _COUNTS]
    return pa.RecordBatch.from_arrays([*b.columns[:3], *cols, pa.array(ppl), pa.array(shape), pa.array(order)], names=["doc_id", "t", "language", *_COUNTS, *_PERPLEXITIES])


def score(documents: DataFrame, models: DataFrame) -> DataFrame:
    """The rows of ``documents`` (key doc_id) with counts, language and log10 perplexities: a byte, of units and of their classes, and a word."""
    spark = documents.sparkSession
    lean = documents.select("doc_id", F.xxhash64("text", "lang").alias("t"), language().alias("language"), "text")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, t long, language string, {', '.join(f'{k} long' for k in _COUNTS)}, {', '.join(f'{k} double' for k in _PERPLEXITIES)}"
    if (models.agg(F.sum(F.octet_length("model"))).first()[0] or 0) <= HELD:
        held = spark.sparkContext.broadcast({r["language"]: pickle.loads(r["model"]) for r in models.collect()})

        def run(batches):
            for b in batches:
                yield _scored(b, held.value.__getitem__)

        return lean.mapInArrow(run, schema)
    # a language's documents meet its model in parts; the number of parts a language is counted, not given
    parts = stored(lean.groupBy("language").agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / PART).cast("long").alias("last")), "parts")
    dealt = lean.join(parts, "language").withColumn("part", F.pmod(F.xxhash64("doc_id", "t"), F.col("last") + 1)).drop("last")
    sent = parts.join(models, "language", "left").select("language", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"), "model")

    def meet(left, right):
        model = pickle.loads(right["model"][0].as_py()) if right.num_rows and right["model"][0].is_valid else None
        rows = [_scored(b, lambda _: model) for b in left.select(["doc_id", "t", "language", "text"]).to_batches()]
        return pa.Table.from_batches(rows) if rows else None

    keys = ["language", "part"]
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, schema)


def judge(documents: DataFrame, low: float = 8.0, high: float = 16.0, floor: float = 0.005, class_high: float = 8.0, class_floor: float = 0.005, word_high: float = 3.0, word_floor: float = 0.03, word_spread: float = 0.7) -> DataFrame:
    """doc_id, base counts, base_failed, kept, perplexities, language and t (hash of text and language) of each row of ``documents``."""
    prepare(documents.sparkSession)
    scored = stored(score(documents, fit(documents)), "quality")
    both = [*zip(_PERPLEXITIES, (floor, class_floor, word_floor))]
    worded = scored.filter("n_words > 0")
    # values are rounded to four digits, so a language's histogram is small at any number of rows
    mid = worded.groupBy("language").agg(*(F.percentile(F.round(x, 4), 0.5).alias(f"{x}_mid") for x, _ in both))
    apart = worded.join(mid, "language").groupBy("language", *(f"{x}_mid" for x, _ in both)).agg(*(F.percentile(F.round(F.abs(F.col(x) - F.col(f"{x}_mid")), 4), 0.5).alias(f"{x}_mad") for x, _ in both))
    off, class_off, word_off = ((F.col(x) - F.col(f"{x}_mid")) / F.greatest(1.4826 * F.col(f"{x}_mad"), F.lit(least)) for x, least in both)
    fine = off.between(-low, high) & (class_off <= class_high)
    spread = F.lit(word_spread) / F.sqrt(F.greatest("n_words", F.lit(1))) / F.greatest(1.4826 * F.col("log_word_perplexity_mad"), F.lit(word_floor))
    fine = fine & (word_off <= word_high + spread)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.join(stored(apart, "bands"), "language", "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(fine, F.lit(True))).alias("kept"), *_PERPLEXITIES, F.expr("substr(language, 2)").alias("language"), "t"
    )


def kept_only(documents: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps; a row's verdict is found by its id and a hash of its text and language."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.isnull("doc_id")]
    good = judge(documents).filter("kept").select(*(c.alias(f"_key{i}") for i, c in enumerate([*key, F.col("t")])))
    own = documents.withColumns({f"_key{i}": c for i, c in enumerate([*key, F.xxhash64("text", "lang")])})
    return own.join(good, ["_key0", "_key1", "_key2"], "left_semi").select(*documents.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("t")
