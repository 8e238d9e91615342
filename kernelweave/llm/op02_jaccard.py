"""N-gram Jaccard join: links between texts whose sets of 5-word shingles have a similarity of 0.75 or more.

Rows of equal sets are one class, found by a digest; everything after works on classes.

1. Shingle hashes (64 bits) go by hash to buckets in packed blocks, where their document frequency is counted exactly
   (distinct classes); only shingles of two classes or more come back. A class that shares fewer than 75 % of its
   shingles can link with nothing and is left here, mostly long before any join.
2. Rare first: a class orders its shingles by (frequency, hash); unshared ones stand in front and need no posting. The
   shared ones within the prefix of n - ceil(0.75 n) + 1 are its postings.
3. Postings join on the shingle under length, positional and suffix filters. The suffix filter bounds the overlap by
   bitmaps: a bit of one text that the other lacks stands for a shingle that it lacks.
4. Star round: each class is verified against the least edited class it meets most often. Rest round: what is still
   in different components is joined and verified, once per pair. Pairs inside a component need no verification, so
   a group of thousands of near copies costs about one verification each, and no link between components is lost.

Hot shingles (more than 1/HEAVY of all rows, so there are at most HEAVY times the mean set size) are found per task in
the first pass, broadcast, and skip the buckets; frequency of theirs only needs to be an order.

Texts are lower-cased A-Z; words are ``[^\\x20\\x09-\\x0D]+``. Fewer than five words: the whole sequence is the one
shingle. Null, empty and blank texts have no set, link with nothing and are their own component. A row with null
doc_id links like others; the smallest non-null id of a component names it. Rows that repeat an id are nodes of
their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm.components import components
from kernelweave.llm.text import Words, chunks, column_bytes, grams
from kernelweave.session import prepare, stored, table

WIDTH = 5
PER_BUCKET = 2_000_000  # shingles that one task counts
HEAVY = 200
MAPS = 8  # 64-bit words of a bitmap
OWNER = np.dtype([("cid", "<i8"), ("n", "<u4"), ("k", "<u4")])  # class, size of its set, shingles of it that follow
HIT = np.dtype([("h", "<i8"), ("df", "<i4")])


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a chunk, sorted within each text, and the size of each set."""
    w = Words(texts)
    h, doc = w.hashes(), w.text_of_word()
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    g = grams(h, WIDTH)
    ok = np.zeros(len(h), bool)
    ok[: max(0, len(h) - WIDTH + 1)] = doc[WIDTH - 1 :] == doc[: max(0, len(h) - WIDTH + 1)]
    for i in np.flatnonzero((w.count > 0) & (w.count < WIDTH)).tolist():
        a, b = int(w.first[i]), int(w.first[i + 1])
        g[a], ok[a] = grams(h[a:b], b - a)[0], True
    g, doc = g[ok], doc[ok]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(texts))


def class_ids(h: np.ndarray, size: np.ndarray) -> list[int | None]:
    """64-bit digest of each set; none for an empty one."""
    stop = np.cumsum(size)
    raw = h.astype("<u8").tobytes()
    return [int.from_bytes(hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=8).digest(), "little", signed=True) if n else None for e, n in zip(stop.tolist(), size.tolist())]


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n, cid of each row, and rows (hash, seen) of shingles frequent in a part of a task."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            held, docs, known = [], 0, set()
            for i, part in chunks(column_bytes(b)):
                h, size = shingles(part)
                ids, own = class_ids(h, size), []
                for x in ids:
                    own.append(x is not None and x not in known)
                    known.add(x)
                held.append(h[np.repeat(own, size)])
                docs += len(part)
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), b.column(1).slice(i, len(part)), pa.array(size.astype(np.int64)), pa.array(ids, pa.int64()), none, none, pa.array(np.ones(len(part), bool))], names=["doc_id", "t", "n", "cid", "hash", "seen", "is_row"])
            if held:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= max(16, docs / (2 * HEAVY))
                m = int(often.sum())
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(m, b.column(0).type), none, none, none, pa.array(u[often].view(np.int64)), pa.array(n[often].astype(np.int64)), pa.array(np.zeros(m, bool))], names=["doc_id", "t", "n", "cid", "hash", "seen", "is_row"])

    return documents.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, n long, cid long, hash long, seen long, is_row boolean")


def shared(documents: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """part, owners, hits (packed): the shingles of each class that another class has too, in blocks by part of classes."""
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(heavy)  # two columns: sorted hash, frequency

    def scatter(batches):
        known: set[int] = set()
        for b in batches:
            held: list = []
            size_held = 0
            for _, part in chunks(column_bytes(b)):
                h, size = shingles(part)
                ids = class_ids(h, size)
                own = []
                for x in ids:
                    own.append(x is not None and x not in known)
                    known.add(x)
                keep = np.repeat(own, size)
                held.append((h[keep], np.array([x for x, k in zip(ids, own) if k], np.int64), size[np.array(own, bool)]))
                size_held += len(h)
                if size_held > 2_000_000:
                    yield from blocks(held)
                    held, size_held = [], 0
            if held:
                yield from blocks(held)

    def blocks(held):
        h = np.concatenate([x[0] for x in held])
        cid, size = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        doc = np.repeat(np.arange(len(cid)), size)
        keys, counts = frequent.value
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hot = keys[at] == h
            packed = np.zeros(int(hot.sum()), HIT)
            packed["h"], packed["df"] = identity(h[hot], buckets), counts[at[hot]]
            n = np.bincount(doc[hot], minlength=len(cid))
            yield block_of([-1 - int(abs(cid[0]) % buckets)], [owners(cid[n > 0], size[n > 0], n[n > 0])], [packed.tobytes()])
            h, doc = h[~hot], doc[~hot]
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * max(1, len(cid)) + doc, kind="stable")
        h, doc, bucket = h[order], doc[order], bucket[order]
        six = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        key = bucket * max(1, len(cid)) + doc
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        runs, own = np.diff(np.concatenate((first, [len(key)]))), doc[first]
        cut = np.flatnonzero(np.concatenate(([True], bucket[first][1:] != bucket[first][:-1]))) if len(first) else np.zeros(0, np.int64)
        stop = np.concatenate((cut[1:], [len(first)]))
        begin, end = first[cut] if len(cut) else cut, np.concatenate((first[cut[1:]], [len(key)])) if len(cut) else cut
        yield block_of(bucket[begin], [owners(cid[own[a:z]], size[own[a:z]], runs[a:z]) for a, z in zip(cut, stop)], [six[a:z].tobytes() for a, z in zip(begin, end)])

    def owners(cid, n, k) -> bytes:
        out = np.zeros(len(cid), OWNER)
        out["cid"], out["n"], out["k"] = cid, n, k
        return out.tobytes()

    def block_of(bucket, own, shingles):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(own, pa.binary()), pa.array(shingles, pa.binary())], names=["bucket", "owners", "shingles"])

    def gather(key, found):
        bucket, own = key[0].as_py(), np.frombuffer(b"".join(found["owners"].to_pylist()), OWNER)
        raw = b"".join(found["shingles"].to_pylist())
        if bucket < 0:
            return by_part(np.repeat(own["cid"], own["k"]), np.repeat(own["n"], own["k"]), np.frombuffer(raw, HIT))
        six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        h = np.zeros((len(six), 8), np.uint8)
        h[:, :6] = six
        h = h.reshape(-1).view("<u8")
        cid, n = np.repeat(own["cid"], own["k"]), np.repeat(own["n"], own["k"])
        order = np.lexsort((cid, h))
        h, cid, n = h[order], cid[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])  # copies in other tasks
        h, cid, n = h[new], cid[new], n[new]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((start, [len(h)])))
        df = np.repeat(times, times)
        both = df > 1
        hits = np.zeros(int(both.sum()), HIT)
        hits["h"], hits["df"] = (h[both] ^ (np.uint64(bucket) << np.uint64(48))).view(np.int64), df[both]
        return by_part(cid[both], n[both], hits)

    def by_part(cid, n, hits):
        part = np.abs(cid % buckets)
        order = np.lexsort((cid, part))
        part, cid, n, hits = part[order], cid[order], n[order], hits[order]
        out: dict[str, list] = {"part": [], "owners": [], "hits": []}
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        for a, z in zip(cut, np.concatenate((cut[1:], [len(part)]))):
            first = a + np.flatnonzero(np.concatenate(([True], cid[a + 1 : z] != cid[a : z - 1])))
            out["part"].append(int(part[a]))
            out["owners"].append(owners(cid[first], n[first], np.diff(np.concatenate((first, [z])))))
            out["hits"].append(hits[a:z].tobytes())
        return pa.table({"part": pa.array(out["part"], pa.int64()), "owners": pa.array(out["owners"], pa.binary()), "hits": pa.array(out["hits"], pa.binary())})

    blocked = documents.select("doc_id", "text").mapInArrow(scatter, "bucket long, owners binary, shingles binary")
    return blocked.groupBy("bucket").applyInArrow(gather, "part long, owners binary, hits binary")


def identity(h: np.ndarray, buckets: int) -> np.ndarray:
    """The 48 low bits of a hash with its bucket above them: what names a shingle after the exchange."""
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    return ((h & np.uint64((1 << 48) - 1)) ^ (bucket << np.uint64(48))).view(np.int64)


def candidates(hits: DataFrame, percent: int) -> DataFrame:
    """cid, n, m (shared), ids (shared shingles, rare first) and bitmaps of classes that share enough to link at all."""
    kinds = {"cid": pa.int64(), "n": pa.int64(), "m": pa.int64(), "ids": pa.list_(pa.int64()), "maps": pa.list_(pa.int64())}

    def collect(key, found):
        own = np.frombuffer(b"".join(found["owners"].to_pylist()), OWNER)
        x = np.frombuffer(b"".join(found["hits"].to_pylist()), HIT)
        cid, n = np.repeat(own["cid"], own["k"]), np.repeat(own["n"], own["k"])
        order = np.lexsort((x["h"], x["df"], cid))
        x, cid, n = x[order], cid[order], n[order]
        new = np.ones(len(x), bool)  # a class whose copies lie in several tasks tells its hot shingles several times
        new[1:] = (cid[1:] != cid[:-1]) | (x["h"][1:] != x["h"][:-1])
        x, cid, n = x["h"][new], cid[new], n[new]
        start = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1]))) if len(cid) else np.zeros(0, np.int64)
        out: dict[str, list] = {k: [] for k in kinds}
        for a, z in zip(start.tolist(), [*start[1:].tolist(), len(cid)]):
            if 100 * (z - a) >= percent * int(n[a]):
                ids = x[a:z]
                maps, at = np.zeros(MAPS, np.uint64), (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
                np.bitwise_or.at(maps, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
                for k, v in zip(out, (int(cid[a]), int(n[a]), z - a, ids, maps.view(np.int64))):
                    out[k].append(v)
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return hits.groupBy("part").applyInArrow(collect, "cid long, n long, m long, ids array<bigint>, maps array<bigint>")


def _filters(percent: int) -> F.Column:
    """Length, positional and suffix filters on posting pairs u, v."""
    need = F.ceil(percent * (F.col("u.n") + F.col("v.n")) / (100 + percent))
    length = (100 * F.least("u.n", "v.n") >= percent * F.greatest("u.n", "v.n"))
    place = 1 + F.least(F.col("u.n") - F.col("u.pos"), F.col("v.n") - F.col("v.pos")) > need  # pos counts from 0
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{k}")))) for k in range(MAPS)), F.lit(0))
    return length & place & (F.col("u.m") - lacks("u", "v") >= need) & (F.col("v.m") - lacks("v", "u") >= need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets really link."""
    own = sets.select("cid", "n", "ids")
    with_a = pairs.join(own.withColumnsRenamed({"cid": "a", "n": "na", "ids": "ia"}), "a")
    both = with_a.join(own.withColumnsRenamed({"cid": "b", "n": "nb", "ids": "ib"}), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def link(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, class_id, part (names the component itself) of each row."""
    spark = prepare(documents.sparkSession)
    first = stored(sized(documents), "sized")
    rows = first.filter("is_row").select("doc_id", "t", "n", "cid")
    classes = stored(rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep")), "classes")
    n_rows, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = first.filter("NOT is_row").groupBy("hash").agg(F.sum("seen").alias("seen")).filter(F.col("seen") * HEAVY >= n_rows).toPandas()
    often = often.assign(hash=often.hash.to_numpy(np.int64).view(np.uint64)).sort_values("hash")
    heavy = (often.hash.to_numpy(np.uint64), often.seen.to_numpy(np.int64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_all / PER_BUCKET))
    sets = stored(candidates(shared(documents, heavy, buckets), percent), "sets")
    prefix = F.col("m") - F.ceil(percent * F.col("n") / 100) + 1
    posting = sets.select("cid", "n", "m", *(F.col("maps")[k].alias(f"b{k}") for k in range(MAPS)), F.posexplode(F.slice("ids", F.lit(1), prefix.cast("int"))).alias("j", "h")).withColumn("pos", F.col("n") - F.col("m") + F.col("j")).drop("j")
    posting = stored(posting, "postings")
    lean = F.struct((F.col("n") - F.col("m")) / F.col("n"), "cid")
    own = ["cid", "n", "m", "pos", *(f"b{k}" for k in range(MAPS))]
    centre = posting.groupBy("h").agg(F.min_by(F.struct(*own), lean).alias("c"), F.count("*").alias("met")).filter("met > 1").select("h", "c.*")
    star = posting.alias("u").join(centre.alias("v"), (F.col("u.h") == F.col("v.h")) & (F.col("u.cid") != F.col("v.cid")) & _filters(percent)).select(F.col("u.cid").alias("a"), F.col("v.cid").alias("b"))
    star = stored(star.groupBy("a", "b").count().groupBy("a").agg(F.max_by("b", F.struct("count", F.col("b"))).alias("b")), "star")
    linked = stored(_verified(star, sets, percent), "links")
    parts = components(linked)
    marked = posting.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid")).drop("component")
    mixed = marked.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("h")
    marked = stored(marked.join(mixed, "h", "left_semi"), "postings")
    rest = marked.alias("u").join(marked.alias("v"), (F.col("u.h") == F.col("v.h")) & (F.col("u.part") < F.col("v.part")) & _filters(percent))
    rest = rest.select(F.least("u.cid", "v.cid").alias("a"), F.greatest("u.cid", "v.cid").alias("b")).distinct()
    rest = rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")  # verified once
    linked = stored(linked.union(_verified(rest, sets, percent)), "links")
    parts = components(linked).withColumnRenamed("node", "cid")
    named = classes.join(parts, "cid", "left").withColumn("part", F.coalesce("component", "cid")).select("cid", "part", "rep")
    # written first: a join of two plain exchanges is one that Spark can split where one component holds a third of all
    named = stored(named, "named")
    low = stored(named.groupBy("part").agg(F.min("rep").alias("component_id")), "names")
    known = stored(named.join(low, "part").select("cid", "component_id", "part"), "parts")
    return rows.join(known, "cid", "left").select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cid").alias("class_id"), "part")


def one_of_each(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id (null last) stays.

    Texts without words are in no component and stay; rows that repeat both id and text are one document.
    """
    rows = link(documents, percent)
    first = rows.filter("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t")).alias("k"))
    keep = first.select("k.doc_id", "k.t").union(rows.filter("part IS NULL").select("doc_id", "t").distinct())
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.isnull("doc_id"), F.col("t")]
    keep = keep.select(*(c.alias(f"_key{i}") for i, c in enumerate(key)))
    own = documents.withColumns({f"_key{i}": c for i, c in enumerate([key[0], key[1], F.xxhash64("text")])})
    # the join leaves rows dealt and sorted by the key, so telling repeated rows apart costs no further shuffle
    return own.join(keep, ["_key0", "_key1", "_key2"], "left_semi").dropDuplicates(["_key0", "_key1", "_key2"]).select(*documents.columns)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.m, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(m) AS m FROM r GROUP BY id) c USING (doc_id)
"""
