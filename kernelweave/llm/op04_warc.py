"""WARC archives: write pages as response and revisit records, and read archives back by boundary-chain verification.

Writing: of records with equal payloads (of at least ``min_bytes``) the one with the smallest page_id is a response,
the others are revisits that refer to it and carry no payload. Which is which is found over (page_id, digest) rows
alone; payloads are shuffled once, by page, so a payload that a third of all pages share makes no large group. Files
are written by Spark's text writer, whose line separator is the blank line that ends a WARC record.

Reading: files are split at the version line, wherever it stands, also inside payloads. Tasks emit for each such
candidate its offset and the offset of the successor that its Content-Length gives; pointer jumping over (file, offset,
successor) rows from each file's start keeps what can be reached, in a number of joins that is logarithmic in the
records of a file. Pieces that a false boundary cut off are put back into their record. Offsets come from one pass,
which is stored; where texts are read once more, they are found by file, size and 64 bits of hash, never by their place in a
partition, so files may be packed into other partitions by then. A length that is negative, no number or beyond the file
leads to no successor; the chain of its file ends there, and what follows belongs to that record. A last record that is
cut off gives the payload that is left.

Null html: an empty payload. Null url: no target header. Null page_id: an empty record id, read back as null; it is a
response only where no page of the same payload has an id. Repeated (page_id, payload) rows are alike. Line breaks in
a url are written as %0D and %0A.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.session import discard, prepare, scratch, stored, table

LONGEST = 1 << 60  # a length beyond it is no length
FEW = 100_000  # hashes that are broadcast
MAGIC, EOL, GAP = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are four times 40 bits, each eight digits of five bits."""
    code = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(code, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 1000, compression: str = "gzip") -> None:
    """Write one record per row of (page_id, url, html) below ``path``; offsets are those of the uncompressed files."""
    prepare(pages.sparkSession)
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    ids = full.filter(F.octet_length("html") >= min_bytes).groupBy("page_id", "digest").agg(F.lit(1).alias("one"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"))
    later = ids.join(first, "digest").filter("first IS NOT NULL AND NOT (page_id <=> first)").select("page_id", F.col("digest").alias("d"), "first")
    rows = full.join(later.withColumnRenamed("page_id", "p"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("html"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = [
        ("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID: ", urn(F.col("page_id"))),
        ("WARC-Date: ", F.lit("1970-01-01T00:00:00Z")),  # pages carry no time
        ("WARC-Target-URI: ", url),
        ("WARC-Payload-Digest: sha1:", F.col("digest")),
        ("WARC-Profile: ", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To: ", F.when(revisit, urn(F.col("first")))),
        ("Content-Type: ", F.lit("application/http; msgtype=response")),
        ("Content-Length: ", F.octet_length(block).cast("string")),
    ]
    lines = F.concat_ws("", *(F.concat(F.lit(k), v, F.lit(EOL)) for k, v in head))
    rows.select(F.concat(F.lit(MAGIC), lines, F.lit(EOL), block).alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece that begins after the version line says of its record; lengths in bytes."""
    head = F.substring_index(value, GAP, 1)
    head_bytes = F.octet_length(head) + 4
    stated = _field(head, "Content-Length").try_cast("long")
    length = F.when(stated.between(0, LONGEST), stated)  # others lead nowhere, so a chain only goes forward
    block = F.substring(value.cast("binary"), head_bytes + 1, F.least(F.coalesce(length, F.lit(0)), F.octet_length(value)).cast("int"))
    http = F.substring_index(block.cast("string"), GAP, 1)
    payload = F.substring(block, F.octet_length(http) + 5, F.octet_length(block))
    return {
        "span": len(MAGIC) + head_bytes + length + 4,
        "type": _field(head, "WARC-Type"),
        "id": F.regexp_extract(_field(head, "WARC-Record-ID"), r"urn:page:(-?\d+)", 1).try_cast("long"),
        "refers": F.regexp_extract(_field(head, "WARC-Refers-To"), r"urn:page:(-?\d+)", 1).try_cast("long"),
        "stated": F.regexp_extract(_field(head, "WARC-Payload-Digest"), r"sha1:(\S+)", 1),
        "http_length": _field(http, "Content-Length").try_cast("long"),
        "digest": base32_sha1(payload),
        "payload_bytes": F.octet_length(payload).cast("long"),
        "payload": payload,
    }


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between version lines with their file, hash and size."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.xxhash64("value").alias("h"), F.octet_length("value").alias("size"), "value")


def _values(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """file, off, record, value of (file, off, record, h, size): another scan, of which only texts that are wanted move.

    Where they are few, their hashes go to the scan; where there are none, there is no scan.
    """
    key = ["file", "h", "size"]
    which = stored(wanted.select(*key).distinct(), "wanted")
    n = which.count()
    if not n:
        return wanted.select("file", "off", "record", F.lit(None).cast("string").alias("value")).limit(0)
    found = _lines(spark, path).join(F.broadcast(which) if n <= FEW else which, key).groupBy(*key).agg(F.first("value").alias("value"))  # equal texts are alike
    return wanted.join(found, key).select("file", "off", "record", "value")


def reachable(nodes: DataFrame) -> DataFrame:
    """Rows of (file, off, next) that a chain from offset 0 of their file reaches, by pointer jumping."""
    state = stored(nodes.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("reached")), "jump")
    while state.filter("reached AND jump IS NOT NULL").limit(1).count():
        hit = state.filter("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("off"), F.lit(True).alias("hit"))  # chains don't merge: one row each
        ahead = state.select("file", F.col("off").alias("jump"), F.col("jump").alias("further"))
        before, state = state, stored(
            state.join(hit.distinct(), ["file", "off"], "left").join(ahead, ["file", "jump"], "left").select("file", "off", F.col("further").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "jump"
        )
        discard(before)
    return state.filter("reached").select("file", "off")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """file, off, page_id, record_type, refers_to, payload_bytes, payload_digest (and payload) of each true record.

    A revisit states length and digest of the payload it refers to; a response's are those of the payload read.
    """
    from pyspark.sql import Window

    prepare(spark)
    lines = _lines(spark, path).withColumn("n", F.monotonically_increasing_id())  # an order within this pass alone
    names = ["span", "type", "id", "refers", "stated", "http_length", "digest", "payload_bytes"]
    parse = lambda c: [_parsed(c)[k].alias(k) for k in names]
    in_file = Window.partitionBy("file").orderBy("block", "n")
    # small rows only: lengths and header fields
    pieces = lines.select("file", "block", "n", "h", "size", *parse(F.col("value")))
    after = F.sum(F.col("size") + len(MAGIC)).over(in_file)
    pieces = stored(pieces.withColumn("off", after - F.col("size") - 2 * len(MAGIC)).filter("off >= 0"), "pieces")
    true = reachable(pieces.select("file", "off", (F.col("off") + F.col("span")).alias("next")))
    marked = pieces.join(true.withColumn("true", F.lit(True)), ["file", "off"], "left")
    owner = F.last(F.when(F.col("true"), F.col("off")), ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
    marked = stored(marked.withColumn("record", owner).filter("record IS NOT NULL").withColumn("parts", F.count("*").over(Window.partitionBy("file", "record"))), "records")
    whole = marked.filter("parts = 1")
    cut = marked.filter("parts > 1").select("file", "off", "record", "h", "size")
    joined = _values(spark, path, cut).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("v"))
    joined = joined.select("file", F.col("record").alias("off"), F.array_join("v.value", MAGIC).alias("value"))
    if payloads:
        own = _values(spark, path, whole.select("file", "off", "record", "h", "size")).select("file", "off", "value").unionByName(joined)
        records = own.select("file", "off", *parse(F.col("value")), _parsed(F.col("value"))["payload"].alias("payload"))
    else:
        records = whole.select("file", "off", *names).unionByName(joined.select("file", "off", *parse(F.col("value"))))
    revisit = F.col("type") == "revisit"
    return records.select(
        "file", "off", F.col("id").alias("page_id"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"), *(["payload"] if payloads else []),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
c AS (SELECT page_id, html, h, [CAST(('0x' || substr(h, 10 * i + 1, 10)) AS BIGINT) FOR i IN range(0, 4)] AS q FROM p),
e AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31 AS BIGINT) + 1, 1) FOR j IN range(0, 32)], '') AS payload_digest FROM c)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM e
"""
