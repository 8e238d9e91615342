"""URL filter: fixed rules on host and path first, mined association rules for what no fixed rule judges.

Pages that a fixed rule judges are the labelled transactions: the tokens of their urls and the rule's verdict. Spark's
FP-growth mines the token combinations of any length that lead to "block", pruned by support (of combination and verdict
together), by confidence and by lift over the share of "block" among the labels; of these the shortest are kept, for a
longer one that holds one of them adds nothing. A page that holds all tokens of a rule is blocked.

Two things keep the mining small without changing its rules. A token that is a rule by itself is told by the counts of
single tokens, FP-growth's own first pass, and takes no part in the second: whatever holds it is no shortest rule. And
tokens that stand in exactly the same labelled pages are one item (closed item sets): a rule of items stands for the
rules of all choices of one token an item, and is matched so. Tokens that stand together more often than
not, but not always, can still be mined in many combinations; support is what bounds these, as in any FP-growth.

Rules are matched by an inverted index: a url's items meet the rules whose rarest item they are, then the rule's other
items are checked. At most tokens / min_support tokens of the labels are frequent, at any number of pages; their table
and FP-growth's items are bounded by that.

The labels come from rules on host and path, so what is mined generalises from them: with a host whose labelled pages
are all blocked, its other pages are blocked too.

Null url or one without "://": host and path empty, no rule; without tokens the method allows. Repeated pages are
judged alike. Empty tables give empty results; without labels the method allows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelweave.session import prepare, stored, table

#: fixed values: host, path, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
VERDICT = "\x1fblock"  # the item of the verdict; no token has that byte


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda x: (len(x[0]) + len(x[1]), x)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host and its parent domains, words of host and path, path parts by place, extension, names in the query."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(r"([a-z]{3,})"), F.lit(1)), lambda x: F.concat(F.lit("word="), x))
    parts = F.filter(F.split(path, "/"), lambda x: ~F.rlike(x, F.lit(r"^[0-9]*$")))
    first = F.transform(F.slice(parts, 1, 1), lambda x: F.concat(F.lit("first="), x))
    last = F.transform(F.slice(F.reverse(parts), 1, 1), lambda x: F.concat(F.lit("last="), x))
    kind = F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]{1,8})$"), F.lit(1)), lambda x: F.concat(F.lit("ext="), F.lower(x)))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    every = F.transform(F.concat(domains, words, first, last, kind, F.coalesce(names, F.array())), lambda x: F.translate(x, "\x1f", " "))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_lift: float = 1.25, min_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """(items, rules) from rows of (tokens, verdict).

    items: token, item, n; tokens that stand in the same rows are one item. rules: items, lead (the rarest of them),
    confidence, support of each shortest rule that leads to block. A rule needs ``min_pages`` blocked pages at least.
    """
    spark = labelled.sparkSession
    kinds = "items array<string>, lead string, confidence double, support long"
    labelled = stored(labelled.select("tokens", "verdict"), "labelled")
    n, n_block = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    least, sure = max(min_pages, math.ceil(min_support * n)), max(min_confidence, min_lift * n_block / max(n, 1))
    blocked = F.col("verdict") == "block"
    # where a token stands, in two sums of row hashes: equal ones stand in the same rows
    rows = labelled.select(F.explode("tokens").alias("token"), blocked.alias("b"), *(F.xxhash64(F.lit(k), "tokens").cast("decimal(20,0)").alias(f"h{k}") for k in range(2)))
    single = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("b").alias("n_block"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    frequent = single.filter(F.col("n_block") >= least)  # no rule has another token
    item = F.min("token").over(Window.partitionBy("n", "n_block", "h0", "h1"))
    items = stored(frequent.select("token", item.alias("item"), "n", "n_block"), "items")  # at most (tokens a url) / min_support rows
    alone = F.col("n_block") / F.col("n") >= sure
    singles = items.filter(alone & (F.col("token") == F.col("item"))).select(F.array("item").alias("items"), (F.col("n_block") / F.col("n")).alias("confidence"), F.col("n_block").alias("support"))
    open_items = F.broadcast(items.filter(~alone).select("token", "item"))
    numbered = labelled.withColumn("id", F.monotonically_increasing_id())
    own = numbered.select("id", blocked.alias("b"), F.explode("tokens").alias("token")).join(open_items, "token").groupBy("id", "b").agg(F.collect_set("item").alias("items"))
    sets = stored(own.select(F.when(F.col("b"), F.concat("items", F.array(F.lit(VERDICT)))).otherwise(F.col("items")).alias("items")), "transactions")
    m = sets.count()
    found = spark.createDataFrame([], "items array<string>, confidence double, support long")
    if m and n_block and sure <= 1:
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / m), minConfidence=sure).fit(sets)
        hit = model.associationRules.filter(F.array_contains("consequent", VERDICT))
        found = hit.select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * m).cast("long").alias("support"))
    every = stored(singles.unionByName(found) if n_block else spark.createDataFrame([], "items array<string>, confidence double, support long"), "rules")
    counts = items.groupBy("item").agg(F.max("n").alias("n"))
    lead = every.select("items", F.explode("items").alias("item")).join(F.broadcast(counts), "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("lead"))
    led = stored(every.join(lead, "items"), "rules")
    # a rule that holds a shorter one goes
    inside = led.select("items", F.explode("items").alias("lead")).join(led.select("lead", F.col("items").alias("part")), "lead")
    longer = inside.filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)).select("items").distinct()
    rules = stored(led.join(longer, "items", "left_anti").select(*(x.split(" ")[0] for x in kinds.split(", "))), "index")
    return items.select("token", "item", "n"), rules


def hits(urls: DataFrame, mined: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The distinct ``url`` of rows (url, tokens) that hold a token of each item of a rule."""
    items, rules = mined
    own = urls.select("url", F.explode("tokens").alias("token")).join(F.broadcast(items.select("token", "item")), "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    met = own.select("url", "items", F.explode("items").alias("lead")).join(rules.select("lead", F.col("items").alias("rule")), "lead")
    return met.filter(F.size(F.array_except("rule", "items")) == 0).select("url").distinct()


def judge(pages: DataFrame, url: str = "url", rules=RULES, min_support: float = 0.005, min_confidence: float = 0.8, min_lift: float = 1.25, min_pages: int = 5) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    parsed = parsed.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "_tokens": tokens(F.col(url), F.col("host"), F.col("path"))})
    mined = mine(parsed.filter("_rule IS NOT NULL").select(F.col("_tokens").alias("tokens"), F.col("_rule.verdict").alias("verdict")), min_support, min_confidence, min_lift, min_pages)
    by_method = F.col("_rule").isNull() & (F.size("_tokens") > 0)
    asked = parsed.filter(by_method)
    bad = hits(asked.select(F.col(url).alias("url"), F.col("_tokens").alias("tokens")).distinct(), mined).select(F.col("url").alias("_bad"))
    asked = asked.join(bad, F.col(url) == F.col("_bad"), "left").withColumn("verdict", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")).drop("_bad")
    known = parsed.filter(~by_method).withColumn("verdict", F.coalesce("_rule.verdict", F.lit("allow")))
    return known.unionByName(asked).withColumn("rule", F.col("_rule.rule")).drop("_rule", "_tokens")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
