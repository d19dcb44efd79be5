"""URL filters: given rules first, association rules mined from labelled URLs for the rest.

A URL becomes a set of tokens (host, its parent domains, sub-domain, path parts, file ending, query keys, fragment, scheme).
FP-growth mines token combinations from the labelled URLs together with their label; those that imply ``block`` with enough
confidence and support are the rules. A rule with a smaller rule inside it that is as sure is left out. Rules are found by an
inverted index: each is filed under one of its tokens, the rarest, joined there with the URLs, and then checked whole.

FP-growth lists every subset of what occurs together, so three things are settled before it. A token of too few bad URLs is in
no rule. A token of bad URLs only is a rule by itself, and no combination with it is surer. Tokens that always occur together
(the parts of one long path) are one item, which a URL has if it has any of them: their combinations are equally sure, so the
smallest, each token alone, would be the rules. What is left grows with the number of tokens of mixed URLs that nest.

A given rule fits its host and every sub-domain, and paths that start with its path; the longest one wins. They are filed
under their host, and URLs look up all parents of theirs.

Null URLs and those without ``://`` have an empty host and path, fit nothing and are allowed. Equal URLs are judged once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A combination is seen in so many rows at least, and in a share of them: none, so that a table that grows loses no rule.
LEAST, SUPPORT = 10, 0.0
CONFIDENCE = 0.6
BLOCK = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> dict[str, Column]:
    """``host`` and ``path`` of the URL."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    take = lambda i: F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))
    return {"host": F.translate(take(1), _UPPER, _LOWER), "path": take(2)}


def parents(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL with columns ``host`` and ``path``."""
    tag = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name + "="), v))
    pieces = F.filter(F.split("path", "/"), lambda v: v != "")
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(query, lambda v: F.regexp_extract(v, r"^([^=]*)", 1)), lambda v: v != "")
    one = lambda name, v: F.when(v != "", F.array(F.concat(F.lit(name + "="), v))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        tag("site", parents(F.col("host"))), one("first", F.regexp_extract("host", r"^([^.]+)\.", 1)), tag("path", pieces),
        one("ending", F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)), tag("key", keys),
        one("fragment", F.regexp_extract(url, r"(?s)#(.*)$", 1)), one("scheme", F.regexp_extract(url, r"(?s)^(.*?)://", 1))))


def items_of(baskets: DataFrame) -> DataFrame:
    """``token, item, pure``: the tokens that can be in a rule, the item they are part of, and whether it is a rule by itself."""
    row = F.struct("row")
    each = baskets.select(F.explode("tokens").alias("token"), F.col("bad").cast("long").alias("bad"),
                          F.xxhash64(row).alias("x"), F.xxhash64(row, F.lit(1)).alias("y"))
    # tokens of equal counts and sums of row hashes occur in the same rows
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    seen = stage(seen.where(F.col("b") >= LEAST), "tokens")
    same = ["n", "b", "x", "y"]
    return seen.join(seen.groupBy(*same).agg(F.min("token").alias("item")), same).select(
        "token", "item", (F.col("b") == F.col("n")).alias("pure"))


def as_items(rows: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """``keys, items`` of the rows with ``tokens`` that have some of the items."""
    each = rows.select(*keys, F.explode("tokens").alias("token")).join(small(items), "token")
    return each.groupBy(*keys).agg(F.collect_set("item").alias("items"))


def mine(baskets: DataFrame, items: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``rule, size, confidence, support``: sets of items that imply the block label, from ``row, tokens, bad``."""
    rows = max(1, baskets.count())
    least = max(support, (LEAST - 0.5) / rows)
    pure = items.where("pure").select("item").distinct()
    mixed = as_items(baskets, items.where("NOT pure"), "row", "bad").select(
        F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    mixed = stage(mixed, "baskets")
    # shares are of the rows that have an item
    some = max(1, mixed.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * rows / some), minConfidence=confidence).fit(mixed)
    sure = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(
        F.sort_array("antecedent").alias("rule"), F.size("antecedent").alias("size"), "confidence",
        (F.col("support") * some / rows).alias("support"))
    sure = stage(sure, "rules")
    # a rule that holds a smaller one which is as sure adds nothing; rules meet at each of their items
    each = sure.select("rule", "size", "confidence", F.explode("rule").alias("token"))
    lesser = each.select(F.col("rule").alias("r"), F.col("size").alias("s"), F.col("confidence").alias("c"), "token")
    spare = each.join(lesser, "token").where("s < size AND c >= confidence").where(
        F.size(F.array_except("r", "rule")) == 0).select("rule").distinct()
    alone = pure.select(F.array("item").alias("rule"), F.lit(1).alias("size"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("support"))
    return sure.join(spare, "rule", "left_anti").select("rule", "size", "confidence", "support").union(alone)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` of the URLs (``key, tokens``) that hold all tokens of some rule."""
    each = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("rule", F.explode("rule").alias("token")).join(often, "token", "left")
    rarest = filed.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("token").alias("token"))).alias("m")).select(
        "rule", F.col("m.token").alias("token"))
    return each.join(small(stage(rarest, "index")), "token").where(F.size(F.array_except("rule", "tokens")) == 0).select("key").distinct()


def given(urls: DataFrame, rules=RULES) -> DataFrame:
    """``key, rule, ruled``: the longest given rule that fits each URL."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "r_host string, r_path string, rule string, ruled string")
    each = urls.where("host <> ''").select("key", "path", F.explode(parents(F.col("host"))).alias("r_host"))
    fits = each.join(small(table, len(rules)), "r_host").where(F.col("path").startswith(F.col("r_path")))
    longest = F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), F.col("rule")))
    return fits.groupBy("key").agg(longest.alias("m")).select("key", "m.rule", "m.ruled")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``labelled`` has ``url`` and ``bad`` (boolean)."""
    split = lambda df: df.withColumn("key", F.coalesce("url", F.lit(""))).withColumns(parts("key"))
    baskets = split(labelled.select("url", "bad")).select(
        F.monotonically_increasing_id().alias("row"), tokens(F.col("key")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    baskets = stage(baskets, "labelled")
    items = stage(items_of(baskets), "items")
    mined = stage(mine(baskets, items, support, confidence), "mined")
    urls = stage(split(pages.select("url").distinct()).select("key", "host", "path", tokens(F.col("key")).alias("tokens")).distinct(), "urls")
    found = match(as_items(urls, items, "key").withColumnRenamed("items", "tokens"), mined).withColumn("_hit", F.lit(True))
    known = urls.select("key", "host", "path").join(given(urls, rules), "key", "left").join(found, "key", "left").select(
        "key", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("_hit"), "block"), F.lit("allow")).alias("verdict"))
    left = pages.drop("host", "path", "rule", "verdict").withColumn("_key", F.coalesce("url", F.lit("")))
    return left.join(known, F.col("_key") == F.col("key")).drop("_key", "key")
