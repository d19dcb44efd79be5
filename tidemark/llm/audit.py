"""How filters interact: what each removes in every order in which they could be applied.

Every filter has a table of the ids that fail it, stored once, without the texts. All else is joins of these small tables.
What a filter removes after others depends on which of them came before, not on their order, so each of the ``2^n`` sets of
filters is one prefix. A prefix blocks the ids that fail one of its filters; then, in one join for all prefixes,

* survivors of a prefix are the documents left-anti what it blocks,
* a filter removes its failing ids left-anti what the prefix before it blocks, and those left-semi are redundant there,
* labels lost, and the ids that fail nothing else, are counted on what is removed.

Documents that fail no filter survive every prefix and are counted once. A row of the input is a document, also if its
doc_id is missing or repeats; each has a key of its own. A copy is a text that a row of a smaller doc_id has, too; a row
without doc_id has no smaller one and is no copy. Null texts are empty, a null ``lang`` is the part with the empty name. A
label counts if any row of ``labels`` with that doc_id sets it. An empty table has no parts and gives no rows.

Tables that grow with the documents are joined by sorting and merging, at every size. Left to the optimizer they could be
broadcast: it takes them for as large as the files they come from, which are compressed, and counts a row for each prefix as one.
"""

from __future__ import annotations

import hashlib
import json
from itertools import combinations, permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, text_of
from tidemark.session import stage

NAMES = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
MARKS = "[#$%&*|]"
COPY = "E"


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, part, words, kinds, uppers, points, marked, digest`` of each row's whole text."""

    def make_step():
        upper = np.zeros(256, bool)
        upper[ord("A"):ord("Z") + 1] = True
        marks = set(MARKS[1:-1].encode())

        def step(texts) -> dict:
            out = {c: [] for c in ("words", "kinds", "uppers", "points", "marked", "digest")}
            for text in texts.to_pylist():
                data = text.encode("utf-8")
                words = data.split()
                codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                out["words"].append(len(words))
                out["kinds"].append(len(set(words)))
                out["uppers"].append(int(codes[upper].sum()))
                out["points"].append(len(text))
                out["marked"].append(any(codes[m] for m in marks))
                out["digest"].append(hashlib.sha256(data).digest())
            return out

        return step

    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return add_from(plain, text_of(), make_step, "words long, kinds long, uppers long, points long, marked boolean, digest binary",
                    ["doc_id", "part"])


def rules() -> dict[str, Column]:
    """Where a measured row fails the filters that look at its text alone."""
    return {
        "A": F.col("words") < MIN_WORDS,
        "B": 100 * F.col("kinds") < DISTINCT_PERCENT * F.col("words"),
        "C": 100 * F.col("uppers") > UPPER_PERCENT * F.col("points"),
        "D": F.col("marked"),
    }


def _merged(table: DataFrame) -> DataFrame:
    """``table`` for the right side of a join that must not broadcast it."""
    return table.hint("merge")


def documents_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measured rows with a key each, written once, and their labels ``good`` and ``toxic``."""
    rows = stage(measure(docs).withColumn("row", F.monotonically_increasing_id()), "measured")
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    false = F.lit(False)
    return stage(rows.join(_merged(named), F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumns(
        {"good": F.coalesce("good", false), "toxic": F.coalesce("toxic", false)}), "documents")


def failing(rows: DataFrame) -> dict[str, DataFrame]:
    """Per filter the stored table of ``row, part, good, toxic`` of what fails it."""
    ids = ["row", "part", "good", "toxic"]
    tables = {name: rows.where(fails).select(*ids) for name, fails in rules().items()}
    # the first of each text isn't a copy: an aggregate combines the copies before they meet, and the join is by id
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    tables[COPY] = rows.where("doc_id IS NOT NULL").join(_merged(first), ["doc_id", "digest"], "left_anti").select(*ids)
    return {name: stage(table, f"failing-{name}") for name, table in sorted(tables.items())}


def prefixes(names: str = NAMES) -> list[str]:
    """All sets of filters, as strings in their own order."""
    return ["".join(c) for k in range(len(names) + 1) for c in combinations(names, k)]


def _spread(table: DataFrame, sets: list[str]) -> DataFrame:
    """Each row once for every prefix in ``sets``."""
    return table.withColumn("prefix", F.explode(F.array(*map(F.lit, sets))))


def _spread_by_filter(table: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Each row once for every prefix in the ``sets`` of its ``filter``.

    Spread before their union, the tables would each meet what is blocked in a join of their own.
    """
    own = F.create_map(*(x for n, s in sets.items() for x in (F.lit(n), F.array(*map(F.lit, s)))))
    return table.withColumn("prefix", F.explode(F.element_at(own, F.col("filter"))))


def joined(tables: dict[str, DataFrame], rows: DataFrame, names: str = NAMES) -> tuple[DataFrame, DataFrame]:
    """Counts by part and prefix: ``kept`` of survivors; and by filter, too, of what it removes or finds gone."""
    sets = prefixes(names)
    failed = _union([tables[n].withColumn("filter", F.lit(n)) for n in names])
    blocked = _spread_by_filter(failed.select("row", "filter"), {n: [s for s in sets if n in s] for n in names}).select("row", "prefix").distinct()
    anyone = failed.select("row", "part").distinct()
    clean = rows.join(_merged(anyone.select("row")), "row", "left_anti").groupBy("part").agg(F.count("*").alias("kept"))
    left = _spread(anyone, sets).join(_merged(blocked), ["row", "prefix"], "left_anti").groupBy("part", "prefix").agg(F.count("*").alias("kept"))
    kept = _spread(clean, sets).select("part", "prefix", "kept").union(left.select("part", "prefix", "kept")).groupBy("part", "prefix").agg(
        F.sum("kept").alias("kept"))
    tried = _spread_by_filter(failed, {n: [s for s in sets if n not in s] for n in names})
    by = ["part", "filter", "prefix"]
    number = lambda c: F.sum(F.col(c).cast("long"))
    removed = tried.join(_merged(blocked), ["row", "prefix"], "left_anti").groupBy(*by).agg(
        F.count("*").alias("removed"), number("good").alias("good_lost"), number("toxic").alias("toxic_lost"))
    gone = tried.join(_merged(blocked), ["row", "prefix"], "left_semi").groupBy(*by).agg(F.count("*").alias("redundant"))
    return stage(kept, "kept"), stage(removed.join(gone, by, "full"), "removed")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def orders(names: str = NAMES) -> list[tuple[str, int, str, str, str]]:
    """``filter_order, step, filter, before, after``: each step of each order, with its prefix before and after it."""
    return [("".join(p), i + 1, f, "".join(sorted(p[:i])), "".join(sorted(p[:i + 1])))
            for p in permutations(names) for i, f in enumerate(p)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part,
    order and step; it needs ``doc_id, text, lang`` and ``doc_id, quality, toxic``."""
    rows = documents_of(docs, labels)
    kept, removed = joined(failing(rows), rows)
    others = len(NAMES) - 1
    # in so many orders exactly this prefix comes before the filter
    often = F.element_at(F.array(*(F.lit(factorial(k) * factorial(others - k)) for k in range(others + 1))), F.length("prefix") + 1)
    alone = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.length("prefix") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * often).alias("shapley"))
    parts = rows.select("part").distinct()
    # the tables below have a row per part and prefix, or per part and step
    shape = "array<struct<filter_order: string, step: int, filter: string, before: string, after: string>>"
    names = ("filter_order", "step", "filter", "before", "after")
    every = json.dumps([dict(zip(names, o, strict=True)) for o in orders()])
    grid = parts.select("part", F.inline(F.from_json(F.lit(every), shape)))
    table = (
        grid.join(kept.withColumnRenamed("prefix", "after"), ["part", "after"], "left")
        .join(removed.withColumnRenamed("prefix", "before"), ["part", "filter", "before"], "left")
        .join(alone, ["part", "filter"], "left")
    )
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return table.select("part", "filter_order", "step", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts))
