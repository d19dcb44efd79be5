"""Quality rules with thresholds that adapt to language and source.

Fixed rules judge what a single text shows (too few words, repeated passages). The other measures have no fixed cutoff:
quantile sketches per language and source give their quartiles, and a text is rejected beyond ``FENCE`` interquartile ranges
of them. Two things widen a fence, both read from the sketches. A share over few words varies more, by the root of their
number, so a text shorter than the median of its group has a fence that much wider. And where most texts have the same value,
as of symbols and repeated lines, quartiles say nothing: ``PASS`` of the documents of the language pass by such a measure.

A sketch counts documents in logarithmic buckets (0.25 % relative error), so sketches merge by adding counts: the sketches of a
language, and of the whole table, are sums of those of its sources, and serve sources of few documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import SEPARATORS, add_from, small, text_of
from tidemark.llm.minhash import _WordHashes, mix
from tidemark.session import stage

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Measures per word, each with the share of a language's documents that its upper fence spares at least (none: quartiles only).
PASS = {"mean_word": 0.0, "symbols": 0.9, "dup_lines": 0.995}
LENGTH = "n_words"
FENCE = 3.0
#: Fewer documents than this borrow the sketch of the language, then of the table.
MIN_DOCS = 50
GAMMA = 1.005
ZERO = -1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of five that occur twice or more, the first occurrence included."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h += mix(hashes[i:i + n] + _ODD[i]) * _ODD[i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not same.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            count += line in seen
            seen.add(line)
    return count


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts of each whole text (null: empty) and ``base_failed``."""

    def make_step():
        hashes = _WordHashes()

        def step(texts) -> dict:
            out = {c: [] for c in COUNTS}
            for text in texts.to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                out["n_words"].append(len(words))
                out["word_chars"].append(len(text) - sum(map(text.count, SEPARATORS)))
                out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
                out["n_dup_lines"].append(repeated_lines(text))
                out["n_repeat_words"].append(repeated_words(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
            return out

        return step

    return add_from(docs, text_of(), make_step, ", ".join(f"{c} long" for c in COUNTS), keep).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The measures per word by name."""
    top = {"mean_word": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines"}
    return {name: F.col(c) / F.col("n_words") for name, c in top.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """Documents per language, source, measure and bucket, of those that pass the fixed rules; also of their lengths."""
    x = F.col("_r")["x"]
    bucket = F.when(x <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(x) / math.log(GAMMA)))
    values = {**rates(), LENGTH: F.col("n_words").cast("double")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), r.alias("x")) for n, r in values.items())))
    return (
        measured.where(~F.col("base_failed")).select("lang", "source", each.alias("_r"))
        .groupBy("lang", "source", F.col("_r")["measure"].alias("measure"), bucket.cast("long").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: documents ``n`` and the struct ``at`` with the quartiles and the spared value (``top``) of each measure, and
    the median length."""
    # at most some thousand buckets a group
    w = Window.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.select(*keys, "measure", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"),
                           F.sum("n").over(w).alias("n"))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(
        2 * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / (1 + GAMMA))
    # a bucket ends at its largest value, which the spared share takes in
    end = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * (1 + 1e-12))
    at = lambda q, v=value: F.min(F.when(F.col("upto") >= q * F.col("n"), v))
    spared = F.create_map(*(F.lit(v) for kv in {**PASS, LENGTH: 0.0}.items() for v in kv))[F.col("measure")]
    each = ranked.withColumn("_pass", spared).groupBy(*keys, "measure").agg(
        F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), at(F.col("_pass"), end).alias("top"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return each.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.struct(*(pick(m, c).alias(f"{m}_{c}") for m in PASS for c in ("q1", "q3", "top")), pick(LENGTH, "q2").alias("length")).alias("at"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """What judges every language and source: its own quantiles, or those of the language or the table if it has few documents,
    and the wide ones of the language, or of the table."""
    own = quantiles(sketch, "lang", "source")
    lang = quantiles(sketch, "lang").select(F.col("lang").alias("_l"), F.col("n").alias("_ln"), F.col("at").alias("_la"))
    all_ = quantiles(sketch.withColumn("_all", F.lit(1)), "_all").select("_all", F.col("at").alias("_aa"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).withColumn("_all", F.lit(1)).join(all_, "_all")
    wide = F.when(F.col("_ln") >= MIN_DOCS, F.col("_la")).otherwise(F.col("_aa"))
    return joined.select(F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source"),
                         F.when(F.col("n") >= MIN_DOCS, F.col("at")).otherwise(wide).alias("_t_own"), wide.alias("_t_wide"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: it passes the fixed rules and lies within the fences of its language and source."""
    inside = F.lit(True)
    short = F.sqrt(F.greatest(F.lit(1.0), F.col("_t_own.length") / F.col("n_words")))
    for name, rate in rates().items():
        q1, q3 = F.col(f"_t_own.{name}_q1"), F.col(f"_t_own.{name}_q3")
        width = FENCE * (q3 - q1) * short
        inside &= rate.between(q1 - width, F.greatest(q3 + width, F.col(f"_t_wide.{name}_top")))
    same = F.col("lang").eqNullSafe(F.col("_t_lang")) & F.col("source").eqNullSafe(F.col("_t_source"))
    return (
        measured.join(small(limits), same, "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.when(~F.col("base_failed"), inside), F.lit(False)))
        .drop("_t_lang", "_t_source", "_t_own", "_t_wide")
    )


def assess(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; it needs ``lang, source, text``.

    ``keep`` names the columns to carry along, ``lang`` and ``source`` among them (all if it isn't given).

    Empty and null texts have no words and fail; rows repeated are judged alike; an empty table gives an empty result.
    """
    measured = stage(measure(docs, keep), "quality")
    limits = stage(thresholds(sketches(measured)), "fences")
    return judge(measured, limits)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    clash = [c for c in docs.columns if c in (*COUNTS, "base_failed", "kept")]
    aside = docs.withColumnsRenamed({c: f"own_{c}" for c in clash})
    return assess(aside).where("kept").select(*(F.col(f"own_{c}" if c in clash else c).alias(c) for c in docs.columns))
