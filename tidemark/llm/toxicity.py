"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

The models predict a letter from the three before it. Counts of four-letter sequences are kept per class, toxic and
ordinary; both classes back off to one shared distribution, made of continuation counts (in how many different contexts a
sequence was seen). Letters instead of words let forms that never occurred be judged by their stems. With absolute
discount D, P(w | h) = max(c(hw) - D, 0) / c(h) + D * types(h) / c(h) * P_shared(w | h'), so where a class has not seen hw the
two models differ by their weight of the shared distribution only. What a text is scored with is therefore one number for
each sequence and one for each context: the difference of the log-likelihoods, whose sum over a text is divided by the
square root of its length. A logistic curve, fitted on all learning rows that the counting left out, turns it into a score.

Sequences are counted by Spark over all learning rows and only their aggregate moves. Up to ``BROADCAST_GRAMS`` of them the
tables are broadcast; beyond, the sequences of each text are counted and joined to the tables.

Null and empty texts, and those without a letter, score what a difference of zero gives. Rows that repeat are scored alike.
Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, text_of
from tidemark.session import stage

ORDER = 4
BROADCAST_GRAMS = 4_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_STEP = np.uint64(1_099_511_628_211)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased words, with one space around each."""
    plain = " " + " ".join(_WORD.findall(text.lower())) + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all sequences of ``n`` code points."""
    count = len(codes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * _STEP + codes[i:i + count] + np.uint64(1)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def counts(rows: DataFrame) -> DataFrame:
    """``gram, context, lower, shorter, fit_0, fit_1, all_0, all_1`` from ``text, toxic, spare``.

    ``context`` is the gram without its last letter, ``lower`` without its first, ``shorter`` without both. ``fit`` counts
    rows that are not ``spare``.
    """

    def make_step():
        def step(texts) -> dict:
            out = []
            for text in texts.to_pylist():
                codes = letters(text)
                key, first, number = np.unique(grams(codes, ORDER), return_index=True, return_counts=True)
                near, short = grams(codes, ORDER - 1), grams(codes, ORDER - 2)
                parts = (key, near[first], near[first + 1], short[first + 1]) if len(key) else (key,) * 4
                out.append((*(p.astype(np.int64) for p in parts), number.astype(np.int64)))
            ends = pa.array(np.cumsum([0, *(len(o[0]) for o in out)], dtype=np.int32))
            flat = [pa.array(np.concatenate([o[i] for o in out])) for i in range(5)]
            return {"grams": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["g", "c", "l", "s", "n"]))}

        return step

    kind = "grams array<struct<g: long, c: long, l: long, s: long, n: long>>"
    seen = add_from(rows, text_of(), make_step, kind, ["toxic", "spare"]).select("toxic", "spare", F.explode("grams").alias("_g"))
    n = F.col("_g.n")
    total = lambda when: F.sum(F.when(when, n).otherwise(0))
    return seen.groupBy(F.col("_g.g").alias("gram")).agg(
        F.first("_g.c").alias("context"), F.first("_g.l").alias("lower"), F.first("_g.s").alias("shorter"),
        *(total((F.col("toxic") == k) & (~F.col("spare") if part == "fit" else F.lit(True))).alias(f"{part}_{k}")
          for part in ("fit", "all") for k in (0, 1)))


def model(counted: DataFrame, part: str) -> DataFrame:
    """``gram, llr``: the difference of log-probabilities of each sequence seen and, under the key of a context, of the rest."""
    seen = counted.where(F.col(f"{part}_0") + F.col(f"{part}_1") > 0)
    a, b = F.col(f"{part}_0"), F.col(f"{part}_1")
    once = seen.agg(*(F.sum((c == i).cast("long")).alias(f"n{i}{k}") for k, c in ((0, a), (1, b)) for i in (1, 2)),
                    F.sum(a).alias("s0"), F.sum(b).alias("s1")).first()
    d = [once[f"n1{k}"] / max(1, once[f"n1{k}"] + 2 * once[f"n2{k}"]) if once[f"n1{k}"] else 0.5 for k in (0, 1)]
    # continuation counts of the shared distribution: contexts before a lower sequence, and their sum per shorter one
    lower = seen.groupBy("lower").agg(F.first("shorter").alias("shorter"), F.count("*").alias("types"))
    shorter = lower.groupBy("shorter").agg(F.sum("types").alias("all_types"))
    shared = lower.join(shorter, "shorter").select("lower", (F.col("types") / F.col("all_types")).alias("shared"))
    context = seen.groupBy("context").agg(
        *(F.sum(c).alias(f"c{k}") for k, c in ((0, a), (1, b))),
        *(F.sum((c > 0).cast("long")).alias(f"t{k}") for k, c in ((0, a), (1, b))))
    weight = lambda k: F.when(F.col(f"c{k}") > 0, d[k] * F.col(f"t{k}") / F.col(f"c{k}")).otherwise(1.0)
    context = context.select("context", "c0", "c1", weight(0).alias("w0"), weight(1).alias("w1"))
    p = lambda k, c: (F.when(F.col(f"c{k}") > 0, F.greatest(c - d[k], F.lit(0.0)) / F.col(f"c{k}")).otherwise(0.0)
                      + F.col(f"w{k}") * F.col("shared"))
    whole = seen.join(context, "context").join(shared, "lower").select("gram", (F.log(p(1, b)) - F.log(p(0, a))).alias("llr"))
    rest = context.select(F.col("context").alias("gram"), (F.log("w1") - F.log("w0")).alias("llr"))
    return whole.union(rest)


@dataclass
class Table:
    """Sorted keys and their differences."""

    keys: np.ndarray
    llr: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame) -> Table:
        """The rows on the driver, as two arrays; their number was checked."""
        got = rows.toArrow()
        keys, llr = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy().astype(np.float32)
        order = np.argsort(keys)
        return cls(keys[order], llr[order])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.llr[at], self.keys[at] == wanted

    def evidence(self, text: str) -> float:
        """The sum of differences over the square root of the number of sequences."""
        codes = letters(text)
        g = grams(codes, ORDER)
        if not len(g) or not len(self.keys):
            return 0.0
        value, known = self.find(g)
        value = np.where(known, value, 0)
        if not known.all():
            back, seen = self.find(grams(codes, ORDER - 1)[:-1][~known])
            value[~known] = np.where(seen, back, 0)
        return float(value.sum(dtype=np.float64) / np.sqrt(len(g)))


def broadcast_evidence(docs: DataFrame, llr: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``evidence``, from a table that every task holds."""
    table = Table.of(llr)
    box = docs.sparkSession.sparkContext.broadcast((table.keys, table.llr))

    def make_step():
        own = Table(*box.value)
        return lambda texts: {"evidence": [own.evidence(t) for t in texts.to_pylist()]}

    return add_from(docs, text_of(), make_step, "evidence double", keep)


def joined_evidence(docs: DataFrame, llr: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The same by a join: sequences are counted within each text before they are shuffled."""
    table = stage(llr, "llr")

    def make_step():
        def step(texts) -> dict:
            pairs, total = [], []
            for text in texts.to_pylist():
                codes = letters(text)
                g = grams(codes, ORDER)
                both = np.stack([g, grams(codes, ORDER - 1)[:len(g)]], axis=1) if len(g) else np.zeros((0, 2), np.uint64)
                each, number = np.unique(both, axis=0, return_counts=True)
                pairs.append([(int(a), int(b), int(n)) for (a, b), n in zip(each.astype(np.int64), number, strict=True)])
                total.append(len(g))
            return {"_grams": pairs, "_total": total}

        return step

    rows = stage(docs.withColumn("_row", F.expr("uuid()")), "rows")
    each = add_from(rows, text_of(), make_step, "_grams array<struct<g: long, c: long, n: long>>, _total long",
                    ["_row"]).select("_row", "_total", F.explode("_grams").alias("_p"))
    back = table.select(F.col("gram").alias("_context"), F.col("llr").alias("_back"))
    summed = (
        each.join(table, F.col("_p.g") == F.col("gram"), "left").join(back, F.col("_p.c") == F.col("_context"), "left")
        .groupBy("_row").agg((F.sum(F.col("_p.n") * F.coalesce("llr", "_back", F.lit(0.0))) / F.sqrt(F.first("_total"))).alias("evidence"))
    )
    kept = rows.select("_row", *(docs.columns if keep is None else keep))
    return kept.join(summed, "_row", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0))).drop("_row")


def logistic(rows: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak ridge, over all rows of ``toxic, evidence``; a round is one sum over them."""
    facts = rows.agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"), F.stddev_pop("evidence").alias("scale")).first()
    if facts["lo"] == facts["hi"]:
        return 0.0, 0.0
    scale = facts["scale"] or 1.0
    w, z = np.zeros(2), F.col("evidence") / scale
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(w[0]) + float(w[1])))))
        sums = rows.select(z.alias("z"), (p - F.col("toxic")).alias("e"), (p * (1 - p)).alias("v")).agg(
            *(F.sum(F.expr(c)) for c in ("z * e", "e", "v * z * z", "v * z", "v"))).first()
        grad = np.array(sums[:2]) + 0.05 * w
        step = np.clip(np.linalg.solve(np.array([sums[2:4], sums[3:5]]) + 0.05 * np.eye(2), grad), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def evidence(docs: DataFrame, llr: DataFrame, limit: int = BROADCAST_GRAMS, keep: list[str] | None = None) -> DataFrame:
    return (broadcast_evidence if llr.count() <= limit else joined_evidence)(docs, llr, keep)


def score(docs: DataFrame, learn: DataFrame, limit: int = BROADCAST_GRAMS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``score`` and ``predicted``, learnt from ``learn`` (``text, toxic, spare``; labels 0 and 1).

    Rows marked ``spare`` set the logistic curve against models that have not counted them; the final models count all.
    """
    learn = learn.where("toxic IN (0, 1)")
    counted = stage(counts(learn), "counts")
    tried, final = stage(model(counted, "fit"), "trial"), stage(model(counted, "all"), "model")
    slope, offset = logistic(stage(evidence(learn.where("spare"), tried, limit, ["toxic"]), "spare"))
    z = slope * F.col("evidence") + offset
    return (
        evidence(docs, final, limit, keep).withColumn("score", 1 / (1 + F.exp(-z)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def learning_rows(docs: DataFrame, labels: DataFrame, fold: Column) -> DataFrame:
    """``text, toxic, spare`` of the labelled documents whose ``fold`` isn't 0; fold 1 is spare.

    Labels grow with the documents, so the join is by a shuffle at every size: texts move once, about their own size.
    """
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_toxic IN (0, 1)").distinct()
    return docs.where(fold != 0).join(named.hint("merge"), F.col("doc_id") == F.col("_id")).select(
        "text", F.col("_toxic").cast("int").alias("toxic"), (fold == 1).alias("spare"))
