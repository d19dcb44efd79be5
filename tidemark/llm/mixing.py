"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is shuffled. A document's packet starts when the words of its source before it have been served and finishes
when it has been served itself, both divided by the source's target: virtual times. A second pass over a source follows the
first. The packets in order of virtual finish time are the mix; it ends at the total budget, and a packet in service at
that moment (virtual time 1) counts with the words served by then. So every source gets its target to the word.

Sources are ranked, and their documents added up, on range-sorted parts, never in one group: a source may hold any share.
Null texts have no words; documents without words take nothing; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, small
from tidemark.operators.ordering import running_before
from tidemark.session import stage

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and the shuffled place ``turn``."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))).substr(1, 16).alias("turn"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``s_source, source_size, before_source, target``: what each source may give.

    A target is a level times the weight, or ``passes`` times the source's size if that is less, with one level for all.
    The level is the largest of those found by taking the sources as capped one after another, in the order in which
    they reach their cap.
    """
    table = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1)), "sources")
    ranked = running_before(table, ["_null", "source"], "_one", "_rank")
    ranked = running_before(ranked, ["_null", "source"], "source_size", "before_source")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", passes * F.col("source_size")).withColumn(
        "_level", F.col("_cap") / F.col("_w"))
    ordered = running_before(ranked, ["_level", "_null", "source"], "_cap", "_caps")
    ordered = stage(running_before(ordered, ["_level", "_null", "source"], "_w", "_ws"), "levels")
    whole = ordered.agg(F.sum("source_size").alias("_s"), F.sum("_w").alias("_all"))
    level = ordered.join(F.broadcast(whole)).agg(
        F.max((share * F.col("_s") - F.col("_caps")) / (F.col("_all") - F.col("_ws"))).alias("_top"))
    # both are one row
    return ordered.join(F.broadcast(level)).select(
        F.col("source").alias("s_source"), "source_size", "before_source",
        F.least(F.col("_cap").cast("double"), F.col("_top") * F.col("_w")).alias("target"))


def packets(sized: DataFrame, goals: DataFrame, passes: int = PASSES) -> DataFrame:
    """A row per document and pass: words ``served`` and the virtual time ``finish``; passes that get nothing are left out,
    but for the first."""
    placed = running_before(
        sized.withColumn("_null", F.col("source").isNull().cast("int")),
        ["_null", "source", "turn", "doc_id", "size"], "size", "_before", rows=1, one_task_rows=0)
    placed = placed.join(small(goals), F.col("source").eqNullSafe(F.col("s_source")))
    again = F.explode(F.array(*(F.lit(i) for i in range(passes)))).alias("pass")
    start = F.col("_before") - F.col("before_source") + F.col("pass") * F.col("source_size")
    served = F.least(F.col("start") + F.col("size"), F.floor("target")) - F.least(F.col("start"), F.floor("target"))
    return (
        placed.select("doc_id", "source", "size", "turn", "source_size", "target", "_before", "before_source", again)
        .withColumn("start", start).withColumn("served", served.cast("long"))
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(0.0))
        .where("pass = 0 OR served > 0")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix in packets: ``doc_id, source, size, pass, served, finish, position, source_size, target``.

    ``position`` counts the words of the mix before the packet. Reruns agree: the shuffle is a hash of the doc_id.
    """
    sized = stage(sizes(docs), "sizes")
    goals = stage(targets(sized, weights, share, passes), "targets")
    queue = running_before(packets(sized, goals, passes), ["finish", "turn", "doc_id", "source", "pass"], "served", "position",
                           rows=1, one_task_rows=0)
    budget = goals.agg(F.sum(F.floor("target")).alias("budget"))
    # one row
    return queue.join(F.broadcast(budget)).withColumn(
        "served", F.greatest(F.least("served", F.col("budget") - F.col("position")), F.lit(0))).drop("budget")


def taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and its first ``position`` in the mix."""
    rows = mix(docs, weights, share, passes)
    # documents without words share their place: as many rows come back as there were first passes
    each = rows.groupBy("doc_id", "source", "_before", "size", "source_size", "target").agg(
        F.sum("served").alias("taken"), F.min("position").alias("position"),
        F.sum((F.col("pass") == 0).cast("int")).alias("_n"))
    return each.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row for each pass of which at least half is served."""
    often = mix(docs).where("served > 0 AND 2 * served >= size").groupBy("doc_id").agg(
        F.max(F.col("pass") + 1).cast("int").alias("_times"))
    often = stage(often, "mix").withColumnRenamed("doc_id", "_mixed")
    return (
        docs.join(small(often), F.col("doc_id").eqNullSafe(F.col("_mixed")))
        .withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)
    )
