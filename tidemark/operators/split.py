"""Train / validation / test splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators.ordering import ONE_TASK_ROWS, running_before
from tidemark.operators.panel import Layout, micros, with_neighbours
from tidemark.session import cut_lineage
from tidemark.spec import PanelSpec

PARTS = ("train", "val", "test")


def _label(position, n, train: float, val: float):
    a = F.floor(n * F.lit(train))
    b = F.floor(n * F.lit(train + val))
    return F.when(position <= a, "train").when(position <= b, "val").otherwise("test")


def split_time(df: DataFrame, spec: PanelSpec, train: float = 0.70, val: float = 0.15, out: str = "part") -> DataFrame:
    """Split by cut times, so no part sees a time of a later part.

    The cuts are taken over the distinct times: the first ``train`` share of them, then ``val``.
    """
    first, second = time_cuts(df, spec, [train, train + val])
    t = col(spec.time)
    return df.withColumn(
        out, F.when(t < F.lit(first), "train").when(t < F.lit(second), "val").otherwise("test")
    )


def time_cuts(df: DataFrame, spec: PanelSpec, shares: Sequence[float], by_rows: bool = False, buckets: int = 4096,
              small: int = 100_000) -> list:
    """For each share the time at rank floor(n * share), over the distinct times or (``by_rows``) over all rows.

    Times are first counted per distinct value. While many are left, they are counted again in equal-width buckets
    (at most ``buckets`` + 1 rows reach the driver) and only the bucket that holds the rank is kept.
    """
    counted = df.where(col(spec.time).isNotNull()).groupBy(col(spec.time).alias("at")).agg(F.count(F.lit(1)).alias("w"))
    if not by_rows:
        counted = counted.withColumn("w", F.lit(1).cast("long"))
    counted = counted.withColumn("t", micros(counted, spec.with_(time="at")))
    low, high, rows, n = counted.agg(F.min("t"), F.max("t"), F.count(F.lit(1)), F.sum("w")).first()
    if not n:
        raise ValueError("no times to split")
    t = F.col("t")
    run = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # over at most ``small`` rows
    ranks = [min(math.floor(n * share), n - 1) for share in shares]
    if rows <= small:  # all cuts in one pass
        placed = counted.withColumn("cum", F.sum("w").over(run))
        return list(placed.agg(*[F.min(F.when(F.col("cum") > rank, F.col("at"))).alias(f"c{i}")
                                 for i, rank in enumerate(ranks)]).first())
    counted = cut_lineage(counted)
    cuts = []
    for rank in ranks:
        lo, hi, inside = math.floor(low), high, rows
        while inside > small:
            width = max(math.ceil((hi - lo) / buckets), 1)
            found = counted.where((t >= lo) & (t <= hi)).groupBy(F.floor((t - lo) / width).alias("s")).agg(
                F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")).collect()
            for s, w, c in sorted(tuple(r) for r in found):
                if rank < w:
                    lo, hi, inside = lo + s * width, min(hi, lo + (s + 1) * width), c
                    break
                rank -= w  # rows before the bucket are behind us
            if width <= 1:
                break
        left = counted.where((t >= lo) & (t <= hi)).withColumn("cum", F.sum("w").over(run))
        cuts.append(left.where(F.col("cum") > rank).agg(F.min("at")).first()[0])
    return cuts


def split_positional(df: DataFrame, spec: PanelSpec, train: float = 0.70, val: float = 0.15, out: str = "part",
                     layout: Layout | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Compatibility split: rows by (entity, time), cut at floor(n * share). This slices by entity.

    A row's position is its position in the entity plus the rows of all entities before it; the latter comes
    from a table with one row per entity.
    """
    if len(spec.entity) != 1:
        raise ValueError("a positional split needs one entity column")
    entity = spec.entity[0]
    sizes = df.groupBy(col(entity)).agg(F.count(F.lit(1)).alias("_size"))
    offsets = running_before(sizes, [entity], "_size", "_offset", one_task_rows=one_task_rows).drop("_size")
    placed = with_neighbours(df, spec, [], layout).join(offsets, entity)
    total = sizes.agg(F.sum("_size").alias("n")).select("n").scalar()
    position = F.col("_pos") + F.col("_offset")
    return placed.withColumn(out, _label(position, total, train, val)).drop("_pos", "_offset")
