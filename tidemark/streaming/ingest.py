"""Streaming ingestion into the lake, de-duplication, and lags across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.columns import col
from tidemark.operators import frames
from tidemark.plans.lake_job import LakeJob, batch_dates
from tidemark.session import cut_lineage, stage
from tidemark.sources.lake import CLEAN, LATE, RAW
from tidemark.sources.state import Watermark
from tidemark.sources.storage import folders
from tidemark.spec import PanelSpec


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, time: str | None = None,
                delay: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Files landing in a folder. A zone-free event time is cast, since watermarks need a TIMESTAMP."""
    df = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    return watermarked(df, time, delay) if time else df


def watermarked(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    df = df.withColumn(time, col(time).cast("timestamp"))
    return df.withWatermark(time, delay) if delay else df


def dedup_stream(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key within the watermark delay. Rows behind the watermark are dropped: ``ingest_stream`` keeps them."""
    return df.dropDuplicatesWithinWatermark(list(key))


def to_files(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), mode: str = "append"
             ) -> StreamingQuery:
    """Exactly-once append to Parquet, everything available now."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", path).trigger(availableNow=True).start()


def ingest_stream(source: DataFrame, job: LakeJob, checkpoint: str, key: Sequence[str], delay: timedelta = timedelta(days=1),
                  late: str = "append", then: Callable[[list], None] | None = None) -> StreamingQuery:
    """Micro-batches into the raw layer; no row is lost.

    A row is late when it is older than the watermark minus ``delay``. Late rows join their date partition
    (``late="append"``) or go to the late table (``late="side"``). Rows already in the lake, by ``key``, are dropped,
    which makes a replayed micro-batch harmless. ``then`` gets the dates written.
    """
    if late not in ("append", "side"):
        raise ValueError("late is 'append' or 'side'")
    time = job.spec.time

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = job.marks.get(job.pipeline)
        high = batch.agg(F.max(col(time))).first()[0]
        if high is None and batch.isEmpty():
            return
        # written once: the checks, the write and the dates below would each de-duplicate the batch again
        fresh = stage(batch.dropDuplicates(list(key)), "fresh")
        if mark.last_success_at is not None and late == "side":
            edge = F.lit(mark.last_success_at - delay).cast(batch.schema[time].dataType)
            tardy = fresh.where(col(time) <= edge)
            job.lake.append_late(tardy, time, batch_id, key)
            fresh = fresh.where(col(time).isNull() | (col(time) > edge))  # those without a time are rejected
        written = job.lake.write(fresh, RAW, time, "append", key)
        job.mark(CLEAN, batch_dates(fresh, time), "dirty")
        if high is not None and (mark.last_success_at is None or high > mark.last_success_at):
            last = max([d for d, _ in written] + ([mark.last_partition_date] if mark.last_partition_date else []),
                       default=None)
            job.marks.update(Watermark(job.pipeline, high.astimezone(), last, sum(n for _, n in written)))
        if then is not None:
            then([d for d, _ in written])

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_rows(job: LakeJob) -> DataFrame:
    return job.lake.read(LATE)


def lag_stream(source: DataFrame, spec: PanelSpec, target: str, lags: Sequence[int], path: str, checkpoint: str,
               buckets: int = 64) -> StreamingQuery:
    """Lags on a stream: the last max(lags) rows of every entity carry over from micro-batch to micro-batch.

    Entities are dealt into ``buckets`` by a hash. A batch reads the tails of the buckets that its entities are in, adds the lags
    with the ordinary (skew-safe) window, and writes its rows and those buckets' new tails under its own batch id, so it costs
    what it touches, and a replayed batch overwrites its own output and nothing else. A small table per batch says which batch
    wrote each bucket last.

    For entities with a late row (one that does not come after all rows before its batch) the rows written so far to their
    buckets take the tail's place, and those whose lags change are written again under the new batch id: ``lagged_rows`` reads
    the valid ones. Rows are told apart by entity, time and tiebreak; a missing time sorts first and so is late.
    """
    spark = source.sparkSession
    depth, keys, keep = max(lags), [*spec.entity, *spec.order], [*spec.entity, *spec.order, target]
    names = [f"{target}_lag_{n}" for n in lags]
    order = lambda: F.struct(*[col(c) for c in spec.order])
    bucket = F.pmod(F.xxhash64(*[col(c) for c in spec.entity]), F.lit(buckets)).cast("int") if spec.entity else F.lit(0)

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*[col(c) for c in keep], bucket.alias("bucket"))
        # one row per bucket
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        if not touched:
            return
        rows = fresh.withColumns({"_new": F.lit(True), "_old": F.lit(None).cast("array<double>")})
        place = tail_places(spark, path, batch_id)
        have = {b: place[b] for b in touched if b in place}
        if have:
            tail = read_tail(spark, path, have)
            entity = list(spec.entity) or [F.lit(0).alias("_all")]
            last = _renamed(tail.groupBy(*entity).agg(F.max(order()).alias("_last")), spec.entity)
            first = fresh.groupBy(*entity).agg(F.min(order()).alias("_first"), F.first("bucket").alias("bucket"))
            late = first.join(last, _match(spec.entity)).where(F.col("_first") <= F.col("_last")).select(*spec.entity, "bucket")
            carried = tail.withColumn("_old", F.lit(None).cast("array<double>"))
            if not late.isEmpty():
                late = cut_lineage(late)
                theirs = [r["bucket"] for r in late.select("bucket").distinct().collect()]
                marked = _renamed(late.drop("bucket"), spec.entity)
                written = lagged_rows(spark, path, spec, before=batch_id, buckets=theirs).withColumns({
                    "_old": F.array(*[col(n).cast("double") for n in names]), "bucket": bucket}).select(*[col(c) for c in keep], "bucket", "_old")
                carried = carried.join(marked, _match(spec.entity), "left_anti").unionByName(
                    written.join(marked, _match(spec.entity), "left_semi"))
            rows = rows.unionByName(carried.withColumn("_new", F.lit(False)))
        done = frames.lags([target], lags).apply(rows, spec)
        now = F.array(*[col(n).cast("double") for n in names])
        changed = F.col("_new") | (F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(now))
        done.where(changed).drop("_new", "_old").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
        frames.last_rows(rows.drop("_new", "_old"), spec, depth).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/_tail/batch={batch_id}")
        # written last: a batch that died before has no place and is done again
        now_at = [(b, n) for b, n in {**place, **dict.fromkeys(touched, batch_id)}.items()]
        spark.createDataFrame(now_at, PLACES).coalesce(1).write.mode("overwrite").parquet(f"{path}/_places/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


PLACES = "bucket int, written long"


def tail_places(spark: SparkSession, path: str, before: int) -> dict[int, int]:
    """Which batch before that one wrote each bucket's tail last: one row per bucket."""
    earlier = [b for b in _batches(spark, f"{path}/_places") if b < before]
    if not earlier:
        return {}
    return {r["bucket"]: r["written"] for r in spark.read.schema(PLACES).parquet(f"{path}/_places/batch={max(earlier)}").collect()}


def read_tail(spark: SparkSession, path: str, places: dict[int, int]) -> DataFrame:
    """The tails of the buckets, each from the folder of its batch alone."""
    folders_ = [f"{path}/_tail/batch={n}/bucket={b}" for b, n in sorted(places.items())]
    return spark.read.option("basePath", f"{path}/_tail").parquet(*folders_).drop("batch")


def lagged_rows(spark: SparkSession, path: str, spec: PanelSpec, before: int | None = None,
                buckets: Sequence[int] | None = None) -> DataFrame:
    """What ``lag_stream`` wrote (in batches ``before`` that one, of some ``buckets``): of each row its last version."""
    rows = spark.read.parquet(f"{path}/rows")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(list(buckets)))
    keys = [*spec.entity, *spec.order]
    rest = F.struct(*[col(c) for c in rows.columns if c not in (*keys, "batch", "bucket")])
    return rows.groupBy(*[col(k) for k in keys]).agg(F.max_by(rest, F.col("batch")).alias("_r")).select(*[col(k) for k in keys], "_r.*")


def _renamed(df: DataFrame, entity: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_e{i}" for i, c in enumerate(entity)})


def _match(entity: Sequence[str]) -> Column:
    """Entity columns equal to their ``_e{i}`` copies, a missing one to a missing one; always true for one series."""
    return reduce(and_, [col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(entity)], F.lit(True))


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removeprefix("batch=")) for n in folders(spark, path) if n.startswith("batch=")]
