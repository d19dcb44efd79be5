"""The date-partitioned lake: ``raw`` is append-only, ``clean`` and ``features`` can be rebuilt.

Which files a layer has, with their rows and columns, says its file table (``filelog``): a read of some dates opens their
files and nothing else, and a write knows what it wrote without looking at what was there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.sources.filelog import FileLog
from tidemark.sources.storage import exists, files

RAW, CLEAN, FEATURES = "raw", "clean", "features"
LATE = "late_rows"
REJECTED = "rejected_rows"
DATE = "date"
POLICIES = ("append", "skip", "side")


def with_date(df: DataFrame, time: str) -> DataFrame:
    """Add the partition column; an event-time column already called ``date`` is renamed first."""
    if time == DATE:
        df, time = df.withColumnRenamed(DATE, "event_time"), "event_time"
    return df.withColumn(DATE, F.to_date(col(time)))


def date_counts(df: DataFrame) -> DataFrame:
    """Rows per partition date."""
    return df.groupBy(DATE).agg(F.count(F.lit(1)).alias("rows"))


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str) -> str:
        return f"{self.root}/{layer}"

    # reading

    def log(self, layer: str) -> FileLog:
        return FileLog(self.spark, self.root, layer)

    def dates(self, layer: str) -> list[date]:
        """Dates that have rows, sorted, from the layer's file table alone."""
        return self.log(layer).dates()

    def date_table(self, layer: str) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in self.dates(layer)], "date date")

    def counts(self, layer: str) -> DataFrame:
        """Rows per date, from the layer's file table alone."""
        return self.log(layer).counts()

    def read(self, layer: str) -> DataFrame:
        """The whole layer, with the columns of all its partitions; a partition without one of them holds nulls."""
        if layer == REJECTED:
            return self._rejected()
        if not exists(self.spark, self.log(layer).table):
            raise FileNotFoundError(f"layer {layer} is empty: {self.path(layer)}")
        return self.log(layer).read()

    def _rejected(self) -> DataFrame:
        if not exists(self.spark, self.path(REJECTED)):
            raise FileNotFoundError(f"no rejected rows: {self.path(REJECTED)}")
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(REJECTED))

    def read_date(self, layer: str, day: date | str) -> DataFrame:
        day = date.fromisoformat(str(day))
        if day not in set(self.dates(layer)):
            raise FileNotFoundError(f"no {layer} partition for {day}")
        return self.log(layer).read([day])

    def read_range(self, layer: str, start: date | str, end: date | str) -> DataFrame:
        """Dates from start to end inclusive; missing dates are skipped, none at all is an error."""
        start, end = date.fromisoformat(str(start)), date.fromisoformat(str(end))
        days = [d for d in self.dates(layer) if start <= d <= end]
        if not days:
            raise FileNotFoundError(f"no {layer} partitions between {start} and {end}")
        return self.log(layer).read(days)

    def read_dates(self, layer: str, days: Sequence[date | str]) -> DataFrame:
        wanted = [date.fromisoformat(str(d)) for d in days]
        have = set(self.dates(layer))
        found = [d for d in wanted if d in have]
        if not found:
            raise FileNotFoundError(f"none of the {len(wanted)} dates exist in {layer}")
        return self.log(layer).read(found)

    def pending(self, source: str, target: str) -> list[date]:
        """Dates of ``source`` that ``target`` does not have yet."""
        done = set(self.dates(target))
        return [d for d in self.dates(source) if d not in done]

    def before(self, layer: str, first: date, k: int) -> list[date]:
        """The last k existing dates before ``first``."""
        return [d for d in self.dates(layer) if d < first][-k:]

    # writing

    def unknown(self, df: DataFrame, layer: str, key: Sequence[str] = ()) -> DataFrame:
        """The rows of ``df`` that ``layer`` does not hold on their date: by ``key``, or else by all columns.

        Without a key a row is known if a stored one equals it in every column; a column that no stored row has must be
        missing in it. Maps can't be compared and do not count.
        """
        have = set(self.dates(layer)) if DATE in df.columns else set()
        # one row per date
        old = [r[DATE] for r in df.select(DATE).distinct().collect() if r[DATE] in have] if have else []
        return self._not_in(df, self.log(layer).read(old), key) if old else df

    def _not_in(self, df: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
        names = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
        if key:
            names = [n for n in names if n == DATE or n in key]
        held = [n for n in names if n in stored.columns]
        right = stored.select(*[col(n).alias(f"_k{i}") for i, n in enumerate(held)])
        same = [col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(held)]
        return df.join(right, reduce(and_, [*same, *[col(n).isNull() for n in names if n not in held]]), "left_anti")

    def write(self, df: DataFrame, layer: str, time: str, policy: str = "append", key: Sequence[str] = (),
              overwrite: bool = False, once: bool = False, note: Callable[[date | None, str, int], None] | None = None,
              replaced: Sequence[date] = ()) -> list[tuple[date, int]]:
        """Write one partition per date and return (date, rows written) of the dates touched.

        ``raw`` is immutable. Rows for a date that already exists follow ``policy``: ``append`` adds a file to
        the partition, ``side`` puts them into the ``late_rows`` table, ``skip`` leaves them out. Rows without a
        readable time go to the ``rejected_rows`` table. The counts hold only rows really written to the layer; ``note``
        gets date, table and rows of what went elsewhere. With ``key`` or ``once``, rows already there (see
        ``unknown``) are dropped, so a job that died before moving its watermark can run again. The other layers
        replace whole partitions: those with rows in ``df``, and those in ``replaced``, which may become empty.
        """
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}; choose one of {POLICIES}")
        if layer == RAW and overwrite:
            raise ValueError("the raw layer is immutable")
        dated = df if DATE in df.columns and time != DATE else with_date(df, time)
        bad, dated = dated.where(F.col(DATE).isNull()).drop(DATE), dated.where(F.col(DATE).isNotNull())
        if layer != RAW:
            return self._save(dated, layer, time, "replace", replaced)
        note = note or (lambda *_: None)
        rejected = self._reject(bad, key)
        if rejected:
            note(None, REJECTED, rejected)
        if key or once:
            dated = self.unknown(dated, RAW, key)
        have = self.dates(RAW)
        if have and policy != "append":
            old = F.col(DATE).isin(have)
            if policy == "side":
                late = self.unknown(dated.where(old), LATE, key) if key or once else dated.where(old)
                if not late.isEmpty():
                    for day, n in self._save(late, LATE, time, "append"):
                        note(day, LATE, n)
            dated = dated.where(~old)
        return self._save(dated, RAW, time, "append")

    def _reject(self, bad: DataFrame, key: Sequence[str]) -> int:
        """Append rows that have no date to the rejected ones, those already there left out; how many were added."""
        if bad.isEmpty():
            return 0
        path = self.path(REJECTED)
        if exists(self.spark, path):
            bad = self._not_in(bad, self.read(REJECTED), key)
        before = set(files(self.spark, path, ".parquet"))
        bad.write.mode("append").parquet(path)
        new = [f for f in files(self.spark, path, ".parquet") if f not in before]
        return self.spark.read.parquet(*new).count() if new else 0

    def append_late(self, df: DataFrame, time: str, batch: int, key: Sequence[str]) -> None:
        """Rows too late for their partition; a replayed batch adds nothing twice."""
        dated = with_date(df, time).withColumn("batch", F.lit(batch))
        if exists(self.spark, self.log(LATE).table):
            known = self.read(LATE).where(F.col("batch") == batch).select(*[col(k) for k in key])
            dated = dated.join(known, list(key), "left_anti").select(*[col(c) for c in dated.columns])
        self._save(dated, LATE, time, "append")

    def _save(self, df: DataFrame, layer: str, time: str, op: str, replaced: Sequence[date] = ()) -> list[tuple[date, int]]:
        # REBALANCE gathers a date into few files and splits a date that is too large for one task
        time = "event_time" if time == DATE else time
        laid = df.hint("rebalance", DATE).sortWithinPartitions(DATE, col(time))
        return self.log(layer).write(laid, op, replaced)[1]

    def snapshot(self, layer: str, path: str) -> DataFrame:
        """All partitions as one unpartitioned copy."""
        self.read(layer).hint("rebalance").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

