"""A streamed prediction log: small micro-batches are gathered into files of a set size, each row exactly once.

A micro-batch first lands in a folder of its own id. When enough rows have landed they are sealed: written as files of the
set size, under the id of the last batch in them. A ledger has one row per step that is complete, and readers go by it alone: the
files that it calls sealed, and the landed batches after them. So whatever a crash leaves behind is either not in the
ledger, and then overwritten under the same name, or superseded, and then not read. A replayed batch that the ledger has is
not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.columns import col
from tidemark.sources.storage import exists
from tidemark.sources.stores import PredictionLog

#: A task that seals writes so many rows, or one file of more.
TASK_ROWS = 50_000
LEDGER = "step string, first long, last long, rows long, at timestamp"


class PredictionSink:
    """The log in folder ``path``; ``rows_per_file`` is the size of a sealed file."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 1_000_000, prepare: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.rows_per_file, self.prepare = spark, path.rstrip("/"), rows_per_file, prepare

    # what is there

    def ledger(self) -> DataFrame:
        path = f"{self.path}/ledger"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(path)

    def sealed(self) -> DataFrame:
        """One row per sealed set of files: its first and last batch, and rows."""
        return self.ledger().where("step = 'sealed'").select("first", "last", "rows")

    def landed(self) -> DataFrame:
        """One row per batch that is complete and in no sealed files."""
        last = self.sealed().agg(F.coalesce(F.max("last"), F.lit(-1)).alias("upto"))
        # one row
        return self.ledger().where("step = 'landed'").join(F.broadcast(last), F.col("last") > F.col("upto")).select(
            F.col("last").alias("batch"), "rows")

    def read(self) -> DataFrame | None:
        """All rows of complete batches, or None before the first one."""
        # one row per set of files, and per batch since
        folders = [f"{self.path}/files/upto={r['last']}" for r in self.sealed().where("rows > 0").collect()]
        folders += [f"{self.path}/pending/batch={r['batch']}" for r in self.landed().where("rows > 0").collect()]
        return self.spark.read.parquet(*folders) if folders else None

    # writing

    def _note(self, step: str, first: int, last: int, rows: int) -> None:
        row = self.spark.range(1).select(F.lit(step).alias("step"), F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"),
                                         F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def land(self, rows: DataFrame, batch: int) -> None:
        """Write a micro-batch under its id, unless the ledger has it."""
        if not self.ledger().where((F.col("step") == "landed") & (F.col("last") == batch)).isEmpty():
            return
        rows = self.prepare(rows) if self.prepare else rows
        have = set(rows.columns)
        rows = rows if "metadata" in have else rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        target = f"{self.path}/pending/batch={batch}"
        rows.select(*[col(c) for c in PredictionLog.COLUMNS if c in have or c == "metadata"], *[col(c) for c in rows.columns if c not in PredictionLog.COLUMNS]
                    ).write.mode("overwrite").parquet(target)
        self._note("landed", batch, batch, self.spark.read.parquet(target).count())

    def seal(self, least: int | None = None) -> int:
        """Gather the landed batches into files if they have ``least`` rows (a file's size) at least; how many rows."""
        # one row per batch since the last sealed files
        waiting = sorted((r["batch"], r["rows"]) for r in self.landed().collect())
        total = sum(n for _, n in waiting)
        if not total or total < (self.rows_per_file if least is None else least):
            return 0
        first, last = waiting[0][0], waiting[-1][0]
        rows = self.spark.read.parquet(*[f"{self.path}/pending/batch={b}" for b, n in waiting if n])
        # small files are cut by their writer: a task for each would cost more than its rows
        tasks = -(-total // (self.rows_per_file * max(1, TASK_ROWS // self.rows_per_file)))
        rows.repartition(tasks).write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).parquet(
            f"{self.path}/files/upto={last}")
        self._note("sealed", first, last, total)
        return total

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A step of a stream."""
        self.land(batch, batch_id)
        self.seal()

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Log all that the stream has now."""
        return source.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
