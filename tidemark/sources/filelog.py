"""The files of a layer as an append-only table, so that nothing lists a layer or reads its footers to know it.

A write puts its files into a folder of its own in each partition (``date=.../commit=...``) and then adds one row per file to
the table: commit, time, operation, date, file, rows and the columns written. The rows come from a job over the new files.
Until they are there the files don't exist for any reader, so a writer that dies, or one that is still at work, shows nothing.
A date's files are those of its last ``replace`` and of every ``append`` since.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.session import stage
from tidemark.sources.storage import exists

DATE, COMMIT = "date", "commit"
SCHEMA = "commit string, at long, op string, date date, file string, rows long, columns string"
#: Numeric types that a later write may widen, narrow to wide.
WIDER = ("tinyint", "smallint", "int", "bigint")


def new_commit() -> str:
    """A name that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class FileLog:
    """The table of one layer's files."""

    def __init__(self, spark: SparkSession, root: str, layer: str):
        self.spark, self.layer = spark, f"{root}/{layer}"
        self.table = f"{root}/_files/{layer}"

    def entries(self) -> DataFrame:
        if not exists(self.spark, self.table):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.table)

    def live(self, upto: str | None = None) -> DataFrame:
        """The rows of the files that count now, or counted when commit ``upto`` had been made."""
        log = self.entries() if upto is None else self.entries().where(F.col(COMMIT) <= upto)
        last = log.where("op = 'replace'").groupBy(F.col(DATE).alias("_date")).agg(F.max(COMMIT).alias("_last"))
        newer = F.col("_last").isNull() | (F.col(COMMIT) >= F.col("_last"))
        return log.join(last, F.col(DATE) == F.col("_date"), "left").where(newer & F.col("file").isNotNull()).drop("_date", "_last")

    def dates(self, upto: str | None = None) -> list[date]:
        """Dates with rows, sorted: one row per date."""
        return sorted(r[DATE] for r in self.live(upto).where("rows > 0").select(DATE).distinct().collect())

    def counts(self) -> DataFrame:
        return self.live().groupBy(DATE).agg(F.sum("rows").alias("rows"))

    def read(self, dates: Sequence[date] | None = None, upto: str | None = None) -> DataFrame:
        """The rows of the dates (or all), from their files alone, with the columns of all files of the layer."""
        live, wanted = self.live(upto), F.lit(True) if dates is None else F.col(DATE).isin(list(dates))
        # a row per different set of columns, with the files that are read
        sets = live.groupBy("columns").agg(F.min(COMMIT).alias("c"), F.collect_list(F.when(wanted, F.col("file"))).alias("files")).collect()
        sets.sort(key=lambda r: r["c"])
        schema = merged([T.StructType.fromJson(json.loads(r["columns"])) for r in sets])
        names = sorted(f for r in sets for f in r["files"])
        schema = T.StructType([*schema, T.StructField(DATE, T.DateType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(T.StructType([*schema, T.StructField(COMMIT, T.StringType())])).option("basePath", self.layer)
        return read.parquet(*names).select(*[col(f.name) for f in schema])

    def write(self, df: DataFrame, op: str, replaced: Sequence[date] = ()) -> tuple[str, list[tuple[date, int]]]:
        """Write ``df``, which has a ``date``, and commit it: the commit, and rows by date.

        ``replaced`` are dates which a ``replace`` also empties if it has no row for them.
        """
        if op not in ("append", "replace"):
            raise ValueError("op is 'append' or 'replace'")
        commit, seen = new_commit(), Observation()
        ends = df.observe(seen, F.min(DATE).alias("lo"), F.max(DATE).alias("hi"), F.count(F.lit(1)).alias("n"))
        ends.withColumn(COMMIT, F.lit(commit)).write.mode("append").partitionBy(DATE, COMMIT).parquet(self.layer)
        own = self._rows(commit, op, df.schema, seen.get)
        gone = [(commit, 0, op, d, None, 0, None) for d in replaced] if op == "replace" else []
        # an empty date of a replaced one is a row without a file
        rows = own.unionByName(self.spark.createDataFrame(gone, SCHEMA)) if gone else own
        rows = rows.withColumn("at", F.lit(time.time_ns() // 1000))
        rows.coalesce(1).write.mode("append").parquet(self.table)
        mine = self.entries().where((F.col(COMMIT) == commit) & F.col("file").isNotNull())
        return commit, sorted((r[DATE], r["n"]) for r in mine.groupBy(DATE).agg(F.sum("rows").alias("n")).collect())

    def _rows(self, commit: str, op: str, schema: T.StructType, seen: dict) -> DataFrame:
        if not seen["n"]:
            return self.spark.createDataFrame([], SCHEMA)
        days = [seen["lo"] + timedelta(days=i) for i in range((seen["hi"] - seen["lo"]).days + 1)]
        folders = [f for f in (f"{self.layer}/{DATE}={d}/{COMMIT}={commit}" for d in days) if exists(self.spark, f)]
        columns = T.StructType([f for f in schema if f.name not in (DATE, COMMIT)])
        new = self.spark.read.schema(T.StructType([T.StructField(DATE, T.DateType())])).option("basePath", self.layer).parquet(*folders)
        return new.groupBy(DATE, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(commit).alias(COMMIT), F.lit(0).cast("long").alias("at"), F.lit(op).alias("op"), DATE, "file", "rows",
            F.lit(columns.json()).alias("columns"))

    def adopt(self) -> int:
        """Enter files that were put into the layer without a commit, as one append; how many."""
        known = self.entries().select(F.col("file").alias("_file"))
        found = self.spark.read.option("mergeSchema", "true").option("basePath", self.layer).parquet(self.layer)
        columns = T.StructType([f for f in found.schema if f.name not in (DATE, COMMIT)])
        name = F.col("_metadata.file_path").alias("file")
        rows = found.groupBy(F.col(DATE).cast("date").alias(DATE), name).agg(F.count(F.lit(1)).alias("rows")).join(
            known, F.col("file") == F.col("_file"), "left_anti")
        rows = stage(rows.select(F.lit(new_commit()).alias(COMMIT), F.lit(time.time_ns() // 1000).alias("at"), F.lit("append").alias("op"),
                                 DATE, "file", "rows", F.lit(columns.json()).alias("columns")), "adopted")
        rows.coalesce(1).write.mode("append").parquet(self.table)
        return rows.count()


def merged(schemas: Sequence[T.StructType]) -> T.StructType:
    """The columns of all, in the order in which they came; whole numbers take the widest type."""
    out: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema:
            old = out.get(f.name)
            if old is None or old.dataType == f.dataType:
                out.setdefault(f.name, T.StructField(f.name, f.dataType))
                continue
            a, b = old.dataType.simpleString(), f.dataType.simpleString()
            if a in WIDER and b in WIDER:
                out[f.name] = old if WIDER.index(a) > WIDER.index(b) else T.StructField(f.name, f.dataType)
            elif {a, b} == {"float", "double"}:
                out[f.name] = T.StructField(f.name, T.DoubleType())
            else:
                raise ValueError(f"column {f.name} is {a} in some files and {b} in others")
    return T.StructType(list(out.values()))
