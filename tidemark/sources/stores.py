"""Append-only stores: reference snapshots, prediction logs, dataset and drift records, CSV export."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.sources.storage import exists


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


class ReferenceStore:
    """Snapshots of the drift baseline; the latest one counts."""

    META = "snapshot string, n_rows long, n_cols long, columns array<string>, extra map<string,string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.data, self.meta = spark, f"{root.rstrip('/')}/snapshots", f"{root.rstrip('/')}/metadata"

    def save(self, df: DataFrame, extra: dict[str, str] | None = None) -> str:
        name = stamp()
        path = f"{self.data}/snapshot={name}"
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.parquet(path)
        row = (name, saved.count(), len(saved.columns), saved.columns, extra or {})
        self.spark.createDataFrame([row], self.META).coalesce(1).write.mode("append").parquet(self.meta)
        return name

    def metadata(self) -> DataFrame | None:
        return self.spark.read.schema(self.META).parquet(self.meta) if exists(self.spark, self.meta) else None

    def latest(self) -> str | None:
        meta = self.metadata()
        return None if meta is None else meta.agg(F.max("snapshot")).first()[0]

    def load(self) -> DataFrame | None:
        """The latest snapshot, or None before the first one."""
        name = self.latest()
        return None if name is None else self.spark.read.parquet(f"{self.data}/snapshot={name}")


class PredictionLog:
    """Long-form predictions; each write adds files, none replaces another."""

    COLUMNS = ("timestamp", "model", "location", "target", "y_true", "y_pred", "absolute_error", "squared_error",
               "inference_time_ms", "metadata")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        empty = F.lit(None).cast("map<string,string>")
        have = set(rows.columns)
        rows = rows if "metadata" in have else rows.withColumn("metadata", empty)
        rows.select(*[col(c) for c in self.COLUMNS]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else None


class DatasetRegistry:
    """Lineage of saved datasets: where, how large, which schema, which role."""

    SCHEMA = ("name string, context string, path string, n_rows long, n_cols long, schema string, "
              "tags map<string,string>, logged_at string")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.table = spark, root.rstrip("/"), f"{root.rstrip('/')}/registry"

    def log(self, df: DataFrame, name: str, context: str, tags: dict[str, str] | None = None) -> str:
        """``context`` is the role: features, reference, production."""
        when = stamp()
        path = f"{self.root}/data/{name}/{context}/{when}"
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.parquet(path)
        row = (name, context, path, saved.count(), len(saved.columns), saved.schema.json(), tags or {}, when)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.table)
        return path

    def entries(self) -> DataFrame:
        if not exists(self.spark, self.table):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.table)

    @staticmethod
    def columns(entry_schema: str) -> list[str]:
        return [f["name"] for f in json.loads(entry_schema)["fields"]]


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a history table (drift verdicts, per-column results, metrics)."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; one file per task, so a large table stays distributed."""
    df.write.mode("overwrite").option("header", True).csv(path)
