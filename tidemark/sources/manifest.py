"""Run manifests: what a job wrote, kept as JSON documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("pipeline", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("partitions", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("file", T.StringType()),
    ]))),
    T.StructField("status", T.StringType()),
])


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class Manifest:
    pipeline: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: str = field(default_factory=_now)
    finished_at: str | None = None
    partitions: list[tuple[str | None, str, int, str]] = field(default_factory=list)
    status: str = "pending"

    def add(self, day: date | None, layer: str, rows: int, file: str) -> None:
        self.partitions.append((day.isoformat() if day else None, layer, int(rows), file))

    def succeed(self) -> None:
        self.status, self.finished_at = "success", _now()

    def fail(self, error: Exception | str) -> None:
        self.status, self.finished_at = f"failed: {error}", _now()

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (self.pipeline, self.run_id, self.started_at, self.finished_at, self.partitions, self.status)
        return spark.createDataFrame([row], SCHEMA)

    def save(self, spark: SparkSession, root: str) -> str:
        path = f"{root.rstrip('/')}/{self.pipeline}/{self.run_id}"
        self.frame(spark).coalesce(1).write.mode("overwrite").json(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Manifest":
        row = spark.read.schema(SCHEMA).json(path).first()
        parts = [tuple(p) for p in row["partitions"] or []]
        return Manifest(row["pipeline"], row["run_id"], row["started_at"], row["finished_at"], parts, row["status"])


def load_all(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(root)


def document(counts: DataFrame, pipeline: str, layer: str, status: str = "success") -> DataFrame:
    """Partition counts (``date, rows``; one row per date) as one JSON document."""
    entry = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit(layer).alias("layer"), F.col("rows"))
    one = counts.agg(F.array_sort(F.collect_list(entry)).alias("partitions"))
    return one.select(F.to_json(F.struct(
        F.lit(pipeline).alias("pipeline"), F.lit(status).alias("status"), F.col("partitions")
    )).alias("manifest"))
