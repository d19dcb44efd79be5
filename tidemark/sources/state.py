"""The watermark table: one current row per pipeline, kept as an append-only Parquet table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.sources.storage import exists

SCHEMA = T.StructType([
    T.StructField("pipeline_name", T.StringType(), False),
    T.StructField("last_success_at", T.TimestampType()),
    T.StructField("last_partition_date", T.DateType()),
    T.StructField("rows_ingested", T.LongType()),
    T.StructField("updated_at", T.TimestampType(), False),
])


@dataclass(frozen=True)
class Watermark:
    pipeline_name: str
    last_success_at: datetime | None = None
    last_partition_date: date | None = None
    rows_ingested: int = 0


def advance(batch: DataFrame, time: str) -> DataFrame:
    """One row for the next mark: latest event time, latest date, rows of the batch."""
    return batch.agg(
        F.max(col(time)).alias("last_success_at"),
        F.to_date(F.max(col(time))).alias("last_partition_date"),
        F.count(F.lit(1)).alias("rows_ingested"),
    )


class WatermarkTable:
    """Updates append a row; reading takes the newest per pipeline, so nothing is ever rewritten in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def current(self) -> DataFrame:
        fields = [f.name for f in SCHEMA if f.name != "pipeline_name"]
        return self._log().groupBy("pipeline_name").agg(
            F.max_by(F.struct(*fields), "updated_at").alias("s")
        ).select("pipeline_name", "s.*")

    def get(self, pipeline: str) -> Watermark:
        row = self.current().where(F.col("pipeline_name") == pipeline).first()
        if row is None:
            return Watermark(pipeline)
        return Watermark(pipeline, row["last_success_at"], row["last_partition_date"], row["rows_ingested"])

    def update(self, mark: Watermark) -> None:
        now = datetime.now(timezone.utc)
        row = (mark.pipeline_name, mark.last_success_at, mark.last_partition_date, mark.rows_ingested, now)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
