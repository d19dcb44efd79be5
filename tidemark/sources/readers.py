"""Batch sources: files, folders of files, landed JSON pages, databases, and a registry of them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, nan_to_null
from tidemark.operators.rows import after_watermark, coerce_numeric, ensure_time
from tidemark.sources.storage import exists, files

log = logging.getLogger(__name__)


def _need(spark: SparkSession, path: str) -> None:
    if not any(ch in path for ch in "*?[{") and not exists(spark, path):
        raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, time: str | None = "date", schema: T.StructType | str | None = None,
             ordered: bool = False, **options) -> DataFrame:
    """CSV with a header; the time column becomes a timestamp, unreadable times NULL.

    Give a ``schema`` for anything large: without one Spark reads the files twice to guess it.
    ``ordered`` sorts by time, which only matters when the result is written or shown.
    """
    _need(spark, path)
    reader = spark.read.option("header", True).options(**options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = nan_to_null(df)
    if time is not None:
        df = ensure_time(df, time)
        if ordered:
            df = df.orderBy(col(time))
    return df


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    _need(spark, path)
    return nan_to_null(spark.read.options(**options).parquet(path))


def read_json_pages(spark: SparkSession, path: str, row_schema: T.StructType | str, rows_field: str | None = "data",
                    time: str = "date", start=None, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Landed API pages: one JSON object per line, its rows in an array field (or each object a row).

    ``start`` keeps rows after the watermark; ``parse`` is the hook for other page layouts.
    """
    _need(spark, path)
    row_type = T.StructType.fromDDL(row_schema) if isinstance(row_schema, str) else row_schema
    if parse is not None:
        df = parse(spark.read.text(path))
    elif rows_field:
        page = T.StructType([T.StructField(rows_field, T.ArrayType(row_type))])
        df = spark.read.schema(page).json(path).select(F.inline(col(rows_field)))
    else:
        df = spark.read.schema(row_type).json(path)
    return nan_to_null(after_watermark(ensure_time(df, time), time, start))


def read_database(spark: SparkSession, url: str, query: str | None = None, *, table: str | None = None,
                  partition_column: str | None = None, lower=None, upper=None, partitions: int | None = None,
                  **options) -> DataFrame:
    """A query through JDBC; or, for large tables, ``table`` read in ``partitions`` ranges of one column."""
    reader = spark.read.format("jdbc").options(**jdbc_options(
        url, query, table=table, partition_column=partition_column, lower=lower, upper=upper, partitions=partitions,
        **options))
    return nan_to_null(reader.load())


def jdbc_options(url: str, query: str | None = None, *, table: str | None = None, partition_column: str | None = None,
                 lower=None, upper=None, partitions: int | None = None, **options) -> dict[str, str]:
    if table is None:
        if not query:
            raise ValueError("a database source needs a query")
        return {"url": url, "query": query, **options}
    out = {"url": url, "dbtable": table, **options}
    if partition_column:
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                "numPartitions": str(partitions)}
    return out


def read_source(spark: SparkSession, source: str, *, query: str | None = None, **options) -> DataFrame:
    """By suffix: ``.csv``, ``.parquet``; anything else is a database URL and needs ``query``."""
    suffix = PurePosixPath(source.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, source, **options)
    if suffix == ".parquet":
        return read_parquet(spark, source, **options)
    return read_database(spark, source if source.startswith("jdbc:") else f"jdbc:{source}", query, **options)


def resolve_csv(spark: SparkSession, folder: str, name: str | None = None) -> str:
    """The named CSV of a folder, else the first by path (with a note when there are several)."""
    found = files(spark, folder, ".csv")
    if name is not None:
        found = [f for f in found if PurePosixPath(f).name == name]
    if not found:
        raise FileNotFoundError(f"no CSV {name or ''} in {folder}")
    if len(found) > 1:
        log.warning("several CSV files in %s, taking %s", folder, found[0])
    return found[0]


def read_csv_folder(spark: SparkSession, folder: str, name: str | None = None, every: bool = False,
                    numeric: tuple[str, ...] = (), **options) -> DataFrame:
    """One CSV of a folder or, with ``every``, all of them with a ``source_file`` column."""
    if every:
        df = read_csv(spark, folder, recursiveFileLookup="true", pathGlobFilter="*.csv", **options)
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    else:
        df = read_csv(spark, resolve_csv(spark, folder, name), **options)
    return coerce_numeric(df, numeric) if numeric else df


class SourceRegistry:
    """Name to reader: ``(spark, **options) -> DataFrame``."""

    def __init__(self):
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, reader: Callable[..., DataFrame]) -> None:
        self._readers[name] = reader

    def create(self, name: str) -> Callable[..., DataFrame]:
        if name not in self._readers:
            raise ValueError(f"unknown source {name!r}; available: {sorted(self._readers)}")
        return self._readers[name]

    def read(self, spark: SparkSession, name: str, **options) -> DataFrame:
        return self.create(name)(spark, **options)


SOURCES = SourceRegistry()
SOURCES.register("csv", read_csv)
SOURCES.register("parquet", read_parquet)
SOURCES.register("folder", read_csv_folder)
SOURCES.register("api", read_json_pages)
SOURCES.register("database", read_database)
