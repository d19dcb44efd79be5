"""File-system questions, asked through Spark's own Hadoop client so they work on any shared store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """True when the folder or file is there and not an empty folder."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return False
    return not fs.getFileStatus(target).isDirectory() or len(fs.listStatus(target)) > 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder."""
    fs, target = _fs(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def partition_dates(spark: SparkSession, path: str, prefix: str = "date=") -> list[date]:
    """Dates of the ``date=YYYY-MM-DD`` folders, sorted; other names are skipped. Reads names only, no data."""
    found = []
    for name in folders(spark, path):
        if name.startswith(prefix):
            try:
                found.append(date.fromisoformat(name[len(prefix):]))
            except ValueError:
                continue
    return sorted(found)


def files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files under a folder (recursively) with this suffix, sorted by path."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    walk, out = fs.listFiles(target, True), []
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name)
    return sorted(out)
