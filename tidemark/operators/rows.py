"""Row filters, de-duplication, coercion and schema rules."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, require
from tidemark.functions.scalars import coerce_number

log = logging.getLogger(__name__)


def after_watermark(df: DataFrame, time: str, cutoff: datetime | str | None) -> DataFrame:
    """Rows strictly after the cutoff; all rows without one."""
    if cutoff is None:
        return df
    return df.where(col(time) > F.lit(cutoff).cast(df.schema[time].dataType))


def is_after(df: DataFrame, time: str, cutoff: datetime | str | None) -> Column:
    """Whether a row has a time strictly after the cutoff; any time without one."""
    if cutoff is None:
        return col(time).isNotNull()
    return F.coalesce(col(time) > F.lit(cutoff).cast(df.schema[time].dataType), F.lit(False))


def ensure_time(df: DataFrame, time: str) -> DataFrame:
    """The time column must exist; text in it becomes a timestamp, unreadable text NULL."""
    require(df, [time])
    if isinstance(df.schema[time].dataType, T.StringType):
        return df.withColumn(time, col(time).try_cast("timestamp"))
    return df


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double where present, bad text to NULL; absent columns are only reported."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        log.warning("expected columns absent: %s", absent)
    return df.withColumns({c: coerce_number(col(c)) for c in cols if c in df.columns})


def drop_all_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="all", subset=list(cols) if cols else None)


def drop_any_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    names = list(cols) if cols else df.columns
    keep = None
    for n in names:
        ok = col(n).isNotNull()
        if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(col(n))
        keep = ok if keep is None else keep & ok
    return df.where(keep)


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def dedup(df: DataFrame, time: str | None = None, partition: Sequence[Column] = (), tiebreak: Sequence[str] = ()
          ) -> DataFrame:
    """Without ``time``: drop exact duplicates. With it: rows equal in all *other* columns collapse to the earliest.

    The second form is an aggregate (the first row is the minimum of a struct), so the copies of one row are
    combined before the shuffle; a window would bring them all to one task.
    """
    if time is None:
        return df.dropDuplicates()
    moving = [time, *tiebreak]
    fixed = [c for c in df.columns if c not in moving]
    parts = [p.alias(f"_p{i}") for i, p in enumerate(partition)]
    first = (
        df.groupBy(*parts, *[col(c) for c in fixed])
        .agg(F.min(F.struct(*[col(c) for c in moving])).alias("_first"))
        .select(*[col(c) for c in fixed], *[F.col("_first")[c].alias(c) for c in moving])
    )
    return first.select(*[col(c) for c in df.columns])


def chain(df: DataFrame, *rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply validation rules or feature steps in order."""
    for rule in rules:
        df = df.transform(rule)
    return df
