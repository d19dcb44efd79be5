"""Naming and missing-value helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its literal name, also when the name holds ``.`` or ``-``."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def shared_numeric(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(numeric_columns(left)) & set(numeric_columns(right)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so NULL is the only missing value downstream."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats}) if floats else df


def keep_null(source: Column, result: Column) -> Column:
    """``greatest``/``least`` skip NULL; keep it missing instead."""
    return F.when(source.isNotNull(), result)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return keep_null(x, F.greatest(F.least(x, hi), lo))


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; have {df.columns}")


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide to long, one row per (row, column), values as double, NULLs dropped."""
    wide = df.select(*[col(i) for i in ids], *[col(c).cast("double").alias(c) for c in cols])
    if not cols:
        raise ValueError("no numeric columns to unpivot")
    long = wide.unpivot([col(i) for i in ids], [col(c) for c in cols], name, value)
    return long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
