"""Null profiles, validation gates, quality and stability tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, numeric_columns
from tidemark.functions.scalars import is_infinite

WARN_NULL_PCT = 5.0
BLOCK_NULL_PCT = 10.0
MIN_NEW_ROWS = 100


def _missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _rows(one: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One aggregated row into several: each entry is a tuple of expressions."""
    structs = [F.struct(*[e.alias(n) for e, n in zip(entry, names)]) for entry in entries]
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, n_rows, n_null, null_pct`` in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_missing(df, c)).alias(f"_{i}") for i, c in enumerate(cols)]
    )
    n = F.col("n")
    return _rows(
        one,
        [(F.lit(c), n, F.col(f"_{i}"), F.when(n > 0, F.col(f"_{i}") / n * 100)) for i, c in enumerate(cols)],
        ["column", "n_rows", "n_null", "null_pct"],
    )


def validation_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: ``n_rows, n_cols, null_pct`` (mean over all cells), ``n_inf``, ``level`` (ok, warn, block)."""
    cols = list(cols or df.columns)
    missing = sum((_missing(df, c).cast("long") for c in cols), F.lit(0))
    numbers = [c for c in numeric_columns(df) if c in cols]
    infinite = sum(
        (F.coalesce(is_infinite(col(c).cast("double")).cast("long"), F.lit(0)) for c in numbers), F.lit(0)
    )
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(cols)).cast("long").alias("n_cols"),
        F.sum(missing).alias("_miss"),
        F.coalesce(F.sum(infinite), F.lit(0)).alias("n_inf"),
    )
    pct = F.coalesce(F.try_divide(F.col("_miss"), F.col("n_rows") * F.col("n_cols")) * 100, F.lit(0.0))
    level = (
        F.when(F.col("null_pct") > BLOCK_NULL_PCT, "block")
        .when((F.col("null_pct") > WARN_NULL_PCT) | (F.col("n_inf") > 0), "warn")
        .otherwise("ok")
    )
    return one.withColumn("null_pct", pct).withColumn("level", level).drop("_miss")


def readiness(features: DataFrame, date: str, last_date, min_new_rows: int = MIN_NEW_ROWS,
              block_null_pct: float = BLOCK_NULL_PCT, cols: Sequence[str] | None = None) -> DataFrame:
    """One row deciding whether there is enough new, clean data to train on.

    ``last_date`` is the last partition trained on; None means a first run.
    """
    cols = [c for c in (cols or features.columns) if c != date]
    first = last_date is None
    newer = F.lit(True) if first else col(date) > F.lit(last_date)
    missing = sum((_missing(features, c).cast("long") for c in cols), F.lit(0))
    # dates are few, so aggregate per date first: exact distinct counts come free
    per_day = features.groupBy(col(date).alias("d"), newer.alias("_new")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(missing).alias("m")
    )
    one = per_day.agg(
        F.count("d").alias("n_partitions"),
        F.count_if("_new").alias("n_new_partitions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total_rows"),
        F.coalesce(F.sum(F.when(F.col("_new"), F.col("n"))), F.lit(0)).alias("n_new_rows"),
        F.coalesce(F.try_divide(F.sum("m"), F.sum("n") * len(cols)) * 100, F.lit(0.0)).alias("null_pct"),
        F.min("d").alias("first_date"),
        F.max("d").alias("last_date"),
    )
    enough = (F.col("n_new_rows") >= min_new_rows) | F.lit(first)
    ready = (F.col("n_total_rows") > 0) & enough & (F.col("null_pct") <= block_null_pct)
    reason = (
        F.when(F.col("n_total_rows") == 0, "no_feature_partitions")
        .when(F.col("null_pct") > block_null_pct, "too_many_nulls")
        .when(~enough, "too_few_new_rows")
        .otherwise("ready")
    )
    return one.select(
        ready.alias("ready"), reason.alias("reason"), "n_partitions", "n_new_partitions", "n_total_rows", "n_new_rows",
        "null_pct", F.lit(first).alias("is_first_run"), "first_date", "last_date",
    )


def _result(one: DataFrame, tests: list[tuple[str, str, Column, float, Column]]) -> DataFrame:
    entries = [
        (F.lit(t), F.lit(c), v.cast("double"), F.lit(float(limit)), F.when(ok, "pass").otherwise("fail"))
        for t, c, v, limit, ok in tests
    ]
    return _rows(one, entries, ["test", "column", "value", "threshold", "status"])


def column_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n, n_distinct, top_n`` per column, counted per value first so a frequent value is one row."""
    text = df.select(*[col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], [col(c) for c in cols], "column", "value").where(F.col("value").isNotNull())
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top_n")
    )


def quality_tests(df: DataFrame, cols: Sequence[str] | None = None, max_null_share: float = 0.05,
                  max_duplicate_share: float = 0.0, almost_unique: float = 0.95, max_top_share: float = 0.95
                  ) -> DataFrame:
    """``test, column, value, threshold, status``: null share, constant, almost unique, most common value, duplicates.
    """
    cols = list(cols or df.columns)
    nulls = null_profile(df, cols)
    names = ["test", "column", "value", "threshold", "status"]
    share = F.coalesce(F.col("null_pct") / 100, F.lit(0.0))
    null_rows = nulls.select(
        F.lit("null_share").alias("test"), "column", share.alias("value"),
        F.lit(float(max_null_share)).alias("threshold"),
        F.when(share <= max_null_share, "pass").otherwise("fail").alias("status"),
    )
    counts = column_counts(df, cols)
    uniq, top = F.col("n_distinct") / F.col("n"), F.col("top_n") / F.col("n")
    entries = [
        ("constant", F.col("n_distinct").cast("double"), 1.0, F.col("n_distinct") > 1),
        ("almost_unique", uniq, almost_unique, uniq < almost_unique),
        ("top_value_share", top, max_top_share, top <= max_top_share),
    ]
    per_column = counts.select(
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("test"), F.col("column"), v.alias("value"), F.lit(float(limit)).alias("threshold"),
                     F.when(ok, "pass").otherwise("fail").alias("status"))
            for t, v, limit, ok in entries
        ])).alias("r")
    ).select("r.*")
    # copies of a row are combined before the shuffle
    rows = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    dup = rows.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    dup_share = F.coalesce(1 - F.try_divide("u", "n"), F.lit(0.0))
    dup_rows = _result(dup, [("duplicate_share", "*", dup_share, max_duplicate_share, dup_share <= max_duplicate_share)])
    return null_rows.unionByName(per_column).unionByName(dup_rows).select(*names)


def stability_tests(reference: DataFrame, current: DataFrame, cols: Sequence[str] | None = None,
                    max_row_ratio: float = 0.1, max_out_of_range: float = 0.0, max_shift_sigma: float = 2.0
                    ) -> DataFrame:
    """Compare two tables: row ratio, column set and types, values out of the old range, mean shift in deviations."""
    shared = [c for c in numeric_columns(reference) if c in current.columns]
    cols = list(cols or shared)
    spark = reference.sparkSession
    ref = reference.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(col(c)).alias(f"{n}_{i}") for i, c in enumerate(cols)
          for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", F.stddev_samp))],
    )
    p = ref.select(F.struct("*").alias("p")).scalar()
    cur = current.withColumn("_p", p)
    outside = [
        F.avg(F.when((col(c) < F.col(f"_p.lo_{i}")) | (col(c) > F.col(f"_p.hi_{i}")), 1.0).otherwise(0.0))
        for i, c in enumerate(cols)
    ]
    one = cur.agg(
        F.count(F.lit(1)).alias("n"),
        *[o.alias(f"out_{i}") for i, o in enumerate(outside)],
        *[F.avg(col(c)).alias(f"mu_{i}") for i, c in enumerate(cols)],
    ).withColumn("p", p)
    ratio = F.try_divide(F.col("n"), F.col("p.n"))
    tests = [("row_ratio", "*", ratio, max_row_ratio, ratio >= max_row_ratio)]
    for i, c in enumerate(cols):
        moved = F.abs(F.col(f"mu_{i}") - F.col(f"p.mu_{i}"))
        # a column without spread counts any move as endless
        shift = F.coalesce(F.try_divide(moved, F.col(f"p.sd_{i}")), F.when(moved > 0, float("inf")).otherwise(0.0))
        tests.append(("out_of_range_share", c, F.col(f"out_{i}"), max_out_of_range, F.col(f"out_{i}") <= max_out_of_range))
        tests.append(("mean_shift_sigma", c, shift, max_shift_sigma, shift <= max_shift_sigma))
    missing = float(len(set(reference.columns) ^ set(current.columns)))
    types = {f.name: f.dataType for f in current.schema}
    changed = float(sum(1 for f in reference.schema if f.name in types and types[f.name] != f.dataType))
    tests.append(("column_set_changes", "*", F.lit(missing), 0.0, F.lit(missing == 0)))
    tests.append(("column_type_changes", "*", F.lit(changed), 0.0, F.lit(changed == 0)))
    return _result(one, tests)
