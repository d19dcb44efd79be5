"""Drift checks as jobs: decision, history, and all reports in one table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators import drift, metrics, quality
from tidemark.sources.stores import ReferenceStore, append_table


def drift_check(reference: DataFrame, current: DataFrame, targets: Sequence[str], p_threshold: float = drift.THRESHOLD,
                share_threshold: float = drift.THRESHOLD, bins: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per shared numeric column, one verdict row). The column table is small and computed once."""
    per_column = drift.ks(drift.two_sides(reference, current), p_threshold, bins)
    spark = reference.sparkSession
    per_column = spark.createDataFrame(per_column.collect(), per_column.schema)
    return per_column, drift.verdict(per_column, targets, share_threshold)


def decide(current: DataFrame, store: ReferenceStore, targets: Sequence[str], first_run: bool = False,
           min_rows: int = drift.MIN_ROWS, history: str | None = None, **thresholds) -> DataFrame:
    """One row: retrain or not, and why.

    A first run, or a store without a baseline, saves the current table as the baseline and retrains. Too few rows
    retrain only on a first run.
    """
    spark = current.sparkSession
    schema = "should_retrain boolean, drift_detected boolean, concept_drift_detected boolean, drift_score double, " \
             "n_drifted_features long, n_total_features long, n_targets_drifted long, total_targets long, " \
             "drifted_features array<string>, reason string"

    def row(retrain: bool, reason: str) -> DataFrame:
        return spark.createDataFrame([(retrain, False, False, 0.0, 0, 0, 0, 0, [], reason)], schema)

    if current.limit(min_rows).count() < min_rows:
        return row(first_run, "insufficient_data_for_drift")
    baseline = None if first_run else store.load()
    if baseline is None:
        store.save(current, {"reason": "first_run" if first_run else "no_reference"})
        return row(True, "first_run" if first_run else "no_reference")
    per_column, verdict = drift_check(baseline, current, targets, **thresholds)
    if history:
        record_drift(spark, per_column, verdict, history, targets)
    return verdict


def record_drift(spark: SparkSession, per_column: DataFrame, verdict: DataFrame, root: str, targets: Sequence[str]) -> None:
    """Append the verdict and the per-target results to the history tables."""
    when = F.lit(datetime.now(timezone.utc))
    append_table(verdict.withColumn("checked_at", when).coalesce(1), f"{root}/drift_history")
    rows = per_column.where(F.col("column").isin(list(targets))).withColumn("checked_at", when)
    append_table(rows.coalesce(1), f"{root}/drift_targets")


def full_report(reference: DataFrame, current: DataFrame, targets: Sequence[str], y_true: str | None = None,
                y_pred: str | None = None, bins: int | None = None) -> DataFrame:
    """Data drift, target drift, quality, stability and (with predictions) performance as one long table.

    Columns: report, check, column, value, status.
    """
    per_column, verdict = drift_check(reference, current, targets, bins=bins)

    def rows(df: DataFrame, report: str, check: Column, column: Column, value: Column, status: Column) -> DataFrame:
        return df.select(F.lit(report).alias("report"), check.alias("check"), column.alias("column"),
                         value.cast("double").alias("value"), status.alias("status"))

    flag = F.when(F.col("drift_detected"), "drift").otherwise("ok")
    is_target = F.col("column").isin(list(targets))
    out = rows(per_column, "data_drift", F.lit("ks"), F.col("column"), F.col("p_value"), flag)
    out = out.unionByName(
        rows(per_column.where(is_target), "target_drift", F.lit("ks"), F.col("column"), F.col("p_value"), flag))
    shared = [c for c in per_column.select("column").toPandas()["column"]]
    area = drift.wasserstein(drift.two_sides(reference, current, shared), bins=bins)
    out = out.unionByName(rows(area, "data_drift", F.lit("wasserstein"), F.col("column"), F.col("normed"), flag))
    test, column, value, status = (F.col(c) for c in ("test", "column", "value", "status"))
    out = out.unionByName(rows(quality.quality_tests(current), "quality", test, column, value, status))
    out = out.unionByName(rows(quality.stability_tests(reference, current), "stability", test, column, value, status))
    out = out.unionByName(rows(
        verdict, "summary", F.lit("drift_score"), F.lit("*"), F.col("drift_score"),
        F.when(F.col("should_retrain"), "retrain").otherwise("ok")))
    if y_true and y_pred:
        pair = [col(y_true).alias("y_true"), col(y_pred).alias("y_pred")]
        both = reference.select(*pair, F.lit("reference").alias("s")).unionByName(
            current.select(*pair, F.lit("current").alias("s")))
        perf = metrics.performance_by_side(both, F.col("s"))
        long = perf.unpivot(["side", "status"], ["mean_error", "mae", "rmse", "r2", "max_abs_error"], "check", "value")
        out = out.unionByName(rows(long, "performance", F.col("check"), F.col("side"), F.col("value"), F.col("status")))
    return out
