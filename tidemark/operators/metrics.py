"""Prediction quality and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.functions.stats import half_even, r_squared, steady_avg

MIN_SAMPLES = 50


def with_errors(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    error = col(y_true) - col(y_pred)
    return df.withColumns({"absolute_error": F.abs(error), "squared_error": error * error})


def prediction_rows(df: DataFrame, targets: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Wide predictions (arrays per row) to the log's long form; extra targets beyond the array are ignored."""
    names = F.slice(F.array(*[F.lit(t) for t in targets]), F.lit(1), F.size(col(y_true)))
    zipped = F.arrays_zip(
        names.alias("target"),
        F.transform(col(y_true), lambda v: v.cast("double")).alias("t"),
        F.transform(col(y_pred), lambda v: v.cast("double")).alias("p"),
    )
    rest = [c for c in df.columns if c not in (y_true, y_pred)]
    long = df.select(*[col(c) for c in rest], F.explode(zipped).alias("z"))
    long = long.select(
        *[col(c) for c in rest], F.col("z.target").alias("target"), F.col("z.t").alias("y_true"),
        F.col("z.p").alias("y_pred"),
    ).where(F.col("target").isNotNull())
    return with_errors(long)


def _quality() -> list[Column]:
    mean = lambda c: half_even(steady_avg(F.col(c)), 4)
    return [
        mean("absolute_error").alias("MAE"),
        half_even(F.sqrt(steady_avg(F.col("squared_error"))), 4).alias("RMSE"),
        F.count("absolute_error").alias("count"),
        mean("y_true").alias("mean_y_true"),
        mean("y_pred").alias("mean_y_pred"),
        mean("inference_time_ms").alias("mean_inference_ms"),
    ]


def quality_summary(log: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, count, means per key list, rounded to 4 (halves to even); sums don't depend on the order of rows."""
    return log.groupBy(*[col(b) for b in by]).agg(*_quality())


def quality_sets(log: DataFrame) -> DataFrame:
    """The same per model, per (model, location) and per (model, target): one pass over the log.

    ``level`` names the grouping.
    """
    sets = [[col("model")], [col("model"), col("location")], [col("model"), col("target")]]
    grouped = log.groupingSets(sets, col("model"), col("location"), col("target"))
    level = (
        F.when(F.grouping("location") == 0, "model_location")
        .when(F.grouping("target") == 0, "model_target")
        .otherwise("model")
    )
    return grouped.agg(level.alias("level"), *_quality())


def regression_metrics(long: DataFrame, by: Sequence[str] = ("model", "target"), y_true: str = "y_true",
                       y_pred: str = "y_pred") -> DataFrame:
    """``by, n, MAE, MSE, RMSE, R2`` per group in one aggregate (the total sum of squares is n * population variance).
    """
    e = col(y_true) - col(y_pred)
    both = long.where(col(y_true).isNotNull() & col(y_pred).isNotNull())
    one = both.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"),
        steady_avg(F.abs(e)).alias("MAE"),
        steady_avg(e * e).alias("MSE"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(col(y_true)).alias("_var"),
    )
    return one.select(
        *[col(b) for b in by], "n", "MAE", "MSE", F.sqrt("MSE").alias("RMSE"),
        r_squared(F.col("_sse"), F.col("_var") * F.col("n")).alias("R2"),
    )


def summarise(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Average MAE, RMSE and R2 over targets."""
    return metrics.groupBy(*[col(b) for b in by]).agg(
        F.avg("MAE").alias("avg_mae"), F.avg("RMSE").alias("avg_rmse"), F.avg("R2").alias("avg_r2")
    )


def metrics_table(models: DataFrame, model: str = "name", per_target: str = "per_target") -> DataFrame:
    """``map<target, struct<MAE, RMSE, R2>>`` to rows, best R2 first."""
    return (
        models.select(col(model).alias("model"), F.explode(col(per_target)).alias("target", "m"))
        .select("model", "target", "m.*")
        .orderBy(F.desc("R2"), "model", "target")
    )


def metrics_map(metrics: DataFrame, model: str = "model") -> DataFrame:
    """The reverse: one row per model with ``per_target`` (targets are few)."""
    entry = F.struct(F.col("target"), F.struct("MAE", "RMSE", "R2").alias("m"))
    return metrics.groupBy(col(model)).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_target"))


def champion(summary: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The model with the best average R2 and whether it may be promoted; one row also for an empty input."""
    best = summary.agg(
        F.max("avg_r2").alias("best_r2"),
        F.min_by("model", F.struct(F.negative(F.col("avg_r2")), F.col("model"))).alias("best_model"),
    )
    return best.select(
        F.col("best_model").isNotNull().alias("success"),
        "best_model",
        "best_r2",
        F.coalesce(F.col("best_r2") >= threshold, F.lit(False)).alias("meets_threshold"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(F.col("best_model").isNull(), "no_model_results").otherwise("ok").alias("reason"),
    )


def performance_by_side(df: DataFrame, side: Column, y_true: str = "y_true", y_pred: str = "y_pred",
                        min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per side: n, mean error, MAE, MAPE, RMSE, R2, largest absolute error, error deviation, status."""
    e = col(y_pred) - col(y_true)
    one = df.where(col(y_true).isNotNull() & col(y_pred).isNotNull()).groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("mean_error"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(col(y_true) != 0, F.abs(e / col(y_true)))).alias("_mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(col(y_true)) * F.count(F.lit(1))).alias("_sst"),
        F.max(F.abs(e)).alias("max_abs_error"),
        F.stddev_samp(e).alias("error_std"),
    )
    return one.select(
        "side", "n", "mean_error", "mae", (F.col("_mape") * 100).alias("mape"), "rmse",
        r_squared(F.col("_sse"), F.col("_sst")).alias("r2"), "max_abs_error", "error_std",
        F.when(F.col("n") >= min_samples, "ok").otherwise("insufficient_data").alias("status"),
    )


def performance_report(log: DataFrame, order: Sequence[str], model: str | None = None, location: str | None = None,
                       min_samples: int = MIN_SAMPLES, halves: Column | None = None) -> DataFrame:
    """``performance_by_side`` of a filtered log; ``halves`` marks the current half (true).

    The guard holds for the filtered log as a whole: its two halves are both ``ok`` or both ``insufficient_data``. A log
    without a usable row gives one row, ``no_data``.
    """
    kept = log.where(col("y_true").isNotNull() & col("y_pred").isNotNull())
    if model is not None:
        kept = kept.where(F.col("model") == model)
    if location is not None:
        kept = kept.where(F.col("location") == location)
    rows = kept.count()
    if not rows:
        kinds = performance_by_side(kept, F.lit("all")).schema
        fixed = {"side": "all", "n": 0, "status": "no_data"}
        return kept.sparkSession.range(1).select(*(F.lit(fixed.get(f.name)).cast(f.dataType).alias(f.name) for f in kinds))
    if halves is None:
        from tidemark.operators.split import time_cuts
        from tidemark.spec import PanelSpec

        timed = kept.where(col(order[0]).isNotNull())
        if timed.isEmpty():
            halves = F.lit(False)
        else:
            spec = PanelSpec((), order[0], tuple(order[1:]))
            halves = col(order[0]) >= F.lit(time_cuts(timed, spec, [0.5], by_rows=True)[0])
    side = F.when(halves, "current").otherwise("reference")
    status = "ok" if rows >= min_samples else "insufficient_data"
    return performance_by_side(kept, side).withColumn("status", F.lit(status))


def first_predictions(df: DataFrame, order: Sequence[str], y_true: str, y_pred: str, n: int = 500) -> DataFrame:
    """The first n rows in time with their index and signed error: a bounded report."""
    top = df.orderBy(*[col(o) for o in order]).limit(n)
    w = Window.orderBy(*[col(o) for o in order])  # n rows
    return top.select(
        (F.row_number().over(w) - 1).alias("index"), *[col(o) for o in order],
        col(y_true).alias("actual"), col(y_pred).alias("predicted"), (col(y_true) - col(y_pred)).alias("error"),
    )
