"""Fitted preprocessing: clip bounds, variance transforms, scaling, and their inverses.

Fitted state is a small table with one row per column (the parameter table), so it can be written,
read back and applied to any later data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars, stats
from tidemark.functions.columns import clamp, col
from tidemark.operators.fill import apply_params, fill_along_time, fill_median, medians
from tidemark.operators.ordering import column_quantiles, per_column
from tidemark.operators.panel import Layout
from tidemark.operators.rows import drop_present
from tidemark.session import stage
from tidemark.spec import PanelSpec

SCALERS = ("robust", "standard", "minmax")
QUARTILES = (0.25, 0.5, 0.75)


def clip_bounds(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """``feature, lo, hi`` with bounds k interquartile ranges outside the quartiles."""
    return _fences(column_quantiles(df, cols, [0.25, 0.75]), F.col("q")[0], F.col("q")[1], k)


def _fences(table: DataFrame, q1: Column, q3: Column, k: float) -> DataFrame:
    return table.select("feature", (q1 - k * (q3 - q1)).alias("lo"), (q3 + k * (q3 - q1)).alias("hi"))


def clip(df: DataFrame, cols: Sequence[str], bounds: DataFrame) -> DataFrame:
    return apply_params(df, bounds, cols, ["lo", "hi"], lambda x, get: clamp(x, get("lo"), get("hi")))


def clip_counts(df: DataFrame, cols: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``bounds`` with ``n_clipped``, the values outside them."""
    flags = df.select(*[col(c).cast("double").alias(c) for c in cols])
    flags = apply_params(flags, bounds, cols, ["lo", "hi"], lambda x, get: F.when((x < get("lo")) | (x > get("hi")), 1.0))
    # one row per column on both sides
    return bounds.join(F.broadcast(per_column(flags, cols, {"n_clipped": F.count})), "feature")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, n, low, skew, kurt, kurt_pearson``; bias-corrected."""
    return per_column(df, cols, {
        "n": F.count, "low": F.min, "skew": stats.sample_skewness, "kurt": stats.sample_kurtosis,
        "kurt_pearson": stats.pearson_kurtosis,
    })


def fit_transforms(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``moments`` plus the chosen ``transform``."""
    return moments(df, cols).withColumn(
        "transform", scalars.choose_transform(F.col("skew"), F.col("kurt"), F.col("low"))
    )


def apply_transforms(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    return apply_params(df, params, cols, ["transform"], lambda x, get: scalars.forward(x, get("transform")))


def invert_transforms(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    return apply_params(df, params, cols, ["transform"], lambda x, get: scalars.inverse(x, get("transform")))


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "robust", quartiles: DataFrame | None = None) -> DataFrame:
    """``feature, center, scale``: median and IQR, mean and population deviation, or minimum and range.

    A scale of 0 becomes 1, so a constant column keeps its spread of nothing. ``quartiles`` (``feature, q`` of these columns)
    spares the robust scaler its passes.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; choose one of {SCALERS}")
    if kind == "robust":
        q = column_quantiles(df, cols, QUARTILES) if quartiles is None else quartiles.where(F.col("feature").isin(*cols))
        fitted = q.select("feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    elif kind == "standard":
        fitted = per_column(df, cols, {"center": F.avg, "scale": F.stddev_pop})
    else:
        fitted = per_column(df, cols, {"center": F.min, "scale": lambda v: F.max(v) - F.min(v)})
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    return apply_params(df, params, cols, ["center", "scale"], lambda x, get: (x - get("center")) / get("scale"))


def invert_scaler(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    return apply_params(df, params, cols, ["center", "scale"], lambda x, get: x * get("scale") + get("center"))


def pin(params: DataFrame) -> DataFrame:
    """A parameter table (one row per column) as a local table, so that applying it never refits it."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)


@dataclass(frozen=True)
class Preprocessor:
    """Everything fitted on the training slice: one parameter table for all columns.

    Columns of ``params``: feature, role, center, scale, transform, median, lo, hi.
    """

    targets: tuple[str, ...]
    features: tuple[str, ...]
    params: DataFrame

    @staticmethod
    def fit(train: DataFrame, targets: Sequence[str], features: Sequence[str], scaler: str = "robust",
            clip_k: float = 3.0) -> "Preprocessor":
        """Targets: clip bounds, transform, then standard scaling. Features: the named scaler.

        Bounds, medians and the robust scaler come from the quartiles of all columns, found together.
        """
        q = column_quantiles(train, list(dict.fromkeys([*targets, *features])), QUARTILES)
        bounds = pin(_fences(q.where(F.col("feature").isin(*targets)), F.col("q")[0], F.col("q")[2], clip_k))
        clipped = clip(train, targets, bounds)
        shape = pin(fit_transforms(clipped, targets).select("feature", "transform"))
        y = fit_scaler(apply_transforms(clipped, targets, shape), targets, "standard").withColumn(
            "role", F.lit("target")
        )
        parts = y.join(F.broadcast(shape), "feature", "left").join(F.broadcast(bounds), "feature", "left")
        if features:
            x = fit_scaler(train, features, scaler, q).withColumn("role", F.lit("feature"))
            parts = parts.unionByName(x, allowMissingColumns=True)
        middle = q.select("feature", F.col("q")[1].alias("median"))
        params = parts.withColumn("transform", F.coalesce("transform", F.lit("none"))).join(
            F.broadcast(middle), "feature", "left"
        )
        return Preprocessor(tuple(targets), tuple(features), pin(params))

    def transform(self, df: DataFrame) -> DataFrame:
        out = clip(df, self.targets, self.params)
        out = apply_transforms(out, self.targets, self.params)
        return apply_scaler(out, [*self.targets, *self.features], self.params)

    def inverse_targets(self, df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        """Back to original units; ``names`` maps target to the column that holds its scaled values."""
        names = names or {t: t for t in self.targets}
        back = {v: k for k, v in names.items()}
        params = self.params.where(F.col("role") == "target").withColumn(
            "feature", F.create_map(*[F.lit(s) for pair in names.items() for s in pair])[F.col("feature")]
        ) if any(k != v for k, v in names.items()) else self.params
        cols = list(back)
        return invert_transforms(invert_scaler(df, cols, params), cols, params)

    def save(self, path: str) -> None:
        self.params.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "Preprocessor":
        params = spark.read.parquet(path)
        names = {r["role"]: r["names"] for r in params.groupBy("role").agg(
            F.sort_array(F.collect_list("feature")).alias("names")).collect()}
        return Preprocessor(tuple(names.get("target", ())), tuple(names.get("feature", ())), params)


def clean_panel(df: DataFrame, spec: PanelSpec, numeric: Sequence[str], targets: Sequence[str] | None = None,
                redundant: Sequence[str] = (), k: float = 3.0, fit_on: DataFrame | None = None,
                layout: Layout | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop redundant columns, fill along time, fill medians, clip targets. Returns (clean, clip bounds).

    ``fit_on`` gives the rows the medians and bounds come from (the training slice); the default is all rows.
    """
    targets = list(targets or spec.targets)
    slim = drop_present(df, redundant)
    # the fill is a shuffle that the fits below would repeat on every pass, so it is written once
    filled = stage(fill_along_time(slim, spec, numeric, layout), "filled")
    base = filled
    if fit_on is not None:
        base = stage(fill_along_time(drop_present(fit_on, redundant), spec, numeric, layout), "filled")
    meds = pin(medians(base, numeric))
    bounds = pin(clip_bounds(fill_median(base, targets, meds), targets, k))
    return clip(fill_median(filled, numeric, meds), targets, bounds), bounds
