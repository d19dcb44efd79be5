"""Training several models on the same sequences, choosing and storing a champion."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators import frames, metrics
from tidemark.operators.panel import Layout
from tidemark.operators.preprocess import Preprocessor
from tidemark.operators.split import split_time
from tidemark.sources.state import Watermark, WatermarkTable
from tidemark.sources.storage import exists
from tidemark.spec import PanelSpec

PROMOTE_R2 = 0.7
TRAINING = "ml_training"

MODELS: dict[str, tuple[Callable[[], Estimator], type, str]] = {
    "linear": (lambda: LinearRegression(regParam=0.01), LinearRegressionModel, "Linear regression"),
    "forest": (lambda: RandomForestRegressor(numTrees=20, maxDepth=6, seed=7), RandomForestRegressionModel,
               "Random forest"),
    "boosted": (lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=7, validationIndicatorCol="is_val"), GBTRegressionModel,
                "Boosted trees"),
}


def register_model(name: str, build: Callable[[], Estimator], model_class: type, display_name: str | None = None) -> None:
    MODELS[name] = (build, model_class, display_name or name)


def build_model(name: str) -> Estimator:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; available: {sorted(MODELS)}")
    return MODELS[name][0]()


@dataclass(frozen=True)
class Setup:
    """What a model sees: ``seq_len`` rows of ``features`` (which may include the targets) predict the ``targets``
    ``horizon`` rows later."""

    spec: PanelSpec
    features: tuple[str, ...]
    targets: tuple[str, ...]
    seq_len: int = 24
    horizon: int = 1
    scaler: str = "robust"
    models: tuple[str, ...] = ("linear", "forest", "boosted")
    promote_r2: float = PROMOTE_R2


def model_input(df: DataFrame, setup: Setup, pre: Preprocessor, keep: Sequence[str] = (),
                layout: Layout | None = None) -> DataFrame:
    """Scaled sequences with a ``features`` vector and the scaled targets in ``y``; ``keep`` columns ride along."""
    spec = setup.spec.with_(tiebreak=(*setup.spec.tiebreak, *keep))
    seq = frames.sequences(pre.transform(df), spec, setup.features, setup.targets, setup.seq_len, setup.horizon,
                           layout)
    flat = F.transform(F.flatten("x"), lambda v: v.cast("double"))
    return seq.withColumn("features", array_to_vector(flat)).drop("x")


def extra_features(setup: Setup) -> list[str]:
    return [f for f in setup.features if f not in setup.targets]


@dataclass
class Trained:
    """Fitted models per name and target, their metrics table and training seconds."""

    models: dict[str, dict[str, Model]]
    per_target: DataFrame
    summary: DataFrame
    seconds: dict[str, float]
    pre: Preprocessor


def train(df: DataFrame, setup: Setup) -> Trained:
    """Time split, fit the preprocessor on the training part, train every model per target, score the test part.

    The sequences of all parts are built once, on the whole panel, so that windows may start in an earlier part.
    """
    parts = split_time(df, setup.spec)
    pre = Preprocessor.fit(parts.where(F.col("part") == "train"), setup.targets, extra_features(setup), setup.scaler)
    data = model_input(parts, setup, pre, keep=["part"]).withColumn("is_val", F.col("part") == "val")
    # keys and times are not kept with the rows
    data = data.select("features", "y", "part", "is_val").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitting, test = data.where(F.col("part") != "test"), data.where(F.col("part") == "test")
        models: dict[str, dict[str, Model]] = {}
        seconds: dict[str, float] = {}
        logs = None
        for name in setup.models:
            start = time.monotonic()
            models[name] = {}
            for i, target in enumerate(setup.targets):
                estimator = build_model(name)
                uses_val = estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol")
                rows = fitting if uses_val else fitting.where(~F.col("is_val"))
                rows = rows.select("features", "is_val", F.col("y")[i].cast("double").alias("label"))
                models[name][target] = estimator.fit(rows)
            seconds[name] = time.monotonic() - start
            log = score(test, models[name], pre, setup.targets, []).withColumn("model", F.lit(name))
            logs = log if logs is None else logs.unionByName(log)
        per_target = metrics.regression_metrics(logs)
        per_target = df.sparkSession.createDataFrame(per_target.collect(), per_target.schema)
    finally:
        data.unpersist()
    return Trained(models, per_target, metrics.summarise(per_target), seconds, pre)


def score(data: DataFrame, fitted: dict[str, Model], pre: Preprocessor, targets: Sequence[str], ids: Sequence[str],
          truth: bool = True) -> DataFrame:
    """Predictions in original units, long form: ids, target, y_pred and (with ``truth``) y_true."""
    out = data
    for i, target in enumerate(targets):
        # each fitted model adds one column; the rows are read once
        out = fitted[target].setPredictionCol(f"_p{i}").transform(out)
    keep = [col(c) for c in ids]
    wide = out.select(*keep, *[F.col(f"_p{i}") for i in range(len(targets))],
                      *([F.col("y")[i].cast("double").alias(f"_t{i}") for i in range(len(targets))] if truth else []))
    wide = pre.inverse_targets(wide, {t: f"_p{i}" for i, t in enumerate(targets)})
    if truth:
        wide = pre.inverse_targets(wide, {t: f"_t{i}" for i, t in enumerate(targets)})
    cells = [F.struct(F.lit(t).alias("target"), F.col(f"_p{i}").alias("y_pred"),
                      *([F.col(f"_t{i}").alias("y_true")] if truth else [])) for i, t in enumerate(targets)]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("r")).select(*keep, "r.*")


def single_target_metrics(scaled: DataFrame, pre: Preprocessor, target: str, y_true: str, y_pred: str) -> DataFrame:
    """One row for one target: MAE, MSE, RMSE, R2 as scaled, and MAE and RMSE in original units."""
    pair = scaled.select(col(y_true).cast("double").alias("t"), col(y_pred).cast("double").alias("p"))
    back = pre.inverse_targets(pre.inverse_targets(pair, {target: "t"}), {target: "p"})
    both = pair.select(F.lit("scaled").alias("unit"), "t", "p").unionByName(back.select(F.lit("original").alias("unit"), "t", "p"))
    two = metrics.regression_metrics(both, ["unit"], "t", "p")

    def of(unit: str, name: str):
        return F.max(F.when(F.col("unit") == unit, F.col(name)))

    return two.agg(
        F.max("n").alias("n"), *[of("scaled", m).alias(m) for m in ("MAE", "MSE", "RMSE", "R2")],
        of("original", "MAE").alias("MAE_original"), of("original", "RMSE").alias("RMSE_original"),
    )


class ModelStore:
    """Fitted models, the registry of their metrics, and the champion history, under one root."""

    META = ("name string, display_name string, saved_at timestamp, seq_len int, horizon int, train_seconds double, "
            "avg_r2 double, avg_mae double, avg_rmse double, "
            "per_target map<string, struct<MAE: double, RMSE: double, R2: double>>, targets array<string>, "
            "features array<string>, path string")
    CHAMPION = "model string, promoted boolean, reason string, best_r2 double, promoted_at timestamp, path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, trained: Trained, setup: Setup) -> None:
        """Every model under a new path, then one registry row each."""
        now = datetime.now(timezone.utc)
        maps = {r["model"]: r["per_target"] for r in metrics.metrics_map(trained.per_target).collect()}
        averages = {r["model"]: r for r in trained.summary.collect()}
        rows = []
        for name, by_target in trained.models.items():
            path = f"{self.root}/models/{name}/{now.strftime('%Y%m%dT%H%M%S%f')}"
            for i, target in enumerate(setup.targets):
                by_target[target].write().overwrite().save(f"{path}/target_{i}")
            trained.pre.save(f"{path}/preprocessor")
            a = averages[name]
            rows.append((name, MODELS[name][2], now, setup.seq_len, setup.horizon, trained.seconds[name], a["avg_r2"],
                         a["avg_mae"], a["avg_rmse"], maps[name], list(setup.targets), list(setup.features), path))
        self.spark.createDataFrame(rows, self.META).coalesce(1).write.mode("append").parquet(f"{self.root}/registry")

    def registry(self) -> DataFrame:
        """The newest row per model."""
        path = f"{self.root}/registry"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.META)
        log = self.spark.read.schema(self.META).parquet(path)
        fields = [f for f in log.columns if f != "name"]
        return log.groupBy("name").agg(F.max_by(F.struct(*fields), "saved_at").alias("s")).select("name", "s.*")

    def info(self, name: str) -> DataFrame:
        found = self.registry().where(F.col("name") == name)
        if found.isEmpty():
            raise KeyError(f"no model named {name!r}")
        return found

    def best(self) -> str | None:
        row = self.registry().orderBy(F.desc("avg_r2"), "name").first()
        return None if row is None else row["name"]

    def load(self, name: str | None = None) -> tuple[dict[str, Model], Preprocessor, dict]:
        """(models per target, preprocessor, registry row); the best model without a name."""
        name = name or self.best()
        if name is None:
            raise KeyError("no model stored")
        row = self.info(name).first().asDict()
        loader = MODELS[name][1]
        models = {t: loader.load(f"{row['path']}/target_{i}") for i, t in enumerate(row["targets"])}
        pre = Preprocessor.load(self.spark, f"{row['path']}/preprocessor")
        ordered = Preprocessor(tuple(row["targets"]), pre.features, pre.params)
        return models, ordered, row

    def promote(self, trained: Trained, setup: Setup, marks: WatermarkTable | None = None,
                last_date: date | None = None) -> DataFrame:
        """Champion row: promoted only at or above the bar; then the serving copy and the training mark move."""
        verdict = metrics.champion(trained.summary, setup.promote_r2).first()
        name, ok = verdict["best_model"], bool(verdict["meets_threshold"])
        reason = verdict["reason"] if not verdict["success"] else "promoted" if ok else "below_quality_threshold"
        now = datetime.now(timezone.utc)
        serving = f"{self.root}/serving/{now.strftime('%Y%m%dT%H%M%S%f')}"
        if ok:
            for i, target in enumerate(setup.targets):
                trained.models[name][target].write().overwrite().save(f"{serving}/target_{i}")
            trained.pre.save(f"{serving}/preprocessor")
            if marks is not None:
                marks.update(Watermark(TRAINING, now, last_date, 0))
        row = (name, ok, reason, verdict["best_r2"], now if ok else None, serving if ok else None)
        out = self.spark.createDataFrame([row], self.CHAMPION)
        out.coalesce(1).write.mode("append").parquet(f"{self.root}/champion")
        return out

    def champions(self) -> DataFrame:
        path = f"{self.root}/champion"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.CHAMPION)
        return self.spark.read.schema(self.CHAMPION).parquet(path)


def comparison(registry: DataFrame) -> DataFrame:
    """One row per model, best first."""
    return registry.select("name", "display_name", "avg_r2", "avg_mae", "avg_rmse", "train_seconds", "seq_len").orderBy(
        F.desc("avg_r2"), "name")


def comparison_by_target(registry: DataFrame) -> DataFrame:
    return metrics.metrics_table(registry, "name")
