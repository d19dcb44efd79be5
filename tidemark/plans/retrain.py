"""Drift-gated retraining, and the data job that ends in a retraining decision."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans.lake_job import LakeJob
from tidemark.plans.monitoring import decide
from tidemark.plans.training import TRAINING, ModelStore, Setup, train
from tidemark.sources.lake import DATE, FEATURES
from tidemark.sources.state import Watermark
from tidemark.sources.storage import exists
from tidemark.sources.stores import DatasetRegistry, ReferenceStore

log = logging.getLogger(__name__)

OUTCOME = "stage string, retrained boolean, reason string, best_model string, best_r2 double, promoted boolean"


def post_training(features: DataFrame, store: ReferenceStore, datasets: DatasetRegistry, model: str | None,
                  averages: dict[str, float]) -> None:
    """Save what the model was trained on as the next baseline, with its name and scores, and register it."""
    tags = {"model": str(model), **{k: str(v) for k, v in averages.items()}}
    store.save(features, tags)
    datasets.log(features, "training_features", "reference", tags)


def train_and_promote(features: DataFrame, setup: Setup, root: str, job: LakeJob) -> tuple:
    """Train, store all models, promote the champion, move the training mark, save the baseline."""
    spark = features.sparkSession
    models = ModelStore(spark, f"{root}/models")
    trained = train(features, setup)
    models.save(trained, setup)
    last, rows = features.agg(F.max(DATE), F.count(F.lit(1))).first()
    row = models.promote(trained, setup).first()
    job.marks.update(Watermark(TRAINING, datetime.now(timezone.utc), last, rows))
    best = trained.summary.where(F.col("model") == row["model"]).first()
    post_training(features, ReferenceStore(spark, f"{root}/reference"), DatasetRegistry(spark, f"{root}/datasets"),
                  row["model"], {} if best is None else {"avg_r2": best["avg_r2"], "avg_rmse": best["avg_rmse"]})
    return row


def retrain(job: LakeJob, setup: Setup, root: str, min_new_rows: int = quality.MIN_NEW_ROWS, **thresholds) -> DataFrame:
    """Readiness, drift, training: one outcome row that says how far it got and why."""
    spark = job.spark

    def outcome(stage, retrained, reason, model=None, r2=None, promoted=False):
        return spark.createDataFrame([(stage, retrained, reason, model, r2, promoted)], OUTCOME)

    if not exists(spark, job.lake.path(FEATURES)):
        return outcome("readiness", False, "no_feature_partitions")
    features = job.lake.read(FEATURES)
    mark = job.marks.get(TRAINING)
    ready = quality.readiness(features, DATE, mark.last_partition_date, min_new_rows).first()
    if not ready["ready"]:
        return outcome("readiness", False, ready["reason"])
    store = ReferenceStore(spark, f"{root}/reference")
    verdict = decide(features, store, setup.targets, first_run=ready["is_first_run"], history=f"{root}/history",
                     **thresholds).first()
    if not verdict["should_retrain"]:
        return outcome("drift", False, verdict["reason"])
    row = train_and_promote(features, setup, root, job)
    return outcome("training", True, verdict["reason"], row["model"], row["best_r2"], row["promoted"])


def data_job(job: LakeJob, source, setup: Setup, root: str) -> DataFrame:
    """Lake stages, validation gate, drift decision; returns the trigger row.

    A blocked validation never triggers. A drift check that fails triggers, since retraining is the safe side.
    """
    spark = job.spark
    job.run(source)
    features = job.lake.read(FEATURES)
    stats = quality.validation_stats(features.drop(DATE)).first()
    schema = "trigger boolean, reason string, level string, null_pct double, n_inf long, n_rows long"

    def row(trigger: bool, reason: str) -> DataFrame:
        return spark.createDataFrame(
            [(trigger, reason, stats["level"], stats["null_pct"], stats["n_inf"], stats["n_rows"])], schema)

    if stats["level"] == "block":
        return row(False, "too_many_nulls")
    try:
        verdict = decide(features, ReferenceStore(spark, f"{root}/reference"), setup.targets).first()
        return row(bool(verdict["should_retrain"]), verdict["reason"])
    except Exception as error:
        log.warning("drift check failed, triggering: %s", error)
        return row(True, f"drift_check_failed: {type(error).__name__}")
