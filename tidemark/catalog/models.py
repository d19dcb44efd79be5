"""Training, forecasting and retraining; iterative fits have no SQL twin."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.common import CUT, USERS, events, r
from tidemark.plans import forecast as scoring
from tidemark.plans.lake_job import LakeJob
from tidemark.plans.monitoring import full_report as build_report
from tidemark.plans.retrain import data_job, retrain
from tidemark.plans.training import ModelStore, Setup, comparison, comparison_by_target, train
from tidemark.session import scratch_path

SETUP = Setup(USERS, features=("value", "k"), targets=("value",), seq_len=5, models=("linear", "forest"))


def _panel(spark, path):
    return events(spark, path).select(
        "user_id", "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def train_eval(spark, path):
    """Test metrics per model and target, in original units."""
    out = train(_panel(spark, path), SETUP).per_target
    return out.select("model", "target", "n", *[r(c, 4).alias(c) for c in ("MAE", "RMSE", "R2")])


def model_registry(spark, path):
    """Stored models compared, best first, and the per-target table of the same registry."""
    store = ModelStore(spark, scratch_path(spark, "models"))
    store.save(train(_panel(spark, path), SETUP), SETUP)
    registry = store.registry()
    return comparison(registry).join(comparison_by_target(registry).select(F.col("model").alias("name"), "target", "R2"),
                                     "name").select("name", "display_name", "target", r("R2", 4).alias("R2"), "seq_len")


def forecast_ml(spark, path):
    """The last seven one-step forecasts of every user from the best stored model."""
    store = ModelStore(spark, scratch_path(spark, "models"))
    df = _panel(spark, path)
    store.save(train(df, SETUP), SETUP)
    fitted, pre, _ = store.load()
    out = scoring.forecast(df, SETUP, fitted, pre, 7)
    return out.select("user_id", "step", "target", r("y_pred", 4).alias("y_pred"), "y_true")


def _job(spark):
    root = scratch_path(spark, "retrain")
    return root, LakeJob(spark, f"{root}/lake", USERS, ("value", "k"), lags=(1, 3), windows=(3,))


def retrain_gate(spark, path):
    """First run trains; the run after it sees no new rows; new dates then go through the drift check."""
    root, job = _job(spark)
    df = _panel(spark, path)
    quick = replace(SETUP, models=("linear",))
    outcomes = []
    for rows in (df.where(F.col("ts") < CUT), None, df):
        if rows is not None:
            job.run(rows)
        outcomes.append(retrain(job, quick, root).withColumn("run", F.lit(len(outcomes) + 1)))
    out = outcomes[0].unionByName(outcomes[1]).unionByName(outcomes[2])
    return out.select("run", "stage", "retrained", "reason", "promoted")


def data_trigger(spark, path):
    """Lake stages, validation and the drift decision as one job."""
    root, job = _job(spark)
    return data_job(job, _panel(spark, path), SETUP, root)


def full_report(spark, path):
    """All monitoring reports of the table before and after the cut, persistence as the prediction."""
    from tidemark.operators import frames

    df = frames.persistence("value", "y_pred").apply(_panel(spark, path), USERS)
    old, new = (df.where(c).select("value", "k", "y_pred") for c in (F.col("ts") < CUT, F.col("ts") >= CUT))
    out = build_report(old, new, ["value"], "value", "y_pred")
    return out.withColumn("value", r("value", 4))


QUERIES = {f.__name__: f for f in (train_eval, model_registry, forecast_ml, retrain_gate, data_trigger, full_report)}
SQL = {}
