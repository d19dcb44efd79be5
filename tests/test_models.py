from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.plans import forecast as scoring
from tidemark.plans.lake_job import LakeJob
from tidemark.plans.retrain import data_job, retrain
from tidemark.plans.training import (
    TRAINING, ModelStore, Setup, build_model, comparison, comparison_by_target, model_input, train,
)
from tidemark.session import scratch_path
from tidemark.sources.state import WatermarkTable
from tidemark.spec import PanelSpec

SPEC = PanelSpec(("who",), "at", ("id",))
SETUP = Setup(SPEC, features=("x", "y", "z"), targets=("x", "y"), seq_len=4, models=("linear",))


@pytest.fixture(scope="module")
def waves(spark):
    """Two smooth series per entity: easy to predict from their own past."""
    rng = np.random.default_rng(5)
    rows = []
    for w in "abc":
        for i in range(150):
            x = 20 + 10 * np.sin(i / 8 + ord(w)) + rng.normal(0, 0.1)
            rows.append((w, datetime(2024, 1, 1) + timedelta(hours=i), i, float(x), float(100 - 2 * x), float(i % 24)))
    return spark.createDataFrame(rows, "who string, at timestamp, id long, x double, y double, z double").cache()


@pytest.fixture(scope="module")
def trained(waves):
    return train(waves, SETUP)


def test_training_learns_in_original_units(trained):
    rows = {r["target"]: r for r in trained.per_target.collect()}
    assert set(rows) == {"x", "y"} and all(r["R2"] > 0.95 and r["n"] > 50 for r in rows.values())
    assert rows["y"]["MAE"] > rows["x"]["MAE"]  # y has twice the amplitude of x
    with pytest.raises(ValueError):
        build_model("oracle")


def test_store_promote_and_compare(spark, trained):
    store = ModelStore(spark, scratch_path(spark, "models"))
    assert store.best() is None and store.champions().count() == 0
    with pytest.raises(KeyError):
        store.load()
    store.save(trained, SETUP)
    assert store.best() == "linear" and comparison(store.registry()).count() == 1
    assert comparison_by_target(store.registry()).count() == 2
    with pytest.raises(KeyError):
        store.info("oracle")
    marks = WatermarkTable(spark, scratch_path(spark, "marks"))
    row = store.promote(trained, SETUP, marks, date(2024, 1, 7)).first()
    assert row["promoted"] and row["reason"] == "promoted" and marks.get(TRAINING).last_partition_date == date(2024, 1, 7)
    strict = Setup(**{**SETUP.__dict__, "promote_r2": 1.1})
    assert store.promote(trained, strict).first()["reason"] == "below_quality_threshold"
    assert store.champions().count() == 2


def test_forecast_of_recent_windows(spark, waves, trained):
    store = ModelStore(spark, scratch_path(spark, "models"))
    store.save(trained, SETUP)
    fitted, pre, _ = store.load()
    short = waves.limit(1).select(F.lit("short").alias("who"), "at", "id", "x", "y", "z")
    out = scoring.forecast(waves.unionByName(short), SETUP, fitted, pre, 5)
    rows = out.collect()
    assert len(rows) == 3 * 5 * 2 and {r["step"] for r in rows} == {1, 2, 3, 4, 5}  # too short: no rows
    assert {r["id"] for r in rows} == set(range(145, 150))
    assert np.mean([abs(r["y_pred"] - r["y_true"]) for r in rows]) < 3
    assert scoring.forecast(waves, SETUP, fitted, pre, 5, targets=["y"]).count() == 15
    with pytest.raises(ValueError):
        scoring.forecast(waves, SETUP, fitted, pre, 5, targets=["nope"])


def test_given_matrices_score_like_sequences(spark, waves, trained):
    data = model_input(waves, SETUP, trained.pre)
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(vector_to_array("features"), i * 3 + 1, 3))
    inputs = data.select("who", "id", grid.alias("m"))
    broken = spark.createDataFrame([("bad", -1, [[1.0, 2.0]]), ("none", -2, None)], "who string, id long, m array<array<double>>")
    good, bad = scoring.score_matrices(inputs.unionByName(broken), "m", SETUP, trained.models["linear"], trained.pre, ["who", "id"])
    assert {r["id"] for r in bad.collect()} == {-1, -2}
    from tidemark.plans.training import score

    want = {(r["who"], r["id"], r["target"]): r["y_pred"] for r in
            score(data, trained.models["linear"], trained.pre, SETUP.targets, ["who", "id"]).collect()}
    got = {(r["who"], r["id"], r["target"]): r["y_pred"] for r in good.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_retraining_gate(spark, waves):
    root = scratch_path(spark, "gate")
    job = LakeJob(spark, f"{root}/lake", SPEC, ("x", "y", "z"), lags=(1,), windows=(3,))
    assert retrain(job, SETUP, root).first()["reason"] == "no_feature_partitions"
    early = waves.where(F.col("id") < 120)
    assert data_job(job, early, SETUP, f"{root}/other").first()["reason"] == "no_reference"
    first = retrain(job, SETUP, root).first()
    assert first["retrained"] and first["reason"] == "first_run" and first["promoted"]
    again = retrain(job, SETUP, root).first()
    assert not again["retrained"] and again["reason"] == "too_few_new_rows"
    shifted = waves.withColumns({"at": F.col("at") + F.expr("interval 30 days"), "x": F.col("x") + 50})
    job.run(shifted)
    last = retrain(job, SETUP, root, min_new_rows=50).first()
    assert last["stage"] == "training" and last["reason"] == "drift_above_threshold"
    assert spark.read.parquet(f"{root}/history/drift_history").count() >= 1


def test_boosted_and_forest_build(spark, waves):
    out = train(waves.where(F.col("who") == "a"), Setup(SPEC, ("x",), ("x",), 3, models=("forest", "boosted")))
    assert out.summary.count() == 2 and set(out.seconds) == {"forest", "boosted"}


def test_external_model_and_single_target_metrics(spark, waves, trained):
    data = model_input(waves, SETUP, trained.pre)

    def load():
        return lambda m: np.stack([m[:, 9], m[:, 10]], axis=1)  # repeat the last x and y of the window

    out = scoring.score_external(data, load, ["who", "id", "y"], 2)
    assert out.count() == data.count()
    pair = out.select(F.col("y")[0].alias("t"), F.col("y_pred")[0].alias("p"))
    from tidemark.plans.training import single_target_metrics

    row = single_target_metrics(pair, trained.pre, "x", "t", "p").first()
    params = {r["feature"]: r for r in trained.pre.params.collect()}
    assert params["x"]["transform"] == "none"
    assert abs(row["MAE_original"] - row["MAE"] * params["x"]["scale"]) < 1e-9 and row["R2"] > 0.9
