from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.lake_job import LakeJob
from tidemark.session import scratch_path
from tidemark.sources.lake import RAW
from tidemark.spec import PanelSpec
from tidemark.streaming import ingest, serving
from tidemark.streaming.predictions import PredictionSink

SPEC = PanelSpec(("who",), "at", ("id",), targets=("x",))
SCHEMA = "who string, at timestamp, id long, x double"
START = datetime(2024, 1, 1)


def hours(spark, ids):
    return spark.createDataFrame([("ab"[i % 2], START + timedelta(hours=i), i, float(i)) for i in ids], SCHEMA)


def run(query):
    query.awaitTermination()


@pytest.mark.parametrize("late", ["append", "side"])
def test_no_row_is_lost_and_replays_add_nothing(spark, late):
    land, check = scratch_path(spark, "land"), scratch_path(spark, "ck")
    job = LakeJob(spark, scratch_path(spark, "lake"), SPEC, ("x",))
    dates = []

    def go(checkpoint=check):
        run(ingest.ingest_stream(ingest.file_stream(spark, land, SCHEMA), job, checkpoint, ["id"], timedelta(hours=6), late,
                                 then=dates.append))

    hours(spark, range(24, 48)).write.mode("append").parquet(land)
    go()
    hours(spark, [*range(0, 4), *range(44, 50)]).write.mode("append").parquet(land)  # late, repeated and new rows
    go()
    go(scratch_path(spark, "lost"))  # a lost checkpoint replays everything
    raw = {r["id"] for r in job.lake.read(RAW).collect()}
    if late == "append":
        assert raw == {*range(0, 4), *range(24, 50)} and job.lake.read(RAW).count() == 30
    else:
        assert raw == set(range(24, 50))
        assert {r["id"] for r in ingest.late_rows(job).collect()} >= set(range(0, 4))
    assert job.marks.get("lake").last_success_at == START + timedelta(hours=49)
    with pytest.raises(ValueError):
        ingest.ingest_stream(ingest.file_stream(spark, land, SCHEMA), job, check, ["id"], late="lose")


def test_stream_lags_equal_batch_lags_also_when_hot(spark):
    from tidemark.operators import frames

    land, out, check = (scratch_path(spark, n) for n in ("land", "out", "ck"))
    hot = SPEC.with_(hot_rows=5)
    for ids in (range(0, 30), range(30, 31), range(31, 60)):
        hours(spark, ids).write.mode("append").parquet(land)
        run(ingest.lag_stream(ingest.file_stream(spark, land, SCHEMA), hot, "x", (1, 4), out, check))
    got = {r["id"]: (r["x_lag_1"], r["x_lag_4"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    batch = frames.lags(["x"], (1, 4)).apply(hours(spark, range(60)), SPEC)
    assert got == {r["id"]: (r["x_lag_1"], r["x_lag_4"]) for r in batch.collect()}


@pytest.mark.parametrize("spec", [SPEC, PanelSpec((), "at", ("id",), targets=("x",))])
def test_late_rows_get_their_lags_and_revise_what_follows(spark, spec):
    from tidemark.operators import frames

    land, out, check = (scratch_path(spark, n) for n in ("land", "out", "ck"))
    for ids in ([2, 6, 10, 14, 18, 1], [8, 22], [0, 3, 24], [40, 42]):
        hours(spark, ids).write.mode("append").parquet(land)
        run(ingest.lag_stream(ingest.file_stream(spark, land, SCHEMA), spec, "x", (1, 3), out, check))
    got = {r["id"]: (r["x_lag_1"], r["x_lag_3"]) for r in ingest.lagged_rows(spark, out, spec).collect()}
    batch = frames.lags(["x"], (1, 3)).apply(hours(spark, [0, 1, 2, 3, 6, 8, 10, 14, 18, 22, 24, 40, 42]), spec)
    assert got == {r["id"]: (r["x_lag_1"], r["x_lag_3"]) for r in batch.collect()}
    # no late row, no second version
    assert spark.read.parquet(f"{out}/rows").where("batch = 3").count() == 2


def test_closed_windows_equal_batch(spark):
    land, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    df = hours(spark, range(100))
    df.write.parquet(land)
    source = ingest.file_stream(spark, land, SCHEMA, "at", "1 day")
    run(ingest.to_files(serving.request_rate(source, "at", ["who"], "1 day"), out, scratch_path(spark, "ck")))
    batch = serving.request_rate(df, "at", ["who"], "1 day")
    edge = START + timedelta(hours=99) - timedelta(days=1)
    want = {tuple(r) for r in batch.where(F.col("window_end") <= edge).select("window_start", "who", "requests").collect()}
    got = {tuple(r) for r in spark.read.parquet(out).select("window_start", "who", "requests").collect()}
    assert got == want and got


def test_bucket_quantiles(spark):
    df = spark.createDataFrame([(START, v) for v in (0.004, 0.02, 0.02, 0.3, 50.0)], "at timestamp, s double")
    row = serving.latency_quantiles(df, "at", F.col("s"), quantiles=(0.2, 0.5, 0.99)).first()
    assert row["p20"] == 0.005  # all of the first bucket
    assert abs(row["p50"] - (0.01 + 0.015 * (2.5 - 1) / 2)) < 1e-12
    assert row["p99"] == 10.0  # beyond the last bound


def test_a_batch_touches_the_buckets_of_its_entities_only(spark):
    land, out, check = (scratch_path(spark, n) for n in ("land", "out", "ck"))
    many = [(f"e{i}", START + timedelta(hours=h), 100 * i + h, float(h)) for i in range(30) for h in range(3)]
    one = [("e7", START + timedelta(hours=1, minutes=30), 5000, 9.0), ("e7", START + timedelta(hours=9), 5001, 8.0)]
    for rows in (many, one):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(land)
        run(ingest.lag_stream(ingest.file_stream(spark, land, SCHEMA), SPEC, "x", (1, 2), out, check, buckets=8))
    places = ingest.tail_places(spark, out, 9)
    assert sorted(places.values()).count(1) == 1 and len(places) > 3
    assert spark.read.parquet(f"{out}/_tail").where("batch = 1").select("bucket").distinct().count() == 1
    got = {r["id"]: (r["x_lag_1"], r["x_lag_2"]) for r in ingest.lagged_rows(spark, out, SPEC).collect()}
    assert len(got) == 92 and got[5000] == (1.0, 0.0) and got[702] == (9.0, 1.0) and got[5001] == (2.0, 9.0) and got[802] == (1.0, 0.0)


def predictions(spark, ids):
    return spark.createDataFrame([(START + timedelta(hours=i), "m", "l", "t", float(i), i + 0.5, 0.5, 0.25, 1.0) for i in ids],
                                 "timestamp timestamp, model string, location string, target string, y_true double, y_pred double, "
                                 "absolute_error double, squared_error double, inference_time_ms double")


def test_prediction_sink_replays_and_crashes(spark, monkeypatch):
    sink = PredictionSink(spark, scratch_path(spark, "sink"), 10)
    values = lambda: sorted(r["y_true"] for r in sink.read().collect())
    assert sink.read() is None and sink.seal() == 0
    sink.write(predictions(spark, range(0, 4)), 0)
    sink.write(predictions(spark, range(4, 8)), 1)
    assert values() == list(range(8)) and sink.sealed().count() == 0
    sink.write(predictions(spark, range(4, 8)), 1)  # replayed
    assert values() == list(range(8))
    note = sink._note

    def dies(step, *rest):
        if step == "sealed":
            raise RuntimeError("killed")
        note(step, *rest)

    monkeypatch.setattr(sink, "_note", dies)
    with pytest.raises(RuntimeError):  # files are written, the ledger doesn't have them
        sink.write(predictions(spark, range(8, 25)), 2)
    assert values() == list(range(25)) and sink.sealed().count() == 0
    monkeypatch.setattr(sink, "_note", note)
    sink.write(predictions(spark, range(8, 25)), 2)
    assert values() == list(range(25)) and [tuple(r) for r in sink.sealed().collect()] == [(0, 2, 25)]
    files = spark.read.parquet(f"{sink.path}/files/upto=2").inputFiles()
    assert len(files) == 3
    monkeypatch.setattr(sink, "_note", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):  # landed, not noted
        sink.write(predictions(spark, [77]), 3)
    assert values() == list(range(25))
    monkeypatch.setattr(sink, "_note", note)
    sink.write(predictions(spark, [25]), 3)
    assert values() == list(range(26)) and sink.seal(1) == 1 and values() == list(range(26))
    sink.write(predictions(spark, []), 4)
    assert values() == list(range(26))


def test_small_files_are_cut_by_few_tasks(spark):
    sink = PredictionSink(spark, scratch_path(spark, "sink"), 10)
    sink.write(predictions(spark, range(1000)), 0)
    files = spark.read.parquet(f"{sink.path}/files/upto=0").inputFiles()
    assert len(files) == 100 and len({f.rpartition("/")[2].split("-")[1] for f in files}) == 1
    assert sink.sealed().count() == 1 and sorted(r["y_true"] for r in sink.read().collect()) == list(range(1000))


def test_a_batch_is_deduplicated_once(spark):
    land, seen = scratch_path(spark, "land"), spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    job = LakeJob(spark, scratch_path(spark, "lake"), SPEC, ("x",))
    hours(spark, [*range(0, 40), *range(0, 10)]).write.parquet(land)
    source = ingest.file_stream(spark, land, SCHEMA).withColumn("id", F.udf(count, "long")("id"))
    run(ingest.ingest_stream(source, job, scratch_path(spark, "ck"), ["id"]))
    # one pass for the latest time, one for all else
    assert seen.value == 100 and sorted(r["id"] for r in job.lake.read(RAW).collect()) == list(range(40))
