"""Serving metrics and streaming runs driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import CUT, USERS, W, events, r, sr, table
from tidemark.session import scratch_path, stage
from tidemark.streaming import ingest, serving


def seconds(divisor: float = 1000.0):
    return F.col("value") / divisor


def serving_rate(spark, path):
    out = serving.request_rate(events(spark, path), "ts", ["event_type"], "5 minutes")
    return out.select("window_start", "event_type", "requests", r("rate").alias("rate"))


def serving_rate_sliding(spark, path):
    out = serving.request_rate(events(spark, path), "ts", ["event_type"], "5 minutes", "1 minute")
    return out.select("window_start", "event_type", "requests", r("rate").alias("rate"))


def serving_latency(spark, path):
    out = serving.latency_quantiles(events(spark, path), "ts", seconds(), ["event_type"], "1 day")
    return out.select("window_start", "event_type", "requests", *[r(c).alias(c) for c in ("p50", "p95", "p99")])


def inference_latency(spark, path):
    out = serving.latency_quantiles(
        events(spark, path), "ts", seconds(10_000.0), [], "1 day", buckets=serving.INFERENCE_BUCKETS
    )
    return out.select("window_start", "requests", *[r(c).alias(c) for c in ("p50", "p95", "p99")])


def preprocessing_latency(spark, path):
    out = serving.latency_quantiles(
        events(spark, path), "ts", seconds(100_000.0), [], "1 day", buckets=serving.PREPROCESSING_BUCKETS, quantiles=(0.5, 0.95)
    )
    return out.select("window_start", "requests", *[r(c).alias(c) for c in ("p50", "p95")])


def status_counts(spark, path):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return serving.status_counts(events(spark, path), "ts", status).select("window_start", "status", "n")


def success_pct(spark, path):
    out = serving.success_share(events(spark, path), "ts", F.col("event_type") != "error", [], "1 hour")
    return out.select("window_start", "requests", "succeeded", r("success_pct").alias("success_pct"))


def mean_prediction(spark, path):
    out = serving.value_means(events(spark, path), "ts", "value", ["event_type"], "1 hour")
    return out.select("window_start", "event_type", "n", r("mean").alias("mean"))


def drift_detections(spark, path):
    """Errors stand for detections: how many per hour and user."""
    rows = events(spark, path).withColumn("drift_detected", F.col("event_type") == "error")
    out = serving.detections(rows, "ts", "user_id")
    return out.select("window_start", "user_id", "detections", r("rate", 8).alias("rate"))


def _landing(spark, path, *frames):
    """Events written as files of a landing folder, one write per frame."""
    root = scratch_path(spark, "landing")
    for frame in frames or (events(spark, path),):
        frame.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(root)
    return root, spark.read.parquet(root).schema


def _finish(query) -> None:
    query.awaitTermination()


def stream_daily(spark, path):
    """Daily counts per type on a stream: only windows the watermark has closed are emitted, each once."""
    root, schema = _landing(spark, path)
    source = ingest.file_stream(spark, root, schema, "ts", "1 day")
    daily = serving.value_means(source, "ts", "value", ["event_type"], "1 day")
    target = scratch_path(spark, "daily")
    _finish(ingest.to_files(daily, target, scratch_path(spark, "ck")))
    out = spark.read.parquet(target)
    return out.select("window_start", "event_type", "n", r("total", 3).alias("total"))


def stream_latency(spark, path):
    root, schema = _landing(spark, path)
    source = ingest.file_stream(spark, root, schema, "ts", "1 day")
    daily = serving.latency_quantiles(source, "ts", seconds(), [], "1 day")
    target = scratch_path(spark, "latency")
    _finish(ingest.to_files(daily, target, scratch_path(spark, "ck")))
    out = spark.read.parquet(target)
    return out.select("window_start", "requests", *[r(c).alias(c) for c in ("p50", "p95", "p99")])


def stream_dedup(spark, path):
    """Every event delivered twice, kept once."""
    rows = events(spark, path)
    root, schema = _landing(spark, path, rows, rows)
    source = ingest.file_stream(spark, root, schema, "ts", "60 days")
    target = scratch_path(spark, "dedup")
    _finish(ingest.to_files(ingest.dedup_stream(source, ["event_id"]), target, scratch_path(spark, "ck")))
    return spark.read.parquet(target).select("event_id", "event_type", "value")


def _stream_job(spark, **options):
    from tidemark.plans.lake_job import LakeJob

    return LakeJob(spark, scratch_path(spark, "lake"), USERS, ("value",), lags=(1, 3, 7), windows=(3, 7), **options)


def stream_incremental(spark, path):
    """Two deliveries, the second with a replay of the first: raw holds every event once, features follow."""
    from tidemark.catalog.features import _rounded
    from tidemark.sources.lake import FEATURES

    job = _stream_job(spark)
    rows = events(spark, path).select("user_id", "event_id", "ts", "event_type", "value")
    early = rows.where(F.col("ts") < CUT)
    root, schema = _landing(spark, path, early)
    check = scratch_path(spark, "ck")

    def build(dates):
        job.clean(dates)
        job.features(dates, lookback="rows")

    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"], then=build))
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(root)
    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"], then=build))
    return _rounded(job.lake.read(FEATURES).drop("ts", "event_type", "date"))


def stream_late(spark, path):
    """Errors arrive after everything else: those older than the watermark minus a day go to the late table."""
    job = _stream_job(spark)
    rows = events(spark, path).select("user_id", "event_id", "ts", "event_type", "value")
    root, schema = _landing(spark, path, rows.where(F.col("event_type") != "error"))
    check = scratch_path(spark, "ck")
    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"], late="side"))
    rows.where(F.col("event_type") == "error").withColumn("ts", F.col("ts").cast("timestamp")).write.mode(
        "append").parquet(root)
    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"], late="side"))
    raw = job.lake.read("raw").select(F.lit("raw").alias("place"), "event_id")
    late = ingest.late_rows(job).select(F.lit("late").alias("place"), "event_id")
    return raw.unionByName(late).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def stream_lags(spark, path):
    """Lags carried over two micro-batches in time order."""
    rows = events(spark, path).select("user_id", "event_id", "ts", "value")
    root, schema = _landing(spark, path, rows.where(F.col("ts") < CUT))
    target, check = scratch_path(spark, "lags"), scratch_path(spark, "ck")
    _finish(ingest.lag_stream(ingest.file_stream(spark, root, schema), USERS, "value", (1, 3), target, check))
    rows.where(F.col("ts") >= CUT).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(root)
    _finish(ingest.lag_stream(ingest.file_stream(spark, root, schema), USERS, "value", (1, 3), target, check))
    return spark.read.parquet(f"{target}/rows").select("user_id", "event_id", "value_lag_1", "value_lag_3")


def stream_lags_late(spark, path):
    """Lags where the events with an id divisible by 13 come last: they get theirs, and what follows them is revised."""
    rows = events(spark, path).select("user_id", "event_id", "ts", "value")
    late = F.col("event_id") % 13 == 0
    root, schema = _landing(spark, path, rows.where(~late))
    target, check = scratch_path(spark, "lags"), scratch_path(spark, "ck")
    _finish(ingest.lag_stream(ingest.file_stream(spark, root, schema), USERS, "value", (1, 3), target, check))
    rows.where(late).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(root)
    _finish(ingest.lag_stream(ingest.file_stream(spark, root, schema), USERS, "value", (1, 3), target, check))
    return ingest.lagged_rows(spark, target, USERS).select("user_id", "event_id", "value_lag_1", "value_lag_3")


def stream_predictions(spark, path):
    """Predictions that come in many small batches, gathered into files of 3,000 rows, with the last batch replayed."""
    from tidemark.catalog.monitoring import _log
    from tidemark.streaming.predictions import PredictionSink

    log = stage(_log(spark, path).withColumn("timestamp", F.col("ts")).drop("ts"), "log")
    root, check = scratch_path(spark, "predictions"), scratch_path(spark, "ck")
    sink = PredictionSink(spark, scratch_path(spark, "sink"), 3_000)
    for day in range(6):  # a delivery is as many files as tasks wrote it, and one micro-batch
        log.where(F.dayofmonth("timestamp") % 6 == day).write.mode("append").parquet(root)
        _finish(sink.start(spark.readStream.schema(log.schema).parquet(root), check))
    sink.write(log.where("false"), 5)  # the ledger has it
    return sink.read().select("event_id", "model", "location", "target", "y_true", *[r(c).alias(c) for c in ("y_pred", "absolute_error", "squared_error")])


def stream_dedup_late(spark, path):
    """The later half first, then everything: repeated rows are kept once, late ones are not lost."""
    job = _stream_job(spark)
    rows = events(spark, path).select("user_id", "event_id", "ts", "event_type", "value")
    root, schema = _landing(spark, path, rows.where(F.col("ts") >= CUT))
    check = scratch_path(spark, "ck")
    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"]))
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(root)
    _finish(ingest.ingest_stream(ingest.file_stream(spark, root, schema), job, check, ["event_id"]))
    return job.lake.read("raw").select("event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (
    serving_rate, serving_rate_sliding, serving_latency, inference_latency, preprocessing_latency, status_counts,
    success_pct, mean_prediction, drift_detections, stream_daily, stream_latency, stream_dedup, stream_incremental,
    stream_late, stream_lags, stream_lags_late, stream_predictions, stream_dedup_late,
)}


def _latency(buckets, seconds: str, by: str, where: str = "", quantiles=(0.5, 0.95, 0.99)) -> str:
    counts = ", ".join(f"count(*) FILTER ({seconds} <= {b}) AS le{i}" for i, b in enumerate(buckets))

    def quantile(q):
        cases = []
        for i, b in enumerate(buckets):
            low, below = (0, "0") if i == 0 else (buckets[i - 1], f"le{i - 1}")
            cases.append(f"WHEN le{i} >= requests * CAST({q} AS DOUBLE) THEN CASE WHEN le{i} > {below} THEN CAST({low} AS DOUBLE)"
                         f" + CAST({b - low!r} AS DOUBLE) * (requests * CAST({q} AS DOUBLE) - {below}) / (le{i} - {below})"
                         f" ELSE {low} END")
        return sr(f"CASE {' '.join(cases)} ELSE {buckets[-1]} END") + f" AS p{round(q * 100)}"

    group = f", {by}" if by else ""
    return f"""SELECT window_start{group}, requests, {', '.join(quantile(q) for q in quantiles)} FROM (
      SELECT date_trunc('day', ts) AS window_start{group}, count(*) AS requests, {counts} FROM events {where} GROUP BY ALL)"""


_CLOSED = "WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"
_HOUR = "date_trunc('hour', ts) AS window_start"
SQL = {
    "serving_rate": f"""SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS requests,
      {sr('count(*) / 300.0')} AS rate FROM events GROUP BY ALL""",
    "serving_rate_sliding": f"""SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INTEGER)) AS window_start, event_type,
      count(*) AS requests, {sr('count(*) / 300.0')} AS rate FROM events, (SELECT unnest(range(5)) AS k) GROUP BY ALL""",
    "serving_latency": _latency(serving.REQUEST_BUCKETS, "value / CAST(1000 AS DOUBLE)", "event_type"),
    "inference_latency": _latency(serving.INFERENCE_BUCKETS, "value / CAST(10000 AS DOUBLE)", ""),
    "preprocessing_latency": _latency(serving.PREPROCESSING_BUCKETS, "value / CAST(100000 AS DOUBLE)", "", quantiles=(0.5, 0.95)),
    "status_counts": f"""SELECT {_HOUR}, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
      count(*) AS n FROM events GROUP BY ALL""",
    "success_pct": f"""SELECT {_HOUR}, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS succeeded,
      {sr("count(*) FILTER (event_type <> 'error') / count(*) * 100")} AS success_pct FROM events GROUP BY ALL""",
    "mean_prediction": f"SELECT {_HOUR}, event_type, count(value) AS n, {sr('sum(value) / count(value)')} AS mean "
                       "FROM events GROUP BY ALL",
    "drift_detections": f"""SELECT {_HOUR}, user_id, count(*) AS detections, {sr('count(*) / 3600.0', 8)} AS rate
      FROM events WHERE event_type = 'error' GROUP BY ALL""",
    "stream_daily": f"""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, {sr('sum(value)', 3)} AS total
      FROM events {_CLOSED} GROUP BY ALL""",
    "stream_latency": _latency(serving.REQUEST_BUCKETS, "value / CAST(1000 AS DOUBLE)", "", _CLOSED),
    "stream_dedup": "SELECT event_id, event_type, value FROM events",
    "stream_late": """WITH h AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM events WHERE event_type <> 'error')
      SELECT CASE WHEN event_type = 'error' AND ts <= edge THEN 'late' ELSE 'raw' END AS place, count(*) AS n,
      CAST(sum(event_id) AS BIGINT) AS ids FROM events, h GROUP BY 1""",
    "stream_lags": f"""SELECT user_id, event_id, lag(value, 1) OVER {W} AS value_lag_1, lag(value, 3) OVER {W} AS value_lag_3
      FROM events""",
}


def _incremental() -> str:
    from tidemark.catalog.lake import _CLEAN, _FEATURES

    return _FEATURES.replace("SRC", _CLEAN)


SQL["stream_incremental"] = _incremental()
SQL["stream_lags_late"], SQL["stream_dedup_late"] = SQL["stream_lags"], SQL["stream_dedup"]


def _predictions() -> str:
    from tidemark.catalog import monitoring

    return monitoring.SQL["prediction_log"]


SQL["stream_predictions"] = _predictions()
