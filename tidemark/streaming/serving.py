"""Windowed serving metrics; every function works on a batch table and on a stream.

On a stream set a watermark first (``source.watermarked``); append mode then emits each window once, when closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col

# Upper bucket bounds in seconds.
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
INFERENCE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
PREPROCESSING_BUCKETS = (0.0005, 0.001, 0.005, 0.01, 0.025, 0.05)


def _window(time: str, width: str, slide: str | None) -> Column:
    return F.window(col(time), width, slide) if slide else F.window(col(time), width)


def _flat(df: DataFrame) -> DataFrame:
    rest = [col(c) for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def request_rate(events: DataFrame, time: str, by: Sequence[str], width: str = "5 minutes", slide: str | None = None,
                 seconds: float = 300.0) -> DataFrame:
    """Requests and requests per second per window and endpoint."""
    out = events.groupBy(_window(time, width, slide), *[col(b) for b in by]).agg(F.count(F.lit(1)).alias("requests"))
    return _flat(out).withColumn("rate", F.col("requests") / F.lit(float(seconds)))


def latency_quantiles(events: DataFrame, time: str, seconds: Column, by: Sequence[str] = (), width: str = "5 minutes",
                      slide: str | None = None, buckets: Sequence[float] = REQUEST_BUCKETS,
                      quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles from bucket counts, linear inside a bucket; beyond the last bound, the last bound itself.

    Only one counter per bucket is kept per window, however many requests it holds.
    """
    counts = [F.count_if(seconds <= b).alias(f"_le{i}") for i, b in enumerate(buckets)]
    out = events.groupBy(_window(time, width, slide), *[col(b) for b in by]).agg(F.count(F.lit(1)).alias("requests"), *counts)
    flat = _flat(out)
    named = {f"p{round(q * 100)}": _bucket_quantile(q, buckets) for q in quantiles}
    return flat.withColumns(named).drop(*[f"_le{i}" for i in range(len(buckets))])


def _bucket_quantile(q: float, buckets: Sequence[float]) -> Column:
    rank = F.col("requests") * F.lit(float(q))
    result = None
    for i, bound in enumerate(buckets):
        low, below = (0.0, F.lit(0)) if i == 0 else (buckets[i - 1], F.col(f"_le{i - 1}"))
        here = F.col(f"_le{i}")
        inside = F.when(here > below, F.lit(low) + F.lit(bound - low) * (rank - below) / (here - below)).otherwise(low)
        result = F.when(here >= rank, inside) if result is None else result.when(here >= rank, inside)
    return result.otherwise(F.lit(float(buckets[-1])))


def status_counts(events: DataFrame, time: str, status: Column, width: str = "1 hour") -> DataFrame:
    out = events.groupBy(_window(time, width, None), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return _flat(out)


def success_share(events: DataFrame, time: str, success: Column, by: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """Successful requests in percent."""
    out = events.groupBy(_window(time, width, None), *[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(success).alias("succeeded")
    )
    return _flat(out).withColumn("success_pct", F.col("succeeded") / F.col("requests") * 100)


def value_means(events: DataFrame, time: str, value: str, by: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """Mean predicted value per window."""
    out = events.groupBy(_window(time, width, None), *[col(b) for b in by]).agg(
        F.sum(col(value)).alias("total"), F.count(col(value)).alias("n")
    )
    return _flat(out).withColumn("mean", F.try_divide("total", "n"))


def detections(drift_rows: DataFrame, time: str, kind: str, detected: str = "drift_detected", width: str = "1 hour"
               ) -> DataFrame:
    """Drift detections per hour and kind, as a count and a per-second rate."""
    out = drift_rows.where(col(detected)).groupBy(_window(time, width, None), col(kind)).agg(
        F.count(F.lit(1)).alias("detections")
    )
    return _flat(out).withColumn("rate", F.col("detections") / F.lit(3600.0))
