"""The lake: partitions, watermarks, manifests, incremental features, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import CUT, USERS, events, r, sr, table
from tidemark.catalog.features import CYCLE_SQL, LAG_SQL, ROLL_SQL, _rounded
from tidemark.plans.lake_job import LakeJob, lookback_features
from tidemark.session import scratch_path
from tidemark.sources import manifest
from tidemark.sources.lake import CLEAN, FEATURES, RAW, REJECTED, Lake, date_counts, with_date
from tidemark.sources.readers import SOURCES, read_csv, read_json_pages
from tidemark.sources.stores import DatasetRegistry, PredictionLog, ReferenceStore, export_csv

MARK = "2024-01-25"


def _slim(spark, path):
    return events(spark, path).select("user_id", "event_id", "ts", "event_type", "value")


def _lake(spark, path, layers=(RAW,), before=None):
    lake = Lake(spark, scratch_path(spark, "lake"))
    for layer in layers:
        df = _slim(spark, path)
        if before and layer in before:
            df = df.where(F.col("ts") < before[layer])
        lake.write(df, layer, "ts")
    return lake


def partition_counts(spark, path):
    return date_counts(with_date(events(spark, path), "ts"))


def manifest_doc(spark, path):
    return manifest.document(date_counts(with_date(events(spark, path), "ts")), "lake", RAW)


def list_dates(spark, path):
    return _lake(spark, path).date_table(RAW)


def pending_dates(spark, path):
    """Dates in the raw layer that the clean layer lacks."""
    lake = _lake(spark, path, (RAW, CLEAN), {CLEAN: CUT})
    return spark.createDataFrame([(d,) for d in lake.pending(RAW, CLEAN)], "date date")


def date_range_scan(spark, path):
    return _lake(spark, path).read_range(RAW, "2024-01-10", "2024-01-12").select("event_id", "date", "value")


def date_scan(spark, path):
    return _lake(spark, path).read_date(RAW, "2024-01-15").select("event_id", "value")


def dates_scan(spark, path):
    days = ["2024-01-03", "2024-01-20", "2031-01-01"]
    return _lake(spark, path).read_dates(RAW, days).select("event_id", "date", "value")


def layer_snapshot(spark, path):
    lake = _lake(spark, path)
    return lake.snapshot(RAW, scratch_path(spark, "snapshot")).select("event_id", "ts", "value")


def lookback_features_query(spark, path):
    """Features of the dates after the mark, computed with the partitions before it."""
    lake = _lake(spark, path, (CLEAN,))
    dates = [d for d in lake.dates(CLEAN) if d.isoformat() >= MARK]
    out = lookback_features(lake, USERS, ["value"], dates, (1, 3, 7), (3, 7), lookback="rows")
    return _rounded(out.drop("ts", "event_type", "date"))


def lookback_partitions(spark, path):
    """The same with a history of whole partitions: the last seven dates before the mark, and no row earlier than that."""
    lake = _lake(spark, path, (CLEAN,))
    dates = [d for d in lake.dates(CLEAN) if d.isoformat() >= MARK]
    out = lookback_features(lake, USERS, ["value"], dates, (1, 3, 7), (3, 7), lookback="partitions")
    return _rounded(out.drop("ts", "event_type", "date"))


def layer_files(spark, path):
    """A layer written twice: rows by date from its file table, beside those that a read of the layer gives."""
    lake = _lake(spark, path, (CLEAN,))
    late = _slim(spark, path).where((F.col("ts") >= CUT) & (F.col("event_type") != "error"))
    lake.write(late, CLEAN, "ts")
    read = lake.read(CLEAN).groupBy("date").agg(F.count(F.lit(1)).alias("read"), F.sum("event_id").alias("ids"))
    return lake.counts(CLEAN).join(read, "date")


def _job(spark, **options):
    return LakeJob(spark, scratch_path(spark, "lake"), USERS, ("value",), lags=(1, 3, 7), windows=(3, 7), **options)


def lake_features(spark, path):
    """The whole lake job in one run: raw, clean, features."""
    job = _job(spark)
    job.run(_slim(spark, path))
    return _rounded(job.lake.read(FEATURES).drop("ts", "event_type", "date"))


def lake_incremental(spark, path):
    """Two ingests split by time give the features of one: the second run starts at the stored watermark."""
    job = _job(spark)
    rows = _slim(spark, path)
    job.run(rows.where(F.col("ts") < CUT))
    job.ingest(rows)
    job.clean()
    job.features(lookback="rows")
    return _rounded(job.lake.read(FEATURES).drop("ts", "event_type", "date"))


def lake_late_rows(spark, path):
    """Errors of three days arrive weeks late: their dates and the dates of their users' next rows are built again."""
    job = _job(spark)
    rows = _slim(spark, path)
    late = (F.col("event_type") == "error") & (F.to_date("ts").between("2024-01-04", "2024-01-06"))
    job.ingest(rows.where(~late))
    job.clean()
    job.features(lookback="rows")
    job.ingest(rows)
    job.clean()
    job.features(lookback="rows")
    return _rounded(job.lake.read(FEATURES).drop("ts", "event_type", "date"))


def inference_table(spark, path):
    """Model-ready features straight from the raw layer: fill, clip, build."""
    from tidemark.plans.lake_job import inference_features

    df = _slim(spark, path).withColumn("reading", F.when(F.col("event_type") != "error", F.col("value")))
    lake = Lake(spark, scratch_path(spark, "lake"))
    lake.write(df.select("user_id", "event_id", "ts", "reading"), RAW, "ts")
    out = inference_features(lake, USERS, ["reading"], (1, 3), (3,), targets=["reading"])
    return out.select("user_id", "event_id", *[r(c, 5).alias(c) for c in (
        "reading", "reading_lag_1", "reading_lag_3", "reading_rmean_3")])


def late_append(spark, path):
    """Rows newer than the mark on a date already written are added to it, and only what is written is counted."""
    job = _job(spark)
    rows = _slim(spark, path)
    early = rows.where(F.col("ts") < "2024-01-15 12:00:00")
    job.ingest(early)
    job.ingest(rows)
    return date_counts(job.lake.read(RAW))


def late_before_mark(spark, path):
    """Errors arrive after rows far newer than they are, twice: each joins its date once."""
    job = _job(spark)
    rows = _slim(spark, path)
    job.ingest(rows.where(F.col("event_type") != "error"))
    job.ingest(rows)
    job.ingest(rows)
    return job.lake.read(RAW).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


def reject_rows(spark, path):
    """Rows without a time are kept apart, once, and counted in the manifests."""
    job = _job(spark)
    rows = _slim(spark, path).withColumn("ts", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    job.ingest(rows)
    job.ingest(rows)
    parts = manifest.load_all(spark, job.manifests).select(F.explode("partitions").alias("p"))
    counted = parts.groupBy(F.col("p.layer").alias("place")).agg(F.sum("p.rows").alias("counted"))
    both = [job.lake.read(n).select(F.lit(n).alias("place"), "event_id") for n in (RAW, REJECTED)]
    return both[0].unionByName(both[1]).groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).join(counted, "place")


def lake_new_column(spark, path):
    """A column that later deliveries bring is read back, missing in earlier rows."""
    job = _job(spark)
    rows = _slim(spark, path)
    job.ingest(rows.where(F.col("ts") < CUT).drop("value"))
    job.ingest(rows.where(F.col("ts") >= CUT))
    return job.lake.read(RAW).select("event_id", "value")


def late_side_table(spark, path):
    """The same with late rows kept apart."""
    job = _job(spark, policy="side")
    rows = _slim(spark, path)
    job.ingest(rows.where(F.col("ts") < "2024-01-15 12:00:00"))
    job.ingest(rows)
    raw = job.lake.read(RAW).withColumn("layer", F.lit("raw"))
    late = job.lake.read("late_rows").withColumn("layer", F.lit("late"))
    return raw.unionByName(late).groupBy("layer", "date").agg(F.count(F.lit(1)).alias("rows"))


def watermark_state(spark, path):
    """The stored mark after two ingests, and the manifests' totals."""
    job = _job(spark)
    rows = _slim(spark, path)
    job.ingest(rows.where(F.col("ts") < CUT))
    job.ingest(rows)
    parts = manifest.load_all(spark, job.manifests).select("status", F.explode("partitions").alias("p"))
    total = parts.where(F.col("status") == "success").agg(F.sum("p.rows").alias("manifest_rows"))
    mark = job.marks.current().select(
        "pipeline_name", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at"),
        "last_partition_date", "rows_ingested",
    )
    # both sides are one row
    return mark.withColumn("manifest_rows", total.scalar())


def csv_round_trip(spark, path):
    target = scratch_path(spark, "export")
    export_csv(table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"), target)
    out = read_csv(spark, target, "l_shipdate", "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate string")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("l_shipdate"))


def csv_folder(spark, path):
    """Every CSV of a folder, read as one registered source."""
    root = scratch_path(spark, "folder")
    df = events(spark, path).select("event_id", "event_type", "value")
    for kind in ("click", "error", "purchase", "signup", "view"):
        export_csv(df.where(F.col("event_type") == kind), f"{root}/{kind}")
    out = SOURCES.read(spark, "folder", folder=root, every=True, time=None, numeric=("value",),
                       schema="event_id long, event_type string, value string")
    return out.select("event_id", "event_type", "value")


def json_pages(spark, path):
    """Landed API pages read from the watermark on."""
    root = scratch_path(spark, "pages")
    row = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), "value")
    events(spark, path).select(F.array(row).alias("data")).write.json(root)
    out = read_json_pages(spark, root, "event_id long, date string, value double", start=CUT)
    return out.select("event_id", "value")


def reference_snapshot(spark, path):
    """The latest of two stored baselines with its metadata."""
    store = ReferenceStore(spark, scratch_path(spark, "reference"))
    df = _slim(spark, path)
    store.save(df.where(F.col("ts") < CUT), {"model": "first"})
    store.save(df.select("event_id", "value"), {"model": "second"})
    latest = store.metadata().where(F.col("snapshot") == store.latest())
    return latest.select("n_rows", "n_cols", F.array_join("columns", ",").alias("columns"),
                         F.col("extra")["model"].alias("model"))


def prediction_log_store(spark, path):
    from tidemark.catalog.monitoring import _log
    from tidemark.operators.metrics import quality_summary

    store = PredictionLog(spark, scratch_path(spark, "predictions"))
    log = _log(spark, path).withColumn("timestamp", F.col("ts"))
    for model in ("persistence", "damped"):
        store.append(log.where(F.col("model") == model))
    return quality_summary(store.read(), ["model", "target"])


def dataset_registry(spark, path):
    store = DatasetRegistry(spark, scratch_path(spark, "datasets"))
    df = _slim(spark, path)
    store.log(df, "events", "features", {"stage": "train"})
    store.log(df.where(F.col("ts") >= CUT).select("event_id", "value"), "events", "production")
    return store.entries().select("name", "context", "n_rows", "n_cols", F.col("tags")["stage"].alias("stage"))


QUERIES = {
    "lookback_features": lookback_features_query,
    **{f.__name__: f for f in (
        partition_counts, manifest_doc, list_dates, pending_dates, date_range_scan, date_scan, dates_scan, layer_snapshot,
        lookback_partitions, layer_files, lake_late_rows, lake_features, lake_incremental, inference_table, late_append, late_before_mark, reject_rows, lake_new_column,
        late_side_table, watermark_state, csv_round_trip, csv_folder,
        json_pages, reference_snapshot, prediction_log_store, dataset_registry)},
}

_CLEAN = """(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type,
  value ORDER BY ts, event_id) AS k FROM events) WHERE k = 1)"""
_FEATURES = f"""SELECT * FROM (SELECT user_id, event_id, value, {CYCLE_SQL}, {LAG_SQL}, {ROLL_SQL} FROM SRC)
  WHERE value_lag_7 IS NOT NULL"""
SQL = {
    "partition_counts": "SELECT CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY 1",
    "manifest_doc": """SELECT '{"pipeline":"lake","status":"success","partitions":[' || string_agg('{"date":"' || d
      || '","layer":"raw","rows":' || n || '}', ',' ORDER BY d) || ']}' AS manifest
      FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM events GROUP BY 1)""",
    "list_dates": "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events",
    "pending_dates": f"""SELECT CAST(ts AS DATE) AS date FROM events EXCEPT
      SELECT CAST(ts AS DATE) FROM events WHERE ts < TIMESTAMP '{CUT}'""",
    "date_range_scan": """SELECT event_id, CAST(ts AS DATE) AS date, value FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
    "date_scan": "SELECT event_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
    "dates_scan": """SELECT event_id, CAST(ts AS DATE) AS date, value FROM events
      WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-20')""",
    "layer_snapshot": "SELECT event_id, ts, value FROM events",
    "lookback_features": f"""SELECT * EXCLUDE (ts) FROM (SELECT ts, user_id, event_id, value, {CYCLE_SQL}, {LAG_SQL},
      {ROLL_SQL} FROM events) WHERE value_lag_7 IS NOT NULL AND ts >= TIMESTAMP '{MARK}'""",
    "lookback_partitions": f"""SELECT * EXCLUDE (ts) FROM (SELECT ts, user_id, event_id, value, {CYCLE_SQL}, {LAG_SQL},
      {ROLL_SQL} FROM (SELECT * FROM events WHERE CAST(ts AS DATE) >= (SELECT min(d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d
      FROM events WHERE ts < TIMESTAMP '{MARK}' ORDER BY d DESC LIMIT 7)))) WHERE value_lag_7 IS NOT NULL AND ts >= TIMESTAMP '{MARK}'""",
    "layer_files": f"""SELECT CAST(ts AS DATE) AS date, count(*) AS rows, count(*) AS read, CAST(sum(event_id) AS BIGINT) AS ids
      FROM events WHERE ts < TIMESTAMP '{CUT}' OR event_type <> 'error' GROUP BY 1""",
    "lake_late_rows": _FEATURES.replace("SRC", _CLEAN),
    "lake_features": _FEATURES.replace("SRC", _CLEAN),
    "lake_incremental": _FEATURES.replace("SRC", _CLEAN),
    "inference_table": None,
    "late_append": "SELECT CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY 1",
    "late_before_mark": """SELECT CAST(ts AS DATE) AS date, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids
      FROM events GROUP BY 1""",
    "reject_rows": """SELECT CASE WHEN event_id % 11 = 0 THEN 'rejected_rows' ELSE 'raw' END AS place, count(*) AS n,
      CAST(sum(event_id) AS BIGINT) AS ids, count(*) AS counted FROM events GROUP BY 1""",
    "lake_new_column": f"SELECT event_id, CASE WHEN ts >= TIMESTAMP '{CUT}' THEN value END AS value FROM events",
    "late_side_table": """SELECT CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' AND ts >= TIMESTAMP '2024-01-15 12:00:00'
      THEN 'late' ELSE 'raw' END AS layer, CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY ALL""",
    "watermark_state": f"""SELECT 'lake' AS pipeline_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_success_at,
      CAST(max(ts) AS DATE) AS last_partition_date, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS rows_ingested,
      count(*) AS manifest_rows FROM events""",
    "csv_round_trip": "SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem",
    "csv_folder": "SELECT event_id, event_type, value FROM events",
    "json_pages": f"SELECT event_id, value FROM events WHERE ts > TIMESTAMP '{CUT}'",
    "reference_snapshot": """SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_cols, 'event_id,value' AS columns,
      'second' AS model FROM events""",
    "prediction_log_store": None,
    "dataset_registry": f"""SELECT 'events' AS name, 'features' AS context, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols,
      'train' AS stage FROM events UNION ALL SELECT 'events', 'production', count(*), 2, NULL FROM events
      WHERE ts >= TIMESTAMP '{CUT}'""",
}


def _prediction_sql() -> str:
    from tidemark.catalog.monitoring import _QUALITY, LOG

    return f"SELECT model, target, {_QUALITY} FROM {LOG} GROUP BY model, target"


SQL["prediction_log_store"] = _prediction_sql()


def _inference_sql() -> str:
    from tidemark.catalog.common import PLAIN_W
    from tidemark.catalog.preprocess import _FILLED

    return f"""WITH m AS (SELECT user_id, event_id, coalesce(f, (SELECT median(f) FROM {_FILLED})) AS v FROM {_FILLED}),
      b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM m),
      c AS (SELECT m.user_id, m.event_id, ts, greatest(least(v, q3 + 3 * (q3 - q1)), q1 - 3 * (q3 - q1)) AS reading
        FROM m JOIN events USING (event_id), b)
      SELECT user_id, event_id, {sr('reading', 5)} AS reading, {sr('l1', 5)} AS reading_lag_1, {sr('l3', 5)} AS reading_lag_3,
        {sr('m3', 5)} AS reading_rmean_3 FROM (SELECT user_id, event_id, reading, lag(reading, 1) OVER w AS l1,
        lag(reading, 3) OVER w AS l3, avg(reading) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3 FROM c
        WINDOW w AS ({PLAIN_W})) WHERE l3 IS NOT NULL"""


SQL["inference_table"] = _inference_sql()
