"""Filters, de-duplication, coercion and the watermark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import GAPPED, events, gapped, r, sr, table
from tidemark.operators import rows

CUTOFF = "2024-01-15 12:00:00"


def _readings(spark, path):
    """Coarse readings, so that equal ones repeat at different times."""
    return events(spark, path).select(
        "event_id", "ts", F.to_date("ts").alias("date"), "event_type", F.round("value", 0).alias("level")
    )


def dedup_rows(spark, path):
    """Equal readings of one date collapse to the earliest: the time itself is not compared."""
    out = rows.dedup(_readings(spark, path), "ts", tiebreak=["event_id"])
    return out.select("event_id", "ts", "event_type", "level")


def dedup_exact(spark, path):
    return rows.dedup(table(spark, path, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


def dropna_any(spark, path):
    return rows.drop_any_missing(gapped(spark, path)).select("event_id", "reading")


def dropna_all(spark, path):
    df = gapped(spark, path).select("event_id", "reading", F.when(F.col("value") > 20, F.col("value")).alias("high"))
    return rows.drop_all_missing(df, ["reading", "high"])


def drop_columns(spark, path):
    df = rows.drop_present(events(spark, path), ["props", "ts", "moonrise"])
    return df


def numeric_coerce(spark, path):
    """Numbers out of text; bad text becomes missing."""
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    df = events(spark, path).select("event_id", text.alias("k"))
    return rows.coerce_numeric(df, ["k", "absent"])


def time_coerce(spark, path):
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.ensure_time(events(spark, path).select("event_id", text.alias("at")), "at")


def infinity_flags(spark, path):
    from tidemark.functions.scalars import is_infinite

    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("inf")))
    df = table(spark, path, "lineitem").select("l_returnflag", ratio.alias("ratio"))
    return df.groupBy("l_returnflag").agg(F.count_if(is_infinite(F.col("ratio"))).alias("n_inf"))


def watermark_filter(spark, path):
    return rows.after_watermark(events(spark, path), "ts", CUTOFF).select("event_id", "ts")


def watermark_next(spark, path):
    """The mark after a batch: latest time, latest date, rows."""
    from tidemark.sources.state import advance

    return advance(rows.after_watermark(events(spark, path), "ts", CUTOFF), "ts")


def rule_chain(spark, path):
    """Validation rules applied in order."""
    return rows.chain(
        gapped(spark, path).select("event_id", "ts", "reading"),
        lambda d: rows.ensure_time(d, "ts"),
        lambda d: rows.drop_all_missing(d, ["reading"]),
        lambda d: d.withColumn("reading", r("reading", 1)),
    ).select("event_id", "reading")


QUERIES = {f.__name__: f for f in (
    dedup_rows, dedup_exact, dropna_any, dropna_all, drop_columns, numeric_coerce, time_coerce, infinity_flags,
    watermark_filter, watermark_next, rule_chain,
)}
SQL = {
    "dedup_rows": """SELECT event_id, ts, event_type, level FROM (SELECT event_id, ts, event_type,
        round(value, 0) AS level, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type, round(value, 0)
        ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""",
    "dedup_exact": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem",
    "dropna_any": f"SELECT event_id, reading FROM {GAPPED} WHERE reading IS NOT NULL",
    "dropna_all": f"""SELECT * FROM (SELECT event_id, reading, CASE WHEN value > 20 THEN value END AS high FROM {GAPPED})
        WHERE reading IS NOT NULL OR high IS NOT NULL""",
    "drop_columns": "SELECT event_id, user_id, event_type, value FROM events",
    "numeric_coerce": """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a'
        ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events""",
    "time_coerce": """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS at
        FROM events""",
    "infinity_flags": """SELECT l_returnflag, count(*) FILTER (l_discount <= 0) AS n_inf FROM lineitem
        GROUP BY l_returnflag""",
    "watermark_filter": f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{CUTOFF}'",
    "watermark_next": f"""SELECT max(ts) AS last_success_at, CAST(max(ts) AS DATE) AS last_partition_date,
        count(*) AS rows_ingested FROM events WHERE ts > TIMESTAMP '{CUTOFF}'""",
    "rule_chain": f"SELECT event_id, {sr('reading', 1)} AS reading FROM {GAPPED} WHERE reading IS NOT NULL",
}
