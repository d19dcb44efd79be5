"""Window features, encodings, fills and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import GAPPED, GEO, PLAIN_W, USERS, W, events, gapped, geo, r, sr, table
from tidemark.functions import scalars
from tidemark.operators import features, fill, frames
from tidemark.operators.panel import probe_layout

LAGS, WINDOWS = (1, 3, 7), (3, 7)
CYCLES = {
    "doy": ("dayofyear(ts)", 365.25), "month": ("month(ts)", 12.0), "dow": ("(isodow(ts) - 1)", 7.0),
}
CYCLE_SQL = ", ".join(
    f"{sr(f'{fn}({v} * (2 * pi()) / {p})')} AS {n}_{fn}" for n, (v, p) in CYCLES.items() for fn in ("sin", "cos")
)
LAG_SQL = ", ".join(f"lag(value, {k}) OVER {W} AS value_lag_{k}" for k in LAGS)


def _rows(n: int) -> str:
    return f"OVER ({PLAIN_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ROLL_SQL = ", ".join(
    f"{sr(f'avg(value) {_rows(n)}')} AS value_rmean_{n}, {sr(f'stddev_samp(value) {_rows(n)}')} AS value_rstd_{n}"
    for n in WINDOWS
)
DIFFS = {"value_change_1": ("value", 1), "value_change_3": ("value", 3)}
DIFF_SQL = ", ".join(f"{sr(f'value - lag(value, {k}) OVER {W}')} AS {n}" for n, (_, k) in DIFFS.items())


def _rounded(df, skip=()):
    return df.select(*[
        r(f.name).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
        for f in df.schema
    ])


def feat_lag(spark, path):
    out = frames.lags(["value"], LAGS).apply(events(spark, path), USERS)
    return out.select("user_id", "event_id", *[f"value_lag_{k}" for k in LAGS])


def feat_rolling(spark, path):
    out = frames.rolling(["value"], WINDOWS).apply(events(spark, path), USERS)
    return _rounded(out.drop("ts", "event_type", "value", "props"))


def feat_diff(spark, path):
    out = frames.differences(DIFFS).apply(events(spark, path), USERS)
    return _rounded(out.select("user_id", "event_id", *DIFFS))


def feat_cyclical(spark, path):
    out = features.add_cyclical(events(spark, path).select("event_id", "ts"), "ts")
    return _rounded(out.drop("ts"))


def feat_hour(spark, path):
    out = features.add_cyclical(events(spark, path).select("event_id", "ts"), "ts", hour=True)
    return _rounded(out.select("event_id", "hour_sin", "hour_cos"))


def feat_direction(spark, path):
    base = table(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 7.2).alias("wind_degree")
    )
    return _rounded(features.add_direction(base))


def feat_interaction(spark, path):
    base = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    pairs = {"qty_x_discount": ("l_quantity", "l_discount"), "qty_x_tax": ("l_quantity", "l_tax"),
             "absent": ("l_quantity", "no_such_column")}
    out = features.add_interactions(base, pairs)
    return _rounded(out.drop("l_quantity", "l_discount", "l_tax"))


def _daylight(spark, path):
    minutes = F.make_interval(mins=F.floor(F.col("value")).cast("int"))
    base = events(spark, path).select(
        "event_id",
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "hh:mm a")).alias("sunrise"),
        F.date_format(F.col("ts") + minutes, "hh:mm a").alias("sunset"),
    )
    return features.add_daylight(base, "day")


def feat_daylight(spark, path):
    return _rounded(_daylight(spark, path).drop("day"))


def daylight_stats(spark, path):
    from tidemark.operators.analytics import derived_stats

    return _rounded(derived_stats(_daylight(spark, path), "daylight_hours"))


DAYLIGHT = """(SELECT event_id, abs(epoch(try_strptime(d || ' ' || sunset, '%Y-%m-%d %I:%M %p'))
    - epoch(try_strptime(d || ' ' || sunrise, '%Y-%m-%d %I:%M %p'))) / 3600.0 AS daylight_hours
  FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d,
    CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%I:%M %p') END AS sunrise,
    strftime(ts + to_minutes(CAST(floor(value) AS INTEGER)), '%I:%M %p') AS sunset FROM events))"""


def feat_entity_code(spark, path):
    out = features.add_entity_code(geo(spark, path), "location_name", "location_id")
    return out.select("s_suppkey", "location_name", F.col("location_id").cast("long").alias("location_id"))


def feature_table(spark, path):
    """The flagship: every window feature, calendar encodings, complete rows only; one shuffle of the panel."""
    out = features.build_features(
        events(spark, path).select("user_id", "event_id", "ts", "value"), USERS, ["value"], ["value"], LAGS, WINDOWS,
        diffs=DIFFS, drop=("ts",),
    )
    return _rounded(out)


def feature_table_orders(spark, path):
    """The same chain on another panel: orders per customer."""
    from tidemark.spec import PanelSpec

    spec = PanelSpec(("o_custkey",), "o_orderdate", ("o_orderkey",))
    out = features.build_features(
        table(spark, path, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), spec,
        ["o_totalprice"], ["o_totalprice"], (1,), (3,), drop=("o_orderdate",),
    )
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_totalprice_lag_1",
                      r("o_totalprice_rmean_3", 3).alias("o_totalprice_rmean_3"),
                      r("o_totalprice_rstd_3", 3).alias("o_totalprice_rstd_3"), r("doy_sin").alias("doy_sin"))


def fill_ffill_bfill(spark, path):
    out = fill.fill_along_time(gapped(spark, path), USERS, ["reading"])
    return out.select("user_id", "event_id", "reading")


def fill_interpolate(spark, path):
    out = fill.interpolate(gapped(spark, path), USERS, ["reading"], limit=3)
    return _rounded(out.select("user_id", "event_id", "reading"))


def fill_median(spark, path):
    out = fill.fill_median(gapped(spark, path).select("event_id", "reading"), ["reading"])
    return _rounded(out)


def sequences(spark, path):
    seq_len, horizon = 5, 2
    out = frames.sequences(events(spark, path), USERS, ["value"], ["value"], seq_len, horizon)
    flat = F.transform(F.col("x"), lambda f: f[0].cast("double"))
    total = F.aggregate(F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)  # the order counts
    return out.select("user_id", "event_id", r(total, 3).alias("x_sum"), F.size("x").cast("long").alias("x_len"),
                      r(F.col("y")[0].cast("double"), 3).alias("y"))


def last_n_steps(spark, path):
    out = frames.last_rows(events(spark, path), USERS, 7, step="step")
    return out.select("user_id", "event_id", F.col("step").cast("long").alias("step"), "value")


def layout_counts(spark, path):
    """Rows per entity as the layout probe sees them, from a probe forced to cut (same totals as without)."""
    df = events(spark, path)
    spec = USERS.with_(hot_rows=1)
    from tidemark.operators.panel import with_neighbours

    placed = with_neighbours(df, spec, [], probe_layout(df, spec))
    return placed.groupBy("user_id").agg(F.max("_pos").alias("n_rows"), F.countDistinct("_pos").alias("n_positions"))


def skewed_features(spark, path):
    """Lags and rolling means with every entity cut into time slots: equal to the uncut result."""
    df = events(spark, path).select("event_type", "event_id", "ts", "value")
    from tidemark.catalog.common import TYPES

    spec = TYPES.with_(hot_rows=max(1, df.count() // 20))
    out = (frames.lags(["value"], (1, 24)) + frames.rolling(["value"], (24,))).apply(df, spec)
    return _rounded(out.drop("ts", "value"))


def target_difference(spark, path):
    """Two target series of one step, their difference."""
    return table(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", r(F.col("l_discount") - F.col("l_tax")).alias("difference")
    )


QUERIES = {f.__name__: f for f in (
    feat_lag, feat_rolling, feat_diff, feat_cyclical, feat_hour, feat_direction, feat_interaction, feat_daylight,
    daylight_stats, feat_entity_code, feature_table, feature_table_orders, fill_ffill_bfill, fill_interpolate,
    fill_median, sequences, last_n_steps, layout_counts, skewed_features, target_difference,
)}

TW = "PARTITION BY event_type ORDER BY ts, event_id"
SQL = {
    "feat_lag": f"SELECT user_id, event_id, {LAG_SQL} FROM events",
    "feat_rolling": f"SELECT user_id, event_id, {ROLL_SQL} FROM events",
    "feat_diff": f"SELECT user_id, event_id, {DIFF_SQL} FROM events",
    "feat_cyclical": f"SELECT event_id, {CYCLE_SQL} FROM events",
    "feat_hour": f"SELECT event_id, {sr('sin(hour(ts) * (2 * pi()) / 24.0)')} AS hour_sin, "
                 f"{sr('cos(hour(ts) * (2 * pi()) / 24.0)')} AS hour_cos FROM events",
    "feat_direction": f"SELECT l_orderkey, l_linenumber, {sr('sin(radians(l_quantity * 7.2))')} AS wind_dir_sin, "
                      f"{sr('cos(radians(l_quantity * 7.2))')} AS wind_dir_cos FROM lineitem",
    "feat_interaction": f"SELECT l_orderkey, l_linenumber, {sr('l_quantity * l_discount')} AS qty_x_discount, "
                        f"{sr('l_quantity * l_tax')} AS qty_x_tax FROM lineitem",
    "feat_daylight": f"SELECT event_id, {sr('daylight_hours')} AS daylight_hours FROM {DAYLIGHT}",
    "daylight_stats": f"SELECT {sr('avg(daylight_hours)')} AS mean, {sr('min(daylight_hours)')} AS min, "
                      f"{sr('max(daylight_hours)')} AS max FROM {DAYLIGHT}",
    "feat_entity_code": f"SELECT s_suppkey, location_name, CAST(dense_rank() OVER (ORDER BY location_name) - 1 AS BIGINT)"
                        f" AS location_id FROM {GEO}",
    "feature_table": f"""SELECT * FROM (SELECT user_id, event_id, value, {CYCLE_SQL}, {LAG_SQL}, {ROLL_SQL}, {DIFF_SQL}
        FROM events) WHERE value_lag_7 IS NOT NULL""",
    "feature_table_orders": f"""SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice,
        lag(o_totalprice) OVER w AS o_totalprice_lag_1,
        {sr('avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS o_totalprice_rmean_3,
        {sr('stddev_samp(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS o_totalprice_rstd_3,
        {sr('sin(dayofyear(o_orderdate) * (2 * pi()) / 365.25)')} AS doy_sin
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        WHERE o_totalprice_lag_1 IS NOT NULL""",
    "fill_ffill_bfill": f"""SELECT user_id, event_id, coalesce(
        last_value(reading IGNORE NULLS) OVER ({PLAIN_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(reading IGNORE NULLS) OVER ({PLAIN_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS reading
        FROM {GAPPED}""",
    "fill_interpolate": f"""WITH p AS (SELECT *, row_number() OVER {W} AS i FROM {GAPPED}),
      q AS (SELECT user_id, event_id, reading, i,
        last_value(reading IGNORE NULLS) OVER before AS pv,
        last_value(CASE WHEN reading IS NOT NULL THEN i END IGNORE NULLS) OVER before AS pi,
        first_value(reading IGNORE NULLS) OVER after AS nv,
        first_value(CASE WHEN reading IS NOT NULL THEN i END IGNORE NULLS) OVER after AS ni FROM p
        WINDOW before AS ({PLAIN_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               after AS ({PLAIN_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT user_id, event_id, {sr('''CASE WHEN reading IS NOT NULL THEN reading WHEN i - pi <= 3 THEN
        coalesce(pv + (nv - pv) * (i - pi) / (ni - pi), pv) END''')} AS reading FROM q""",
    "fill_median": f"SELECT event_id, {sr(f'coalesce(reading, (SELECT median(reading) FROM {GAPPED}))')} AS reading "
                   f"FROM {GAPPED}",
    "sequences": f"""SELECT user_id, event_id, {sr('l[1] + 2 * l[2] + 3 * l[3] + 4 * l[4] + 5 * l[5]', 3)} AS x_sum, CAST(len(l) AS BIGINT) AS x_len,
        {sr('CAST(CAST(value AS FLOAT) AS DOUBLE)', 3)} AS y FROM (SELECT user_id, event_id, value,
        list(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER ({PLAIN_W} ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS l
        FROM events) WHERE len(l) = 5""",
    "last_n_steps": """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
        AS BIGINT) AS step, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
        event_id DESC) AS k FROM events) WHERE k <= 7""",
    "layout_counts": "SELECT user_id, count(*) AS n_rows, count(*) AS n_positions FROM events GROUP BY user_id",
    "skewed_features": f"""SELECT event_type, event_id, lag(value, 1) OVER ({TW}) AS value_lag_1,
        lag(value, 24) OVER ({TW}) AS value_lag_24,
        {sr(f'avg(value) OVER ({TW} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)')} AS value_rmean_24,
        {sr(f'stddev_samp(value) OVER ({TW} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)')} AS value_rstd_24
        FROM events""",
    "target_difference": f"SELECT l_orderkey, l_linenumber, {sr('l_discount - l_tax')} AS difference FROM lineitem",
}
