"""Dimensions, summaries, correlations, distributions and forecast reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import GEO, TARGETS, USERS, W, events, geo, long_sql, r, sr, table
from tidemark.functions.columns import to_long
from tidemark.operators import analytics, frames

K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _targets(spark, path):
    return table(spark, path, "lineitem").select(*TARGETS)


def _located(spark, path):
    """Line items with the location and country of their supplier."""
    return table(spark, path, "lineitem").join(geo(spark, path), F.col("l_suppkey") == F.col("s_suppkey"))


LOCATED = f"(SELECT * FROM lineitem JOIN {GEO} ON l_suppkey = s_suppkey)"


def locations(spark, path):
    return analytics.locations(geo(spark, path), "location_name", "country", "latitude", "longitude", ["s_suppkey"])


def country_filter(spark, path):
    return analytics.locations(
        geo(spark, path), "location_name", "country", "latitude", "longitude", ["s_suppkey"], in_country="ASIA"
    )


def distinct_countries(spark, path):
    return analytics.distinct_values(geo(spark, path), "country")


def first_countries(spark, path):
    return analytics.distinct_values(_located(spark, path), "location_name", first=5)


def country_members(spark, path):
    dim = geo(spark, path).select("s_suppkey", "country")
    items = table(spark, path, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return analytics.members(items, dim, "s_suppkey", "country", "EUROPE").select("l_orderkey", "l_linenumber", "s_suppkey")


def entity_rows(spark, path):
    dim = geo(spark, path).select("location_name", "country", F.col("s_suppkey").alias("l_suppkey"))
    items = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return analytics.entity_rows(items, dim, "location_name", "l_suppkey", country="country", country_value="AFRICA")


def lake_summary(spark, path):
    return analytics.table_summary(_located(spark, path), "l_shipdate", "location_name", "country")


def target_stats(spark, path):
    return analytics.target_stats(_targets(spark, path), TARGETS)


def describe(spark, path):
    out = analytics.describe(_targets(spark, path), TARGETS)
    return out.select("feature", "count", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def date_bounds(spark, path):
    return analytics.date_bounds(events(spark, path).select(F.to_date("ts").alias("date")), "date")


def corr_pearson(spark, path):
    return analytics.pearson(_targets(spark, path), TARGETS).withColumn("corr", r("corr"))


def corr_spearman(spark, path):
    return analytics.spearman(_targets(spark, path), TARGETS).withColumn("corr", r("corr"))


def ols_trend(spark, path):
    out = analytics.trend(table(spark, path, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"),
                      r("r2").alias("r2"))


def histogram(spark, path):
    out = analytics.histogram(events(spark, path), "value", 20)
    return out.select(F.col("bin").cast("long").alias("bin"), r("lo").alias("lo"), r("hi").alias("hi"), "n")


def box_stats(spark, path):
    out = analytics.box_stats(to_long(_targets(spark, path), TARGETS), k=0.5)
    return out.select("feature", "n", "n_outliers", *[
        r(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")
    ])


def box_by_country(spark, path):
    long = _located(spark, path).select("country", F.col("l_extendedprice").alias("value"))
    out = analytics.box_stats(long, ["country"])
    return out.select("country", "n", "n_outliers", *[
        r(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")
    ])


def box_outliers(spark, path):
    long = to_long(events(spark, path), ["value"], ids=["event_id"])
    return analytics.outliers(long, ["feature"]).select("event_id", "feature", "value")


def density(spark, path):
    out = analytics.density(events(spark, path), "value", 25)
    return out.select(r("x").alias("x"), r("density", 8).alias("density"))


def country_means(spark, path):
    out = analytics.means_by(_located(spark, path), "country", TARGETS)
    return out.select("country", *[r(t, 4).alias(t) for t in TARGETS])


def melt_targets(spark, path):
    means = analytics.means_by(_located(spark, path), "country", TARGETS)
    return analytics.melt(means, ["country"], TARGETS).withColumn("Value", r("Value", 4))


def radar_norm(spark, path):
    means = analytics.means_by(_located(spark, path), "country", TARGETS).withColumn("flat", F.lit(3.0))
    out = analytics.min_max_norm(means, [*TARGETS, "flat"])
    return out.select("country", *[r(t, 4).alias(t) for t in (*TARGETS, "flat")])


def location_map(spark, path):
    dim = analytics.locations(geo(spark, path), "location_name", "country", "latitude", "longitude", ["s_suppkey"])
    out = analytics.location_map(_located(spark, path).select("location_name", *TARGETS), dim, "location_name",
                                 TARGETS, "l_discount")
    return out.select("location_name", "country", "latitude", "longitude", r("marker_size", 4).alias("marker_size"),
                      *[r(t, 4).alias(t) for t in TARGETS])


def pair_long(spark, path):
    out = analytics.pair_points(_targets(spark, path), [("l_quantity", "l_tax"), ("l_discount", "l_tax")])
    return out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x") * F.col("y")), 2).alias("sxy"))


def _forecast(spark, path):
    """The last seven steps per user: previous value as the forecast of two targets."""
    df = events(spark, path).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    ahead = (frames.persistence("value", "f_value") + frames.persistence("k", "f_k")).apply(df, USERS)
    last = frames.last_rows(ahead.select("user_id", "event_id", "ts", "f_value", "f_k"), USERS, 7, step="step")
    return last.select("user_id", "step", "f_value", "f_k")


FORECAST = f"""(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, f_value, f_k FROM (
  SELECT user_id, ts, event_id, coalesce(lag(value) OVER {W}, value) AS f_value, coalesce(lag({K}) OVER {W}, {K}) AS f_k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 7)"""


def _forecast_long(spark, path):
    return analytics.melt(_forecast(spark, path), ["user_id", "step"], ["f_value", "f_k"], "target", "value")


FORECAST_LONG = f"""(SELECT user_id, step, 'f_value' AS target, f_value AS value FROM {FORECAST} UNION ALL
  SELECT user_id, step, 'f_k', f_k FROM {FORECAST})"""


def forecast_stats(spark, path):
    out = analytics.forecast_stats(_forecast_long(spark, path), ["user_id", "target"])
    return out.select("user_id", "target", *[r(c, 4).alias(c) for c in ("mean", "min", "max", "std")])


def forecast_summary(spark, path):
    out = analytics.forecast_summary(_forecast_long(spark, path), ["user_id", "target"])
    return out.withColumn("values", F.array_join(F.transform("values", lambda v: F.format_number(v, 2)), ";"))


def forecast_comparison(spark, path):
    out = analytics.comparison(_forecast(spark, path), "step", "user_id", ["f_value", "f_k"])
    return out.withColumn("step", F.col("step").cast("long"))


def forecast_named(spark, path):
    """Forecast rows with the display name and unit of their target; unknown targets keep their own name."""
    info = analytics.target_info(spark, [("f_value", "Value", "ms")])
    means = analytics.forecast_stats(_forecast_long(spark, path), ["target"])
    return analytics.with_target_info(means, info).select("target", "display_name", "unit", r("mean", 4).alias("mean"))


QUERIES = {f.__name__: f for f in (
    locations, country_filter, distinct_countries, first_countries, country_members, entity_rows, lake_summary,
    target_stats, describe, date_bounds, corr_pearson, corr_spearman, ols_trend, histogram, box_stats, box_by_country,
    box_outliers, density, country_means, melt_targets, radar_norm, location_map, pair_long, forecast_stats,
    forecast_summary, forecast_comparison, forecast_named,
)}

_LOC = f"""SELECT location_name, arg_min(country, s_suppkey) AS country, {sr('avg(latitude)', 4)} AS latitude,
  {sr('avg(longitude)', 4)} AS longitude FROM {GEO} GROUP BY location_name"""
_PAIRS = [(a, b) for i, a in enumerate(TARGETS) for b in TARGETS[i + 1:]]
_AVGS = ", ".join(f"avg({t}) AS {t}" for t in TARGETS)
_MEANS = f"(SELECT country, {_AVGS} FROM {LOCATED} GROUP BY country)"


def _box(source: str, by: str, k: float) -> str:
    return f"""SELECT {by}, any_value(n) AS n, count(*) FILTER (value < lo OR value > hi) AS n_outliers,
      {sr('any_value(q1)', 4)} AS q1, {sr('any_value(med)', 4)} AS median, {sr('any_value(q3)', 4)} AS q3,
      {sr('min(value) FILTER (value BETWEEN lo AND hi)', 4)} AS whisker_lo,
      {sr('max(value) FILTER (value BETWEEN lo AND hi)', 4)} AS whisker_hi
      FROM ({source}) JOIN (SELECT {by}, n, q1, med, q3, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM (
        SELECT {by}, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
        FROM ({source}) GROUP BY {by})) USING ({by}) GROUP BY {by}"""


def _avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


SQL = {
    "locations": _LOC,
    "country_filter": f"SELECT * FROM ({_LOC}) WHERE country = 'ASIA'",
    "distinct_countries": f"SELECT DISTINCT country FROM {GEO}",
    "first_countries": f"SELECT DISTINCT location_name FROM {LOCATED} ORDER BY location_name LIMIT 5",
    "country_members": f"""SELECT l_orderkey, l_linenumber, l_suppkey AS s_suppkey FROM lineitem WHERE l_suppkey IN
      (SELECT s_suppkey FROM {GEO} WHERE country = 'EUROPE')""",
    "entity_rows": f"""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN
      (SELECT s_suppkey FROM {GEO} WHERE country = 'AFRICA')""",
    "lake_summary": f"""SELECT count(*) AS total_rows, CAST(min(l_shipdate) AS DATE) AS first_date,
      CAST(max(l_shipdate) AS DATE) AS last_date, count(DISTINCT location_name) AS n_locations,
      count(DISTINCT country) AS n_countries FROM {LOCATED}""",
    "target_stats": f"""SELECT feature, {sr('avg(value)', 4)} AS mean, {sr('stddev_samp(value)', 4)} AS std,
      {sr('min(value)', 4)} AS min, {sr('max(value)', 4)} AS max FROM ({long_sql()}) GROUP BY feature""",
    "describe": f"""SELECT feature, count(value) AS count, {sr('avg(value)', 4)} AS mean, {sr('stddev_samp(value)', 4)} AS std,
      {sr('min(value)', 4)} AS min, {sr('quantile_cont(value, 0.25)', 4)} AS p25, {sr('median(value)', 4)} AS p50,
      {sr('quantile_cont(value, 0.75)', 4)} AS p75, {sr('max(value)', 4)} AS max FROM ({long_sql()}) GROUP BY feature""",
    "date_bounds": "SELECT CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM events",
    "corr_pearson": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {sr(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in _PAIRS),
    "corr_spearman": "WITH k AS (SELECT " + ", ".join(f"{_avg_rank(t)} AS {t}" for t in TARGETS) + " FROM lineitem) "
      + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sr(f'corr({a}, {b})')} AS corr FROM k" for a, b in _PAIRS),
    "ols_trend": f"""SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
      {sr('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope,
      {sr('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept,
      {sr('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY l_returnflag""",
    "histogram": f"""SELECT bin, {sr('lo + (bin - 1) * (hi - lo) / 20')} AS lo, {sr('lo + bin * (hi - lo) / 20')} AS hi,
      count(*) AS n FROM (SELECT lo, hi, CAST(least(floor((value - lo) / (hi - lo) * 20) + 1, 20) AS BIGINT) AS bin
      FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY bin, lo, hi""",
    "box_stats": _box(long_sql(), "feature", 0.5),
    "box_by_country": _box(f"SELECT country, l_extendedprice AS value FROM {LOCATED}", "country", 1.5),
    "box_outliers": """SELECT event_id, 'value' AS feature, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "density": f"""SELECT {sr('x')} AS x, {sr('avg(exp(-0.5 * pow((value - x) / h, 2))) / (any_value(h) * sqrt(2 * pi()))', 8)}
      AS density FROM events, (SELECT lo + (hi - lo) * i / 24 AS x, h FROM (SELECT min(value) AS lo, max(value) AS hi,
      stddev_samp(value) * pow(count(*), -0.2) AS h FROM events), (SELECT unnest(range(25)) AS i)) GROUP BY x""",
    "country_means": "SELECT country, " + ", ".join(f"{sr(f'avg({t})', 4)} AS {t}" for t in TARGETS)
      + f" FROM {LOCATED} GROUP BY country",
    "melt_targets": " UNION ALL ".join(
        f"SELECT country, '{t}' AS \"Target\", {sr(t, 4)} AS \"Value\" FROM {_MEANS}" for t in TARGETS),
    "radar_norm": "SELECT country, " + ", ".join(
        f"{sr(f'({t} - min({t}) OVER ()) / (max({t}) OVER () - min({t}) OVER ())', 4)} AS {t}" for t in TARGETS)
      + f", CAST(0.5 AS DOUBLE) AS flat FROM {_MEANS}",
    "location_map": f"SELECT location_name, country, latitude, longitude, {sr('greatest(abs(l_discount), 0.1)', 4)} AS "
      "marker_size, " + ", ".join(f"{sr(t, 4)} AS {t}" for t in TARGETS)
      + f" FROM (SELECT location_name, {_AVGS} FROM {LOCATED} GROUP BY location_name) JOIN ({_LOC}) USING (location_name)",
    "pair_long": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {sr(f'sum({a} * {b})', 2)} AS sxy FROM lineitem"
        for a, b in (("l_quantity", "l_tax"), ("l_discount", "l_tax"))),
    "forecast_stats": f"""SELECT user_id, target, {sr('avg(value)', 4)} AS mean, {sr('min(value)', 4)} AS min,
      {sr('max(value)', 4)} AS max, {sr('stddev_samp(value)', 4)} AS std FROM {FORECAST_LONG} GROUP BY user_id, target""",
    "forecast_summary": f"""SELECT user_id, target, string_agg(printf('%.2f', value), ';' ORDER BY step) AS "values",
      {sr('avg(value)', 4)} AS mean, {sr('min(value)', 4)} AS min, {sr('max(value)', 4)} AS max FROM {FORECAST_LONG}
      GROUP BY user_id, target""",
    "forecast_comparison": f"SELECT user_id, CAST(step AS BIGINT) AS step, f_value, f_k FROM {FORECAST}",
    "forecast_named": f"""SELECT target, CASE target WHEN 'f_value' THEN 'Value' ELSE target END AS display_name,
      CASE target WHEN 'f_value' THEN 'ms' ELSE '' END AS unit, {sr('avg(value)', 4)} AS mean FROM {FORECAST_LONG}
      GROUP BY target""",
}
