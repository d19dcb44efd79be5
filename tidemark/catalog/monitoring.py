"""Quality gates, drift, prediction quality and model metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.common import CUT, GAPPED, TARGETS, USERS, W, even_sql, events, gapped, r, sr, steady_sql, table
from tidemark.functions.stats import half_even
from tidemark.operators import drift, frames, metrics, quality

SHIP_CUT = "1998-06-01"


def null_profile(spark, path):
    out = quality.null_profile(gapped(spark, path).select("event_id", "reading", "event_type"))
    return out.withColumn("null_pct", r("null_pct"))


def validation_stats(spark, path):
    ratio = F.when(F.col("value") > 400, F.lit(float("inf"))).otherwise(F.col("value"))
    df = gapped(spark, path).select("event_id", "reading", ratio.alias("ratio"))
    return quality.validation_stats(df).withColumn("null_pct", r("null_pct"))


def readiness(spark, path):
    df = gapped(spark, path).select(F.to_date("ts").alias("date"), "event_id", "reading", "value", "user_id")
    out = quality.readiness(df, "date", F.lit("2024-01-25").cast("date"), block_null_pct=10.0)
    return out.withColumn("null_pct", r("null_pct"))


def quality_tests(spark, path):
    df = gapped(spark, path).select("event_type", "user_id", "reading", F.lit("same").alias("fixed"))
    return quality.quality_tests(df).withColumn("value", r("value"))


def stability_tests(spark, path):
    df = events(spark, path).select("ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    old, new = df.where(F.col("ts") < CUT).drop("ts"), df.where(F.col("ts") >= CUT).drop("ts")
    return quality.stability_tests(old, new).withColumn("value", r("value"))


def _sides(spark, path):
    df = table(spark, path, "lineitem")
    return drift.sided(df, F.col("l_shipdate") >= F.lit(SHIP_CUT).cast("date"), TARGETS)


def _event_sides(spark, path):
    df = events(spark, path).withColumns({
        "k": F.get_json_object("props", "$.k").cast("double"), "position": F.col("event_id").cast("double")
    })
    return drift.sided(df, F.col("ts") >= CUT, ["value", "k", "position"])


def ks_drift(spark, path):
    return drift.ks(_sides(spark, path))


def ks_drift_binned(spark, path):
    """The same test with every column's distribution function built bin by bin."""
    return drift.ks(_sides(spark, path), bins=64)


def drift_score(spark, path):
    out = drift.dataset_drift(drift.ks(_event_sides(spark, path)))
    return out.withColumn("drifted_features", F.array_join("drifted_features", ","))


def concept_drift(spark, path):
    return drift.concept_drift(drift.ks(_event_sides(spark, path)), ["value", "absent"])


def drift_verdict(spark, path):
    out = drift.verdict(drift.ks(_event_sides(spark, path)), ["value"])
    return out.withColumn("drifted_features", F.array_join("drifted_features", ","))


def time_drift(spark, path):
    """Drift of a table against its own last fifth of rows; hours tie many rows."""
    return drift.own_past(events(spark, path).withColumn("ts", F.date_trunc("hour", "ts")), USERS, ["value"])


def performance_status(spark, path):
    """The status of a log of no, 40, 60 and all rows of a model: the guard holds for the log, not for its halves."""
    log = _log(spark, path).where("model = 'damped'")
    order = Window.orderBy("ts", "event_id", "target")
    first = log.orderBy("ts", "event_id", "target").limit(60).withColumn("_n", F.row_number().over(order))  # 60 rows
    parts = {"none": log.where("false"), "40": first.where("_n <= 40"), "60": first, "all": log}
    each = [metrics.performance_report(part.drop("_n"), ["ts"]).select(F.lit(name).alias("log"), "side", "n", "status")
            for name, part in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


def wasserstein(spark, path):
    out = drift.wasserstein(_sides(spark, path))
    return out.withColumns({"distance": r("distance"), "normed": r("normed")})


def wasserstein_binned(spark, path):
    out = drift.wasserstein(_sides(spark, path), bins=64)
    return out.withColumns({"distance": r("distance"), "normed": r("normed")})


def js_divergence(spark, path):
    return drift.js_divergence(events(spark, path), F.col("ts") >= CUT, "event_type").withColumn("distance", r("distance"))


def chi_square(spark, path):
    out = drift.chi_square(events(spark, path), F.col("ts") >= CUT, "event_type")
    return out.withColumns({"chi2": r("chi2"), "critical_95": r("critical_95")})


def proportion_z(spark, path):
    out = drift.proportion_z(events(spark, path), F.col("ts") >= CUT, F.col("event_type") == "error", "error_rate")
    return out.withColumns({c: r(c) for c in ("p_ref", "p_cur", "z")})


def _log(spark, path):
    """A prediction log in long form: two models, two targets, each user's previous value as the prediction."""
    df = events(spark, path).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    ahead = (frames.persistence("value", "p_value") + frames.persistence("k", "p_k")).apply(df, USERS)
    model = F.explode(F.array(
        F.struct(F.lit("persistence").alias("model"), F.lit(1.0).alias("f")),
        F.struct(F.lit("damped").alias("model"), F.lit(0.5).alias("f")),
    )).alias("m")
    wide = ahead.select("event_id", "ts", "user_id", F.col("event_type").alias("location"),
                        F.col("value").alias("inference_time_ms"), "value", "k", "p_value", "p_k", model)
    wide = wide.select(
        "event_id", "ts", "location", "inference_time_ms", F.col("m.model").alias("model"),
        F.array("value", "k").alias("y_true"),
        F.array(F.col("p_value") * F.col("m.f"), F.col("p_k") * F.col("m.f")).alias("y_pred"),
    )
    return metrics.prediction_rows(wide, ["value", "k", "never_sent"])


LOG = f"""(WITH b AS (SELECT event_id, ts, event_type AS location, value AS inference_time_ms, value, k,
    coalesce(lag(value) OVER {W}, value) AS p_value, coalesce(lag(k) OVER {W}, k) AS p_k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
  m(model, f) AS (VALUES ('persistence', CAST(1.0 AS DOUBLE)), ('damped', CAST(0.5 AS DOUBLE))),
  l AS (SELECT event_id, ts, location, inference_time_ms, model, 'value' AS target, value AS y_true,
      p_value * f AS y_pred FROM b, m
    UNION ALL SELECT event_id, ts, location, inference_time_ms, model, 'k', k, p_k * f FROM b, m)
  SELECT *, abs(y_true - y_pred) AS absolute_error, (y_true - y_pred) * (y_true - y_pred) AS squared_error FROM l)"""


def prediction_log(spark, path):
    return _log(spark, path).select(
        "event_id", "model", "location", "target", "y_true", r("y_pred").alias("y_pred"),
        r("absolute_error").alias("absolute_error"), r("squared_error").alias("squared_error"),
    )


def pred_quality(spark, path):
    return metrics.quality_summary(_log(spark, path), ["model", "location", "target"])


def pred_quality_sets(spark, path):
    return metrics.quality_sets(_log(spark, path))


def reg_metrics(spark, path):
    out = metrics.regression_metrics(_log(spark, path))
    return out.select("model", "target", "n", *[r(c, 5).alias(c) for c in ("MAE", "MSE", "RMSE", "R2")])


def reg_summary(spark, path):
    out = metrics.summarise(metrics.regression_metrics(_log(spark, path)))
    return out.select("model", *[r(c, 5).alias(c) for c in ("avg_mae", "avg_rmse", "avg_r2")])


def metrics_ranked(spark, path):
    """Metrics as a map per model and back to a table."""
    maps = metrics.metrics_map(metrics.regression_metrics(_log(spark, path)))
    out = metrics.metrics_table(maps, "model")
    return out.select("model", "target", *[half_even(F.col(c), 5).alias(c) for c in ("MAE", "RMSE", "R2")])


def champion(spark, path):
    out = metrics.champion(metrics.summarise(metrics.regression_metrics(_log(spark, path))))
    return out.withColumn("best_r2", r("best_r2", 5))


def performance_split(spark, path):
    log = _log(spark, path)
    out = metrics.performance_report(log, ["ts"], model="persistence", halves=F.col("ts") >= CUT)
    return out.select("side", "n", "status", *[
        r(c, 5).alias(c) for c in ("mean_error", "mae", "mape", "rmse", "r2", "max_abs_error", "error_std")
    ])


def performance_halves(spark, path):
    """The log cut into two halves of equal rows by time."""
    out = metrics.performance_report(_log(spark, path), ["ts"], model="damped", location="click")
    return out.select("side", "n", "status", r("mae", 5).alias("mae"), r("rmse", 5).alias("rmse"))


def first_predictions(spark, path):
    log = _log(spark, path).where((F.col("model") == "persistence") & (F.col("target") == "value"))
    out = metrics.first_predictions(log, ["ts", "event_id"], "y_true", "y_pred", 500)
    return out.select(F.col("index").cast("long").alias("index"), "event_id", "actual", "predicted", r("error").alias("error"))


def flat_metrics(spark, path):
    """Nested metric maps as one level of ``model/target`` keys."""
    from tidemark.functions.scalars import flatten_map, short_name

    base = metrics.regression_metrics(_log(spark, path))
    per_model = base.groupBy("model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", r("MAE", 8).alias("v"))))).alias("t")
    )
    nested = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model", "t"))).alias("m"))
    flat = nested.select(F.explode(flatten_map(F.col("m"))).alias("key", "mae"))
    return flat.select(short_name(F.col("key"), "persistence", "last").alias("key"), "mae")


QUERIES = {f.__name__: f for f in (
    null_profile, validation_stats, readiness, quality_tests, stability_tests, ks_drift, ks_drift_binned, drift_score,
    concept_drift, drift_verdict, time_drift, wasserstein, wasserstein_binned, js_divergence, chi_square, proportion_z,
    prediction_log, pred_quality, pred_quality_sets, reg_metrics, reg_summary, metrics_ranked, champion,
    performance_split, performance_halves, performance_status, first_predictions, flat_metrics,
)}

SIDES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, l_shipdate >= DATE '{SHIP_CUT}' AS cur FROM lineitem" for c in TARGETS
)
EVENT_SIDES = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {x} AS value, ts >= TIMESTAMP '{CUT}' AS cur FROM events" for n, x in (
        ("value", "value"), ("k", "CAST(json_extract_string(props, '$.k') AS DOUBLE)"),
        ("position", "CAST(event_id AS DOUBLE)"))
)


def _steps(sides: str) -> str:
    return f"""(SELECT feature, value, r, c, sum(r) OVER w AS rc, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature)
      AS n1, sum(c) OVER (PARTITION BY feature) AS n2, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nx
      FROM (SELECT feature, value, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM ({sides}) GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING))"""


def _ks(sides: str) -> str:
    return f"""SELECT feature AS "column", {sr('d')} AS ks_statistic, {sr('p')} AS p_value, p < 0.05 AS drift_detected,
        CAST(n1 AS BIGINT) AS n_ref, CAST(n2 AS BIGINT) AS n_cur FROM (
      SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
          lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS p FROM (
        SELECT *, (e + 0.12 + 0.11 / e) * d AS lam FROM (
          SELECT feature, max(abs(rc / n1 - cc / n2)) AS d, max(n1) AS n1, max(n2) AS n2,
            sqrt(CAST(max(n1) AS DOUBLE) * max(n2) / (max(n1) + max(n2))) AS e FROM {_steps(sides)} GROUP BY feature)))"""


_WASS = f"""SELECT feature AS "column", {sr('d')} AS distance, {sr('d / sd')} AS normed, d / sd >= 0.1 AS drift_detected FROM
  (SELECT feature, sum(abs(rc / n1 - cc / n2) * (nx - value)) AS d FROM {_steps(SIDES)} GROUP BY feature)
  JOIN (SELECT feature, stddev_pop(value) AS sd FROM ({SIDES}) WHERE NOT cur GROUP BY feature) USING (feature)"""
_QUALITY = ", ".join(
    f"{even_sql(x, 4)} AS {n}" for n, x in (
        ("MAE", steady_sql("absolute_error")), ("RMSE", f"sqrt({steady_sql('squared_error')})"), ("mean_y_true", steady_sql("y_true")),
        ("mean_y_pred", steady_sql("y_pred")), ("mean_inference_ms", steady_sql("inference_time_ms")))
) + ", count(*) AS count"
_METRICS = f"""(SELECT model, target, count(*) AS n, {steady_sql('absolute_error')} AS MAE, {steady_sql('squared_error')} AS MSE,
  sqrt({steady_sql('squared_error')}) AS RMSE, 1 - sum(squared_error) / (var_pop(y_true) * count(*)) AS R2 FROM {LOG}
  GROUP BY model, target)"""
_SUMMARY = f"(SELECT model, avg(MAE) AS avg_mae, avg(RMSE) AS avg_rmse, avg(R2) AS avg_r2 FROM {_METRICS} GROUP BY model)"
_TYPES = f"""(SELECT event_type, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS r, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS c
  FROM events GROUP BY 1)"""
_COLS = {"event_type": "event_type", "user_id": "user_id", "reading": "reading", "fixed": "'same'"}


def _round_list(names, digits):
    return ", ".join(f"{sr(n, digits)} AS {n}" for n in names)


def _column_tests():
    parts = []
    for c, x in _COLS.items():
        parts.append(f"""SELECT 'null_share' AS test, '{c}' AS "column", count(*) FILTER ({x} IS NULL) / count(*) AS value,
          CAST(0.05 AS DOUBLE) AS threshold, '<=' AS op FROM {GAPPED}""")
        per = f"(SELECT {x} AS v, count(*) AS n FROM {GAPPED} WHERE {x} IS NOT NULL GROUP BY 1)"
        parts.append(f"SELECT 'constant', '{c}', count(*), 1.0, '>' FROM {per}")
        parts.append(f"SELECT 'almost_unique', '{c}', count(*) / sum(n), 0.95, '<' FROM {per}")
        parts.append(f"SELECT 'top_value_share', '{c}', max(n) / sum(n), 0.95, '<=' FROM {per}")
    parts.append(f"""SELECT 'duplicate_share', '*', 1 - count(*) / sum(n), 0.0, '<=' FROM
      (SELECT event_type, user_id, reading, count(*) AS n FROM {GAPPED} GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


_EV = "(SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def _stability():
    cut = f"TIMESTAMP '{CUT}'"
    parts = [f"""SELECT 'row_ratio' AS test, '*' AS "column", count(*) FILTER (ts >= {cut}) / count(*) FILTER (ts < {cut})
      AS value, CAST(0.1 AS DOUBLE) AS threshold, '>=' AS op FROM events"""]
    for c in ("value", "k"):
        ref = f"(SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS mu, stddev_samp({c}) AS sd FROM {_EV} WHERE ts < {cut})"
        parts.append(f"""SELECT 'out_of_range_share', '{c}', avg(CASE WHEN {c} < lo OR {c} > hi THEN 1.0 ELSE 0.0 END), 0.0,
          '<=' FROM {_EV}, {ref} WHERE ts >= {cut}""")
        parts.append(f"""SELECT 'mean_shift_sigma', '{c}', abs(avg({c}) - any_value(mu)) / any_value(sd), 2.0, '<='
          FROM {_EV}, {ref} WHERE ts >= {cut}""")
    parts.append("SELECT 'column_set_changes', '*', 0.0, 0.0, '<='")
    parts.append("SELECT 'column_type_changes', '*', 0.0, 0.0, '<='")
    return " UNION ALL ".join(parts)


def _judged(inner: str) -> str:
    return f"""SELECT test, "column", {sr('value')} AS value, threshold, CASE WHEN (op = '<=' AND value <= threshold) OR
      (op = '<' AND value < threshold) OR (op = '>' AND value > threshold) OR (op = '>=' AND value >= threshold)
      THEN 'pass' ELSE 'fail' END AS status FROM ({inner})"""


def _drifted(inner: str) -> str:
    return f"""SELECT count(*) FILTER (drift_detected) AS d, count(*) AS n,
      coalesce(string_agg("column", ',' ORDER BY "column") FILTER (drift_detected), '') AS names,
      count(*) FILTER (drift_detected AND "column" = 'value') AS td FROM ({inner})"""


SQL = {
    "null_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null,
        {sr(f'count(*) FILTER ({c} IS NULL) / count(*) * 100')} AS null_pct FROM {GAPPED}"""
        for c in ("event_id", "reading", "event_type")),
    "validation_stats": f"""SELECT n_rows, n_cols, {sr('null_pct')} AS null_pct, n_inf, CASE WHEN null_pct > 10 THEN 'block'
      WHEN null_pct > 5 OR n_inf > 0 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT count(*) AS n_rows,
      CAST(3 AS BIGINT) AS n_cols, count(*) FILTER (reading IS NULL) / (count(*) * 3) * 100 AS null_pct,
      count(*) FILTER (value > 400) AS n_inf FROM {GAPPED})""",
    "readiness": f"""SELECT n_new_rows >= 100 AND null_pct <= 10 AS ready, CASE WHEN null_pct > 10 THEN 'too_many_nulls'
      WHEN n_new_rows < 100 THEN 'too_few_new_rows' ELSE 'ready' END AS reason, n_partitions, n_new_partitions,
      n_total_rows, n_new_rows, {sr('null_pct')} AS null_pct, false AS is_first_run, first_date, last_date FROM (
      SELECT count(DISTINCT d) AS n_partitions, count(DISTINCT d) FILTER (d > DATE '2024-01-25') AS n_new_partitions,
      count(*) AS n_total_rows, count(*) FILTER (d > DATE '2024-01-25') AS n_new_rows,
      count(*) FILTER (reading IS NULL) / (count(*) * 4) * 100 AS null_pct, min(d) AS first_date, max(d) AS last_date
      FROM (SELECT *, CAST(ts AS DATE) AS d FROM {GAPPED}))""",
    "quality_tests": _judged(_column_tests()),
    "stability_tests": _judged(_stability()),
    "ks_drift": _ks(SIDES),
    "ks_drift_binned": _ks(SIDES),
    "drift_score": f"""SELECT d / n > 0.05 AS drift_detected, {sr('d / n', 4)} AS drift_score, d AS n_drifted_features,
      n AS n_total_features, names AS drifted_features, 'ks_test' AS method FROM ({_drifted(_ks(EVENT_SIDES))})""",
    "concept_drift": f"""SELECT td > 0 AS concept_drift_detected, td AS n_targets_drifted, CAST(1 AS BIGINT) AS total_targets
      FROM ({_drifted(_ks(EVENT_SIDES))})""",
    "drift_verdict": f"""SELECT d / n > 0.05 OR td > 0 AS should_retrain, d / n > 0.05 AS drift_detected,
      td > 0 AS concept_drift_detected, {sr('d / n', 4)} AS drift_score, d AS n_drifted_features, n AS n_total_features,
      td AS n_targets_drifted, CAST(1 AS BIGINT) AS total_targets, names AS drifted_features,
      CASE WHEN d / n > 0.05 THEN 'drift_above_threshold' WHEN td > 0 THEN 'concept_drift' ELSE 'no_significant_drift' END
      AS reason FROM ({_drifted(_ks(EVENT_SIDES))})""",
    "time_drift": _ks("""SELECT 'value' AS feature, value, hr >= (SELECT max(CASE WHEN p = floor(n * 0.8) THEN hr END)
      FROM (SELECT hr, row_number() OVER (ORDER BY hr) - 1 AS p, count(*) OVER () AS n FROM
        (SELECT date_trunc('hour', ts) AS hr FROM events))) AS cur FROM (SELECT date_trunc('hour', ts) AS hr, value FROM events)"""),
    "performance_status": f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, target) AS k FROM {LOG} WHERE model = 'damped'),
      logs AS (SELECT '40' AS log, * FROM l WHERE k <= 40 UNION ALL SELECT '60', * FROM l WHERE k <= 60 UNION ALL SELECT 'all', * FROM l),
      o AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY log) AS m FROM logs),
      c AS (SELECT log, max(CASE WHEN p = floor(m * 0.5) THEN ts END) AS cut FROM o GROUP BY 1)
      SELECT o.log, CASE WHEN ts >= cut THEN 'current' ELSE 'reference' END AS side, count(*) AS n,
        CASE WHEN max(m) >= 50 THEN 'ok' ELSE 'insufficient_data' END AS status FROM o JOIN c ON o.log = c.log GROUP BY 1, 2
      UNION ALL SELECT 'none', 'all', 0, 'no_data'""",
    "wasserstein": _WASS,
    "wasserstein_binned": _WASS,
    "js_divergence": f"""SELECT 'event_type' AS "column", {sr('js')} AS distance, js >= 0.1 AS drift_detected FROM (
      SELECT sqrt(sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2)) AS js FROM (
      SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM {_TYPES}))""",
    "chi_square": f"""SELECT 'event_type' AS "column", {sr('chi2')} AS chi2, dof, {sr('crit')} AS critical_95,
      chi2 > crit AS drift_detected FROM (SELECT chi2, dof, dof * pow(1 - 2.0 / (9 * dof)
        + CAST(1.6448536269514722 AS DOUBLE) * sqrt(2.0 / (9 * dof)), 3) AS crit FROM (
      SELECT sum(pow(r - er, 2) / er + pow(c - ec, 2) / ec) AS chi2, count(*) - 1 AS dof FROM (
      SELECT r, c, (r + c) * CAST(sum(r) OVER () AS DOUBLE) / (sum(r) OVER () + sum(c) OVER ()) AS er,
      (r + c) * CAST(sum(c) OVER () AS DOUBLE) / (sum(r) OVER () + sum(c) OVER ()) AS ec FROM {_TYPES})))""",
    "proportion_z": f"""SELECT 'error_rate' AS "column", {sr('p1')} AS p_ref, {sr('p2')} AS p_cur, {sr('z')} AS z,
      abs(z) > 1.959963984540054 AS drift_detected FROM (SELECT s1 / n1 AS p1, s2 / n2 AS p2,
      (s1 / n1 - s2 / n2) / sqrt((s1 + s2) / (n1 + n2) * (1 - (s1 + s2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM (
      SELECT count(*) FILTER (ts < TIMESTAMP '{CUT}') AS n1, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS n2,
      count(*) FILTER (ts < TIMESTAMP '{CUT}' AND event_type = 'error') AS s1,
      count(*) FILTER (ts >= TIMESTAMP '{CUT}' AND event_type = 'error') AS s2 FROM events))""",
    "prediction_log": f"""SELECT event_id, model, location, target, y_true, {sr('y_pred')} AS y_pred,
      {sr('absolute_error')} AS absolute_error, {sr('squared_error')} AS squared_error FROM {LOG}""",
    "pred_quality": f"SELECT model, location, target, {_QUALITY} FROM {LOG} GROUP BY model, location, target",
    "pred_quality_sets": f"""SELECT model, location, target, CASE WHEN grouping(location) = 0 THEN 'model_location'
      WHEN grouping(target) = 0 THEN 'model_target' ELSE 'model' END AS level, {_QUALITY} FROM {LOG}
      GROUP BY GROUPING SETS ((model), (model, location), (model, target))""",
    "reg_metrics": f"SELECT model, target, n, {_round_list(('MAE', 'MSE', 'RMSE', 'R2'), 5)} FROM {_METRICS}",
    "reg_summary": f"SELECT model, {_round_list(('avg_mae', 'avg_rmse', 'avg_r2'), 5)} FROM {_SUMMARY}",
    "metrics_ranked": f"SELECT model, target, {', '.join(f'{even_sql(c, 5)} AS {c}' for c in ('MAE', 'RMSE', 'R2'))} FROM {_METRICS}",
    "champion": f"""SELECT true AS success, arg_max(model, avg_r2) AS best_model, {sr('max(avg_r2)', 5)} AS best_r2,
      max(avg_r2) >= 0.7 AS meets_threshold, CAST(0.7 AS DOUBLE) AS threshold, 'ok' AS reason FROM {_SUMMARY}""",
    "performance_split": f"""SELECT CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'current' ELSE 'reference' END AS side,
      count(*) AS n, 'ok' AS status, {sr('avg(y_pred - y_true)', 5)} AS mean_error, {sr('avg(absolute_error)', 5)} AS mae,
      {sr('avg(CASE WHEN y_true <> 0 THEN abs((y_pred - y_true) / y_true) END) * 100', 5)} AS mape,
      {sr('sqrt(avg(squared_error))', 5)} AS rmse,
      {sr('1 - sum(squared_error) / (var_pop(y_true) * count(*))', 5)} AS r2, {sr('max(absolute_error)', 5)} AS max_abs_error,
      {sr('stddev_samp(y_pred - y_true)', 5)} AS error_std FROM {LOG} WHERE model = 'persistence' GROUP BY 1""",
    "performance_halves": f"""WITH l AS (SELECT * FROM {LOG} WHERE model = 'damped' AND location = 'click'),
      o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM l),
      c AS (SELECT max(CASE WHEN p = floor(n * 0.5) THEN ts END) AS cut FROM o)
      SELECT CASE WHEN ts >= cut THEN 'current' ELSE 'reference' END AS side, count(*) AS n, 'ok' AS status,
      {sr('avg(absolute_error)', 5)} AS mae, {sr('sqrt(avg(squared_error))', 5)} AS rmse FROM l, c GROUP BY 1""",
    "first_predictions": f"""SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS index, event_id, y_true AS actual,
      y_pred AS predicted, {sr('y_true - y_pred')} AS error FROM {LOG} WHERE model = 'persistence' AND target = 'value'
      ORDER BY ts, event_id LIMIT 500""",
    "flat_metrics": f"""SELECT regexp_replace(model || '/' || target, '^persistence', 'last') AS key, {sr('MAE', 8)} AS mae
      FROM {_METRICS}""",
}
