"""Clipping, moments, transforms, scaling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import GAPPED, TARGETS, USERS, events, gapped, long_sql, r, sr, table
from tidemark.functions.columns import to_long
from tidemark.operators import ordering, preprocess, split


def _targets(spark, path):
    return table(spark, path, "lineitem").select(*TARGETS)


def quantiles_exact(spark, path):
    q = ordering.column_quantiles(_targets(spark, path), TARGETS, [0.25, 0.5, 0.75])
    return q.select("feature", "n", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


def quantiles_grouped(spark, path):
    """Quantiles per key group, here with the column name as the key."""
    q = ordering.bracketed_quantiles(
        to_long(_targets(spark, path), TARGETS), ["feature"], "value", [0.25, 0.5, 0.75], accuracy=1_000
    )
    return q.select("feature", "n", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


def clip_bounds(spark, path):
    df = _targets(spark, path)
    counts = preprocess.clip_counts(df, TARGETS, preprocess.clip_bounds(df, TARGETS, 0.5))
    return counts.select("feature", r("lo").alias("lo"), r("hi").alias("hi"), "n_clipped")


def clip_iqr(spark, path):
    df = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", *TARGETS)
    out = preprocess.clip(df, TARGETS, preprocess.clip_bounds(df, TARGETS, 0.5))
    return out.select("l_orderkey", "l_linenumber", *[r(t, 4).alias(t) for t in TARGETS])


def moments(spark, path):
    df = preprocess.moments(_targets(spark, path), TARGETS)
    return df.select("feature", "n", r("low", 4).alias("low"), *[r(c, 4).alias(c) for c in ("skew", "kurt", "kurt_pearson")])


def _wide(spark, path):
    """Event values and the squared, signed deviations: one right-skewed, one heavy with both signs."""
    centre = F.col("value") - 30
    return events(spark, path).select(
        "event_id", F.col("value").alias("skewed"), (centre * F.abs(centre)).alias("signed"),
        (F.col("event_id") * 0.5).alias("even"),
    )


NAMES = ("skewed", "signed", "even")
WIDE = """(SELECT event_id, value AS skewed, (value - 30) * abs(value - 30) AS signed, CAST(event_id AS DOUBLE) / 2 AS even
  FROM events)"""


def transform_choice(spark, path):
    return preprocess.fit_transforms(_wide(spark, path), NAMES).select("feature", "n", "transform")


def target_transform(spark, path):
    df = _wide(spark, path)
    out = preprocess.apply_transforms(df, NAMES, preprocess.fit_transforms(df, NAMES))
    return out.select("event_id", *[r(n, 5).alias(n) for n in NAMES])


def inverse_roundtrip(spark, path):
    df = _wide(spark, path)
    pre = preprocess.Preprocessor.fit(df, NAMES, [], clip_k=1e6)
    out = pre.inverse_targets(pre.transform(df))
    return out.select("event_id", *[r(n, 4).alias(n) for n in NAMES])


def _scaled(kind):
    def run(spark, path):
        df = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", *TARGETS)
        out = preprocess.apply_scaler(df, TARGETS, preprocess.fit_scaler(df, TARGETS, kind))
        return out.select("l_orderkey", "l_linenumber", *[r(t, 5).alias(t) for t in TARGETS])

    run.__name__ = f"scale_{kind}"
    return run


def fitted_table(spark, path):
    """Everything the fitted preprocessor stores: bounds, transform, centre and scale per column."""
    df = events(spark, path).select("value", (F.col("event_id") * 0.5).alias("position"))
    params = preprocess.Preprocessor.fit(df, ["value"], ["position"]).params
    return params.select(
        "feature", "role", "transform", *[r(c, 5).alias(c) for c in ("center", "scale", "lo", "hi", "median")]
    )


def clean_panel(spark, path):
    df = gapped(spark, path).select("user_id", "event_id", "ts", "reading", F.col("props").alias("timezone"))
    out, _ = preprocess.clean_panel(df, USERS, ["reading"], ["reading"], redundant=("timezone",), k=1.0)
    return out.select("user_id", "event_id", r("reading", 5).alias("reading"))


def split_time(spark, path):
    df = events(spark, path).select("event_id", "ts")
    return split.split_time(df, USERS).select("event_id", "part")


def split_positional(spark, path):
    df = events(spark, path).select("user_id", "event_id", "ts")
    return split.split_positional(df, USERS).select("event_id", "part")


def split_positional_slots(spark, path):
    """The same split with every user cut into time slots and the user table range-sorted."""
    df = events(spark, path).select("user_id", "event_id", "ts")
    spec = USERS.with_(hot_rows=1)
    return split.split_positional(df, spec, one_task_rows=1).select("event_id", "part")


QUERIES = {f.__name__: f for f in (
    quantiles_exact, quantiles_grouped, clip_bounds, clip_iqr, moments, transform_choice, target_transform,
    inverse_roundtrip, _scaled("robust"), _scaled("standard"), _scaled("minmax"), fitted_table, clean_panel,
    split_time, split_positional, split_positional_slots,
)}

_Q = f"""SELECT feature, count(*) AS n, {sr('quantile_cont(value, 0.25)')} AS p25,
  {sr('quantile_cont(value, 0.5)')} AS p50, {sr('quantile_cont(value, 0.75)')} AS p75
  FROM ({long_sql()}) GROUP BY feature"""
_B = f"""(SELECT feature, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM (SELECT feature,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({long_sql()}) GROUP BY feature))"""
_M = """count(*) AS n, min(value) AS low, skewness(value) AS skew, kurtosis(value) AS kurt"""
_CHOICE = """CASE WHEN NOT (abs(skew) > 1 OR kurt > 2) THEN 'none' WHEN low >= 0 AND skew >= 0 THEN 'log1p'
  ELSE 'asinh' END"""
_FIT = f"(SELECT feature, n, {_CHOICE} AS transform FROM (SELECT feature, {_M} FROM ({long_sql(NAMES, WIDE)}) GROUP BY feature))"


def _forward(c):
    k = f"(SELECT transform FROM {_FIT} WHERE feature = '{c}')"
    x = f"CAST({c} AS DOUBLE)"
    return f"CASE {k} WHEN 'log1p' THEN ln(1 + greatest({x}, 0)) WHEN 'asinh' THEN asinh({x}) ELSE {x} END"


def _clip(c, digits):
    lo, hi = (f"(SELECT {b} FROM {_B} WHERE feature = '{c}')" for b in ("lo", "hi"))
    return f"{sr(f'greatest(least({c}, {hi}), {lo})', digits)} AS {c}"


def _scale(kind, c):
    centre, scale = {
        "robust": (f"median({c})", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
        "standard": (f"avg({c})", f"stddev_pop({c})"),
        "minmax": (f"min({c})", f"max({c}) - min({c})"),
    }[kind]
    return f"{sr(f'({c} - (SELECT {centre} FROM lineitem)) / (SELECT {scale} FROM lineitem)', 5)} AS {c}"


_FILLED = f"""(SELECT user_id, event_id, coalesce(
  last_value(reading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(reading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM {GAPPED})"""
_POSITIONAL = """SELECT event_id, CASE WHEN p <= floor(n * 0.70) THEN 'train' WHEN p <= floor(n * 0.85) THEN 'val'
  ELSE 'test' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS p,
  count(*) OVER () AS n FROM events)"""
SQL = {
    "quantiles_exact": _Q,
    "quantiles_grouped": _Q,
    "clip_bounds": f"""SELECT feature, {sr('max(lo)')} AS lo, {sr('max(hi)')} AS hi,
      count(*) FILTER (value < lo OR value > hi) AS n_clipped
      FROM ({long_sql()}) JOIN {_B} USING (feature) GROUP BY feature""",
    "clip_iqr": f"SELECT l_orderkey, l_linenumber, {', '.join(_clip(c, 4) for c in TARGETS)} FROM lineitem",
    "moments": f"""SELECT feature, n, {sr('low', 4)} AS low, {sr('skew', 4)} AS skew, {sr('kurt', 4)} AS kurt,
      {sr('kurt + 3', 4)} AS kurt_pearson FROM (SELECT feature, {_M} FROM ({long_sql()}) GROUP BY feature)""",
    "transform_choice": f"SELECT feature, n, transform FROM {_FIT}",
    "target_transform": f"SELECT event_id, {', '.join(f'{sr(_forward(c), 5)} AS {c}' for c in NAMES)} FROM {WIDE}",
    "inverse_roundtrip": f"SELECT event_id, {', '.join(f'{sr(f'CAST({c} AS DOUBLE)', 4)} AS {c}' for c in NAMES)} FROM {WIDE}",
    **{f"scale_{k}": f"SELECT l_orderkey, l_linenumber, {', '.join(_scale(k, c) for c in TARGETS)} FROM lineitem"
       for k in ("robust", "standard", "minmax")},
    "fitted_table": f"""WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
        median(value) AS med FROM events),
      c AS (SELECT greatest(least(value, q3 + 3 * (q3 - q1)), q1 - 3 * (q3 - q1)) AS value FROM events, b),
      k AS (SELECT {_CHOICE} AS transform FROM (SELECT {_M} FROM c)),
      v AS (SELECT CASE transform WHEN 'log1p' THEN ln(1 + value) WHEN 'asinh' THEN asinh(value) ELSE value END AS v,
        transform FROM c, k)
      SELECT 'value' AS feature, 'target' AS role, any_value(transform) AS transform, {sr('avg(v)', 5)} AS center,
        {sr('stddev_pop(v)', 5)} AS scale, {sr('any_value(q1 - 3 * (q3 - q1))', 5)} AS lo,
        {sr('any_value(q3 + 3 * (q3 - q1))', 5)} AS hi, {sr('any_value(med)', 5)} AS median FROM v, b
      UNION ALL SELECT 'position', 'feature', 'none', {sr('median(CAST(event_id AS DOUBLE) / 2)', 5)},
        {sr('quantile_cont(CAST(event_id AS DOUBLE) / 2, 0.75) - quantile_cont(CAST(event_id AS DOUBLE) / 2, 0.25)', 5)}, NULL, NULL,
        {sr('median(CAST(event_id AS DOUBLE) / 2)', 5)} FROM events""",
    "clean_panel": f"""WITH m AS (SELECT user_id, event_id, coalesce(f, (SELECT median(f) FROM {_FILLED})) AS v FROM {_FILLED}),
      b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM m)
      SELECT user_id, event_id, {sr('greatest(least(v, q3 + (q3 - q1)), q1 - (q3 - q1))', 5)} AS reading FROM m, b""",
    "split_time": """WITH t AS (SELECT DISTINCT ts FROM events),
      o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM t),
      c AS (SELECT max(CASE WHEN p = floor(n * 0.70) THEN ts END) AS a, max(CASE WHEN p = floor(n * 0.85) THEN ts END) AS b
        FROM o)
      SELECT event_id, CASE WHEN ts < a THEN 'train' WHEN ts < b THEN 'val' ELSE 'test' END AS part FROM events, c""",
    "split_positional": _POSITIONAL,
    "split_positional_slots": _POSITIONAL,
}
