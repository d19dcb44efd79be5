"""Windows: plain, cut into slots, and brute force agree."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import close
from pyspark.sql import functions as F

from tidemark.operators import features, fill, frames
from tidemark.operators.panel import _split, PLAIN, probe_layout, with_neighbours
from tidemark.spec import PanelSpec


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.select("id", *cols).collect()}


def same(left, right, *cols):
    a, b = by_id(left, *cols), by_id(right, *cols)
    assert a.keys() == b.keys()
    for k in a:
        assert all(close(x, y, 1e-9) if not isinstance(x, str) else x == y for x, y in zip(a[k], b[k])), (k, a[k], b[k])


def test_small_entities_stay_plain(panel, spec):
    assert probe_layout(panel, spec).hot is None


@pytest.mark.parametrize("hot_rows", [5, 50, 200])
def test_slots_equal_plain_for_frames(panel, spec, hot_rows):
    hot = spec.with_(hot_rows=hot_rows)
    layout = probe_layout(panel, hot)
    assert layout.hot is not None
    work = frames.lags(["x", "z"], (1, 7)) + frames.rolling(["z"], (3, 9)) + frames.differences({"d": ("z", 3)})
    cols = ["x_lag_1", "x_lag_7", "z_lag_1", "z_lag_7", "z_rmean_3", "z_rstd_9", "d"]
    same(work.apply(panel, hot, layout), work.apply(panel, spec, PLAIN), *cols)


@pytest.mark.parametrize("hot_rows", [5, 50])
def test_slots_equal_plain_for_fills(panel, spec, hot_rows):
    hot = spec.with_(hot_rows=hot_rows)
    same(fill.fill_along_time(panel, hot, ["x"]), fill.fill_along_time(panel, spec, ["x"]), "x")
    same(fill.interpolate(panel, hot, ["x"]), fill.interpolate(panel, spec, ["x"]), "x")
    same(with_neighbours(panel, hot, []), with_neighbours(panel, spec, []), "_pos")


def test_slots_keep_time_order_across_clock_changes(spark, spec):
    start = datetime(2024, 3, 9, 20)
    rows = [("a", start + timedelta(minutes=10 * i), i, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "who string, at timestamp_ntz, id long, x double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(frames.lags(["x"], (1,)).apply(df, spec.with_(hot_rows=5)), frames.lags(["x"], (1,)).apply(df, spec), "x_lag_1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000])
def test_bin_index_counts_cuts(spark, n):
    from tidemark.operators.ordering import bin_index

    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 31, 32, n - 1, n + 7)] + [(None,)], "x double")
    cuts = F.array(*[]).cast("array<double>") if not n else F.sequence(F.lit(0), F.lit(n - 1)).cast("array<double>")
    for r in df.select("x", bin_index(cuts, F.col("x")).alias("i")).collect():
        assert r["i"] == (0 if r["x"] is None else sum(c <= r["x"] for c in range(n)))


def test_slots_equal_plain_for_sequences(panel, spec):
    def run(s):
        out = frames.sequences(panel, s, ["z"], ["z"], 4, 2)
        return {r["id"]: (tuple(v[0] for v in r["x"]), r["y"][0]) for r in out.collect()}

    assert run(spec) == run(spec.with_(hot_rows=20))


def test_global_mode_is_one_series(panel):
    whole = PanelSpec((), "at", ("id",))
    plain = frames.lags(["z"], (1,)).apply(panel, whole)
    slots = frames.lags(["z"], (1,)).apply(panel, whole.with_(hot_rows=40))
    same(plain, slots, "z_lag_1")
    assert plain.where(F.col("z_lag_1").isNull()).count() == 1
    assert "_all" not in plain.columns


def test_lags_and_rolling_match_pandas(panel, spec, panel_pdf):
    out = (frames.lags(["z"], (1, 3)) + frames.rolling(["z"], (3, 7))).apply(panel, spec)
    got = by_id(out, "z_lag_1", "z_lag_3", "z_rmean_3", "z_rstd_7")
    ordered = panel_pdf.sort_values(["at", "id"])
    grouped = ordered.groupby("who", dropna=False)["z"]
    want = pd.DataFrame({
        "id": ordered["id"], "a": grouped.shift(1), "b": grouped.shift(3),
        "c": grouped.transform(lambda s: s.rolling(3, min_periods=1).mean()),
        "d": grouped.transform(lambda s: s.rolling(7, min_periods=1).std()),
    })
    for row in want.itertuples(index=False):
        for g, w in zip(got[row.id], row[1:]):
            assert close(g, None if pd.isna(w) else w, 1e-7)


def test_interpolation_matches_pandas(panel, spec, panel_pdf):
    got = by_id(fill.interpolate(panel, spec, ["x"], 3), "x")
    ordered = panel_pdf.sort_values(["at", "id"]).reset_index(drop=True)
    ordered["x"] = ordered["x"].astype(float)
    want = ordered.groupby("who", dropna=False)["x"].transform(
        lambda s: s.interpolate(limit=3) if s.notna().any() else s)
    for i, w in zip(ordered["id"], want):
        assert close(got[i][0], None if pd.isna(w) else w), i


def test_fill_is_idempotent_and_leaves_empty_entities(panel, spec):
    once = fill.fill_along_time(panel, spec, ["x"])
    same(once, fill.fill_along_time(once, spec, ["x"]), "x")
    assert {r["who"] for r in once.where(F.col("x").isNull()).collect()} <= {"void", "one"}


def test_sequence_count_formula(spark, spec):
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=i), i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "who string, at timestamp, id long, x double")
    for horizon in (1, 5):
        out = frames.sequences(df, spec, ["x"], ["x"], 10, horizon)
        assert out.count() == 100 - 10 - horizon + 1
        first = out.orderBy("id").first()
        assert [v[0] for v in first["x"]] == [float(i) for i in range(10)]
        assert first["y"] == [float(9 + horizon)]
    assert frames.sequences(df.limit(5), spec, ["x"], ["x"], 10, 1).count() == 0
    with pytest.raises(ValueError):
        frames.sequences(df, spec, ["x"], ["x"], 0, 1)


def test_last_rows_and_steps(panel, spec):
    out = frames.last_rows(panel, spec, 3, step="step")
    assert out.where(F.col("who") == "big").orderBy("at", "id").select("step").toPandas()["step"].tolist() == [1, 2, 3]
    assert out.where(F.col("who") == "one").count() == 1


def test_persistence_first_row(panel, spec):
    out = frames.persistence("z", "p").apply(panel, spec).where(F.col("who") == "one").first()
    assert out["p"] == out["z"]


def test_feature_chain(spark):
    rng = np.random.default_rng(1)
    rows = [(loc, "AA", datetime(2024, 3, 1) + timedelta(days=i), "06:10 AM", "bad" if i == 30 else "06:10 PM",
             float(rng.normal()), float(rng.uniform(30, 90)), 1000.0 + i, float(i), float(i * 10)) for loc in ("b", "a")
            for i in range(40)]
    df = spark.createDataFrame(
        rows, "location_name string, country string, last_updated timestamp, sunrise string, sunset string, "
              "`air_quality_PM2.5` double, humidity double, pressure_mb double, temperature_celsius double, wind_degree double")
    spec = PanelSpec(("location_name",), "last_updated")
    out = features.weather_features(df, spec)
    assert not [n for n, t in out.dtypes if t == "string"] and "last_updated" not in out.columns
    assert {"air_quality_PM2.5_lag_7", "humidity_rstd_7", "pressure_change_3d", "temp_x_humidity", "wind_dir_sin",
            "doy_sin", "daylight_hours", "location_id"} <= set(out.columns)
    pdf = out.toPandas()
    # 7 rows lack the longest lag and one has an unreadable sunset
    assert len(pdf) == 2 * (40 - 7 - 1) and not pdf.isna().any().any()
    assert set(pdf["daylight_hours"]) == {12.0} and set(pdf["location_id"]) == {0, 1}
    assert pdf[[c for c in pdf if c.endswith(("_sin", "_cos"))]].abs().max().max() <= 1.0
    assert df.columns[3] == "sunrise"  # the input is untouched
    with pytest.raises(TypeError):
        features.add_cyclical(df, "humidity")
    with pytest.raises(KeyError):
        features.add_cyclical(df, "nope")


def test_entity_code_missing_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "n string")
    codes = features.entity_codes(df, "n", "c")
    more = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "n string")
    got = {r["n"]: r["c"] for r in features.add_entity_code(more, "n", "c", codes).collect()}
    assert got == {"a": 0, "b": 1, "zz": -1, None: -1}


def test_every_entity_above_hot_rows_is_cut_to_its_own_size(spark):
    sizes = {f"e{i}": 500 for i in range(20)} | {"big": 4000, "small": 90}
    df = spark.createDataFrame([(k, j, j) for k, n in sizes.items() for j in range(n)], "k string, t long, id long")
    spec = PanelSpec(("k",), "t", ("id",), targets=("id",), hot_rows=100)
    layout = probe_layout(df, spec)
    got = {r["k"]: len(r["_cuts"]) + 1 for r in layout.hot.collect()}
    assert got == {f"e{i}": 10 for i in range(20)} | {"big": 80}
    _, hot = _split(df, ["k"], layout, spec)
    assert hot.groupBy("k", "_slot").count().agg({"count": "max"}).first()[0] <= spec.hot_rows
