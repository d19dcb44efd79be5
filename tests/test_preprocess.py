import numpy as np
import pytest
from helpers import close
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.columns import nan_to_null, to_long
from tidemark.operators import fill, ordering, preprocess, split
from tidemark.spec import PanelSpec


def table(spark, columns: dict):
    n = len(next(iter(columns.values())))
    rows = [tuple(None if columns[c][i] is None else float(columns[c][i]) for c in columns) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns))


def quant(df, cols, probs, **kw):
    return {r["feature"]: (r["n"], r["q"]) for r in ordering.column_quantiles(df, cols, probs, **kw).collect()}


@pytest.mark.parametrize("accuracy", [20, 200, 3_000, 10_000])
def test_column_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(5)
    data = {
        "flat": rng.uniform(-5, 5, 3000), "ties": rng.integers(0, 4, 3000), "heavy": rng.pareto(1.1, 3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)), "a.b-c": np.full(3000, 2.0),
    }
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = quant(table(spark, data).repartition(3), list(data), probs, accuracy=accuracy)
    for name, values in data.items():
        want = np.quantile(values, probs)
        assert got[name][0] == 3000
        assert all(close(g, w, 1e-12) for g, w in zip(got[name][1], want)), (name, got[name][1], want)


def test_brackets_narrow_until_small(spark, monkeypatch):
    """No pass gathers more than ``small`` values, also beside a value that holds most rows."""
    rng = np.random.default_rng(9)
    n, small = 100_000, 1_000
    data = {"wide": np.exp(rng.normal(0, 40, n)), "hot": np.where(rng.random(n) < 0.7, 3.0, rng.normal(3, 1, n))}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(*data.values())], "wide double, hot double").repartition(4).cache()
    gather = F.collect_list
    monkeypatch.setattr(ordering.F, "collect_list", lambda x: F.when(
        F.count(x) > small, F.raise_error(F.lit("too many values"))).otherwise(gather(x)))
    probs = [0.0, 0.15, 0.1501, 0.5, 0.85, 1.0]
    got = quant(df, list(data), probs, accuracy=100, small=small)
    long = df.selectExpr("explode(array(struct('wide' as k, wide as v), struct(null as k, hot as v))) as r").select("r.*")
    grouped = {r["k"]: (r["n"], r["q"]) for r in ordering.bracketed_quantiles(long, ["k"], "v", probs, 100, small).collect()}
    for name, values in data.items():
        want = np.quantile(values, probs)
        for count, q in (got[name], grouped[name if name == "wide" else None]):
            assert count == n and all(close(g, w, 1e-12) for g, w in zip(q, want)), (name, q, want)


def test_column_quantiles_missing_and_empty(spark):
    df = table(spark, {"x": [1, None, float("nan"), 4], "void": [None] * 4})
    assert quant(df, ["x", "void"], [0.5]) == {"x": (2, [2.5]), "void": (0, None)}
    assert quant(df.limit(0), ["x"], [0.5]) == {"x": (0, None)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_column_quantiles_property(spark, values, p):
    got = quant(table(spark, {"x": values}), ["x"], [p], accuracy=10)
    assert close(got["x"][1][0], float(np.quantile(values, p)), 1e-9)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k, n in (("a", 900), ("b", 5)) for v in rng.normal(size=n)]
    df = spark.createDataFrame(rows, "k string, v double")
    for out in (ordering.quantiles(df, ["k"], "v", [0.25, 0.5]),
                ordering.quantiles(df, ["k"], "v", [0.25, 0.5], one_task_rows=1),
                ordering.bracketed_quantiles(df, ["k"], "v", [0.25, 0.5], accuracy=100)):
        for r in out.collect():
            want = np.quantile([v for k, v in rows if k == r["k"]], [0.25, 0.5])
            assert all(close(a, b) for a, b in zip(r["q"], want))


def test_running_before_small_equals_sorted_parts(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i % 5 + 1) for i in range(200)], "k string, w long")
    small = {r["k"]: r["o"] for r in ordering.running_before(df, ["k"], "w", "o").collect()}
    parts = {r["k"]: r["o"] for r in ordering.running_before(df, ["k"], "w", "o", one_task_rows=10).collect()}
    assert small == parts and small["k000"] == 0


def test_robust_scaler_keeps_constant_spread(spark):
    df = table(spark, {"x": [3, 3, 3, 3, 9], "y": [1, 2, 3, 4, 5]})
    out = preprocess.apply_scaler(df, ["x"], preprocess.fit_scaler(df, ["x"], "robust"))
    assert sorted(r["x"] for r in out.collect()) == [0, 0, 0, 0, 6]
    out = preprocess.apply_scaler(df, ["y"], preprocess.fit_scaler(df, ["y"], "minmax"))
    assert sorted(r["y"] for r in out.collect()) == [0, 0.25, 0.5, 0.75, 1]
    params = preprocess.fit_scaler(df, ["y"], "standard").first()
    assert close(params["scale"], float(np.std([1, 2, 3, 4, 5])))
    with pytest.raises(ValueError):
        preprocess.fit_scaler(df, ["x"], "quantum")


def test_transform_choice(spark):
    rng = np.random.default_rng(7)
    df = table(spark, {"even": rng.uniform(size=400), "right": rng.gamma(0.3, 9, 400), "both": rng.standard_t(1.5, 400)})
    got = {r["feature"]: r["transform"] for r in preprocess.fit_transforms(df, ["even", "right", "both"]).collect()}
    assert got == {"even": "none", "right": "log1p", "both": "asinh"}


def test_clip_counts_and_nulls(spark):
    df = table(spark, {"x": [*range(20), 1000, None]})
    bounds = preprocess.clip_bounds(df, ["x"], 3.0)
    row = preprocess.clip_counts(df, ["x"], bounds).first()
    assert row["n_clipped"] == 1
    out = [r["x"] for r in preprocess.clip(df, ["x"], bounds).collect()]
    assert out.count(None) == 1 and close(max(v for v in out if v is not None), row["hi"])


def test_preprocessor_round_trip_save_load(spark, tmp_path):
    rng = np.random.default_rng(8)
    df = table(spark, {"t.1": rng.gamma(0.5, 9, 300), "t-2": rng.standard_t(2, 300), "f": rng.normal(size=300)})
    pre = preprocess.Preprocessor.fit(df, ["t.1", "t-2"], ["f"], clip_k=1e9)
    pre.save(str(tmp_path / "p"))
    again = preprocess.Preprocessor.load(spark, str(tmp_path / "p"))
    assert set(again.targets) == {"t.1", "t-2"} and again.features == ("f",)
    scaled = again.transform(df)
    stats = scaled.agg(F.avg("`t.1`").alias("m"), F.stddev_pop("`t.1`").alias("s")).first()
    assert abs(stats["m"]) < 1e-9 and close(stats["s"], 1.0)
    back = pre.inverse_targets(scaled).select("`t.1`", "`t-2`").collect()
    want = df.select("`t.1`", "`t-2`").collect()
    for a, b in zip(sorted(map(tuple, back)), sorted(map(tuple, want))):
        assert close(a[0], b[0], 1e-8) and close(a[1], b[1], 1e-8)


def test_clean_panel_fits_on_training_rows(panel, spec):
    train = panel.where(F.col("at") < "2024-01-04")
    out, bounds = preprocess.clean_panel(panel.withColumn("junk", F.lit(1)), spec, ["x"], ["x"], ("junk",), 1.0, train)
    assert "junk" not in out.columns and out.where(F.col("x").isNull()).count() == 0
    row = bounds.first()
    extremes = out.agg(F.min("x"), F.max("x")).first()
    assert extremes[0] >= row["lo"] - 1e-9 and extremes[1] <= row["hi"] + 1e-9


def test_fill_median(spark):
    df = table(spark, {"x": [1, 5, None, 9], "void": [None] * 4})
    assert sorted(r["x"] for r in fill.fill_median(df, ["x", "void"]).collect()) == [1, 5, 5, 9]


def test_nan_becomes_null(spark):
    assert nan_to_null(table(spark, {"x": [float("nan"), 1]})).where(F.col("x").isNull()).count() == 1


def test_to_long_drops_missing(spark):
    assert to_long(table(spark, {"x": [1, None], "y": [float("nan"), 2]}), ["x", "y"]).count() == 2


@pytest.mark.parametrize("small", [10, 100_000])
def test_time_cuts_match_sorting(panel, spec, panel_pdf, small):
    times = sorted(panel_pdf["at"].unique())
    rows = sorted(panel_pdf["at"])
    got = split.time_cuts(panel, spec, [0.7, 0.85], small=small, buckets=16)
    assert [np.datetime64(g) for g in got] == [np.datetime64(times[int(len(times) * s)]) for s in (0.7, 0.85)]
    got = split.time_cuts(panel, spec, [0.5], by_rows=True, small=small, buckets=16)
    assert np.datetime64(got[0]) == np.datetime64(rows[len(rows) // 2])


def test_split_time_does_not_overlap(panel, spec):
    out = split.split_time(panel, spec)
    ends = {r["part"]: (r["a"], r["z"], r["n"]) for r in out.groupBy("part").agg(
        F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("n")).collect()}
    assert sum(v[2] for v in ends.values()) == panel.count()
    assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]


def test_split_positional_counts(panel, spec):
    known = panel.where(F.col("who").isNotNull())
    n = known.count()
    got = {r["part"]: r["count"] for r in split.split_positional(known, spec).groupBy("part").count().collect()}
    assert got == {"train": int(n * 0.7), "val": int(n * 0.85) - int(n * 0.7), "test": n - int(n * 0.85)}
    with pytest.raises(ValueError):
        split.split_positional(known, PanelSpec((), "at"))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50])
def test_column_quantiles_short_columns(spark, n):
    values = [float(i * i) for i in range(n)]
    probs = [0.1, 0.25, 0.5, 0.9]
    got = quant(table(spark, {"x": values}), ["x"], probs)["x"][1]
    assert all(close(g, w, 1e-12) for g, w in zip(got, np.quantile(values, probs)))


def test_a_fit_finds_all_quartiles_together(spark, monkeypatch):
    """Bounds, medians and the robust scaler share the passes over the rows, and equal those found one by one."""
    df = spark.createDataFrame([(float(i * i % 97), None if i % 7 == 0 else float(i % 31), None) for i in range(300)],
                               "x double, z double, void double")
    bounds = preprocess.clip_bounds(df, ["x"], 3.0).first()
    scales = {r.feature: r for r in preprocess.fit_scaler(df, ["z", "void"], "robust").collect()}
    middle = {r.feature: r["median"] for r in preprocess.medians(df, ["x", "z", "void"]).collect()}
    asked = []

    def counted(table, cols, probs, *rest):
        asked.append(list(cols))
        return ordering.column_quantiles(table, cols, probs, *rest)

    monkeypatch.setattr(preprocess, "column_quantiles", counted)
    monkeypatch.setattr(fill, "column_quantiles", counted)
    rows = {r.feature: r for r in preprocess.Preprocessor.fit(df, ["x"], ["z", "void"]).params.collect()}
    assert asked == [["x", "z", "void"]]
    assert (rows["x"].lo, rows["x"].hi) == (bounds.lo, bounds.hi)
    assert {f: r["median"] for f, r in rows.items()} == middle
    assert all((rows[f].center, rows[f].scale) == (scales[f].center, scales[f].scale) for f in scales)


def test_cuts_of_few_times_are_found_in_one_pass(spark, panel, spec, monkeypatch):
    passes, agg = [], type(panel).agg

    def counted(self, *columns):
        passes.append(len(columns))
        return agg(self, *columns)

    monkeypatch.setattr(type(panel), "agg", counted)
    split.time_cuts(panel, spec, [0.5, 0.7, 0.85])
    assert passes == [4, 3]  # what there is, then all cuts
