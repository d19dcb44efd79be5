"""Descriptive tables: dimensions, summaries, correlations, distributions, forecast reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, to_long
from tidemark.functions.stats import correlation
from tidemark.operators.ordering import choose_bins, column_quantiles, cumulative, measured, per_column, quantiles


def locations(df: DataFrame, name: str, country: str, lat: str, lon: str, order: Sequence[str],
              in_country: str | None = None) -> DataFrame:
    """One row per location: earliest country by ``order``, mean coordinates rounded to 4."""
    first = F.min_by(col(country), F.struct(*[col(o) for o in order]))
    dim = df.groupBy(col(name)).agg(
        first.alias(country), F.round(F.avg(col(lat)), 4).alias(lat), F.round(F.avg(col(lon)), 4).alias(lon)
    )
    return dim if in_country is None else dim.where(col(country) == in_country)


def distinct_values(df: DataFrame, name: str, first: int | None = None) -> DataFrame:
    out = df.select(col(name)).where(col(name).isNotNull()).distinct().orderBy(col(name))
    return out if first is None else out.limit(first)


def members(df: DataFrame, dim: DataFrame, key: str, country: str, value: str) -> DataFrame:
    """Rows whose entity lies in a country."""
    return df.join(dim.where(col(country) == value).select(col(key)), key, "left_semi")


def entity_rows(df: DataFrame, dim: DataFrame, name: str, code: str, *, country: str | None = None,
                country_value: str | None = None, name_value: str | None = None) -> DataFrame:
    """Engineered rows of one location or country, through the code dimension; an unknown name filters nothing."""
    wanted = dim
    if name_value is not None:
        wanted = dim.where(col(name) == name_value)
    elif country_value is not None:
        wanted = dim.where(col(country) == country_value)
    if (name_value is None and country_value is None) or wanted.isEmpty():
        return df
    return df.join(wanted.select(col(code)).distinct(), code, "left_semi")


def table_summary(df: DataFrame, time: str, entity: str, country: str | None = None) -> DataFrame:
    """Rows, first and last date, distinct entities and countries."""
    groups = [entity] + ([country] if country else [])
    # distinct counts over a pre-aggregated table: one row per (entity, country)
    per = df.groupBy(*[col(g) for g in groups]).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(time)).alias("a"), F.max(col(time)).alias("z")
    )
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.to_date(F.min("a")).alias("first_date"),
        F.to_date(F.max("z")).alias("last_date"),
        F.countDistinct(col(entity)).alias("n_locations"),
        *([F.countDistinct(col(country)).alias("n_countries")] if country else []),
    )


def target_stats(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``feature, mean, std, min, max`` rounded to 4."""
    return per_column(df, targets, {
        "mean": lambda v: F.round(F.avg(v), 4), "std": lambda v: F.round(F.stddev_samp(v), 4),
        "min": lambda v: F.round(F.min(v), 4), "max": lambda v: F.round(F.max(v), 4),
    })


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, count, mean, std, min, p25, p50, p75, max`` with exact quartiles."""
    basic = per_column(df, cols, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    })
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")
    )
    # one row per column on both sides
    return basic.join(F.broadcast(q), "feature").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, corr`` for every pair of columns, pairs of non-missing values only; one aggregate."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[correlation(col(a).cast("double"), col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def spearman(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """Rank correlation of every column pair, average ranks for ties, pairwise complete: ``a, b, corr``.

    Columns without missing values are ranked once each; a pair with missing values is ranked over its own
    complete rows. Ranks are computed per distinct value and joined back, so ties cost nothing.
    """
    slim = df.select(*[col(c).cast("double").alias(c) for c in cols])
    one = slim.agg(F.count(F.lit(1)).alias("_n"), *[F.count(col(c)).alias(c) for c in cols]).first()
    bins = choose_bins(one["_n"]) if bins is None else bins
    whole = [c for c in cols if one[c] == one["_n"]]
    out = None
    if len(whole) > 1:
        out = pearson(_ranked(slim.select(*[col(c) for c in whole]), whole, bins), whole)
    for a, b in combinations(cols, 2):
        if a in whole and b in whole:
            continue
        pair = _ranked(slim.select(col(a), col(b)).dropna(), [a, b], bins)
        found = pearson(pair, [a, b])
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Every value replaced by its average rank in its column."""
    ranked = df
    for c in cols:
        long = df.select(F.lit(c).alias("feature"), col(c).alias("value"))
        per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        run = cumulative(per_value, ["feature"], "value", ["n"], bins)
        ranks = run.select(F.col("value").alias(c), (F.col("n_cum") - (F.col("n") - 1) / 2).alias("_rank"))
        rest = [col(o) for o in cols if o != c]
        ranked = ranked.join(ranks, c).select(*rest, F.col("_rank").alias(c))
    return ranked


def trend(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x: ``slope, intercept, r2, n``."""
    yy, xx = col(y).cast("double"), col(x).cast("double")
    return df.groupBy(*[col(b) for b in by]).agg(
        F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"),
        F.regr_count(yy, xx).alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin, lo, hi, n``: equal-width bins between minimum and maximum; the maximum falls into the last one."""
    x = col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.struct("lo", "hi").alias("e")).scalar()
    kept = df.where(x.isNotNull()).select(x.alias("x")).withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    slot = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - lo, hi - lo) * bins) + 1, F.lit(bins)), F.lit(1))
    counted = kept.groupBy(slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max(lo).alias("_lo"), F.max(hi).alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(
        "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"), (F.col("_lo") + F.col("bin") * width).alias("hi"),
        "n",
    )


def box_stats(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value", k: float = 1.5,
              rows: int | None = None) -> DataFrame:
    """``by, n, q1, median, q3, whisker_lo, whisker_hi, n_outliers``: whiskers are the last values inside the fences."""
    q = quantiles(long, by, value, [0.25, 0.5, 0.75], rows)
    iqr = F.col("q")[2] - F.col("q")[0]
    fences = q.select(
        *[col(b) for b in by], "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - k * iqr).alias("_lo"), (F.col("q")[2] + k * iqr).alias("_hi"),
    )
    x = col(value)
    inside = (x >= F.col("_lo")) & (x <= F.col("_hi"))
    return long.join(measured(fences, "fences"), list(by)).groupBy(*[col(b) for b in by]).agg(
        *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(F.when(inside, x)).alias("whisker_lo"),
        F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )


def outliers(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value", k: float = 1.5,
             rows: int | None = None) -> DataFrame:
    """The points outside the fences."""
    q = quantiles(long, by, value, [0.25, 0.75], rows)
    iqr = F.col("q")[1] - F.col("q")[0]
    fences = q.select(
        *[col(b) for b in by], (F.col("q")[0] - k * iqr).alias("_lo"), (F.col("q")[1] + k * iqr).alias("_hi")
    )
    joined = long.join(measured(fences, "fences"), list(by))
    return joined.where((col(value) < F.col("_lo")) | (col(value) > F.col("_hi"))).drop("_lo", "_hi")


def density(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """``x, density``: Gaussian kernel estimate on an even grid, bandwidth by Scott's rule.

    Every row adds to the fixed number of grid points inside one aggregate, so nothing is multiplied in a shuffle.
    """
    v = col(column).cast("double")
    p = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n")).select(
        F.struct("lo", "hi", (F.col("sd") * F.when(F.col("n") > 0, F.pow(F.col("n"), F.lit(-0.2)))).alias("h")).alias("p")
    ).scalar()
    rows = df.where(v.isNotNull()).select(v.alias("v")).withColumn("_p", p)

    def at(i: int):
        return F.col("_p.lo") + (F.col("_p.hi") - F.col("_p.lo")) * F.lit(i / (points - 1))

    root = 2.5066282746310002
    sums = rows.groupBy().agg(
        F.max("_p").alias("_p"),
        *[F.avg(F.exp(F.lit(-0.5) * F.pow(F.try_divide(F.col("v") - at(i), F.col("_p.h")), 2))).alias(f"_{i}") for i in range(points)],
    )
    cells = [F.struct(at(i).alias("x"), F.try_divide(F.col(f"_{i}"), F.col("_p.h") * root).alias("density")) for i in range(points)]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def means_by(df: DataFrame, by: str, targets: Sequence[str]) -> DataFrame:
    return df.groupBy(col(by)).agg(*[F.avg(col(t)).alias(t) for t in targets])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "Target", value: str = "Value"
         ) -> DataFrame:
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], name, value)


def min_max_norm(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0.5."""
    ends = df.agg(*[f(col(c)).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    p = ends.select(F.struct("*").alias("p")).scalar()
    out = df.withColumn("_p", p).withColumns({
        c: F.when(F.col(f"_p.hi_{i}") > F.col(f"_p.lo_{i}"),
                  (col(c) - F.col(f"_p.lo_{i}")) / (F.col(f"_p.hi_{i}") - F.col(f"_p.lo_{i}"))).otherwise(0.5)
        for i, c in enumerate(cols)
    })
    return out.drop("_p")


def location_map(df: DataFrame, dim: DataFrame, name: str, targets: Sequence[str], size_of: str) -> DataFrame:
    """Mean per location with its coordinates and a marker size that never vanishes."""
    means = means_by(df, name, targets)
    return means.join(dim, name).withColumn("marker_size", F.greatest(F.abs(col(size_of)), F.lit(0.1)))


def with_target_info(df: DataFrame, info: DataFrame, target: str = "target") -> DataFrame:
    """Display name and unit of each target; its own name and no unit when unknown. ``info`` is a fixed list."""
    return df.join(F.broadcast(info), target, "left").withColumns({
        "display_name": F.coalesce(F.col("display_name"), col(target)), "unit": F.coalesce(F.col("unit"), F.lit(""))
    })


def target_info(spark, rows=None) -> DataFrame:
    from tidemark.spec import WEATHER_TARGET_INFO

    return spark.createDataFrame(list(rows or WEATHER_TARGET_INFO), "target string, display_name string, unit string")


def forecast_stats(long: DataFrame, by: Sequence[str] = ("location", "target"), value: str = "value") -> DataFrame:
    v = col(value)
    return long.groupBy(*[col(b) for b in by]).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std")
    )


def forecast_summary(long: DataFrame, by: Sequence[str] = ("target",), step: str = "step", value: str = "value"
                     ) -> DataFrame:
    """Values in step order (an array as long as the forecast), mean, min and max rounded to 4."""
    v = F.round(col(value), 4)
    return long.groupBy(*[col(b) for b in by]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(col(step).alias("s"), v.alias("v")))), lambda e: e["v"])
        .alias("values"),
        F.round(F.avg(col(value)), 4).alias("mean"),
        F.round(F.min(col(value)), 4).alias("min"),
        F.round(F.max(col(value)), 4).alias("max"),
    )


def pair_points(df: DataFrame, pairs: Sequence[tuple[str, str]], fraction: float | None = None, seed: int = 7
                ) -> DataFrame:
    """``a, b, x, y`` for the column pairs of a scatter plot; ``fraction`` samples rows for the picture only."""
    base = df if fraction is None else df.sample(fraction=fraction, seed=seed)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).cast("double").alias("x"),
                     col(b).cast("double").alias("y")) for a, b in pairs]
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def comparison(forecast: DataFrame, step: str, location: str, targets: Sequence[str]) -> DataFrame:
    """Step by location by target, ordered for reading."""
    return forecast.select(col(location), col(step), *[col(t) for t in targets]).orderBy(col(location), col(step))


def date_bounds(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(col(date)).alias("first_date"), F.max(col(date)).alias("last_date"))


def derived_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, minimum and maximum of a derived column such as daylight hours."""
    return df.agg(F.avg(col(column)).alias("mean"), F.min(col(column)).alias("min"), F.max(col(column)).alias("max"))

