"""Distribution drift between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, shared_numeric, to_long
from tidemark.functions.stats import ks_pvalue
from tidemark.operators.ordering import choose_bins, cumulative
from tidemark.operators.split import time_cuts
from tidemark.spec import PanelSpec

THRESHOLD = 0.05
MIN_ROWS = 200


def two_sides(reference: DataFrame, current: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long form ``feature, value, current`` of the shared numeric columns."""
    cols = list(cols or shared_numeric(reference, current))
    return to_long(reference, cols).withColumn("current", F.lit(False)).unionByName(
        to_long(current, cols).withColumn("current", F.lit(True))
    )


def sided(df: DataFrame, is_current: Column, cols: Sequence[str]) -> DataFrame:
    """The same long form when one flag splits one table: a single scan."""
    return to_long(df.withColumn("current", is_current), cols, ids=["current"])


def steps(long: DataFrame, bins: int | None = None, following: str | None = None) -> DataFrame:
    """Per distinct value: cumulative counts of both sides and their totals.

    Columns: feature, value, r, c, r_cum, c_cum, n_ref, n_cur.
    """
    bins = choose_bins(long.count()) if bins is None else bins
    per_value = long.groupBy("feature", "value").agg(
        F.count_if(~F.col("current")).alias("r"), F.count_if(F.col("current")).alias("c")
    )
    totals = long.groupBy("feature").agg(
        F.count_if(~F.col("current")).alias("n_ref"), F.count_if(F.col("current")).alias("n_cur")
    )
    # totals has one row per column
    run = cumulative(per_value, ["feature"], "value", ["r", "c"], bins, following)
    return run.join(F.broadcast(totals), "feature")


def ks(long: DataFrame, threshold: float = THRESHOLD, bins: int | None = None) -> DataFrame:
    """``column, ks_statistic, p_value, drift_detected, n_ref, n_cur``: the two-sample Kolmogorov-Smirnov test."""
    gap = F.abs(F.try_divide("r_cum", "n_ref") - F.try_divide("c_cum", "n_cur"))
    stat = steps(long, bins).groupBy("feature").agg(
        F.max(gap).alias("d"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur")
    ).where((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    p = ks_pvalue(F.col("d"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return stat.withColumn("p", p).select(
        F.col("feature").alias("column"),
        F.round("d", 6).alias("ks_statistic"),
        F.round("p", 6).alias("p_value"),
        (F.col("p") < threshold).alias("drift_detected"),
        "n_ref",
        "n_cur",
    )


def dataset_drift(per_column: DataFrame, share_threshold: float = THRESHOLD, listed: int = 20) -> DataFrame:
    """One row over ``ks``: share of drifted columns, the first ``listed`` of them, and the verdict."""
    # one row per column of the table
    drifted = F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column"))))
    one = per_column.agg(
        F.count_if("drift_detected").alias("n_drifted_features"),
        F.count(F.lit(1)).alias("n_total_features"),
        F.slice(drifted, 1, listed).alias("drifted_features"),
    )
    score = F.col("n_drifted_features") / F.greatest(F.col("n_total_features"), F.lit(1))
    return one.select(
        (score > share_threshold).alias("drift_detected"), F.round(score, 4).alias("drift_score"),
        "n_drifted_features", "n_total_features", "drifted_features", F.lit("ks_test").alias("method"),
    )


def concept_drift(per_column: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row over the target columns of ``ks``: any drifted target flags it."""
    return per_column.where(F.col("column").isin(list(targets))).agg(
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("concept_drift_detected"),
        F.count_if("drift_detected").alias("n_targets_drifted"),
        F.count(F.lit(1)).alias("total_targets"),
    )


def verdict(per_column: DataFrame, targets: Sequence[str], share_threshold: float = THRESHOLD) -> DataFrame:
    """One row: retrain when the table or any target drifted. Both checks read the one row per column of ``ks``."""
    is_target = F.col("column").isin(list(targets))
    drifted = F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column"))))
    one = per_column.agg(
        F.count_if("drift_detected").alias("n_drifted_features"),
        F.count(F.lit(1)).alias("n_total_features"),
        F.count_if(F.col("drift_detected") & is_target).alias("n_targets_drifted"),
        F.count_if(is_target).alias("total_targets"),
        F.slice(drifted, 1, 20).alias("drifted_features"),
    )
    score = F.col("n_drifted_features") / F.greatest(F.col("n_total_features"), F.lit(1))
    data, concept = score > share_threshold, F.col("n_targets_drifted") > 0
    return one.select(
        (data | concept).alias("should_retrain"),
        data.alias("drift_detected"),
        concept.alias("concept_drift_detected"),
        F.round(score, 4).alias("drift_score"),
        "n_drifted_features", "n_total_features", "n_targets_drifted", "total_targets", "drifted_features",
        F.when(data, "drift_above_threshold").when(concept, "concept_drift").otherwise("no_significant_drift")
        .alias("reason"),
    )


def wasserstein(long: DataFrame, threshold: float = 0.1, bins: int | None = None) -> DataFrame:
    """``column, distance, normed, drift_detected``: area between the two distribution functions over the reference
    deviation. The test to use on large samples, where KS flags every difference.
    """
    gaps = steps(long, bins, following="_next")
    height = F.abs(F.try_divide("r_cum", "n_ref") - F.try_divide("c_cum", "n_cur"))
    area = gaps.groupBy("feature").agg(F.sum(height * (F.col("_next") - F.col("value"))).alias("distance"))
    spread = long.where(~F.col("current")).groupBy("feature").agg(F.stddev_pop("value").alias("sd"))
    normed = F.col("distance") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-3)
    return area.join(F.broadcast(spread), "feature").select(
        F.col("feature").alias("column"), F.coalesce("distance", F.lit(0.0)).alias("distance"),
        F.coalesce(normed, F.lit(0.0)).alias("normed"),
        F.coalesce(normed >= threshold, F.lit(False)).alias("drift_detected"),
    )


def js_divergence(df: DataFrame, is_current: Column, column: str, threshold: float = 0.1) -> DataFrame:
    """Jensen-Shannon distance (base 2) of the category shares of one column: ``column, distance, drift_detected``."""
    shares = category_counts(df, is_current, column)
    total = shares.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p = total.select(F.struct("nr", "nc").alias("t")).scalar()
    joint = shares.withColumn("_t", p).select(
        F.try_divide("r", "_t.nr").alias("p"), F.try_divide("c", "_t.nc").alias("q")
    ).withColumn("m", (F.col("p") + F.col("q")) / 2)

    def part(s: str) -> Column:
        return F.when(F.col(s) > 0, F.col(s) * F.log2(F.col(s) / F.col("m"))).otherwise(0.0)

    distance = F.sqrt(F.greatest(F.sum((part("p") + part("q")) / 2), F.lit(0.0)))
    return joint.agg(distance.alias("distance")).select(
        F.lit(column).alias("column"), "distance", (F.col("distance") >= threshold).alias("drift_detected")
    )


def category_counts(df: DataFrame, is_current: Column, column: str) -> DataFrame:
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("category")).agg(
        F.count_if(~is_current).alias("r"), F.count_if(is_current).alias("c")
    )


def chi_square(df: DataFrame, is_current: Column, column: str) -> DataFrame:
    """``column, chi2, dof, critical_95, drift_detected``: homogeneity of the category counts of both sides.

    The 5 % critical value uses the Wilson-Hilferty approximation, which needs no special functions.
    """
    counts = category_counts(df, is_current, column)
    t = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc")).select(F.struct("nr", "nc").alias("t")).scalar()
    n = F.col("_t.nr") + F.col("_t.nc")
    row = F.col("r") + F.col("c")
    er, ec = F.try_divide(row * F.col("_t.nr"), n), F.try_divide(row * F.col("_t.nc"), n)
    cell = F.try_divide(F.pow(F.col("r") - er, 2), er) + F.try_divide(F.pow(F.col("c") - ec, 2), ec)
    one = counts.withColumn("_t", t).agg(F.sum(cell).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    k = F.col("dof").cast("double")
    spread = F.try_divide(F.lit(2.0), 9 * k)
    critical = k * F.pow(1 - spread + F.lit(1.6448536269514722) * F.sqrt(spread), 3)
    return one.select(
        F.lit(column).alias("column"), "chi2", "dof", critical.alias("critical_95"),
        F.coalesce(F.col("chi2") > critical, F.lit(False)).alias("drift_detected"),
    )


def proportion_z(df: DataFrame, is_current: Column, success: Column, label: str) -> DataFrame:
    """Two-proportion z test of a flag: ``column, p_ref, p_cur, z, drift_detected`` (two-sided, 5 %)."""
    one = df.agg(
        F.count_if(~is_current).cast("double").alias("n1"), F.count_if(is_current).cast("double").alias("n2"),
        F.count_if(success & ~is_current).alias("s1"), F.count_if(success & is_current).alias("s2"),
    )
    p1, p2 = F.try_divide("s1", "n1"), F.try_divide("s2", "n2")
    pooled = F.try_divide(F.col("s1") + F.col("s2"), F.col("n1") + F.col("n2"))
    each = F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))
    z = F.try_divide(p1 - p2, F.sqrt(pooled * (1 - pooled) * each))
    return one.select(
        F.lit(label).alias("column"), p1.alias("p_ref"), p2.alias("p_cur"), z.alias("z"),
        F.coalesce(F.abs(z) > 1.959963984540054, F.lit(False)).alias("drift_detected"),
    )


def own_past(df: DataFrame, spec: PanelSpec, cols: Sequence[str], share: float = 0.8, **options) -> DataFrame:
    """``ks`` of a table's last rows against its earlier ones, cut at the time of the row at ``share`` of all rows."""
    cut = time_cuts(df, spec, [share], by_rows=True)[0]
    return ks(sided(df, F.col(spec.time) >= F.lit(cut), cols), **options)
