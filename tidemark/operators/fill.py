"""Missing values: fills along time, interpolation, medians."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators.ordering import column_quantiles
from tidemark.operators.panel import Layout, drop_neighbours, with_neighbours
from tidemark.spec import PanelSpec


def fill_along_time(df: DataFrame, spec: PanelSpec, cols: Sequence[str], layout: Layout | None = None) -> DataFrame:
    """Forward fill, then backward fill for the leading gap, per entity."""
    near = with_neighbours(df, spec, cols, layout)
    filled = near.withColumns({
        c: F.coalesce(F.col(f"_prev_{i}")["val"], F.col(f"_next_{i}")["val"]) for i, c in enumerate(cols)
    })
    return drop_neighbours(filled, cols)


def interpolate(df: DataFrame, spec: PanelSpec, cols: Sequence[str], limit: int = 3,
                layout: Layout | None = None) -> DataFrame:
    """Linear interpolation by row position: at most ``limit`` rows after each known value.

    A leading gap stays missing; a trailing gap repeats the last value, again ``limit`` rows at most.
    """
    typed = df.withColumns({c: col(c).cast("double") for c in cols})
    near = with_neighbours(typed, spec, cols, layout)

    def value(i: int, c: str) -> Column:
        prev, nxt, pos = F.col(f"_prev_{i}"), F.col(f"_next_{i}"), F.col("_pos")
        steps = pos - prev["pos"]
        line = prev["val"] + (nxt["val"] - prev["val"]) * steps / (nxt["pos"] - prev["pos"])
        return F.when(col(c).isNotNull(), col(c)).when(steps <= limit, F.coalesce(line, prev["val"]))

    return drop_neighbours(near.withColumns({c: value(i, c) for i, c in enumerate(cols)}), cols)


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: ``feature, median``."""
    return column_quantiles(df, cols, [0.5]).select("feature", F.col("q")[0].alias("median"))


def apply_params(df: DataFrame, params: DataFrame, cols: Sequence[str], fields: Sequence[str],
                 make: Callable[[Column, Callable[[str], Column]], Column]) -> DataFrame:
    """Rewrite ``cols`` with ``make(column, get)``, where ``get(field)`` is the column's fitted parameter.

    The parameter table (one row per column) is folded into one struct and read as a scalar subquery:
    it is computed once and reaches the rows as a constant, without a join.
    """
    cells = [
        F.max(F.when(F.col("feature") == c, F.col(f))).alias(f"{f}_{i}") for i, c in enumerate(cols) for f in fields
    ]
    names = [f"{f}_{i}" for i in range(len(cols)) for f in fields]
    one = params.groupBy().agg(*cells).select(F.struct(*names).alias("p"))
    with_p = df.withColumn("_p", one.scalar())
    out = with_p.withColumns(
        {c: make(col(c), lambda field, i=i: F.col("_p")[f"{field}_{i}"]) for i, c in enumerate(cols)}
    )
    return out.drop("_p")


def fill_median(df: DataFrame, cols: Sequence[str], params: DataFrame | None = None) -> DataFrame:
    """Replace what is still missing by the column median (of ``df``, or fitted earlier)."""
    params = medians(df, cols) if params is None else params
    return apply_params(df, params, cols, ["median"], lambda x, get: F.coalesce(x, get("median")))
