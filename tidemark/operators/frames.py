"""Lags, rolling statistics, differences and sliding sequences over row frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators.panel import Layout, framed
from tidemark.spec import PanelSpec


@dataclass(frozen=True)
class Frames:
    """Window columns to build together; adding two keeps one window, one sort, one shuffle."""

    make: Callable[[WindowSpec], dict[str, Column]]
    reach: int

    def __add__(self, other: "Frames") -> "Frames":
        return Frames(lambda w: {**self.make(w), **other.make(w)}, max(self.reach, other.reach))

    def apply(self, df: DataFrame, spec: PanelSpec, layout: Layout | None = None) -> DataFrame:
        return framed(df, spec, self.make, self.reach, layout)


def lags(cols: Sequence[str], steps: Sequence[int] = (1, 3, 7)) -> Frames:
    """``{c}_lag_{k}``: the value k rows (not days) earlier."""
    return Frames(lambda w: {f"{c}_lag_{k}": F.lag(col(c), k).over(w) for c in cols for k in steps}, max(steps))


def rolling(cols: Sequence[str], windows: Sequence[int] = (3, 7)) -> Frames:
    """``{c}_rmean_{n}`` and ``{c}_rstd_{n}`` over the last n rows including this one."""

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in cols:
            for n in windows:
                frame = w.rowsBetween(-(n - 1), 0)
                out[f"{c}_rmean_{n}"] = F.avg(col(c)).over(frame)
                out[f"{c}_rstd_{n}"] = F.stddev_samp(col(c)).over(frame)
        return out

    return Frames(make, max(windows) - 1)


def differences(names: dict[str, tuple[str, int]]) -> Frames:
    """``{out: (column, k)}``: the value minus the value k rows earlier."""
    return Frames(
        lambda w: {out: col(c) - F.lag(col(c), k).over(w) for out, (c, k) in names.items()},
        max(k for _, k in names.values()),
    )


def persistence(target: str, out: str) -> Frames:
    """The previous value as the prediction; the first row of an entity predicts itself."""
    return Frames(lambda w: {out: F.coalesce(F.lag(col(target), 1).over(w), col(target))}, 1)


def sequences(df: DataFrame, spec: PanelSpec, features: Sequence[str], targets: Sequence[str], seq_len: int = 24,
              horizon: int = 1, layout: Layout | None = None) -> DataFrame:
    """Model inputs: ``x`` = ``seq_len`` rows of features, ``y`` = the targets ``horizon`` rows after them.

    One row per complete window: n - seq_len - horizon + 1 per entity. The row kept is the one the targets
    come from. Everything but keys, order and the needed columns is dropped before the frame multiplies rows.
    """
    if seq_len < 1 or horizon < 1:
        raise ValueError("seq_len and horizon must be at least 1")
    keep = [*spec.entity, *spec.order]
    slim = df.select(
        *[col(k) for k in keep],
        F.array(*[col(f).cast("float") for f in features]).alias("_f"),
        F.array(*[col(t).cast("float") for t in targets]).alias("y"),
    )
    reach = seq_len + horizon - 1

    def make(w: WindowSpec) -> dict[str, Column]:
        return {"x": F.collect_list("_f").over(w.rowsBetween(-reach, -horizon))}

    out = framed(slim, spec, make, reach, layout)
    return out.where(F.size("x") == seq_len).select(*[col(k) for k in keep], "x", "y")


def last_rows(df: DataFrame, spec: PanelSpec, n: int, step: str | None = None) -> DataFrame:
    """The most recent n rows per entity, optionally numbered 1..n in time order.

    The rank filter is pushed below the shuffle, so a large entity sends n rows per task, not all of them.
    """
    from pyspark.sql import Window

    by = [col(k) for k in spec.entity]
    latest = Window.partitionBy(*by).orderBy(*[col(o).desc() for o in spec.order])
    kept = df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n)
    if step:
        oldest = Window.partitionBy(*by).orderBy(F.col("_r").desc())
        kept = kept.withColumn(step, F.row_number().over(oldest))
    return kept.drop("_r")
