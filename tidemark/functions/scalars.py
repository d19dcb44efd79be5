"""Scalar feature expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import keep_null

TRANSFORMS = ("none", "log1p", "asinh")


def daylight_hours(day: Column, sunrise: Column, sunset: Column) -> Column:
    """Hours between two ``hh:mm AM/PM`` texts of one day; unreadable text gives NULL."""
    text = F.date_format(day, "yyyy-MM-dd")

    def at(clock: Column) -> Column:
        return F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", text, clock), F.lit("yyyy-MM-dd hh:mm a")))

    return F.abs(at(sunset) - at(sunrise)) / F.lit(3600.0)


def direction(degrees: Column) -> tuple[Column, Column]:
    rad = F.radians(degrees)
    return F.sin(rad), F.cos(rad)


def cyclical(when: Column, hour: bool = False) -> dict[str, Column]:
    """Sine and cosine of day of year, month and weekday (Monday is 0); hour of day on request."""
    parts = {
        "doy": (F.dayofyear(when), 365.25),
        "month": (F.month(when), 12.0),
        "dow": (F.weekday(when), 7.0),
    }
    if hour:
        parts["hour"] = (F.hour(when), 24.0)
    out = {}
    for name, (value, period) in parts.items():
        angle = value * F.lit(2 * math.pi) / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def choose_transform(skew: Column, kurt: Column, low: Column) -> Column:
    heavy = (F.abs(skew) > 1.0) | (kurt > 2.0)
    return (
        F.when(~F.coalesce(heavy, F.lit(False)), F.lit("none"))
        .when((low >= 0) & (skew >= 0), F.lit("log1p"))
        .otherwise(F.lit("asinh"))
    )


def forward(x: Column, kind: Column) -> Column:
    return (
        F.when(kind == "log1p", keep_null(x, F.log1p(F.greatest(x, F.lit(0.0)))))
        .when(kind == "asinh", F.asinh(x))
        .otherwise(x)
    )


def inverse(x: Column, kind: Column) -> Column:
    return F.when(kind == "log1p", F.expm1(x)).when(kind == "asinh", F.sinh(x)).otherwise(x)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def coerce_number(x: Column) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    return x.try_cast("double")


def short_name(x: Column, prefix: str = "air_quality_", to: str = "aq_") -> Column:
    return F.regexp_replace(x, F.lit("^" + prefix), F.lit(to))


def flatten_map(value: Column, outer: str = "model") -> Column:
    """``map<k, map<kk, v>>`` to ``map<k/kk, v>``."""
    return F.map_from_entries(
        F.flatten(
            F.transform(
                F.map_entries(value),
                lambda e: F.transform(
                    F.map_entries(e["value"]),
                    lambda m: F.struct(F.concat_ws("/", e["key"], m["key"]).alias("key"), m["value"].alias("value")),
                ),
            )
        )
    )
