"""The feature chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.functions.columns import col, require
from tidemark.operators import frames
from tidemark.operators.ordering import dense_codes
from tidemark.operators.panel import Layout
from tidemark.operators.rows import drop_any_missing, drop_present
from tidemark.spec import PanelSpec

# Interaction columns and the pairs they multiply.
INTERACTIONS = {
    "temp_x_humidity": ("temperature_celsius", "humidity"),
    "wind_x_temp": ("wind_kph", "temperature_celsius"),
    "precip_x_humidity": ("precip_mm", "humidity"),
}


def add_daylight(df: DataFrame, day: str, sunrise: str = "sunrise", sunset: str = "sunset") -> DataFrame:
    if not {sunrise, sunset} <= set(df.columns):
        return df
    hours = scalars.daylight_hours(col(day), col(sunrise), col(sunset))
    return df.withColumn("daylight_hours", hours).drop(sunrise, sunset)


def add_direction(df: DataFrame, degrees: str = "wind_degree", prefix: str = "wind_dir") -> DataFrame:
    if degrees not in df.columns:
        return df
    sin, cos = scalars.direction(col(degrees))
    return df.withColumns({f"{prefix}_sin": sin, f"{prefix}_cos": cos}).drop(degrees)


def add_interactions(df: DataFrame, pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    pairs = INTERACTIONS if pairs is None else pairs
    present = {n: (a, b) for n, (a, b) in pairs.items() if a in df.columns and b in df.columns}
    return df.withColumns({n: col(a) * col(b) for n, (a, b) in present.items()}) if present else df


def add_cyclical(df: DataFrame, time: str, hour: bool = False) -> DataFrame:
    require(df, [time])
    if not isinstance(df.schema[time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{time} is not a date or timestamp")
    return df.withColumns(scalars.cyclical(col(time), hour))


def entity_codes(df: DataFrame, name: str, code: str) -> DataFrame:
    """The dimension ``name, code``. Save it with the model: codes depend on the names seen."""
    return dense_codes(df, name, code)


def add_entity_code(df: DataFrame, name: str, code: str, codes: DataFrame | None = None) -> DataFrame:
    """Alphabetical integer code of a text column; a missing or unknown name gives -1."""
    codes = entity_codes(df, name, code) if codes is None else codes
    return df.join(codes, name, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))


def build_features(
    df: DataFrame,
    spec: PanelSpec,
    lag_cols: Sequence[str],
    roll_cols: Sequence[str],
    lags: Sequence[int] = (1, 3, 7),
    windows: Sequence[int] = (3, 7),
    diffs: dict[str, tuple[str, int]] | None = None,
    interactions: dict[str, tuple[str, str]] | None = None,
    code: tuple[str, str] | None = None,
    codes: DataFrame | None = None,
    drop: Sequence[str] = (),
    complete: bool = True,
    layout: Layout | None = None,
) -> DataFrame:
    """Daylight, direction, differences, interactions, entity code, cyclical time, lags, rolling, complete rows.

    All window columns are one ``Frames``, so the panel is shuffled and sorted once.
    ``code=(name, out)`` adds the integer code of a text column. ``drop`` lists what to leave out at the end.
    """
    windowed = frames.lags(lag_cols, lags) + frames.rolling(roll_cols, windows)
    if diffs:
        windowed = windowed + frames.differences(diffs)
    out = df.transform(lambda d: add_daylight(d, spec.time)).transform(add_direction)
    out = add_interactions(out, interactions)
    out = add_cyclical(out, spec.time)
    out = windowed.apply(out, spec, layout)
    if code:
        out = add_entity_code(out, *code, codes=codes)
    if complete:
        out = drop_any_missing(out)
    return drop_present(out, drop)


def weather_features(df: DataFrame, spec: PanelSpec, codes: DataFrame | None = None,
                     layout: Layout | None = None) -> DataFrame:
    """The preset: 12 lagged and 10 rolled columns where present, text and dates dropped at the end."""
    from tidemark.spec import WEATHER_LAG_EXTRA, WEATHER_ROLL_EXTRA, WEATHER_TARGETS

    have = set(df.columns)
    lag_cols = [c for c in (*WEATHER_TARGETS, *WEATHER_LAG_EXTRA) if c in have]
    roll_cols = [c for c in (*WEATHER_TARGETS, *WEATHER_ROLL_EXTRA) if c in have]
    diffs = {"pressure_change_1d": ("pressure_mb", 1), "pressure_change_3d": ("pressure_mb", 3)}
    return build_features(
        df, spec, lag_cols, roll_cols,
        diffs=diffs if "pressure_mb" in have else None,
        code=("location_name", "location_id") if "location_name" in have else None,
        codes=codes,
        drop=("country", "location_name", "date", spec.time, *spec.tiebreak),
        layout=layout,
    )
