"""What a panel looks like: who is measured, when, and which columns are targets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PanelSpec:
    """A panel has one row per entity and time.

    ``time`` plus ``tiebreak`` must order the rows of an entity totally; every window uses both.
    ``entity=()`` treats the whole table as one series (the opt-in "global" mode).
    ``hot_rows`` is the largest number of rows of one entity that a single task may hold;
    larger entities are cut into time slots (see ``operators.panel``).
    """

    entity: tuple[str, ...]
    time: str
    tiebreak: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    hot_rows: int = 5_000_000

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tiebreak)

    def with_(self, **changes) -> "PanelSpec":
        return replace(self, **changes)


# Column lists of the weather / air-quality preset.
WEATHER_TARGETS = (
    "air_quality_Carbon_Monoxide",
    "air_quality_Ozone",
    "air_quality_Nitrogen_dioxide",
    "air_quality_Sulphur_dioxide",
    "air_quality_PM2.5",
    "air_quality_PM10",
    "temperature_celsius",
)
WEATHER_LAG_EXTRA = ("humidity", "pressure_mb", "wind_kph", "precip_mm", "uv_index")
WEATHER_ROLL_EXTRA = ("humidity", "pressure_mb", "wind_kph")
WEATHER_REDUNDANT = (
    "temperature_fahrenheit",
    "feels_like_fahrenheit",
    "pressure_in",
    "precip_in",
    "visibility_miles",
    "gust_mph",
    "wind_mph",
    "air_quality_us-epa-index",
    "air_quality_gb-defra-index",
    "moonrise",
    "moonset",
    "moon_phase",
    "moon_illumination",
    "condition_text",
    "last_updated_epoch",
    "wind_direction",
    "timezone",
)
# Target, display name, unit.
WEATHER_TARGET_INFO = (
    ("air_quality_Carbon_Monoxide", "Carbon Monoxide (CO)", "µg/m³"),
    ("air_quality_Ozone", "Ozone (O₃)", "µg/m³"),
    ("air_quality_Nitrogen_dioxide", "Nitrogen Dioxide (NO₂)", "µg/m³"),
    ("air_quality_Sulphur_dioxide", "Sulphur Dioxide (SO₂)", "µg/m³"),
    ("air_quality_PM2.5", "PM 2.5", "µg/m³"),
    ("air_quality_PM10", "PM 10", "µg/m³"),
    ("temperature_celsius", "Temperature (°C)", "°C"),
)

WEATHER = PanelSpec(
    entity=("location_name",),
    time="last_updated",
    targets=WEATHER_TARGETS,
    features=WEATHER_LAG_EXTRA,
)
