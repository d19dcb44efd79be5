"""Time-series features, drift checks and forecasting for panels, on PySpark."""

from tidemark.spec import PanelSpec, WEATHER

__all__ = ["PanelSpec", "WEATHER"]
