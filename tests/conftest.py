from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session  # noqa: E402
from tidemark.spec import PanelSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def spec():
    return PanelSpec(("who",), "at", ("id",), targets=("x",))


@pytest.fixture(scope="session")
def panel_pdf():
    """One large entity, a few small ones, one row alone, one missing name; gaps, ties in time, an all-missing entity."""
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for who, n in (("big", 400), ("mid", 60), ("one", 1), ("void", 12), (None, 90)):
        at = pd.Timestamp("2024-01-01")
        for _ in range(n):
            at += pd.Timedelta(minutes=int(rng.integers(0, 90)))
            missing = who == "void" or rng.random() < 0.4
            rows.append((who, at, i, None if missing else float(np.round(rng.gamma(2, 10), 2)), float(rng.normal())))
            i += 1
    return pd.DataFrame(rows, columns=["who", "at", "id", "x", "z"])


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    rows = [
        (None if r.who is None or r.who != r.who else r.who, r.at.to_pydatetime(), r.id, None if pd.isna(r.x) else r.x, r.z)
        for r in panel_pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "who string, at timestamp, id long, x double, z double").repartition(4).cache()
