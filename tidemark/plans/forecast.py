"""Batch scoring: the latest windows of every entity in one job, and given input matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.operators import frames
from tidemark.operators.panel import PLAIN
from tidemark.operators.preprocess import Preprocessor
from tidemark.plans.training import Setup, model_input, score


def check_targets(requested: Sequence[str] | None, known: Sequence[str]) -> list[str]:
    unknown = sorted(set(requested or []) - set(known))
    if unknown:
        raise ValueError(f"unknown targets {unknown}; known: {list(known)}")
    return list(requested or known)


def forecast(df: DataFrame, setup: Setup, fitted: dict[str, Model], pre: Preprocessor, n_steps: int = 7,
             targets: Sequence[str] | None = None) -> DataFrame:
    """One-step predictions of the most recent ``n_steps`` windows of every entity, in original units.

    Columns: entity, order, step (1..n in time), target, y_pred, y_true. Entities with too few rows give no rows.
    Only the rows those windows need are scaled and expanded.
    """
    wanted = check_targets(targets, setup.targets)
    need = n_steps + setup.seq_len + setup.horizon - 1
    recent = frames.last_rows(df, setup.spec, need)
    data = model_input(recent, setup, pre, layout=PLAIN)  # no entity holds more than ``need`` rows
    data = frames.last_rows(data, setup.spec, n_steps, step="step")
    ids = [*setup.spec.entity, *setup.spec.order, "step"]
    return score(data, fitted, pre, setup.targets, ids).where(F.col("target").isin(wanted))


def score_matrices(inputs: DataFrame, matrix: str, setup: Setup, fitted: dict[str, Model], pre: Preprocessor,
                   ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Score a column of ready-scaled ``seq_len`` x features matrices. Returns (predictions, rejected rows)."""
    width = len(setup.features)
    m = col(matrix)
    ok = F.coalesce((F.size(m) == setup.seq_len) & F.forall(m, lambda row: F.size(row) == width), F.lit(False))
    good = inputs.where(ok).withColumn("features", array_to_vector(F.flatten(m)))
    bad = inputs.where(~ok).select(*[col(i) for i in ids], F.lit("expected a 2-D matrix of the model's shape").alias("error"))
    return score(good, fitted, pre, setup.targets, ids, truth=False), bad


def score_external(data: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], ids: Sequence[str],
                   n_targets: int) -> DataFrame:
    """Score ``features`` vectors with a model Spark does not know.

    ``load`` runs once per task and returns a function from a (rows, width) matrix to a (rows, n_targets) matrix;
    rows arrive in Arrow batches. Predictions come back as one ``y_pred`` array per row, in scaled units.
    """
    slim = data.select(*[col(i) for i in ids], vector_to_array("features").alias("_v"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("y_pred", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for batch in batches:
            if predict is None:
                predict = load()
            if len(batch):
                found = np.asarray(predict(np.stack(batch.pop("_v").to_numpy())), dtype="float64").reshape(len(batch), n_targets)
                yield batch.assign(y_pred=list(found))

    return slim.mapInPandas(run, schema)
