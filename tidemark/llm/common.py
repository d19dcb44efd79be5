"""Text columns, Arrow batches and measured broadcasts shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import tidemark.llm

# what tasks run travels with them: executors need not have this package installed
cloudpickle.register_pickle_by_value(tidemark.llm)

#: Words are runs of anything but these six ASCII separators, which are also those of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
#: Rows of a table that is broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Characters handed to one step of a Python task at once, so that a batch of long texts stays small.
STEP_CHARS = 1_000_000
#: Rows and bytes of an Arrow batch at most: texts are long, and batches are held on both sides.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def text_of(name: str = "text") -> Column:
    """The text, valid UTF-8, with null read as empty."""
    return F.coalesce(F.make_valid_utf8(F.col(name)), F.lit(""))


def map_batches(df: DataFrame, make_step: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Rows of ``schema`` from rows of ``df``, a few at a time as lists by column.

    ``make_step`` runs once in each task and returns the step, so that tables it needs are built where they are used.
    """
    small_batches(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, step = to_arrow_schema(spark_schema), make_step()
        for batch in batches:
            for part in slices(batch):
                out = step(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def add_from(df: DataFrame, column: Column, make_step: Callable[[], Callable[[pa.Array], dict]], added: str,
             keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added``, which the step makes of the values of ``column``, a few rows at a time.

    Other columns (those in ``keep``, or all) pass through as they are, whatever their names; columns of the names added
    are replaced.
    """
    small_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    names = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), column.alias("x"))
    schema = StructType([*plain.schema.fields[:-1], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, step = to_arrow_schema(new), make_step()
        for batch in batches:
            for part in slices(batch):
                out = step(part.column(part.num_columns - 1))
                made = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    done = plain.mapInArrow(run, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *new.names)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` and ``BATCH_BYTES`` if it is larger."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(name))
        except ValueError:  # written with a unit: not yet set here
            now = 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def slices(batch: pa.RecordBatch, step_bytes: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``step_bytes``; a single larger row is a run of its own."""
    if not batch.num_rows:
        return
    each = max(1, int(batch.num_rows * step_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it was counted and is within ``limit`` rows, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df
