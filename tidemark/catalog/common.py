"""Tables, panels and rounding shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import nan_to_null
from tidemark.spec import PanelSpec

USERS = PanelSpec(entity=("user_id",), time="ts", tiebreak=("event_id",), targets=("value",))
TYPES = PanelSpec(entity=("event_type",), time="ts", tiebreak=("event_id",), targets=("value",))
TARGETS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUT = "2024-01-20"
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
PLAIN_W = "PARTITION BY user_id ORDER BY ts, event_id"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{path}/{name}.parquet"))


def events(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "events")


def gapped(spark: SparkSession, path: str) -> DataFrame:
    """An error event carries no reading: about a fifth of the readings are missing."""
    return events(spark, path).withColumn("reading", F.when(F.col("event_type") != "error", F.col("value")))


GAPPED = "(SELECT *, CASE WHEN event_type <> 'error' THEN value END AS reading FROM events)"


def geo(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers with their nation (location) and region (country)."""
    nation = table(spark, path, "nation")
    region = table(spark, path, "region")
    supplier = table(spark, path, "supplier")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("s_suppkey", "s_acctbal", F.col("n_name").alias("location_name"), F.col("r_name").alias("country"),
                F.col("s_nationkey").cast("double").alias("latitude"),
                F.col("s_suppkey").cast("double").alias("longitude"))
    )


GEO = """(SELECT s_suppkey, s_acctbal, n_name AS location_name, r_name AS country,
  CAST(s_nationkey AS DOUBLE) AS latitude, CAST(s_suppkey AS DOUBLE) AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def sr(expression: str, digits: int = 6) -> str:
    """Rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


def even_sql(expression: str, digits: int) -> str:
    """Rounding of halves to even in SQL."""
    y = f"(({expression}) * CAST(1e{digits} AS DOUBLE))"
    return f"((CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END) / CAST(1e{digits} AS DOUBLE) + 0.0)"


def steady_sql(expression: str) -> str:
    """An average by an exact sum of ten decimal digits in SQL."""
    return f"(CAST(sum(CAST({expression} AS DECIMAL(28, 10))) AS DOUBLE) / count({expression}))"


def long_sql(cols=TARGETS, source: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols)
