"""Catalogue view over an event stream table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column expressions that Spark SQL and other engines read alike.
SHARED = """
    event_id AS row_idx,
    'ev' || CAST(event_id AS varchar(20)) AS eventID,
    -46e0 + CAST(user_id * 37 % 120 AS double) / 1e1 + CAST(event_id * 7919 % 200 AS double) / 1e3 AS latitude,
    167e0 + CAST(user_id * 53 % 110 AS double) / 1e1 + CAST(event_id * 6131 % 200 AS double) / 1e3 AS longitude,
    CAST(event_id * 31 % 4000 AS double) / 1e1 AS depth,
    2e0 + value / 115e0 AS magnitude,
    'Unknown Location' AS locality,
    event_type AS eventType
"""
SPARK_TIME = "unix_micros(cast(ts as timestamp)) div 1000"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of a folder's ``events`` table: ``row_idx`` orders rows and breaks ties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = [c.strip() for c in SHARED.replace("varchar(20)", "string").strip().split(",\n")]
    return events.select(*[F.expr(c) for c in columns], F.expr(SPARK_TIME).alias("timeMs"), F.col("ts").cast("timestamp").alias("time"), F.col("props"))
