"""Shapes in which the example tables feed the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t (microseconds), id, v: the events as sensor series."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), F.col("value").alias("v"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with every tenth value missing."""
    return series(spark, sf_dir).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("v")))


#: The same in SQL.
SERIES_SQL = "s AS (SELECT event_type AS series, epoch_us(ts) AS t, event_id AS id, value AS v FROM events)"
GAPPY_SQL = "s AS (SELECT event_type AS series, epoch_us(ts) AS t, event_id AS id, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events)"
