"""Reductions over unbounded input with Structured Streaming; bounded sequences don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key in tumbling windows; rows later than ``late`` are dropped and state is freed behind the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def running_summary(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, least and greatest value by key, for complete or update output."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
