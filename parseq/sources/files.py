"""File sources and sinks of the recipes: delimited lines, plain text, and scans of files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: a row per line."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ",") -> DataFrame:
    """Typed columns with an explicit schema; fields that don't parse are null."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files below a folder; contents aren't read unless selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def scan_stats(found: DataFrame, most_bytes: int) -> DataFrame:
    """valid, errors, total_bytes: files over the limit are errors and don't count as bytes."""
    good = F.col("length") <= most_bytes
    return found.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("errors"), F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).alias("total_bytes"))


def write(df: DataFrame, path: str, mode: str = "error", kind: str = "parquet") -> None:
    df.write.mode(mode).format(kind).save(path)
