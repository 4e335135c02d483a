"""Projection: values change, order and length stay."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Fn, Seq
from ..session import get_grain_size



def map(seq: Seq, f: Fn) -> Seq:  # noqa: A001
    """``f`` takes the value's column; the type may change."""
    return seq.with_values(seq.df.withColumn("v", f(F.col("v"))))


def map_python(seq: Seq, f: Callable, kind: str) -> Seq:
    """An opaque Python function of one value, run over Arrow batches; for what columns can't say."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(f)

    return seq.with_values(seq.df.withColumn("v", F.pandas_udf(run, kind)(F.col("v"))))


def parallel_collect(seq: Seq, f: Callable[..., Column], **context) -> Seq:
    """``f(value, **context)``; plain context values become literals."""
    return map(seq, lambda v: f(v, **{k: x if isinstance(x, Column) else F.lit(x) for k, x in context.items()}))


def with_grain(seq: Seq, grain: int | None = None) -> Seq:
    """The same sequence in partitions of about ``grain`` rows. It costs a shuffle: only for heavy work on each row."""
    grain = grain or get_grain_size()
    return seq.with_values(seq.df.repartition(max(1, -(-seq.df.count() // grain))))


def parallel_collect_with_grain(seq: Seq, f: Callable[..., Column], grain: int, **context) -> Seq:
    return parallel_collect(with_grain(seq, grain), f, **context)


map_in_place = parallel_map_in_place = parallel_collect
parallel_map = map


def parallel_map_in_place_with_grain(seq: Seq, f: Callable[..., Column], grain: int, **context) -> Seq:
    return parallel_collect_with_grain(seq, f, grain, **context)


def fill(seq: Seq, value) -> Seq:
    """Every value becomes ``value``, in the sequence's own type."""
    return map(seq, lambda v: F.lit(value).cast(seq.df.schema["v"].dataType))


parallel_fill = fill


def enumerate_iter(seq: Seq, offset: int = 0) -> DataFrame:
    """i (position + offset), v."""
    return seq.indexed().withColumn("i", F.col("i") + F.lit(offset).cast("long"))


enumerate_from = enumerate_iter


def enumerate_map(seq: Seq, f: Callable[[Column, Column], Column], offset: int = 0) -> Seq:
    """``f(position + offset, value)``."""
    return Seq(seq.indexed().select(f(F.col("i") + offset, F.col("v")).alias("v"), F.col("i").alias("k0")), ["k0"], True)


def filter(seq: Seq, predicate: Fn) -> Seq:  # noqa: A001
    """The subsequence whose values satisfy the predicate, positions closed up."""
    return Seq(seq.df.filter(F.coalesce(predicate(F.col("v")), F.lit(False))), seq.keys, False)


def collect(seq: Seq) -> DataFrame:
    """i, v in order: a range partitioning, not one task."""
    return seq.indexed().orderBy("i")


def to_list(seq: Seq) -> list:
    """The values on the driver, for results known to be small."""
    return [r[0] for r in seq.df.orderBy(*seq.key()).select("v").collect()]


def for_each(seq: Seq, f: Callable) -> None:
    """Run ``f`` on each value, on the executors, for its side effects; the order is not defined."""
    seq.df.select("v").foreachPartition(lambda rows: [f(r[0]) for r in rows] and None)


parallel_for_each = for_each


def enumerate_for_each(seq: Seq, f: Callable) -> None:
    seq.indexed().foreachPartition(lambda rows: [f(r[0], r[1]) for r in rows] and None)
