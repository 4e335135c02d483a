"""Fallible forms: everything runs, then the leftmost error counts. Errors are data, so no task fails or is retried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Fn, Seq
from .search import numbered



class SequenceError(RuntimeError):
    def __init__(self, message: str, index):
        super().__init__(message)
        self.index = index


def try_results(seq: Seq, f: Fn, error: Fn) -> DataFrame:
    """i, value, error: ``error(v)`` is null where ``f(v)`` is good."""
    return seq.indexed().select("i", F.when(error(F.col("v")).isNull(), f(F.col("v"))).alias("value"), error(F.col("v")).alias("error"))


def first_error(seq: Seq, error: Fn) -> DataFrame:
    """index, error of the leftmost failure; no row without one. The least failing key comes first, then a count of smaller ones."""
    e = error(F.col("v"))
    found = seq.df.agg(F.min(F.when(e.isNotNull(), F.struct(seq.place().alias("k"), e.alias("e")))).alias("m")).filter("m is not null")
    return numbered(seq, found.select("m.k", F.col("m.e").alias("error"))).select("index", "error")


def try_for_each(seq: Seq, error: Fn) -> None:
    """Raises the leftmost error."""
    bad = first_error(seq, error).first()
    if bad is not None:
        raise SequenceError(bad["error"], bad["index"])


def try_reduce_frame(seq: Seq, f: Fn, error: Fn, aggregate: Fn, identity) -> DataFrame:
    """value, error_index, error: value is null if any element fails. One pass, and one over the keys if they aren't dense."""
    e = error(F.col("v"))
    done = seq.df.agg(F.min(F.when(e.isNotNull(), F.struct(seq.place().alias("k"), e.alias("e")))).alias("m"), aggregate(F.when(e.isNull(), f(F.col("v")))).alias("r"))
    value = F.when(F.col("m").isNull(), F.coalesce("r", F.lit(identity))).alias("value")
    if seq.dense:
        return done.select(value, F.col("m.k.k0").alias("error_index"), F.col("m.e").alias("error"))
    # Without an error no key is compared, and the count of smaller keys counts for nothing.
    before = seq.df.join(F.broadcast(done), F.struct(*seq.keys) < F.col("m.k")).agg(F.count(F.lit(1)).alias("index"))
    return before.crossJoin(F.broadcast(done)).select(value, F.when(F.col("m").isNotNull(), F.col("index")).alias("error_index"), F.col("m.e").alias("error"))


def try_reduce(seq: Seq, f: Fn, error: Fn, aggregate: Fn, identity):
    row = try_reduce_frame(seq, f, error, aggregate, identity).first()
    if row["error"] is not None:
        raise SequenceError(row["error"], row["error_index"])
    return row["value"]


def failing(condition: Column, message: str) -> Column:
    """An error column: the message where the condition holds."""
    return F.when(condition, F.lit(message))
