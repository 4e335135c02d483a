"""Search and predicates. ``find_any`` forms stop early through a limit; the others are one aggregate, no sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Fn, Seq



def _holds(predicate: Fn, *columns: Column) -> Column:
    return F.coalesce(predicate(*(columns or (F.col("v"),))), F.lit(False))


def numbered(seq: Seq, found: DataFrame) -> DataFrame:
    """found (k: an element's place, and others) of at most one row, with its ``index``: how many keys are smaller."""
    if seq.dense:
        return found.withColumn("index", F.col("k.k0")).drop("k")
    before = seq.df.join(F.broadcast(found), F.struct(*seq.keys) < F.col("k")).agg(F.count(F.lit(1)).alias("index"))
    return before.crossJoin(F.broadcast(found.drop("k")))


def _at(seq: Seq, predicate: Fn, last: bool = False) -> DataFrame:
    """index, value of the first or last match; no row without one. Positions of keys that aren't dense are counts of smaller keys."""
    pick = (F.max if last else F.min)(F.when(_holds(predicate), F.struct(seq.place().alias("k"), F.col("v").alias("v"))))
    found = seq.df.agg(pick.alias("m")).filter("m is not null").select("m.k", F.col("m.v").alias("value"))
    return numbered(seq, found).select("index", "value")


def find_first(seq: Seq, predicate: Fn) -> DataFrame:
    return _at(seq, predicate)


def find_last(seq: Seq, predicate: Fn) -> DataFrame:
    return _at(seq, predicate, True)


def _position(seq: Seq, predicate: Fn, last: bool) -> DataFrame:
    if seq.dense:
        return seq.df.agg((F.max if last else F.min)(F.when(_holds(predicate), F.col("k0"))).alias("position"))
    return _at(seq, predicate, last).agg(F.max("index").alias("position"))


def position(seq: Seq, predicate: Fn) -> DataFrame:
    """One row: the least position of a match, or null."""
    return _position(seq, predicate, False)


def rposition(seq: Seq, predicate: Fn) -> DataFrame:
    return _position(seq, predicate, True)


parallel_find = position


def parallel_find_value(seq: Seq, value) -> DataFrame:
    return position(seq, lambda v: v == F.lit(value))


def find_any(seq: Seq, predicate: Fn) -> DataFrame:
    """value of some match, at most one row; tasks stop at their first match."""
    return seq.df.filter(_holds(predicate)).limit(1).select(F.col("v").alias("value"))


parallel_find_any = find_any


def position_any(seq: Seq, predicate: Fn) -> DataFrame:
    """position of some match, at most one row; the match is looked for first, then its position."""
    if seq.dense:
        return seq.df.filter(_holds(predicate)).limit(1).select(F.col("k0").alias("position"))
    # A limit may pick another row when it runs again: the least of what one run picked is one row for both uses.
    some = seq.df.filter(_holds(predicate)).select(seq.place().alias("k")).limit(1).agg(F.min("k").alias("k")).filter("k is not null")
    row = some.first()
    return numbered(seq, seq.df.sparkSession.createDataFrame([row] if row else [], some.schema)).select(F.col("index").alias("position"))


def any(seq: Seq, predicate: Fn) -> DataFrame:  # noqa: A001
    return seq.df.agg(F.coalesce(F.bool_or(_holds(predicate)), F.lit(False)).alias("any"))


def all(seq: Seq, predicate: Fn) -> DataFrame:  # noqa: A001
    return seq.df.agg(F.coalesce(F.bool_and(_holds(predicate)), F.lit(True)).alias("all"))


parallel_any, parallel_all = any, all


def exists(seq: Seq, predicate: Fn) -> bool:
    """The form for likely matches: runs partitions until one has a match."""
    return not seq.df.filter(_holds(predicate)).isEmpty()


def enumerate_any(seq: Seq, predicate: Callable[[Column, Column], Column], offset: int = 0) -> DataFrame:
    return seq.indexed().agg(F.coalesce(F.bool_or(_holds(predicate, F.col("i") + offset, F.col("v"))), F.lit(False)).alias("any"))


def enumerate_all(seq: Seq, predicate: Callable[[Column, Column], Column], offset: int = 0) -> DataFrame:
    return seq.indexed().agg(F.coalesce(F.bool_and(_holds(predicate, F.col("i") + offset, F.col("v"))), F.lit(True)).alias("all"))
