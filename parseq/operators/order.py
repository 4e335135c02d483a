"""Sorting and permuting. All sorts end with the position, so all are stable; Spark range-partitions and spills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..seq import Fn, Seq, dense_index
from .packed import gathered
from .place import check_places



def sort(seq: Seq, *keys: Fn, descending: bool = False) -> DataFrame:
    """Values in order of the keys (functions of the value's column; the value itself without any), ties as they were."""
    by = [(k(F.col("v")).desc() if descending else k(F.col("v")).asc()) for k in keys] or [F.col("v").desc() if descending else F.col("v").asc()]
    return seq.df.orderBy(*by, *seq.key())


def sort_asc(seq: Seq) -> DataFrame:
    return sort(seq)


def sort_desc(seq: Seq) -> DataFrame:
    return sort(seq, descending=True)


def sort_by_key(seq: Seq, key: Fn) -> DataFrame:
    return sort(seq, key)


def sort_by_cached_key(seq: Seq, key: Fn) -> DataFrame:
    """The key is a column of its own, computed once before the exchange, for costly keys."""
    return seq.df.withColumn("key", key(F.col("v"))).orderBy("key", *seq.key()).drop("key")


stable_sort, stable_sort_asc, stable_sort_desc = sort, sort_asc, sort_desc
parallel_sort, parallel_sort_by = sort_asc, sort


def ranked(seq: Seq, *keys: Fn, descending: bool = False) -> DataFrame:
    """rank (0-based position in the sorted sequence), v and the old keys: the sort as data."""
    named = seq.df
    names = []
    for n, k in enumerate(keys or (lambda v: v,)):
        named = named.withColumn(f"s{n}", k(F.col("v")))
        names.append(f"s{n}")
    by = [F.col(s).desc() if descending else F.col(s).asc() for s in names]
    return dense_index(named, [*by, *seq.keys], "rank").drop(*names)


def merge(seq: Seq, other: Seq) -> DataFrame:
    """Two sorted sequences as one; at ties the first one's values come first."""
    from .compose import chain

    return sort(chain(seq, other))


def is_sorted(seq: Seq, descending: bool = False) -> DataFrame:
    """Neighbours are compared inside ranges of the keys; of each range one row goes on, to be compared with the range before.
    Nulls are where sorts put them: first, or last if ``descending``."""
    good = lambda a, b: F.coalesce(a >= b if descending else a <= b, F.lit(True))
    dealt = seq.df.repartitionByRange(*seq.keys).withColumn("p", F.spark_partition_id()).select("p", F.struct(F.col("v").isNotNull(), "v").alias("v"), *seq.keys)
    inside = dealt.withColumn("before", F.lag("v").over(Window.partitionBy("p").orderBy(*seq.keys)))
    ends = inside.groupBy("p").agg(F.bool_and(good(F.col("before"), F.col("v"))).alias("ok"), F.min_by("v", seq.place()).alias("first"), F.max_by("v", seq.place()).alias("last"))
    across = ends.withColumn("ok", F.col("ok") & good(F.lag("last").over(Window.orderBy("p")), F.col("first")))
    return across.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))


def is_sorted_asc(seq: Seq) -> DataFrame:
    return is_sorted(seq)


def is_sorted_desc(seq: Seq) -> DataFrame:
    return is_sorted(seq, True)


def binary_search(seq: Seq, value) -> DataFrame:
    """Lower bound in a sorted sequence: how many values are smaller."""
    return seq.df.agg(F.count_if(F.col("v") < F.lit(value)).alias("lower_bound"))


def parallel_partition(seq: Seq, predicate: Fn) -> DataFrame:
    """side (0: matches), v and keys, matches first, both sides in their old order."""
    return seq.df.withColumn("side", F.when(F.coalesce(predicate(F.col("v")), F.lit(False)), 0).otherwise(1)).orderBy("side", *seq.key())


def partition_point(seq: Seq, predicate: Fn) -> DataFrame:
    return seq.df.agg(F.count_if(F.coalesce(predicate(F.col("v")), F.lit(False))).alias("matches"))


def apply_permutation(seq: Seq, indices: Seq) -> Seq:
    """Gather: value j becomes the old value at position indices[j]. ValueError if the lengths differ or a position isn't there."""
    check_places(indices, seq)
    return gathered(seq, indices)


def key_columns(*columns: Column) -> Fn:
    return lambda _: F.struct(*columns)
