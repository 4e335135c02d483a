"""Reductions. Recognised reducers are Spark's own aggregates; others fold in order, in partials and one final step."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.reducers import REDUCERS, product
from ..seq import Fn, Seq
from ..session import get_grain_size
from .transform import with_grain



def sum(seq: Seq, wide: bool = False) -> DataFrame:  # noqa: A001
    """0 if empty; overflow raises, unless ``wide`` sums as a decimal of 38 digits."""
    v = F.col("v").cast("decimal(38,0)") if wide else F.col("v")
    return seq.df.agg(F.coalesce(F.sum(v), F.lit(0)).alias("sum"))


def min(seq: Seq) -> DataFrame:  # noqa: A001
    return seq.df.agg(F.min(F.col("v")).alias("min"))


def max(seq: Seq) -> DataFrame:  # noqa: A001
    return seq.df.agg(F.max(F.col("v")).alias("max"))


def count(seq: Seq) -> DataFrame:
    return seq.df.agg(F.count(F.lit(1)).alias("count"))


def reduce(seq: Seq, identity, combine: str | Callable, map: Fn | None = None) -> DataFrame:  # noqa: A002
    """``combine``: the name of a recognised reducer, or an associative Python function of two values (it need not commute).
    The identity must be neutral: it stands for the empty sequence only. Names skip nulls; ``mul`` of integers is exact and
    raises when the product isn't a long."""
    if isinstance(combine, str):
        value = map(F.col("v")) if map else F.col("v")
        if combine == "mul":
            return product(seq.df.select(value.alias("v")), identity)
        return seq.df.agg(F.coalesce(REDUCERS[combine](value), F.lit(identity)).alias("reduce"))
    return ordered_fold(seq if map is None else seq.with_values(seq.df.withColumn("v", map(F.col("v")))), identity, combine)


def ordered_fold(seq: Seq, identity, combine: Callable, fan_in: int = 16) -> DataFrame:
    """Each range partition folds its values in order to one partial; partials are folded by a tree, ``fan_in`` neighbours at a
    time, so no task reads all of them."""
    kind = seq.df.schema["v"].dataType
    names = [*seq.keys, "v"]
    rows = seq.df.select(*names)

    def fold(batches):
        first, state, schema = None, None, None
        for b in batches:
            schema = b.schema
            values = b.column(b.num_columns - 1).to_pylist()
            if not values:
                continue
            if first is None:
                first, state, values = b.slice(0, 1), values[0], values[1:]
            for x in values:
                state = combine(state, x)
        if first is not None:
            yield pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array([state], schema.field("v").type)], schema=schema)

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = rows.repartitionByRange(width, *seq.keys).sortWithinPartitions(*seq.keys).mapInArrow(numbered(fold), _with_place(rows.schema))
    return tree_fold(partial, width, fold, kind, identity, fan_in)


def _with_place(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("place__", T.LongType()), *schema.fields])


def numbered(fold: Callable) -> Callable:
    """``fold`` with the number of its partition in front of what it yields."""

    def run(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        for b in fold(batches):
            yield pa.RecordBatch.from_arrays([pa.array([place] * b.num_rows, pa.int64()), *b.columns], names=["place__", *b.schema.names])

    return run


def tree_fold(partial: DataFrame, width: int, fold: Callable, kind: T.DataType, identity, fan_in: int) -> DataFrame:
    """Partials (place__ below ``width``, keys, v), at most one for each place, folded in the order of places by levels: a task of
    each level reads at most ``fan_in`` states, however many partials there are and however large states get."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    schema = partial.schema
    while width > 1:
        width = -(-width // fan_in)

        def level(batches):
            from pyspark import TaskContext

            place = TaskContext.get().partitionId()
            inner = (pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]) for b in batches)
            for b in fold(inner):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), *b.columns], names=schema.names)

        partial = partial.repartitionById(width, F.expr(f"cast(place__ div {fan_in} as int)")).sortWithinPartitions("place__").mapInArrow(level, schema)
    return partial.agg(F.coalesce(F.first("v"), F.lit(identity).cast(kind)).alias("reduce"))


def small_fold(seq: Seq, identity: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """The same fold as column expressions over one ordered array; for sequences that fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct(*seq.keys, "v")))
    return seq.df.agg(F.aggregate(F.transform(ordered, lambda x: x["v"]), identity, combine).alias("reduce"))


def _extreme(seq: Seq, key: Fn, extreme: Callable) -> DataFrame:
    """The extreme key in one pass, then the first of its values in another; neither keeps a struct in an aggregate over all rows."""
    named = seq.df.withColumn("k__", key(F.col("v")))
    best = named.agg(extreme("k__").alias("k__"))
    return named.join(F.broadcast(best), "k__").agg(F.min_by("v", seq.place()).alias("value"))


def min_by_key(seq: Seq, key: Fn) -> DataFrame:
    """value with the least key, the first of equals; null if empty. Values with a null key don't count."""
    return _extreme(seq, key, F.min)


def max_by_key(seq: Seq, key: Fn) -> DataFrame:
    """value with the greatest key, the first of equals; null if empty. Values with a null key don't count."""
    return _extreme(seq, key, F.max)


def _by(seq: Seq, compare: Callable, swap: bool, keyed: Callable) -> DataFrame:
    if len(inspect.signature(compare).parameters) < 2:
        return keyed(seq, compare)
    better = (lambda a, b: compare(b, a) > 0) if swap else (lambda a, b: compare(b, a) < 0)
    return ordered_fold(seq, None, lambda a, b: b if better(a, b) else a).select(F.col("reduce").alias("value"))


def min_by(seq: Seq, compare: Callable) -> DataFrame:
    """value that no other is smaller than, the first of equals. ``compare(a, b)`` of two values is below, at or above 0 (an
    ordered fold in Python); with one parameter it is a key, given as a column."""
    return _by(seq, compare, False, min_by_key)


def max_by(seq: Seq, compare: Callable) -> DataFrame:
    """value that no other is greater than, the first of equals; ``compare`` as in :func:`min_by`."""
    return _by(seq, compare, True, max_by_key)


def parallel_reduce(seq: Seq, **aggregates: Fn) -> DataFrame:
    """Map-reduce with a struct as accumulator: one pass, each named aggregate a function of the value's column."""
    return seq.df.agg(*[f(F.col("v")).alias(n) for n, f in aggregates.items()])


def parallel_reduce_with_grain(seq: Seq, grain: int, **aggregates: Fn) -> DataFrame:
    """The same over partitions of about ``grain`` values; it costs a shuffle, so only for heavy work on each value."""
    return parallel_reduce(with_grain(seq, grain), **aggregates)


def parallel_reduce_chunked(seq: Seq, chunk: Callable, combine: Fn, kind: str, grain: int | None = None, identity=None) -> DataFrame:
    """``chunk`` reduces a list of at most ``grain`` values (the default grain's, if none is given) that one task has read one after
    the other to a value of type ``kind``; ``combine`` is an aggregate over those. Without rows no chunk is made, and the
    result is the ``identity``, which must be neutral for ``combine``."""
    size = grain or get_grain_size()
    if size < 0:
        raise ValueError("grain must not be negative")

    def run(batches):
        held: list = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= size:
                yield pa.RecordBatch.from_pylist([{"v": chunk(held[:size])}])
                held = held[size:]
        if held:
            yield pa.RecordBatch.from_pylist([{"v": chunk(held)}])

    return seq.df.select("v").mapInArrow(run, f"v {kind}").agg(F.coalesce(combine(F.col("v")), F.lit(identity)).alias("reduce"))


def enumerate_reduce(seq: Seq, aggregate: Callable[[Column, Column], Column], offset: int = 0) -> DataFrame:
    """``aggregate(position + offset, value)`` is an aggregate expression."""
    return seq.indexed().agg(aggregate(F.col("i") + offset, F.col("v")).alias("reduce"))


def map_sum(seq: Seq, f: Fn) -> DataFrame:
    return seq.df.agg(F.coalesce(F.sum(f(F.col("v"))), F.lit(0)).alias("sum"))
