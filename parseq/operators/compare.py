"""Sorting, merging and checking under an opaque order: ``compare(a, b)`` of two values, below, at or above 0.

Sorts are sample sorts. A bounded sample, ordered by the comparator, gives splitters; each row finds its range by binary search
while its Arrow batch passes; a task sorts bounded runs, spills them, and merges them as streams. Equal values are told
apart by their places, in the splitters too, so sorts are stable and a value that a third of all rows share is many ranges.

Merges of two sorted sequences sort nothing: splitters of (value, side, position) cut packed blocks of both at equal ranks, and
a task merges what it gets of either.
"""

from __future__ import annotations

import functools
import heapq
import pickle
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..seq import Seq, cut
from . import packed

#: Sampled values for each range, rows of a run in memory, rows of a batch that goes out.
SAMPLED, RUN, OUT = 32, 200_000, 8192


def natural(a, b) -> int:
    return (a > b) - (a < b)


def total_order(compare: Callable) -> Callable:
    """A sort key of (value, place): nulls first, then the comparator, then the place."""

    def both(x, y) -> int:
        a, b = x[0], y[0]
        if a is None or b is None:
            c = (a is not None) - (b is not None)
        else:
            c = compare(a, b)
        return c or natural(x[1], y[1])

    return functools.cmp_to_key(both)


def _places(b: pa.RecordBatch, width: int) -> list[tuple]:
    """Keys of rows as tuples that Python orders as Spark does, nulls first."""
    columns = [[(x is not None, x) for x in b.column(k).to_pylist()] for k in range(width)]
    return list(zip(*columns))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spilled(rows: Iterator, key: Callable, run: int) -> Iterator:
    """Rows in order: sorted runs go to files of the task's own, which are gone when it ends, and are merged as streams."""

    def stored(held):
        f = tempfile.TemporaryFile()
        for at in range(0, len(held), 1024):
            pickle.dump(held[at : at + 1024], f)
        f.seek(0)
        return f

    def read(f):
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    held, files = [], []
    for r in rows:
        held.append(r)
        if len(held) >= run:
            held.sort(key=key)
            files.append(stored(held))
            held = []
    held.sort(key=key)
    yield from heapq.merge(*map(read, files), held, key=key)


def sort_by(seq: Seq, compare: Callable, parts: int | None = None) -> Seq:
    """The sequence in the comparator's order, ties as they were, nulls first; its keys are ranks from 0. The comparator must be
    a total preorder of the values."""
    df, width, names = seq.df.select(*seq.keys, "v"), len(seq.keys), [*seq.keys, "v"]
    parts, kind = parts or _parts(df), seq.df.schema["v"].dataType
    every = max(1, df.count() // (SAMPLED * parts))
    # About SAMPLED * parts rows, whatever the input.
    sample = [(r[-1], tuple((x is not None, x) for x in r[:-1])) for r in df.filter(F.pmod(F.xxhash64(*seq.keys), F.lit(every)) == 0).collect()]
    sample.sort(key=total_order(compare))
    splitters = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    dealt_schema = T.StructType([T.StructField("part__", T.IntegerType()), *df.select(*names).schema.fields])

    def deal(batches):
        key = total_order(compare)
        marks = [key(s) for s in splitters]
        for b in batches:
            at = [bisect_right(marks, key(x)) for x in zip(b.column(width).to_pylist(), _places(b, width))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["part__", *names])

    ranked_schema = T.StructType([T.StructField("part__", T.IntegerType()), T.StructField("at__", T.LongType()), T.StructField("v", kind)])

    def ordered(batches):
        part, out_type = None, None

        def rows():
            nonlocal part, out_type
            for b in batches:
                if b.num_rows:
                    part, out_type = b.column(0)[0].as_py(), b.schema.field("v").type
                    keyed = pa.RecordBatch.from_arrays(b.columns[1:], names=names)
                    yield from zip(b.column(width + 1).to_pylist(), _places(keyed, width))

        held, at = [], 0
        for v, _ in spilled(rows(), total_order(compare), RUN):
            held.append(v)
            if len(held) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, out_type)], names=["part__", "at__", "v"])
                at, held = at + len(held), []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, out_type)], names=["part__", "at__", "v"])

    dealt = df.mapInArrow(deal, dealt_schema).repartitionById(parts, F.col("part__"))
    return _numbered(cut(dealt.mapInArrow(ordered, ranked_schema)))


def _numbered(done: DataFrame) -> Seq:
    """(part__, at__, v) with positions inside parts -> a dense sequence; one row for each part is broadcast."""
    sizes = done.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__")))
    return Seq(done.join(starts, "part__").select("v", (F.col("first__") + F.col("at__")).alias("k0")), ["k0"], True)


def is_sorted_by(seq: Seq, compare: Callable) -> DataFrame:
    """is_sorted: no value comes before one that it is greater than. Of each range of keys one row goes on."""
    df, names = seq.df.select(*seq.keys, "v"), [*seq.keys, "v"]
    kind, width = seq.df.schema["v"].dataType, len(seq.keys)
    order = lambda a, b: (a is not None) - (b is not None) if a is None or b is None else compare(a, b)
    ends = T.StructType([T.StructField("p", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("first", kind), T.StructField("last", kind)])

    def run(batches):
        from pyspark import TaskContext

        ok, some, first, last, out_type = True, False, None, None, None
        for b in batches:
            out_type = b.schema.field("v").type
            for v in b.column(width).to_pylist():
                ok = ok and not (some and order(last, v) > 0)
                first = first if some else v
                some, last = True, v
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([ok]), pa.array([first], out_type), pa.array([last], out_type)], names=ends.names)

    def across(batches):
        ok, before = True, None
        for b in batches:
            for good, first, last in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                ok = ok and good and not (before and order(before[0], first) > 0)
                before = (last,)
        yield pa.RecordBatch.from_arrays([pa.array([ok])], names=["is_sorted"])

    rows = df.repartitionByRange(_parts(df), *seq.keys).sortWithinPartitions(*seq.keys).select(*names).mapInArrow(run, ends)
    # One row for each shuffle partition.
    return rows.repartition(1).sortWithinPartitions("p").mapInArrow(across, "is_sorted boolean").agg(F.coalesce(F.bool_and("is_sorted"), F.lit(True)).alias("is_sorted"))


def merge_runs(seq: Seq, other: Seq, compare: Callable | None = None, parts: int | None = None) -> Seq:
    """Two sequences that are sorted (nulls first) as one sorted sequence, the first one's values first at ties; no row is
    sorted. Without a comparator values have Spark's order; numbers are then merged as arrays."""
    kind = seq.df.schema["v"].dataType
    parts, order_of = parts or _parts(seq.df), compare or natural
    fast = compare is None and isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType)
    first, second = packed.together(seq.df.sparkSession, (packed.pieces, seq), (packed.pieces, other))
    sides = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    blocks = cut(sides)
    every = max(1, blocks.count() // (SAMPLED * parts))
    # First values of about SAMPLED blocks for each range.
    firsts = [(r.v, (r.side, r.start)) for r in blocks.filter(F.pmod(F.xxhash64("b", "side", "start"), F.lit(every)) == 0).select(F.col("vs")[0].alias("v"), "side", "start").collect()]
    firsts.sort(key=total_order(order_of))
    splitters = [firsts[len(firsts) * k // parts] for k in range(1, parts)] if firsts else []
    piece = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("vs", T.ArrayType(kind))])

    def deal(batches):
        key = total_order(order_of)
        marks = [key(s) for s in splitters]
        for b in batches:
            rows = []
            for side, start, vs in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                values = vs.values
                at = lambda k, values=values, side=side, start=start: key((values[k].as_py(), (side, start + k)))
                low, end = 0, len(values)
                part = bisect_right(marks, at(0))
                while low < end:
                    high = bisect_left(range(low, end), marks[part], key=at) + low if part < len(marks) else end
                    if high > low:
                        rows.append((part, side, start + low, values.slice(low, high - low)))
                    low, part = high, part + 1
            if rows:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32()), pa.concat_arrays([r[3] for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), lists], names=piece.names)

    cuts = cut(blocks.mapInArrow(deal, piece))
    # One row for each range.
    sizes = dict(cuts.groupBy("part").agg(F.sum(F.size("vs").cast("long"))).collect())
    begins, total = {}, 0
    for p in sorted(sizes):
        begins[p], total = total, total + sizes[p]

    def run(batches):
        held: dict = {0: [], 1: []}
        part = None
        for b in batches:
            for p, side, start, vs in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                part = p
                held[side].append((start, vs.values))
        if part is None:
            return
        a, b = (pa.concat_arrays([v for _, v in sorted(held[s], key=lambda x: x[0])]) if held[s] else pa.array([], held[1 - s][0][1].type) for s in (0, 1))
        both = pa.concat_arrays([a, b])
        if fast and not a.null_count and not b.null_count:
            x, y = a.to_numpy(), b.to_numpy()
            place = np.concatenate([np.arange(len(x)) + np.searchsorted(y, x, "left"), np.arange(len(y)) + np.searchsorted(x, y, "right")])
            order = np.empty(len(both), np.int64)
            order[place] = np.arange(len(both))
        else:
            streams = [zip(side.to_pylist(), zip([s] * len(side), range(len(side)))) for s, side in ((0, a), (1, b))]
            order = np.array([n + s * len(a) for _, (s, n) in heapq.merge(*streams, key=total_order(order_of))], dtype=np.int64)
        at = begins[part]
        for k in range(0, len(order), OUT):
            some = order[k : k + OUT]
            yield pa.RecordBatch.from_arrays([both.take(pa.array(some)), pa.array(np.arange(at + k, at + k + len(some)), pa.int64())], names=["v", "k0"])

    merged = cuts.repartitionById(parts, F.col("part")).mapInArrow(run, T.StructType([T.StructField("v", kind), T.StructField("k0", T.LongType())]))
    return Seq(merged, ["k0"], True)
