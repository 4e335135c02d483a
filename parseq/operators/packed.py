"""Sequences in blocks of positions: arrays of up to ``BLOCK`` consecutive values, cut at multiples of ``BLOCK``.

A block's place depends on positions alone, so two sequences meet block by block, whatever their keys, files or partitions.
Tasks pack the rows they read (Arrow arrays, no Python values), so what is shuffled is a row for each piece of a block. Dense keys are
positions already; other keys are dealt by ranges, packed as they are written, and moved by the counts of the ranges before.

:func:`stored` writes a sequence as a table bucketed by block: zips and dot products of stored sequences have no exchange.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..seq import Seq, bucketed, cut

BLOCK = 4096


def _piece(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("b", T.LongType()), T.StructField("start", T.LongType()), T.StructField("vs", T.ArrayType(kind))])


def _lists(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    """Neighbouring slices of ``values`` that begin at ``at`` and end with it."""
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of lists end to end, and the lengths of the lists."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _cut_up(values: pa.Array, i: np.ndarray, size: int) -> pa.RecordBatch:
    """Pieces of values at positions ``i``: new ones begin at gaps and at multiples of ``size``."""
    order = np.argsort(i, kind="stable")
    if not np.array_equal(order, np.arange(len(i))):
        i, values = i[order], values.take(pa.array(order))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (i[1:] % size == 0)]))
    return pa.RecordBatch.from_arrays([pa.array(i[new] // size), pa.array(i[new]), _lists(values, new)], names=["b", "start", "vs"])


def pieces(seq: Seq) -> DataFrame:
    """b, start, vs: the sequence in pieces of blocks; a block may come in several."""
    kind, size = seq.df.schema["v"].dataType, BLOCK
    if seq.dense:

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield _cut_up(b.column(1), b.column(0).to_numpy(), size)

        return seq.df.select("k0", "v").mapInArrow(run, _piece(kind))

    def packed(batches):
        from pyspark import TaskContext

        at, p = 0, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                values = b.column(b.num_columns - 1)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([at], pa.int64()), _lists(values, np.zeros(1, int))], names=["b", "start", "vs"])
                at += b.num_rows

    parts = int(seq.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seq.df.select(*seq.keys, "v").repartitionByRange(parts, *seq.keys).sortWithinPartitions(*seq.keys)
    written = cut(dealt.mapInArrow(packed, _piece(kind)))
    # One row for each shuffle partition.
    sizes = dict(written.groupBy("b").agg(F.sum(F.size("vs").cast("long"))).collect())
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]

    def moved(batches):
        for b in batches:
            if b.num_rows:
                values, sizes = _flat(b.column(2))
                start = np.array([first[p] for p in b.column(0).to_pylist()]) + b.column(1).to_numpy()
                yield _cut_up(values, np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(values)), size)

    return written.mapInArrow(moved, _piece(kind))


def together(spark: SparkSession, *calls: tuple) -> list:
    """Results of (function, *arguments), called at the same time: what they write before they return is written by jobs that
    run side by side."""
    with ThreadPoolExecutor(len(calls)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(f), *args) for f, *args in calls]
    return [r.result() for r in running]


def whole(t: pa.Table) -> tuple[int, pa.Array]:
    """First position and values of one block's pieces, which follow each other."""
    if not t.num_rows:
        return 0, pa.array([], t.schema.field("vs").type.value_type)
    t = t.take(pa.array(np.argsort(t.column("start").to_numpy()))).combine_chunks()
    lists = t.column("vs").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, sizes = _flat(lists)
    start = t.column("start").to_numpy()
    if (start[1:] != start[:-1] + sizes[:-1]).any():
        raise ValueError("positions are missing or come twice")
    return int(start[0]), values


def zipped(seq: Seq, other: Seq) -> Seq:
    """Pairs (a, b) at equal positions; pieces of blocks meet, rows don't travel."""
    kinds = [s.df.schema["v"].dataType for s in (seq, other)]
    pair = T.StructType([T.StructField("a", kinds[0]), T.StructField("b", kinds[1])])

    def run(left, right):
        (start, a), (_, b) = whole(left), whole(right)
        n = min(len(a), len(b))
        v = pa.StructArray.from_arrays([a.slice(0, n), b.slice(0, n)], names=["a", "b"])
        return pa.Table.from_arrays([v, pa.array(np.arange(start, start + n), pa.int64())], names=["v", "k0"])

    left, right = together(seq.df.sparkSession, (pieces, seq), (pieces, other))
    meet = left.groupBy("b").cogroup(right.groupBy("b"))
    return Seq(meet.applyInArrow(run, T.StructType([T.StructField("v", pair), T.StructField("k0", T.LongType())])), ["k0"], True)


class Stored:
    """A sequence as a table of whole blocks (b, vs), bucketed and sorted by block."""

    def __init__(self, df: DataFrame):
        self.df = df

    def seq(self) -> Seq:
        return Seq(self.df.select("b", F.posexplode("vs").alias("p", "v")).select("v", (F.col("b") * BLOCK + F.col("p")).alias("k0")), ["k0"], True)

    def zip(self, other: Stored) -> Seq:
        """Pairs (a, b) as far as the shorter one goes, without an exchange."""
        met = self._met(other).select("b", F.posexplode(F.arrays_zip(F.slice("x", 1, F.col("n")).alias("a"), F.slice("y", 1, F.col("n")).alias("b"))).alias("p", "v"))
        return Seq(met.select(F.struct(F.col("v.a").alias("a"), F.col("v.b").alias("b")).alias("v"), (F.col("b") * BLOCK + F.col("p")).alias("k0")), ["k0"], True)

    def _met(self, other: Stored) -> DataFrame:
        both = self.df.select("b", F.col("vs").alias("x")).join(other.df.select("b", F.col("vs").alias("y")).hint("merge"), "b")
        return both.withColumn("n", F.least(F.size("x"), F.size("y")))

    def dot_product(self, other: Stored) -> DataFrame:
        """Sum of products, folded inside each pair of blocks; overflow raises."""
        kind = "double" if any("double" in s.df.schema["vs"].dataType.simpleString() or "float" in s.df.schema["vs"].dataType.simpleString() for s in (self, other)) else "long"
        products = F.zip_with(F.slice("x", 1, F.col("n")), F.slice("y", 1, F.col("n")), lambda a, b: a.cast(kind) * b.cast(kind))
        folded = F.aggregate(F.filter(products, lambda x: x.isNotNull()), F.lit(0).cast(kind), lambda s, x: s + x)
        return self._met(other).agg(F.coalesce(F.sum(folded), F.lit(0).cast(kind)).alias("dot"))


def stored(seq: Seq) -> Stored:
    kind = seq.df.schema["v"].dataType

    def run(key, t):
        _, values = whole(t)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), _lists(values, np.zeros(1, int))], names=["b", "vs"])

    blocks = pieces(seq).groupBy("b").applyInArrow(run, T.StructType([T.StructField("b", T.LongType()), T.StructField("vs", T.ArrayType(kind))]))
    return Stored(bucketed(blocks, "b"))


def scattered(out: Seq, values: Seq, indices: Seq) -> Seq:
    """out[indices[k]] = values[k], the last k of a slot wins: the writes go to their slots' blocks, and one Arrow task applies
    what a block gets. Slots outside make the job fail; the caller looks at bounds first."""
    kind = out.df.schema["v"].dataType
    given = values.with_values(values.df.withColumn("v", F.col("v").cast(kind)))
    old, writes = together(out.df.sparkSession, (pieces, out), (zipped, given, indices))
    writes = writes.df.select(F.expr(f"v.b div {BLOCK}").alias("b"), F.col("v.b").alias("slot"), F.col("k0").alias("k"), F.col("v.a").alias("new"))

    def run(left, right):
        start, old = whole(left)
        slot, k = right.column("slot").to_numpy(), right.column("k").to_numpy()
        order = np.lexsort((k, slot))
        last = order[np.append(slot[order][1:] != slot[order][:-1], True)] if len(order) else order
        at = slot[last] - start
        if len(at) and not (0 <= at.min() and at.max() < len(old)):
            raise ValueError("a slot that isn't there")
        take = np.arange(len(old))
        take[at] = len(old) + np.arange(len(last))
        new = right.column("new").combine_chunks() if right.num_rows else pa.array([], old.type)
        new = (new.chunk(0) if isinstance(new, pa.ChunkedArray) else new).take(pa.array(last))
        v = pa.concat_arrays([old, new.cast(old.type)]).take(pa.array(take))
        return pa.Table.from_arrays([v, pa.array(np.arange(start, start + len(old)), pa.int64())], names=["v", "k0"])

    met = old.groupBy("b").cogroup(writes.groupBy("b"))
    return Seq(met.applyInArrow(run, T.StructType([T.StructField("v", kind), T.StructField("k0", T.LongType())])), ["k0"], True)


def gathered(seq: Seq, indices: Seq) -> Seq:
    """Value j becomes the old value at indices[j]: requests go to the blocks they ask for."""
    kind = seq.df.schema["v"].dataType
    old, asks = together(seq.df.sparkSession, (pieces, seq), (indices.indexed,))
    asks = asks.select(F.expr(f"v div {BLOCK}").alias("b"), F.col("v").alias("slot"), F.col("i").alias("k"))

    def run(left, right):
        start, values = whole(left)
        return pa.Table.from_arrays([values.take(pa.array(right.column("slot").to_numpy() - start)), right.column("k")], names=["v", "k0"])

    met = old.groupBy("b").cogroup(asks.groupBy("b"))
    return Seq(met.applyInArrow(run, T.StructType([T.StructField("v", kind), T.StructField("k0", T.LongType())])), ["k0"], True)
