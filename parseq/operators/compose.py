"""Chaining, zipping, flattening, chunks."""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..seq import Fn, Seq
from .transform import with_grain



def chain(seq: Seq, other: Seq) -> Seq:
    """All of ``seq``, then all of ``other``. Reductions of it need no index: it is ordered by (side, keys). Keys of one type share
    a column; from the first place where the types differ, each side has columns of its own."""
    kinds = [[s.df.schema[k].dataType for k in s.keys] for s in (seq, other)]
    same = 0
    while same < min(map(len, kinds)) and kinds[0][same] == kinds[1][same]:
        same += 1
    rest = [k[same:] for k in kinds]
    every = [*kinds[0][:same], *rest[0], *rest[1]]
    sides = []
    for n, s in enumerate((seq, other)):
        first = same + n * len(rest[0])
        own = dict(builtins.zip([*range(same), *range(first, first + len(rest[n]))], s.keys))
        sides.append(s.df.select("v", F.lit(n).alias("k0"), *[(F.col(own[m]) if m in own else F.lit(None).cast(kind)).alias(f"k{m + 1}") for m, kind in enumerate(every)]))
    return Seq(sides[0].unionByName(sides[1]), [f"k{m}" for m in range(len(every) + 1)])


def zip(seq: Seq, other: Seq) -> Seq:  # noqa: A001
    """Pairs (a, b) at equal positions, as many as the shorter one has: blocks of positions meet. Sequences that are
    :func:`~parseq.operators.packed.stored` meet without an exchange."""
    from . import packed

    return packed.zipped(seq, other)


def zip_columns(df: DataFrame, a: str | Column, b: str | Column, order: str | list[str]) -> Seq:
    """Two columns of the same rows: the zip that needs no join."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return Seq.of(df, F.struct(a.alias("a"), b.alias("b")), order)


def unzip(seq: Seq) -> tuple[Seq, Seq]:
    return tuple(seq.with_values(seq.df.withColumn("v", F.col(f"v.{s}"))) for s in ("a", "b"))


def map_reduce(seq: Seq, aggregate: Callable[[Column, Column], Column]) -> DataFrame:
    """An aggregate expression of both sides of a zipped sequence."""
    return seq.df.agg(aggregate(F.col("v.a"), F.col("v.b")).alias("reduce"))


def dot_product(seq: Seq, wide: bool = False) -> DataFrame:
    product = F.col("v.a").cast("decimal(19,0)") * F.col("v.b").cast("decimal(19,0)") if wide else F.col("v.a") * F.col("v.b")
    return seq.df.agg(F.coalesce(F.sum(product), F.lit(0)).alias("dot"))


def flatten(seq: Seq) -> Seq:
    """The items of array values, one level, in order."""
    return Seq(seq.df.select(*seq.keys, F.posexplode("v").alias("p", "x")).select(F.col("x").alias("v"), *seq.keys, F.col("p").alias(f"k{len(seq.keys)}")), [*seq.keys, f"k{len(seq.keys)}"])


parallel_flatten = flatten


def parallel_flatten_with_grain(seq: Seq, grain: int) -> Seq:
    """The same over partitions of about ``grain`` arrays."""
    return flatten(with_grain(seq, grain))


def flatten_sum(seq: Seq) -> DataFrame:
    """Sum of all items without exploding them, in the items' own kind: double, long, or decimal of their scale. Nulls among
    the items, and null arrays, count for nothing."""
    kind = seq.df.schema["v"].dataType.elementType.simpleString()
    wide = "double" if kind in ("float", "double") else re.sub(r"\(\d+", "(38", kind) if kind.startswith("decimal") else "long"
    zero = F.lit(0).cast(wide)
    items = F.filter("v", lambda x: x.isNotNull())
    return seq.df.agg(F.coalesce(F.sum(F.aggregate(items, zero, lambda a, x: (a + x).cast(wide))), zero).alias("sum"))


def flatten_len(seq: Seq) -> DataFrame:
    return seq.df.agg(F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(0)).cast("long")), F.lit(0)).alias("len"))


def flatten_reduce(seq: Seq, inner: Fn, outer: Fn) -> DataFrame:
    """``inner`` reduces an array column to a value, ``outer`` aggregates those."""
    return seq.df.agg(outer(inner(F.col("v"))).alias("reduce"))


def _sized(size: int) -> int:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return size


def chunks_iter(seq: Seq, size: int) -> DataFrame:
    """chunk, i, v."""
    return seq.indexed().select(F.expr(f"i div {_sized(size)}").alias("chunk"), "i", "v")


chunks_mut = chunks_iter


def chunks_count(seq: Seq, size: int) -> DataFrame:
    return seq.df.agg(F.expr(f"(count(1) + {_sized(size) - 1}) div {size}").alias("chunks"))


def chunks_aggregate(seq: Seq, size: int, **aggregates: Fn) -> DataFrame:
    """chunk and each named aggregate of its values: for_each_with_index over chunks, as data."""
    return chunks_iter(seq, size).groupBy("chunk").agg(*[f(F.col("v")).alias(n) for n, f in aggregates.items()])


def chunks_reduce(seq: Seq, size: int, inner: Fn, outer: Fn) -> DataFrame:
    return chunks_aggregate(seq, size, v=inner).agg(outer(F.col("v")).alias("reduce"))


def chunks_sum(seq: Seq, size: int) -> DataFrame:
    """Total over all chunks: chunking doesn't change a sum, so none is made."""
    _sized(size)
    return seq.df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("sum"))


def chunks_apply(seq: Seq, size: int, f: Callable[[int, list], list]) -> Seq:
    """``f(chunk, values)`` gives a chunk's new values; a chunk is bounded by its size, so it fits a task. Chunks that a task has
    read whole are done there, only the rows of split ones travel."""
    from . import halo

    return halo.chunks_apply(seq, _sized(size), f)


def chunks_window(size: int) -> Window:
    """The frame of a chunk for window expressions over (i, v)."""
    return Window.partitionBy(F.expr(f"i div {_sized(size)}"))
