"""Offsets, scatter and gather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..seq import Seq
from .packed import gathered, scattered  # noqa: F401
from .prefix import prefix_sums



def compute_offsets_into(seq: Seq) -> DataFrame:
    """i, length, offset: the exclusive prefix sum of the lengths."""
    return prefix_sums(seq.indexed(), "i", "v").select("i", F.col("v").alias("length"), F.col("before").alias("offset"))


def total(seq: Seq) -> DataFrame:
    return seq.df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))


def cap_and_offsets(seq: Seq) -> DataFrame:
    """i, length, offset of array values."""
    return compute_offsets_into(seq.with_values(seq.df.withColumn("v", F.greatest(F.size("v"), F.lit(0)).cast("long"))))


def check_places(indices: Seq, out: Seq, values: Seq | None = None) -> None:
    """ValueError unless each index is a position of ``out``, and there are as many ``values`` as indices: one job for all."""
    one = indices.df.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    for name, s in (("size", out), ("given", values)):
        one = one.crossJoin(s.df.agg(F.count(F.lit(1)).alias(name))) if s is not None else one
    r = one.first()
    if values is not None and r.n != r.given:
        raise ValueError(f"sequences of {r.given}, {r.n} elements, of which all should be equally long")
    if values is None and r.n != r["size"]:
        raise ValueError(f"sequences of {r['size']}, {r.n} elements, of which all should be equally long")
    if r.missing or r.low is not None and (r.low < 0 or r.high >= r["size"]):
        raise ValueError(f"positions from {r.low} to {r.high} ({r.missing} missing) in a sequence of {r['size']}")


def parallel_flatten_with_offsets(seq: Seq, offsets: DataFrame) -> DataFrame:
    """i (offset + place inside the array), v, with one offset (i, offset) for each array given by the caller; ValueError if
    some array has none or some offset no array."""
    arrays, given = seq.indexed(), offsets.select("i", "offset")
    odd = arrays.select("i", F.lit(1).alias("n")).unionAll(given.select("i", F.when(F.col("offset").isNotNull(), F.lit(1 << 32)).otherwise(0).alias("n"))).groupBy("i").agg(F.sum("n").alias("n")).filter(F.col("n") != (1 << 32) + 1)
    if not odd.isEmpty():
        raise ValueError("arrays and offsets don't belong to each other one by one")
    return arrays.join(given, "i").select(F.col("offset"), F.posexplode("v").alias("p", "x")).select((F.col("offset") + F.col("p")).alias("i"), F.col("x").alias("v"))


def parallel_scatter(out: Seq, values: Seq, indices: Seq) -> Seq:
    """out[indices[k]] = values[k], other slots as they were; of several writes to a slot the last k wins. ValueError if values
    and indices aren't equally long, or an index isn't a slot."""
    check_places(indices, out, values)
    return scattered(out, values, indices)


def slice_from(seq: Seq, offset: int, length: int) -> DataFrame:
    return seq.indexed().filter((F.col("i") >= offset) & (F.col("i") < offset + length))
