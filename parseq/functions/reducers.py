"""Reducers that Spark has as aggregates, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = {
    "add": F.sum,
    "min": F.min,
    "max": F.max,
    "and": F.bit_and,
    "or": F.bit_or,
    "xor": F.bit_xor,
    "all": F.bool_and,
    "any": F.bool_or,
}

#: Factors of at least 2 that a long can have.
MOST_FACTORS = 63
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def product(df: DataFrame, identity) -> DataFrame:
    """reduce: the product of ``v``, nulls skipped; ``identity`` if there is no value. Floating values multiply as doubles. The
    product of integers is exact, and an error if it isn't a long: more than MOST_FACTORS values other than 0, 1 and -1 can't
    have one, so at most that many meet, whatever the number of rows. Decimals have no product of their own type."""
    kind = df.schema["v"].dataType.simpleString()
    if kind in ("float", "double"):
        return df.agg(F.coalesce(F.product("v"), F.lit(identity)).alias("reduce"))
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"no exact product of {kind}")
    v = F.col("v").cast("long")
    large = (v >= 2) | (v <= -2)
    counts = df.agg(F.count("v").alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(v == -1).alias("turns"), F.count_if(large).alias("factors"))
    few = df.filter(large).select(v.alias("v")).limit(MOST_FACTORS + 1).agg(F.collect_list("v").alias("list"))
    wide = lambda x: x.cast("decimal(20,0)")
    sign = F.when(F.col("turns") % 2 == 1, -1).otherwise(1)
    error = F.raise_error(F.lit("integer overflow in mul")).cast("decimal(38,0)")
    step = lambda a, x: F.when((a >= F.lit(LOW)) & (a <= F.lit(1 << 62).cast("decimal(20,0)") * 2), (a * wide(x)).cast("decimal(38,0)")).otherwise(error)
    exact = F.aggregate("list", wide(F.lit(1)).cast("decimal(38,0)"), step) * sign
    fits = F.when((F.col("factors") <= MOST_FACTORS) & (exact >= F.lit(LOW)) & (exact <= F.lit(HIGH)), exact).otherwise(error).cast("long")
    return counts.crossJoin(F.broadcast(few)).select(F.when(F.col("n") == 0, F.lit(identity).cast("long")).when(F.col("zeros") > 0, F.lit(0).cast("long")).otherwise(fits).alias("reduce"))
