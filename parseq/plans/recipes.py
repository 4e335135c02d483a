"""Documented recipes as functions of DataFrames: log analysis, column statistics, normalisation, index building, numeric sums,
matrices, pixels, particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.halo import stencil

#: Weights of the luma sum over 1000, and the 3 x 3 blur kernel over 16.
LUMA = {"r": 299, "g": 587, "b": 114}
BLUR = {(-1, -1): 1, (-1, 0): 2, (-1, 1): 1, (0, -1): 2, (0, 0): 4, (0, 1): 2, (1, -1): 1, (1, 0): 2, (1, 1): 1}
#: Steps of a two-dimensional low-discrepancy sequence, over 10^9.
QUASI = (754877666, 569840291)


def log_any(logs: DataFrame, level: str, levels: list[str], text: str, message: str) -> DataFrame:
    """Whether an entry has one of the levels, and whether a message contains a text."""
    return logs.agg(F.coalesce(F.bool_or(F.col(level).isin(levels)), F.lit(False)).alias("any_level"), F.coalesce(F.bool_or(F.contains(F.col(message), F.lit(text))), F.lit(False)).alias("any_message"))


def level_counts(level: str, levels: list[str]) -> list[Column]:
    return [F.count_if(F.col(level) == x).alias(f"n_{x}") for x in levels]


def log_comprehensive(logs: DataFrame, level: str, levels: list[str], worst: str, time: Column) -> DataFrame:
    """Whether the worst level occurs, counts by level, and the time of its latest entry (0 if none): three tasks, one scan."""
    bad = F.col(level) == worst
    return logs.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_worst"), *level_counts(level, levels), F.coalesce(F.max(F.when(bad, time)), F.lit(0)).alias("latest_worst"))


def column_stats(lines: DataFrame, column: int, name: str, sep: str = ",") -> list[Column]:
    """Sum, least, greatest, count and mean of one field of delimited lines; fields that don't parse count for nothing."""
    x = F.expr(f"try_cast(split(value, '{sep}')[{column}] as double)")
    return [F.round(F.coalesce(F.sum(x), F.lit(0.0)), 2).alias(f"{name}_sum"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.count(x).alias(f"{name}_count"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(f"{name}_avg")]


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<c>_z``: population statistics of all rows in one pass, sent to the rows as a single row; values stay as they are when n < 2."""
    stats = df.agg(F.count(F.lit(1)).alias("n__"), *[F.avg(c).alias(f"{c}_m__") for c in columns], *[F.avg(F.col(c) * F.col(c)).alias(f"{c}_s__") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))
    for c in columns:
        sd = F.sqrt(F.greatest(F.col(f"{c}_s__") - F.col(f"{c}_m__") * F.col(f"{c}_m__"), F.lit(1e-15)))
        joined = joined.withColumn(f"{c}_z", F.when(F.col("n__") < 2, F.col(c)).otherwise((F.col(c) - F.col(f"{c}_m__")) / sd))
    return joined.select(*df.columns, *[f"{c}_z" for c in columns])


def minmax(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<c>_scaled`` in [0, 1]; unchanged when all values are equal."""
    stats = df.agg(F.min(column).alias("lo__"), F.max(column).alias("hi__"))
    span = F.col("hi__") - F.col("lo__")
    return df.crossJoin(F.broadcast(stats)).withColumn(f"{column}_scaled", F.when(span == 0, F.col(column)).otherwise((F.col(column) - F.col("lo__")) / span)).drop("lo__", "hi__")


def postings(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """token, doc_id, position of every maximal run of ASCII letters."""
    return docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("position", "token")).select("token", "doc_id", F.col("position").cast("long").alias("position"))


def index_stats(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """total_tokens, unique_terms: each document's own distinct tokens are exploded, its number of tokens comes with the first."""
    tokens = docs.select(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)).alias("t"))
    terms = tokens.select(F.size("t").alias("size"), F.posexplode(F.array_distinct("t")).alias("at", "token"))
    by_term = terms.groupBy("token").agg(F.sum(F.when(F.col("at") == 0, F.col("size")).otherwise(0)).alias("n"))
    return by_term.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("unique_terms"))


def quasi_pi(spark: SparkSession, n: int) -> DataFrame:
    """hits and 4 hits / n of a low-discrepancy sample of the unit square."""
    x, y = ((F.col("id") * s % 1_000_000_000) / 1e9 for s in QUASI)
    return spark.range(n).agg(F.count_if(x * x + y * y <= 1).alias("hits")).withColumn("pi", F.round(F.col("hits") * 4.0 / n, 9))


def trapezoid(spark: SparkSession, f, a: float, b: float, n: int) -> DataFrame:
    h = (b - a) / n
    x = F.lit(a) + F.col("id") * F.lit(h)
    w = F.when(F.col("id").isin(0, n), 0.5).otherwise(1.0)
    return spark.range(n + 1).agg(F.round(F.sum(f(x) * w) * h, 9).alias("integral"))


def simpson(spark: SparkSession, f, a: float, b: float, n: int) -> DataFrame:
    if n % 2:
        raise ValueError("Simpson's rule needs an even number of steps")
    h = (b - a) / n
    x = F.lit(a) + F.col("id") * F.lit(h)
    w = F.when(F.col("id").isin(0, n), 1.0).when(F.col("id") % 2 == 1, 4.0).otherwise(2.0)
    return spark.range(n + 1).agg(F.round(F.sum(f(x) * w) * (h / 3), 9).alias("integral"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, x of the product of two matrices given as (i, j, x)."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("x").alias("y"))
    return a.join(right, a.j == right.k).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("x"))


def norm(values: Column) -> Column:
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * LUMA["r"] + g * LUMA["g"] + b * LUMA["b"]) / 1000).cast("long")


def brightness(x: Column, factor: float) -> Column:
    """Scaled, clamped to a byte, truncated."""
    return F.floor(F.least(F.greatest(x * F.lit(factor), F.lit(0.0)), F.lit(255.0))).cast("long")


def blur_image(pixels: DataFrame, width: int) -> DataFrame:
    """idx, v of a 3 x 3 blur of a whole image: idx runs from 0 without gaps, the number of rows gives the height. A neighbour
    outside is the nearest column's nearest pixel; below an incomplete last row that is the row before. Pixels stay in the tasks
    that read them; at the edges of their runs partial sums travel."""
    return stencil(pixels, width, BLUR).select("idx", F.expr("total div 16").alias("v"))


def euler_step(particles: DataFrame, dt: float, bound: float, bounce: float = 0.8) -> DataFrame:
    """pos, vel, acc per axis x, y, z: one step, then reflection at 0 and ``bound`` with a loss of speed."""
    out = particles
    for a in "xyz":
        out = out.withColumn(f"v{a}", F.col(f"v{a}") + F.col(f"a{a}") * dt).withColumn(f"p{a}", F.col(f"p{a}") + F.col(f"v{a}") * dt)
        low, high = F.col(f"p{a}") < 0, F.col(f"p{a}") > bound
        out = out.withColumn(f"v{a}", F.when(low | high, -F.col(f"v{a}") * bounce).otherwise(F.col(f"v{a}"))).withColumn(f"p{a}", F.when(low, F.lit(0.0)).when(high, F.lit(float(bound))).otherwise(F.col(f"p{a}")))
    return out


def kinetic(particles: DataFrame) -> DataFrame:
    """energy, alive, max_speed2 in one aggregate; dead particles have no energy."""
    speed2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return particles.agg(F.round(F.coalesce(F.sum(F.when(F.col("alive"), F.col("mass") * speed2 / 2)), F.lit(0.0)), 4).alias("energy"), F.count_if("alive").alias("alive"), F.round(F.coalesce(F.max(F.when(F.col("alive"), speed2)), F.lit(0.0)), 6).alias("max_speed2"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    return spark.sql(f"WITH RECURSIVE f(k, a, b) AS (SELECT 0, 0L, 1L UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < {int(n)}) SELECT a AS fib FROM f WHERE k = {int(n)}")
