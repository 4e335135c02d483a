"""The ordered sequence: a DataFrame, a value and an order key.

A DataFrame has no order, so a :class:`Seq` carries one. Operators that only need relative order compare the keys; only
those that need a position ask for the dense index ``i``, and sums, extrema and predicates never pay for it.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

Fn = Callable[..., Column]
#: The tables of :func:`dense_index`, by session; :func:`release` deletes them.
_tables: dict[int, Scratch] = {}
_lock = threading.Lock()


def scratch(session: SparkSession) -> Scratch:
    with _lock:
        if id(session) not in _tables:
            _tables[id(session)] = Scratch(session)
        return _tables[id(session)]


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that the session's tasks share."""
    return scratch(df.sparkSession).cut(df)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table there that is bucketed and sorted by a column, so that joins on it need no exchange."""
    return scratch(df.sparkSession).bucketed(df, key)


def release(spark: SparkSession) -> None:
    """Delete the tables behind dense indices; frames that use one can't be run any more."""
    if id(spark) in _tables:
        _tables.pop(id(spark)).close()


def dense_index(df: DataFrame, keys: list[str | Column], name: str = "i") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of its unique ``keys`` (names, or columns with a direction).

    Rows are dealt by ranges of the keys that Spark samples, so clustered keys spread evenly, and written; an exclusive sum
    over the ranges' counts, one row for each shuffle partition, is broadcast, and rows are numbered inside their range. The
    table is written when this is called; a declared dense key needs none.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, *keys).withColumn("p__", F.spark_partition_id()))
    starts = dealt.groupBy("p__").agg(F.count(F.lit(1)).alias("n__"))
    starts = starts.select(F.col("p__"), F.coalesce(F.sum("n__").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at__"))
    joined = dealt.join(F.broadcast(starts), "p__")
    return joined.withColumn(name, F.col("at__") + F.row_number().over(Window.partitionBy("p__").orderBy(*keys)) - 1).drop("p__", "at__")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


class Seq:
    """``df`` has the value ``v`` and the order keys ``k0``, ``k1``, ...; ``dense``: k0 is the position itself."""

    def __init__(self, df: DataFrame, keys: list[str], dense: bool = False):
        self.df, self.keys, self.dense = df, keys, dense

    @classmethod
    def of(cls, df: DataFrame, value: str | Column, order: str | list[str], dense: bool = False) -> Seq:
        """A sequence of a DataFrame's rows; ``dense`` declares that the (single) order column runs from 0 without gaps."""
        order = [order] if isinstance(order, str) else list(order)
        value = F.col(value) if isinstance(value, str) else value
        names = [f"k{n}" for n in range(len(order))]
        picked = df.select(value.alias("v"), *[F.col(o).alias(n) for o, n in zip(order, names)])
        return cls(picked.withColumn("k0", F.col("k0").cast("long")) if dense else picked, names, dense)

    @classmethod
    def from_list(cls, spark: SparkSession, values: list, kind: str = "bigint") -> Seq:
        return cls(spark.createDataFrame([(n, x) for n, x in enumerate(values)], f"k0 bigint, v {kind}").select("v", "k0"), ["k0"], True)

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int, grain: int | None = None) -> Seq:
        """Integers of [start, end); empty if end <= start. ``grain``: at most so many in a partition."""
        n = max(0, end - start)
        ids = spark.range(0, n, 1, max(1, -(-n // grain))) if grain else spark.range(0, n)
        return cls(ids.select((F.col("id") + start).alias("v"), F.col("id").alias("k0")), ["k0"], True)

    def indexed(self) -> DataFrame:
        """i, v."""
        if self.dense:
            return self.df.select(F.col("k0").alias("i"), "v")
        return dense_index(self.df, self.keys).select("i", "v")

    def key(self, descending: bool = False) -> list[Column]:
        return [F.col(k).desc() if descending else F.col(k).asc() for k in self.keys]

    def place(self) -> Column:
        """A value that orders as the rows do."""
        return F.struct(*self.keys)

    def with_values(self, df: DataFrame) -> Seq:
        return Seq(df, self.keys, self.dense)

    def __getattr__(self, name: str):
        """Operators are functions of a sequence; names in mixed case are taken too."""
        from . import operators

        if name.startswith("__"):
            raise AttributeError(name)
        f = operators.find(snake(name))
        if f is None:
            raise AttributeError(name)
        return lambda *a, **b: f(self, *a, **b)


def scalar(df: DataFrame):
    """The only value of a one-row, one-column result; None of an empty one."""
    row = df.first()
    return None if row is None else row[0]
