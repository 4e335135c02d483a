"""A fence index: a sequence in files of key ranges, with the first and last key, value bounds and first position of each file.

Files are written in key order, ``rows`` in each. Lookups ask the fences (a row for each file) for the files that matter and read
only those: a lower bound reads one file, a slice the files it lies in, and a search for a value those whose bounds hold it,
in waves of growing size that end at the first hit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..seq import Fn, Seq, scratch

#: Rows of a file; files of the first wave of a search, and the factor from wave to wave.
ROWS, FIRST, GROWTH = 1 << 20, 1, 2


@dataclass
class Found:
    """A search's answer, and how many of the index's files it began to read."""

    value: object
    hit: bool
    files_read: int
    files: int


class FenceIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fences = spark.read.parquet(f"{path}/fences")
        self.keys = self.fences.schema["first"].dataType.names
        self.schema = spark.read.parquet(f"{path}/rows").schema

    @classmethod
    def build(cls, seq: Seq, path: str | None = None, rows: int = ROWS) -> FenceIndex:
        """Write the index of a sequence; without a path it lies with the session's tables and goes with them."""
        spark = seq.df.sparkSession
        path = path or scratch(spark).folder()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = seq.df.select(*seq.keys, "v").repartitionByRange(parts, *seq.keys).sortWithinPartitions(*seq.keys)
        dealt.write.option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
        read = spark.read.schema(dealt.schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
        key = F.struct(*seq.keys)
        fences = read.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.min("v").alias("low"), F.max("v").alias("high"), F.max_by("v", key).alias("end"), F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        # The window orders one row for each file.
        fences.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/fences")
        return cls(spark, path)

    def read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files)

    def n(self) -> int:
        return self.fences.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def lower_bound(self, value) -> int:
        """How many values are smaller, in a sequence that is sorted by value: one file is read."""
        r = self.fences.filter(F.col("end") >= F.lit(value)).orderBy("start").select("file", "start").first()
        return self.n() if r is None else r.start + self.read([r.file]).agg(F.count_if(F.col("v") < F.lit(value))).first()[0]

    def lower_bound_plan(self, value) -> DataFrame | None:
        """The frame that a lower bound counts in, for a look at its plan; None if all values are smaller."""
        r = self.fences.filter(F.col("end") >= F.lit(value)).orderBy("start").select("file").first()
        return None if r is None else self.read([r.file]).filter(F.col("v") < F.lit(value))

    def position(self, *key) -> int | None:
        """Position of a key, or None: one file is read."""
        at = F.struct(*[F.lit(k).alias(n) for n, k in zip(self.keys, key)])
        r = self.fences.filter((F.col("first") <= at) & (at <= F.col("last"))).select("file", "start").first()
        if r is None:
            return None
        own = F.struct(*self.keys)
        there, before = self.read([r.file]).agg(F.count_if(own == at), F.count_if(own < at)).first()
        return r.start + before if there else None

    def slice(self, offset: int, length: int) -> DataFrame:
        """i, v of the positions [offset, offset + length): only the files they lie in are read."""
        found = self.fences.filter((F.col("start") < offset + length) & (F.col("start") + F.col("n") > offset)).select("file", "start").collect()
        if not found:
            return self.spark.createDataFrame([], f"i long, v {self.schema['v'].dataType.simpleString()}")
        rows = self.read([r.file for r in found]).withColumn("file", F.col("_metadata.file_path"))
        starts = F.broadcast(self.spark.createDataFrame([tuple(r) for r in found], "file string, start long"))
        at = F.row_number().over(Window.partitionBy("file").orderBy(*self.keys)) - 1
        numbered = rows.join(starts, "file").withColumn("i", F.col("start") + at)
        return numbered.filter((F.col("i") >= offset) & (F.col("i") < offset + length)).select("i", "v")

    def find_any(self, predicate: Fn, low=None, high=None, above=None, below=None) -> Found:
        """A value that satisfies the predicate, and lies between ``low`` and ``high`` (themselves included), and between ``above``
        and ``below`` (excluded), if they are given. Files whose bounds rule it out aren't read; the others are in waves, those
        with the widest bounds first, and a hit cancels what still runs."""

        def between(least: Column, greatest: Column) -> Column:
            """Whether some value from ``least`` to ``greatest`` can lie in the bounds."""
            tests = ((low, greatest.__ge__), (above, greatest.__gt__), (high, least.__le__), (below, least.__lt__))
            return reduce(and_, [test(F.lit(x)) for x, test in tests if x is not None], F.lit(True))

        possible, upper = between(F.col("low"), F.col("high")), low is not None or above is not None
        files = self.fences.count()
        order = [r.file for r in self.fences.filter(possible).orderBy(F.col("high").desc() if upper else F.col("low"), "start").select("file").collect()]
        context, size, begun = self.spark.sparkContext, FIRST, 0
        while order:
            wave, order, size = order[:size], order[size:], size * GROWTH
            tag = f"wave-{uuid4().hex}"
            begun += len(wave)

            def look(file: str, tag: str = tag):
                context.addJobTag(tag)
                rows = self.read([file])
                good = F.coalesce(predicate(F.col("v")), F.lit(False)) & between(F.col("v"), F.col("v"))
                return rows.filter(good).select("v").take(1)

            with ThreadPoolExecutor(len(wave)) as pool:
                jobs = [pool.submit(inheritable_thread_target(self.spark)(look), f) for f in wave]
                for job in as_completed(jobs):
                    if job.exception() is None and job.result():
                        context.cancelJobsWithTag(tag)
                        return Found(job.result()[0][0], True, begun, files)
                for job in jobs:
                    job.result()
        return Found(None, False, begun, files)
