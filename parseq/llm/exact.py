"""Operator 12 [native]: exact dedup against a persistent index of digests, bucketed and sorted by hash.

The index is a pair of tables, ``seen`` (a row for each distinct text, with the greatest row that its batch had of it) and
``more`` (what later batches brought of texts that were seen before). Both are bucketed and sorted by the SHA-256 of the
text, so new data meets them by sort-merge joins for which only the new data moves:

1. A batch is reduced to one row for each digest, with partial aggregation: a text that a third of all rows share leaves each
   task once.
2. A sort-merge anti-join with ``seen`` leaves the digests that are new; they are appended to ``seen``, as a partition of
   their own. The digests that were there, by the semi-join, are appended to ``more``.
3. :meth:`DigestIndex.lookup` joins the two tables bucket by bucket, without an exchange.

A batch has a number, and adding a batch again replaces what it added before, so a load whose driver was lost is simply run
again. Tables that lie at ``path`` are opened; ``compact`` writes one sorted file for each bucket again after many batches.

Rows that look their texts up meet the index by a sort-merge join; digests with more than a task's share of all rows, of
which there are at most as many as shuffle partitions, are broadcast instead.

Defined results: null texts are empty texts and equal to them; texts are equal when identical, whatever their length; the row
with the largest doc_id stays, of rows with that id and text one; rows without an id stay only if no equal row has one; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, make_folder, only, shuffles, table
from .components import grouped

#: Loads in which :func:`op12_exact` brings its table to the index, so that the second one meets what the first one left.
BATCHES = 2
TABLE = "digest BINARY, doc_id BIGINT, row BIGINT, n BIGINT, batch BIGINT"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for each row, once the frame is written), digest."""
    return only(docs, doc_id="long", text="string").select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest"))


def tops(rows: DataFrame) -> DataFrame:
    """digest, doc_id and row of the greatest row, n."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).select("digest", "top.*", "n")


class DigestIndex:
    """The index at ``path``, opened or begun. ``buckets`` counts when it is begun; Spark's shuffle partitions by default."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        try:
            self.buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
        except AnalysisException:
            self.buckets = buckets or shuffles(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{path}/about")
        mark = uuid.uuid4().hex
        self.names = {kind: f"digests_{kind}_{mark}" for kind in ("seen", "more")}
        for kind in self.names:
            self._open(kind)

    def _open(self, kind: str) -> None:
        name = self.names[kind]
        make_folder(self.spark, f"{self.path}/{kind}")
        self.spark.sql(f"CREATE TABLE {name} ({TABLE}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        self.spark.catalog.recoverPartitions(name)

    def _table(self, kind: str) -> DataFrame:
        return self.spark.table(self.names[kind])

    def _append(self, rows: DataFrame, kind: str, batch: int) -> None:
        """Write the batch's own partition, over what an earlier try may have left there."""
        mode, conf = "spark.sql.sources.partitionOverwriteMode", self.spark.conf
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            rows.select("digest", "doc_id", "row", "n", F.lit(batch).cast("long").alias("batch")).write.insertInto(self.names[kind], overwrite=True)
        finally:
            conf.set(mode, before)

    def add(self, found: DataFrame, batch: int) -> None:
        """Append a batch, given as :func:`tops` of its rows; it is read twice. A batch of this number is replaced."""
        others = self._table("seen").filter(F.col("batch") != batch).select("digest").hint("merge")
        self._append(found.join(others, "digest", "left_semi"), "more", batch)
        self._append(found.join(others, "digest", "left_anti"), "seen", batch)

    def lookup(self) -> DataFrame:
        """digest, keep_id, keep_batch and keep_row (the greatest row of all batches), n: one row for each distinct text."""
        top = lambda: F.struct("doc_id", "batch", "row")
        later = self._table("more").groupBy("digest").agg(F.max(top()).alias("later"), F.sum("n").alias("m"))
        both = self._table("seen").join(later.hint("merge"), "digest", "left").withColumn("keep", F.greatest(top(), F.col("later")))
        return both.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.batch").alias("keep_batch"), F.col("keep.row").alias("keep_row"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))

    def compact(self, path: str) -> DigestIndex:
        """The same index at another path, as one batch (number 0) with one sorted file for each bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        out._append(self.lookup().select("digest", F.col("keep_id").alias("doc_id"), F.col("keep_row").alias("row"), "n"), "seen", 0)
        return out

    def close(self) -> None:
        """Forget the tables' names; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup(docs: DataFrame, batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row. The digests come to an index of their own in ``batches``
    loads; tables that the result reads stay in ``scratch``, which the caller may empty when it is done."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.cut(rows_of(docs).withColumn("batch", F.pmod("row", F.lit(batches))))
    index = DigestIndex(spark, scratch.folder())
    for k in range(batches):
        found = scratch.cut(tops(rows.filter(F.col("batch") == k)))
        index.add(found, k)
        scratch.drop(found)
    known = scratch.cut(index.lookup())
    index.close()
    scratch.delete(index.path)
    out = grouped(rows, known, ["digest"], rows.count())
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), ((F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
