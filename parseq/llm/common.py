"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, make_folder  # noqa: F401

#: ASCII white space as the word pattern ``[^\x20\x09-\x0D]+`` sees it; ``bytes.split()`` cuts at exactly these bytes.
WHITESPACE = " \t\n\v\f\r"
U64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; if the scan of a few files gives work to fewer tasks than run at a time, the rows are dealt to as many."""
    docs, tasks = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if len(docs._jdf.inputFiles()) >= tasks or docs.select(F.spark_partition_id().alias("p")).distinct().count() >= tasks:
        return docs
    return docs.repartition(tasks)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash: ``only(df, doc_id="long", text="string")``."""
    return df.select(*[df[f"`{c}`"].cast(kind).alias(c) for c, kind in columns.items()])


def one_text(rows: DataFrame, mark: str) -> DataFrame:
    """doc_id, ``mark``, text: one of the texts of rows that share an id (and so its mark), so that as many rows as ids come out."""
    return rows.groupBy("doc_id", mark).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def shuffles(spark: SparkSession) -> int:
    """Partitions of a shuffle: Spark's own setting, which the operator of a cluster sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """Texts one at a time (null: empty), without a list of the whole batch."""
    for x in column:
        yield x.as_py() or ""


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Cache(dict):
    """Values of ``make(key)``, forgotten together when there are too many."""

    def __init__(self, make, most: int = 1 << 19):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal non-null keys, of batches sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(b.schema.get_field_index(k)) for k in keys]
        values = [c.to_numpy(zero_copy_only=False) for c in at]
        differs = np.zeros(b.num_rows, bool)
        for v in values:
            differs[1:] |= v[1:] != v[:-1]
        first = tuple(v[0] for v in values)
        differs[0] = first != last
        starts = np.flatnonzero(differs).tolist()
        if starts[:1] == [0] and held:
            yield pa.Table.from_batches(held)
            held = []
        bounds = ([] if starts[:1] == [0] else [0]) + starts + [b.num_rows]
        for i, (s, e) in enumerate(zip(bounds, bounds[1:])):
            if i and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held)


def packed(column) -> F.Column:
    return F.expr(f"named_struct('x', {column})")
