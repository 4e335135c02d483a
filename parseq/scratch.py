"""Tables in the folder that driver and executors share: they cut the lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _local["folder"], True)
    return _local["folder"]


_local: dict[str, str] = {}


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def _delete(jvm, settings, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(settings).delete(p, True)


def _at_end(*args) -> None:
    """At the driver's end the JVM may be gone; then the files stay."""
    with contextlib.suppress(Py4JError, OSError):
        _delete(*args)


class Scratch:
    """Tables written to the shared folder to cut the lineage; :meth:`drop` deletes those that nothing reads any more, and the
    driver's end all others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.numbers, self.at = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", itertools.count(1), {}
        self.names: list[str] = []
        jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
        atexit.register(_at_end, jvm, settings, self.root)

    def folder(self) -> str:
        """A path of its own for files that the caller writes."""
        return f"{self.root}/{next(self.numbers)}"

    def delete(self, path: str) -> None:
        _delete(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), path)

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (out, path)
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """The same as a table of the catalogue, in as many buckets of ``key`` as there are shuffle partitions, a file for each."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"parseq_{uuid.uuid4().hex}"
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", self.folder()).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget and delete everything."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.at = {}
        self.delete(self.root)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.at.pop(id(df))
            self.delete(path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(df for df, _ in list(self.at.values()) if not any(df is k for k in kept)))
