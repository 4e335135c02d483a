"""Tables of a folder as sequences, with the order key of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..seq import Seq

#: Unique order keys.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
#: Keys that number the rows from 0 without gaps.
DENSE = {"events"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sequence(spark: SparkSession, folder: str, name: str, value: str | Column) -> Seq:
    return Seq.of(load(spark, folder, name), value, KEYS[name], dense=name in DENSE)
