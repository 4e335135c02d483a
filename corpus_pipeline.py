"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again by the next.

Quality rules reject documents, near-duplicates leave one document of each group, repeated lines and sentences go, sources
are mixed to target weights, and what is left is encoded. Every stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parseq.llm import bpe, mixing, neardup, quality_rules, substrings
from parseq.llm.common import Scratch, documents, table

#: Share of the remaining tokens that the mix takes, each document at most once.
SHARE = (8, 10)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = neardup.link(docs, width=5, least=80).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.rewrite(docs, min_run=substrings.PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, share=SHARE, max_epochs=1).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality rules", rules),
    ("minhash near-dedup", near),
    ("substring dedup", repeated),
    ("mixing to target weights", mixed),
    ("bpe encoding", encoded),
]

#: SQL can't express the line labels of the first stage; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return docs
