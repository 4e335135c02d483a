"""Queries of the operators that work on ranges and blocks: comparators, merges of runs, stored zips, tiles, scans, fences, phrases,
barriers, waves, and the forms with grains, contexts and side effects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import compare, compose, packed, reduce, tasks, transform
from ..operators.prefix import scan
from ..seq import Seq
from ..sources.fences import FenceIndex
from ..sources.tables import load, sequence
from . import postings, tiles
from .catalog import PAIRS, SQL_CENTS, THOUSANDTHS, TYPES, events, query

PRICE = "cast(round(o_totalprice * 100) as bigint)"


def by_digits(a: int, b: int) -> int:
    """Last three digits first, then the greater one first: an order that only this function knows."""
    x, y = a % 1000, b % 1000
    return (x > y) - (x < y) or (b > a) - (b < a)


@query(f"SELECT (row_number() OVER (ORDER BY x % 1000, x DESC, o_orderkey) - 1)::BIGINT AS rank, x AS v FROM (SELECT o_orderkey, {PRICE} AS x FROM orders)")
def sort_by_comparator(spark, d):
    return compare.sort_by(sequence(spark, d, "orders", F.expr(PRICE)), by_digits).df.select(F.col("k0").alias("rank"), "v")


@query("SELECT (row_number() OVER (ORDER BY length(event_type), event_id) - 1)::BIGINT AS rank, event_id, event_type FROM events")
def sort_by_comparator_ties(spark, d):
    """Five different values in all: nearly all rows are ties, and stay as they were."""
    s = Seq.of(load(spark, d, "events"), F.struct("event_id", "event_type"), "event_id", True)
    return compare.sort_by(s, lambda a, b: len(a["event_type"]) - len(b["event_type"])).df.select(F.col("k0").alias("rank"), "v.event_id", "v.event_type")


@query(f"SELECT true AS after, (SELECT bool_and(ok) FROM (SELECT coalesce(lag(row(x % 1000, -x)) OVER (ORDER BY o_orderkey) <= row(x % 1000, -x), true) AS ok FROM (SELECT o_orderkey, {PRICE} AS x FROM orders))) AS before")
def is_sorted_by_comparator(spark, d):
    s = sequence(spark, d, "orders", F.expr(PRICE))
    after = compare.is_sorted_by(compare.sort_by(s, by_digits), by_digits).withColumnRenamed("is_sorted", "after")
    return after.crossJoin(F.broadcast(compare.is_sorted_by(s, by_digits).withColumnRenamed("is_sorted", "before")))


SQL_MERGE = "SELECT (row_number() OVER (ORDER BY {by}, side, k) - 1)::BIGINT AS rank, v FROM (SELECT 0 AS side, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)"


@query(SQL_MERGE.format(by="v"))
def merge_sorted_runs(spark, d):
    a = Seq.of(load(spark, d, "customer"), "c_acctbal", ["c_acctbal", "c_custkey"])
    b = Seq.of(load(spark, d, "supplier"), "s_acctbal", ["s_acctbal", "s_suppkey"])
    return compare.merge_runs(a, b).df.select(F.col("k0").alias("rank"), "v")


@query(SQL_MERGE.format(by="v DESC"))
def merge_runs_by_comparator(spark, d):
    a, b = (load(spark, d, t).withColumn("down", -F.col(c)) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")))
    runs = Seq.of(a, "c_acctbal", ["down", "c_custkey"]), Seq.of(b, "s_acctbal", ["down", "s_suppkey"])
    return compare.merge_runs(*runs, compare=lambda x, y: (y > x) - (y < x)).df.select(F.col("k0").alias("rank"), "v")


@query(f"SELECT sum(a * b)::BIGINT AS dot FROM {PAIRS}")
def zip_stored_dot(spark, d):
    a, b = packed.stored(sequence(spark, d, "orders", "o_orderkey")), packed.stored(sequence(spark, d, "part", "p_partkey"))
    return a.dot_product(b)


@query(f"SELECT i, a, b FROM {PAIRS}")
def zip_stored_collect(spark, d):
    a, b = packed.stored(sequence(spark, d, "orders", "o_orderkey")), packed.stored(sequence(spark, d, "part", "p_partkey"))
    return a.zip(b).df.select(F.col("k0").alias("i"), "v.a", "v.b")


ALL_EVENTS = "(SELECT event_id // 512 AS i, event_id % 512 AS j, user_id % 100 - 50 AS x FROM events)"


@query(f"SELECT a.i, b.i AS j, sum(a.x * b.x)::BIGINT AS x FROM {ALL_EVENTS} a JOIN {ALL_EVENTS} b ON a.j = b.j GROUP BY 1, 2")
def matmul_tiled_cells(spark, d):
    """All events as a matrix of 512 columns, times its transpose."""
    m = load(spark, d, "events").select(F.expr("event_id div 512").alias("i"), (F.col("event_id") % 512).alias("j"), (F.col("user_id") % 100 - 50).cast("long").alias("x"))
    t = tiles.of_cells(m)
    return tiles.cells(tiles.matmul(t, tiles.transposed(t)))


@query(f"SELECT event_id, max({SQL_CENTS}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS top FROM events")
def scan_running_max(spark, d):
    return scan(events(spark, d, "cents"), np.maximum).select(F.col("k0").alias("event_id"), F.col("scan").alias("top"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_error FROM events")
def scan_last_error(spark, d):
    """Of each event the last error before it (-1: none): an operator that doesn't commute."""
    s = Seq.of(load(spark, d, "events"), F.expr("CASE WHEN event_type = 'error' THEN event_id END"), "event_id", True)
    return scan(s, lambda a, b: b, exclusive=True, identity=-1).select(F.col("k0").alias("event_id"), F.col("scan").alias("last_error"))


@query(f"SELECT event_id, sum(x) OVER (PARTITION BY part ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS since FROM (SELECT event_id, {SQL_CENTS} AS x, count(*) FILTER (WHERE event_type = 'error') OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)")
def scan_affine_restarts(spark, d):
    """Sums that begin anew at errors, as a prefix of affine maps x -> a * x + b, where an error has a = 0."""
    s = Seq.of(load(spark, d, "events"), F.struct(F.expr("CASE WHEN event_type = 'error' THEN 0L ELSE 1L END").alias("a"), F.expr("cast(round(value * 100) as bigint)").alias("b")), "event_id", True)
    done = scan(s, lambda x, y: {"a": x["a"] * y["a"], "b": y["a"] * x["b"] + y["b"]})
    return done.select(F.col("k0").alias("event_id"), F.col("scan.b").alias("since"))


PROBES = [1_000.0, 50_000.0, 123_456.78, 300_000.0, 1e9]


@query("SELECT p AS probe, (SELECT count(*) FROM orders WHERE o_totalprice < p) AS lower_bound FROM (VALUES " + ", ".join(f"({p}::DOUBLE)" for p in PROBES) + ") t(p)")
def fence_lower_bounds(spark, d):
    index = FenceIndex.build(Seq.of(load(spark, d, "orders"), F.col("o_totalprice").cast("double"), ["o_totalprice", "o_orderkey"]), rows=1000)
    return spark.createDataFrame([(p, index.lower_bound(p)) for p in PROBES], "probe double, lower_bound long")


@query("SELECT i, v FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS i, o_custkey AS v FROM orders) WHERE i >= 990 AND i < 1490")
def fence_slice(spark, d):
    return FenceIndex.build(sequence(spark, d, "orders", "o_custkey"), rows=500).slice(990, 500)


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey < m) AS position, -1::BIGINT AS missing FROM (SELECT max(p_partkey) AS m FROM part)")
def fence_position(spark, d):
    index = FenceIndex.build(sequence(spark, d, "part", "p_name"), rows=100)
    top = load(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return spark.createDataFrame([(index.position(top), -1 if index.position(-1) is None else 0)], "position long, missing long")


@query("SELECT bool_or(value > 499) AS hit, bool_or(value < 0) AS below, true AS fewer_read, 0::BIGINT AS read_below FROM events")
def early_exit_waves(spark, d):
    index = FenceIndex.build(events(spark, d), rows=100)
    found, none = index.find_any(lambda v: v > 499, above=499.0), index.find_any(lambda v: v < 0, below=0.0)
    return spark.createDataFrame([(found.hit, none.hit, found.files_read < found.files, none.files_read)], "hit boolean, below boolean, fewer_read boolean, read_below long")


SQL_WORDS = "SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents"


@query(f"WITH d AS ({SQL_WORDS}), p AS (SELECT w[1:2] AS q FROM d WHERE len(w) >= 2 ORDER BY doc_id LIMIT 1), n AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda k: w[k] = q[1] AND w[k + 1] = q[2])) AS n FROM d, p) SELECT doc_id, n::BIGINT AS n FROM n WHERE n > 0")
def phrase_documents(spark, d):
    """All documents that hold the first two words of the first document that has two."""
    docs = load(spark, d, "documents")
    first = docs.filter(F.col("text").rlike("[A-Za-z][^A-Za-z]+[A-Za-z]")).select("doc_id", "text").orderBy("doc_id").limit(1)
    found = first.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).first()
    # Without such a document the words are none that a text can have.
    return postings.phrase(postings.build(postings.of_texts(docs, "doc_id", "text")), found.w[:2] if found else ["", ""])


@query(f"WITH t AS (SELECT unnest(w) AS term, doc_id FROM ({SQL_WORDS})) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, (sum(count(*)) OVER (ORDER BY term) - count(*))::BIGINT AS first FROM t GROUP BY term")
def index_blocks_terms(spark, d):
    """Of each term its postings and documents, summed over its blocks, and the place of its first posting in the index."""
    index = postings.build(postings.of_texts(load(spark, d, "documents"), "doc_id", "text"))
    return index.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("offset").alias("first"))


@query(f"SELECT sum({SQL_CENTS})::BIGINT AS shares, sum({SQL_CENTS})::BIGINT AS least_total, sum({SQL_CENTS})::BIGINT AS greatest_total FROM events")
def barrier_totals(spark, d):
    """Each worker's share of the events, and the total that every worker knows after the exchange."""
    import pyarrow.compute as pc

    seen = tasks.gather_all(events(spark, d, "cents").df.select("v"), lambda batches: sum(pc.sum(b.column(0)).as_py() or 0 for b in batches))
    return seen.agg(F.sum("share").alias("shares"), F.min("total").alias("least_total"), F.max("total").alias("greatest_total"))


def counted(spark, run) -> tuple[int, int]:
    """How many values ``run(add)`` hands to a function, and their sum, by accumulators."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(x):
        n.add(1)
        total.add(x)

    run(add)
    return n.value, total.value


@query(f"SELECT 'chain' AS form, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT o_custkey AS v FROM orders UNION ALL SELECT p_partkey FROM part) UNION ALL SELECT 'zip', count(*), sum(a * b)::BIGINT FROM {PAIRS} UNION ALL SELECT 'flatten', count(*), sum(v)::BIGINT FROM (SELECT round(unnest(embedding) * 1000)::BIGINT AS v FROM embeddings) UNION ALL SELECT 'enumerate', count(*), sum(event_id + 5)::BIGINT FROM events UNION ALL SELECT 'range', count(*), sum(event_id)::BIGINT FROM events")
def for_each_forms(spark, d):
    orders, part = sequence(spark, d, "orders", "o_custkey"), sequence(spark, d, "part", "p_partkey")
    nested = sequence(spark, d, "embeddings", F.expr(THOUSANDTHS))
    n = load(spark, d, "events").count()
    forms = {
        "chain": lambda add: transform.for_each(compose.chain(orders, part), add),
        "zip": lambda add: transform.for_each(compose.zip(sequence(spark, d, "orders", "o_orderkey"), part), lambda v: add(v["a"] * v["b"])),
        "flatten": lambda add: transform.for_each(compose.flatten(nested), add),
        "enumerate": lambda add: transform.enumerate_for_each(events(spark, d, "cents"), lambda i, _: add(i + 5)),
        "range": lambda add: transform.for_each(Seq.range(spark, 0, n), add),
    }
    return spark.createDataFrame([(name, *counted(spark, run)) for name, run in forms.items()], "form string, n long, total long")


@query(f"SELECT arg_min(event_id, row({SQL_CENTS} % 1000, event_id)) AS least, arg_max(event_id, row({SQL_CENTS} % 1000, -event_id)) AS greatest FROM events")
def min_max_by_comparator(spark, d):
    s = Seq.of(load(spark, d, "events"), F.struct("event_id", F.expr("cast(round(value * 100) as bigint)").alias("x")), "event_id", True)
    order = lambda a, b: a["x"] % 1000 - b["x"] % 1000
    low, high = reduce.min_by(s, order), reduce.max_by(s, order)
    return low.select(F.col("value.event_id").alias("least")).crossJoin(F.broadcast(high.select(F.col("value.event_id").alias("greatest"))))


@query(f"SELECT sum({SQL_CENTS})::BIGINT AS total, count(*) AS n, (SELECT sum(round(x * 1000)::BIGINT)::BIGINT FROM (SELECT unnest(embedding) AS x FROM embeddings)) AS items, (SELECT sum(event_id * 3)::BIGINT FROM events) AS ranged FROM events")
def grain_and_context_forms(spark, d):
    """The reduce and the flatten in partitions of a grain, and a range with a context over the events' numbers."""
    sums = reduce.parallel_reduce_with_grain(events(spark, d, "cents"), 300, total=F.sum, n=lambda v: F.count(F.lit(1)))
    nested = sequence(spark, d, "embeddings", F.expr(THOUSANDTHS))
    items = reduce.sum(compose.parallel_flatten_with_grain(nested, 50)).withColumnRenamed("sum", "items")
    ranged = tasks.parallel_for_range_with_context(spark, 0, load(spark, d, "events").count(), lambda i, scale: F.sum(i * scale), scale=3).withColumnRenamed("reduce", "ranged")
    return sums.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(ranged))


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS n FROM events")
def chunked_reduce_grain(spark, d):
    return reduce.parallel_reduce_chunked(sequence(spark, d, "events", "event_type"), lambda values: values.count(TYPES[2]), F.sum, "bigint", grain=500, identity=0).withColumnRenamed("reduce", "n")


@query("SELECT product(o_custkey % 3 - 1)::BIGINT AS product, (SELECT product(3)::BIGINT FROM region) AS small FROM orders")
def reduce_product_exact(spark, d):
    """Factors of -1, 0 and 1 over all orders, and of 3 over the regions."""
    one = reduce.reduce(sequence(spark, d, "orders", F.expr("o_custkey % 3 - 1")), 1, "mul").withColumnRenamed("reduce", "product")
    return one.crossJoin(F.broadcast(reduce.reduce(sequence(spark, d, "region", F.lit(3)), 1, "mul").withColumnRenamed("reduce", "small")))


@query("SELECT sum(x)::DECIMAL(38,2)::VARCHAR AS sum FROM (SELECT unnest([o_totalprice::DECIMAL(12,2), NULL, o_custkey::DECIMAL(12,2)]) AS x FROM orders)")
def flatten_sum_nulls(spark, d):
    s = sequence(spark, d, "orders", F.expr("array(cast(o_totalprice as decimal(12,2)), null, cast(o_custkey as decimal(12,2)))"))
    return compose.flatten_sum(s).select(F.col("sum").cast("string"))


@query("SELECT bool_and(ok) AS is_sorted, false AS reversed FROM (SELECT coalesce(lag(v) OVER (ORDER BY event_id) <= v, true) AS ok FROM (SELECT event_id, CASE WHEN event_id >= 10 THEN event_id ELSE -1 END AS v FROM events))")
def is_sorted_nulls(spark, d):
    from ..operators import order

    # Nulls come first, as -1 does in the SQL.
    s = Seq.of(load(spark, d, "events"), F.expr("CASE WHEN event_id >= 10 THEN event_id END"), "event_id", True)
    return order.is_sorted(s).crossJoin(F.broadcast(order.is_sorted_desc(s).withColumnRenamed("is_sorted", "reversed")))
