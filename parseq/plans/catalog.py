"""All queries of the sequence operators, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, fallible, order, place, reduce, search, tasks, transform
from ..operators.prefix import prefix_sums
from ..seq import Seq, dense_index
from ..sources.tables import load, sequence
from . import recipes, tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CENTS = "cast(round(value * 100) as bigint)"
SQL_CENTS = "cast(round(value * 100) as bigint)"
#: Embeddings in whole thousandths. A float times an integer would be a double in Spark, and is a float in the SQL: halves round otherwise.
THOUSANDTHS = "transform(embedding, x -> cast(round(x * cast(1000 as float)) as bigint))"
TYPES = ["signup", "purchase", "error", "view", "click"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str, value="value") -> Seq:
    return sequence(spark, d, "events", F.expr(CENTS) if value == "cents" else value)


def i32(s: str) -> str:
    return f"(row_number() OVER (ORDER BY {s}) - 1)::BIGINT"


# Reductions


@query(f"SELECT coalesce(sum({SQL_CENTS}), 0)::BIGINT AS sum FROM events")
def seq_sum(spark, d):
    return reduce.sum(events(spark, d, "cents"))


@query(f"SELECT min({SQL_CENTS}) AS min, max({SQL_CENTS}) AS max, count(*) AS count FROM events")
def seq_min_max_count(spark, d):
    return tasks.join_aggregates(events(spark, d, "cents"), min=F.min, max=F.max, count=lambda v: F.count(F.lit(1)))


@query("SELECT 0::BIGINT AS sum, NULL::BIGINT AS min, NULL::BIGINT AS max, 0::BIGINT AS count, false AS \"any\", true AS \"all\"")
def seq_empty_identities(spark, d):
    none = events(spark, d, "cents")
    none = Seq(none.df.filter(F.lit(False)), none.keys, True)
    one = lambda s: F.broadcast(s)
    return reduce.sum(none).crossJoin(one(reduce.min(none))).crossJoin(one(reduce.max(none))).crossJoin(one(reduce.count(none))).crossJoin(one(search.any(none, lambda v: v > 0))).crossJoin(one(search.all(none, lambda v: v > 0)))


@query("SELECT bit_xor(event_id) AS reduce FROM events")
def reduce_bitxor(spark, d):
    return reduce.reduce(sequence(spark, d, "events", "event_id"), 0, "xor")


@query("SELECT product(r_regionkey + 1)::BIGINT AS reduce FROM region")
def reduce_product_small(spark, d):
    one = F.lit(1).cast("long")
    return reduce.small_fold(sequence(spark, d, "region", F.expr("cast(r_regionkey + 1 as bigint)")), one, lambda a, x: a * x)


@query("SELECT coalesce(string_agg(event_type, '' ORDER BY event_id), '') AS reduce FROM events")
def reduce_ordered_concat(spark, d):
    return reduce.ordered_fold(sequence(spark, d, "events", "event_type"), "", lambda a, b: a + b)


@query("SELECT (SELECT arg_min(event_id, row(user_id, event_id)) FROM events) AS first_least, (SELECT arg_max(event_id, row(user_id, -event_id)) FROM events) AS first_greatest")
def min_max_by_key_ties(spark, d):
    s = Seq.of(load(spark, d, "events"), F.struct("event_id", "user_id"), "event_id", True)
    a = reduce.min_by_key(s, lambda v: v["user_id"]).select(F.col("value.event_id").alias("first_least"))
    b = reduce.max_by_key(s, lambda v: v["user_id"]).select(F.col("value.event_id").alias("first_greatest"))
    return a.crossJoin(F.broadcast(b))


@query(f"SELECT arg_min({SQL_CENTS}, row(abs({SQL_CENTS} - 10000), event_id)) AS value FROM events")
def min_by_key_distance(spark, d):
    return reduce.min_by_key(events(spark, d, "cents"), lambda v: F.abs(v - 10000))


@query("SELECT count(*) AS n, sum(l_quantity)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def map_reduce_struct(spark, d):
    row = F.struct("l_quantity", "l_extendedprice", "l_shipdate")
    return reduce.parallel_reduce(sequence(spark, d, "lineitem", row), n=lambda v: F.count(F.lit(1)), qty=lambda v: F.sum(v["l_quantity"]).cast("long"), cents=lambda v: F.sum(F.round(v["l_extendedprice"] * 100).cast("long")), first_ship=lambda v: F.min(v["l_shipdate"]), last_ship=lambda v: F.max(v["l_shipdate"]))


@query(f"SELECT sum({SQL_CENTS})::BIGINT AS reduce FROM events")
def chunked_reduce(spark, d):
    return reduce.parallel_reduce_chunked(events(spark, d, "cents"), sum, F.sum, "bigint")


@query("SELECT coalesce(sum(o_orderkey * o_orderkey), 0)::BIGINT AS sum FROM orders")
def map_sum(spark, d):
    return reduce.map_sum(sequence(spark, d, "orders", "o_orderkey"), lambda v: v * v)


@query("SELECT sum(o_orderkey::HUGEINT * o_orderkey)::DECIMAL(38,0)::VARCHAR AS sum FROM orders")
def wide_sum(spark, d):
    s = sequence(spark, d, "orders", F.expr("cast(o_orderkey as decimal(19,0)) * o_orderkey"))
    return reduce.sum(s, wide=True).select(F.col("sum").cast("string"))


# Transforms


@query(f"SELECT {i32('o_orderkey')} AS i, o_orderkey * o_orderkey AS v FROM orders")
def map_square_collect(spark, d):
    return transform.collect(transform.map(sequence(spark, d, "orders", "o_orderkey"), lambda v: v * v))


@query(f"SELECT event_id AS i, {SQL_CENTS} * 3 + 7 AS v FROM events")
def map_in_place_context(spark, d):
    return transform.parallel_map_in_place(events(spark, d, "cents"), lambda v, scale, shift: v * scale + shift, scale=3, shift=7).indexed()


@query("SELECT event_id AS i, 42::BIGINT AS v FROM events")
def fill_const(spark, d):
    return transform.fill(events(spark, d, "cents"), 42).indexed()


@query(f"SELECT event_id AS i, {SQL_CENTS} % 97 AS v FROM events")
def map_python_batches(spark, d):
    return transform.map_python(events(spark, d, "cents"), lambda x: x % 97, "bigint").indexed()


@query(f"SELECT {i32('o_orderkey')} + 100 AS i, o_orderkey AS v FROM orders")
def enumerate_from(spark, d):
    return transform.enumerate_from(sequence(spark, d, "orders", "o_orderkey"), 100)


@query(f"SELECT sum(i * o_orderkey)::BIGINT AS reduce FROM (SELECT {i32('o_orderkey')} AS i, o_orderkey FROM orders)")
def enumerate_weighted_sum(spark, d):
    return reduce.enumerate_reduce(sequence(spark, d, "orders", "o_orderkey"), lambda i, v: F.sum(i * v))


@query(f"SELECT event_id AS i, {SQL_CENTS} + event_id AS v FROM events")
def enumerate_map(spark, d):
    return transform.enumerate_map(events(spark, d, "cents"), lambda i, v: v + i).indexed()


@query(f"SELECT bool_or(event_id % 2 = 1 AND {SQL_CENTS} > 48000) AS \"any\", bool_and({SQL_CENTS} + event_id > 0) AS \"all\" FROM events")
def enumerate_any_all(spark, d):
    s = events(spark, d, "cents")
    return search.enumerate_any(s, lambda i, v: (i % 2 == 1) & (v > 48000)).crossJoin(F.broadcast(search.enumerate_all(s, lambda i, v: v + i > 0)))


@query("SELECT i, event_type AS v FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS i, event_type FROM events WHERE event_type = 'error')")
def filter_compact(spark, d):
    return transform.filter(sequence(spark, d, "events", "event_type"), lambda v: v == "error").indexed()


# Search


@query("SELECT min(event_id) AS index, 'error' AS value FROM events WHERE event_type = 'error'")
def find_first(spark, d):
    return search.find_first(sequence(spark, d, "events", "event_type"), lambda v: v == "error")


@query("SELECT max(event_id) AS index, 'error' AS value FROM events WHERE event_type = 'error'")
def find_last(spark, d):
    return search.find_last(sequence(spark, d, "events", "event_type"), lambda v: v == "error")


@query(f"WITH o AS (SELECT {i32('o_orderkey')} AS i, o_totalprice FROM orders) SELECT min(i) AS position FROM o WHERE o_totalprice > 300000")
def position_sparse_keys(spark, d):
    return search.position(sequence(spark, d, "orders", "o_totalprice"), lambda v: v > 300000)


@query("SELECT min(event_id) AS position FROM events WHERE value > 400")
def position(spark, d):
    return search.position(events(spark, d), lambda v: v > 400)


@query("SELECT max(event_id) AS position FROM events WHERE value > 400")
def rposition(spark, d):
    return search.rposition(events(spark, d), lambda v: v > 400)


@query("SELECT min(event_id) AS position FROM events WHERE user_id = 7")
def find_value(spark, d):
    return search.parallel_find_value(sequence(spark, d, "events", "user_id"), 7)


@query("SELECT count(*) AS found FROM (SELECT 1 FROM events WHERE value > 400 LIMIT 1)")
def find_any_exists(spark, d):
    """How many rows find_any gives: which match it is isn't defined."""
    return search.find_any(events(spark, d), lambda v: v > 400).agg(F.count(F.lit(1)).alias("found"))


@query("SELECT count(*) AS found FROM (SELECT 1 FROM events WHERE value > 400 LIMIT 1)")
def position_any_exists(spark, d):
    return search.position_any(events(spark, d), lambda v: v > 400).agg(F.count(F.lit(1)).alias("found"))


@query("SELECT coalesce(bool_or(value > 490), false) AS \"any\", coalesce(bool_and(value > 0), true) AS \"all\" FROM events")
def any_all(spark, d):
    s = events(spark, d)
    return s.df.agg(*[F.coalesce(F.bool_or(F.col("v") > 490), F.lit(False)).alias("any"), F.coalesce(F.bool_and(F.col("v") > 0), F.lit(True)).alias("all")])


@query("SELECT coalesce(bool_or(value < 0), false) AS \"any\" FROM events")
def any_full_scan(spark, d):
    return search.any(events(spark, d), lambda v: v < 0)


@query("SELECT coalesce(bool_and(value > 0), true) AS \"all\" FROM events")
def all_pass(spark, d):
    return search.all(events(spark, d), lambda v: v > 0)


# Ranges


@query("SELECT sum(i * i)::BIGINT AS reduce FROM range(0, 100000) t(i)")
def range_sum_squares(spark, d):
    return tasks.parallel_for_range(spark, 0, 100000, lambda i: F.sum(i * i))


@query("SELECT sum(i)::BIGINT AS covered, 10000::BIGINT AS n FROM range(0, 10000) t(i)")
def parallel_for_cover(spark, d):
    ranges = tasks.parallel_for(spark, 10000, lambda s, e: (s + e - 1) * (e - s) // 2, grain=999)
    return ranges.agg(F.sum("value").alias("covered"), F.sum(F.col("end") - F.col("start")).alias("n"))


@query("SELECT sum(i)::BIGINT AS reduce FROM range(100) t(i)")
def for_range_sum(spark, d):
    return tasks.parallel_for_range(spark, 0, 100, F.sum)


@query("SELECT true AS each_worker_once")
def broadcast_workers(spark, d):
    seen = tasks.broadcast(spark, lambda k: k * 2, "bigint")
    return seen.agg((F.count_distinct("worker") == F.count(F.lit(1))).alias("a"), F.bool_and(F.col("value") == F.col("worker") * 2).alias("b")).select((F.col("a") & F.col("b")).alias("each_worker_once"))


# Chunks


@query(f"SELECT event_id // 777 AS chunk, count(*) AS n, sum({SQL_CENTS})::BIGINT AS total, max({SQL_CENTS}) AS top FROM events GROUP BY 1")
def chunks_indexed_stats(spark, d):
    return compose.chunks_aggregate(events(spark, d, "cents"), 777, n=lambda v: F.count(F.lit(1)), total=F.sum, top=F.max)


@query(f"SELECT sum({SQL_CENTS})::BIGINT AS sum FROM events")
def chunks_sum(spark, d):
    return compose.chunks_sum(events(spark, d, "cents"), 1000)


@query("SELECT ((count(*) + 776) // 777)::BIGINT AS chunks FROM events")
def chunks_count(spark, d):
    return compose.chunks_count(events(spark, d, "cents"), 777)


@query(f"SELECT max(t)::BIGINT AS reduce FROM (SELECT sum({SQL_CENTS}) AS t FROM events GROUP BY event_id // 1000)")
def chunks_reduce(spark, d):
    return compose.chunks_reduce(events(spark, d, "cents"), 1000, F.sum, F.max)


@query(f"SELECT event_id AS i, sum({SQL_CENTS}) OVER (PARTITION BY event_id // 100 ORDER BY event_id)::BIGINT AS v FROM events")
def chunks_rewrite(spark, d):
    import itertools

    return compose.chunks_apply(events(spark, d, "cents"), 100, lambda _, values: list(itertools.accumulate(values))).indexed()


# Chain, zip, flatten


@query("SELECT (row_number() OVER (ORDER BY side, k) - 1)::BIGINT AS i, v FROM (SELECT 0 AS side, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)")
def chain_collect(spark, d):
    return transform.collect(compose.chain(sequence(spark, d, "customer", "c_acctbal"), sequence(spark, d, "supplier", "s_acctbal")))


@query("SELECT sum(round(v * 100)::BIGINT)::BIGINT AS sum, count(*) AS len, bool_or(v > 9990) AS \"any\", bool_and(v > 0) AS \"all\" FROM (SELECT c_acctbal AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def chain_reductions(spark, d):
    s = compose.chain(sequence(spark, d, "customer", "c_acctbal"), sequence(spark, d, "supplier", "s_acctbal"))
    return tasks.join_aggregates(s, sum=lambda v: F.sum(F.round(v * 100).cast("long")), len=lambda v: F.count(F.lit(1)), any=lambda v: F.bool_or(v > 9990), all=lambda v: F.bool_and(v > 0))


PAIRS = f"(SELECT i, o_orderkey AS a, p_partkey AS b FROM (SELECT {i32('o_orderkey')} AS i, o_orderkey FROM orders) JOIN (SELECT {i32('p_partkey')} AS i, p_partkey FROM part) USING (i))"


def pairs(spark, d) -> Seq:
    return compose.zip(sequence(spark, d, "orders", "o_orderkey"), sequence(spark, d, "part", "p_partkey"))


@query(f"SELECT i, a, b FROM {PAIRS}")
def zip_collect_min_len(spark, d):
    return pairs(spark, d).indexed().select("i", "v.a", "v.b")


@query(f"SELECT sum(a * b)::BIGINT AS dot FROM {PAIRS}")
def zip_dot(spark, d):
    return compose.dot_product(pairs(spark, d))


@query("SELECT sum(l_partkey * l_suppkey)::BIGINT AS dot FROM lineitem")
def zip_dot_same_rows(spark, d):
    return compose.dot_product(compose.zip_columns(load(spark, d, "lineitem"), "l_partkey", "l_suppkey", ["l_orderkey"]))


@query(f"SELECT bool_or(a = b) AS \"any\", bool_and(a + b > 0) AS \"all\", count(*) AS len FROM {PAIRS}")
def zip_any_all_len(spark, d):
    return tasks.join_aggregates(pairs(spark, d), any=lambda v: F.bool_or(v["a"] == v["b"]), all=lambda v: F.bool_and(v["a"] + v["b"] > 0), len=lambda v: F.count(F.lit(1)))


@query(f"SELECT sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b, count(*) AS n FROM {PAIRS}")
def unzip(spark, d):
    a, b = compose.unzip(pairs(spark, d))
    return reduce.sum(a).withColumnRenamed("sum", "sum_a").crossJoin(F.broadcast(reduce.sum(b).withColumnRenamed("sum", "sum_b"))).crossJoin(F.broadcast(reduce.count(a).withColumnRenamed("count", "n")))


def words(spark, d, table="benchmark") -> Seq:
    return sequence(spark, d, table, F.split("text", " "))


@query("SELECT (row_number() OVER (ORDER BY item_id, p) - 1)::BIGINT AS i, w AS v FROM (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS p, unnest(string_split(text, ' ')) AS w FROM benchmark)")
def flatten_collect(spark, d):
    return transform.collect(compose.flatten(words(spark, d)))


@query("SELECT (row_number() OVER (ORDER BY vec_id, p) - 1)::BIGINT AS i, x AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS x FROM embeddings)")
def flatten_collect_embeddings(spark, d):
    return transform.collect(compose.flatten(sequence(spark, d, "embeddings", "embedding")))


@query("SELECT round(sum(x::DOUBLE), 4) AS sum FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def flatten_sum(spark, d):
    s = sequence(spark, d, "embeddings", F.col("embedding").cast("array<double>"))
    return compose.flatten_sum(s).select(F.round("sum", 4).alias("sum"))


@query("SELECT sum(len(embedding))::BIGINT AS len FROM embeddings")
def flatten_len(spark, d):
    return compose.flatten_len(sequence(spark, d, "embeddings", "embedding"))


@query("SELECT max(list_max(list_transform(string_split(text, ' '), lambda w: length(w))))::BIGINT AS reduce FROM benchmark")
def flatten_reduce(spark, d):
    return compose.flatten_reduce(words(spark, d), lambda v: F.array_max(F.transform(v, lambda w: F.length(w))).cast("long"), F.max)


@query("SELECT max(list_max(list_transform(string_split(text, ' '), lambda w: length(w))))::BIGINT AS reduce FROM documents")
def flatten_reduce_documents(spark, d):
    return compose.flatten_reduce(words(spark, d, "documents"), lambda v: F.array_max(F.transform(v, lambda w: F.length(w))).cast("long"), F.max)


# Placement


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS i, n_chars AS length, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents")
def prefix_offsets(spark, d):
    return place.compute_offsets_into(sequence(spark, d, "documents", "n_chars"))


@query("WITH w AS (SELECT item_id, string_split(text, ' ') AS a FROM benchmark), o AS (SELECT item_id, a, coalesce(sum(len(a)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM w) SELECT (f + generate_subscripts(a, 1) - 1)::BIGINT AS i, unnest(a) AS v FROM o")
def flatten_with_offsets(spark, d):
    s = words(spark, d)
    return place.parallel_flatten_with_offsets(s, place.cap_and_offsets(s))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), o AS (SELECT doc_id, a, coalesce(sum(len(a)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM w) SELECT (f + generate_subscripts(a, 1) - 1)::BIGINT AS i, unnest(a) AS v FROM o")
def flatten_with_offsets_documents(spark, d):
    s = words(spark, d, "documents")
    return place.parallel_flatten_with_offsets(s, place.cap_and_offsets(s))


@query(f"WITH p AS (SELECT {i32('p_partkey')} AS i, round(p_retailprice * 100)::BIGINT AS v FROM part), c AS (SELECT {i32('c_custkey')} AS k, c_custkey FROM customer), w AS (SELECT (k * 7) % (SELECT count(*) FROM part) AS i, arg_max(c_custkey, k) AS new FROM c GROUP BY 1) SELECT p.i, coalesce(w.new, p.v) AS v FROM p LEFT JOIN w USING (i)")
def scatter_updates(spark, d):
    out = sequence(spark, d, "part", F.expr("cast(round(p_retailprice * 100) as bigint)"))
    values = sequence(spark, d, "customer", "c_custkey")
    size = out.df.count()
    slots = transform.enumerate_map(values, lambda i, v: (i * 7) % size)
    return place.parallel_scatter(out, values, slots).indexed()


@query(f"WITH p AS (SELECT {i32('p_partkey')} AS i, p_partkey, count(*) OVER () AS n FROM part) SELECT j.i, q.p_partkey AS v FROM (SELECT i, n - 1 - i AS at FROM p) j JOIN p q ON q.i = j.at")
def permute_gather(spark, d):
    s = sequence(spark, d, "part", "p_partkey")
    n = s.df.agg(F.count(F.lit(1)).alias("n"))
    at = s.indexed().crossJoin(F.broadcast(n)).select((F.col("n") - 1 - F.col("i")).alias("v"), F.col("i").alias("k0"))
    return order.apply_permutation(s, Seq(at, ["k0"], True)).indexed()


@query(f"SELECT {i32('o_orderkey')} AS i, o_orderkey AS v FROM orders QUALIFY i >= 100 AND i < 150")
def slice_from(spark, d):
    return place.slice_from(sequence(spark, d, "orders", "o_orderkey"), 100, 50)


# Orders: the rank is part of the result, so the order is compared


def _sorted(by: str, value: str, table: str, key: str) -> str:
    return f"SELECT {i32(f'{by}, {key}')} AS rank, {value} AS v FROM {table}"


@query(_sorted("o_totalprice", "o_totalprice", "orders", "o_orderkey"))
def sort_asc(spark, d):
    return order.ranked(sequence(spark, d, "orders", "o_totalprice")).select("rank", "v")


@query(_sorted("o_totalprice DESC", "o_totalprice", "orders", "o_orderkey"))
def sort_desc(spark, d):
    return order.ranked(sequence(spark, d, "orders", "o_totalprice"), descending=True).select("rank", "v")


@query(_sorted("abs(c_acctbal - 5000)", "c_acctbal", "customer", "c_custkey"))
def sort_abs(spark, d):
    return order.ranked(sequence(spark, d, "customer", "c_acctbal"), lambda v: F.abs(v - 5000)).select("rank", "v")


@query(_sorted("o_custkey % 1000", "o_custkey", "orders", "o_orderkey"))
def sort_mod_key(spark, d):
    return order.ranked(sequence(spark, d, "orders", "o_custkey"), lambda v: v % 1000).select("rank", "v")


@query(_sorted("o_orderstatus, o_totalprice", "o_orderkey", "orders", "o_orderkey"))
def sort_multi(spark, d):
    row = F.struct("o_orderstatus", "o_totalprice", "o_orderkey")
    return order.ranked(sequence(spark, d, "orders", row), lambda v: v["o_orderstatus"], lambda v: v["o_totalprice"]).select("rank", F.col("v.o_orderkey").alias("v"))


@query(_sorted("event_type", "event_id", "events", "event_id"))
def stable_sort_by_key(spark, d):
    return order.ranked(sequence(spark, d, "events", F.struct("event_type", "event_id")), lambda v: v["event_type"]).select("rank", F.col("v.event_id").alias("v"))


@query(_sorted("length(p_name)", "p_name", "part", "p_partkey"))
def sort_cached_key_length(spark, d):
    return order.ranked(sequence(spark, d, "part", "p_name"), lambda v: F.length(v)).select("rank", "v")


@query("SELECT count(*) AS n, bool_and(ok) AS sorted FROM (SELECT coalesce(lag(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey) <= o_totalprice, true) AS ok FROM orders)")
def sort_checked(spark, d):
    s = sequence(spark, d, "orders", "o_totalprice")
    ranked = order.ranked(s).select("v", F.col("rank").alias("k0"))
    return order.is_sorted(Seq(ranked, ["k0"], True)).crossJoin(F.broadcast(reduce.count(s))).select(F.col("count").alias("n"), F.col("is_sorted").alias("sorted"))


@query("SELECT (row_number() OVER (ORDER BY (value < 100) DESC, event_id) - 1)::BIGINT AS rank, event_id, (CASE WHEN value < 100 THEN 0 ELSE 1 END)::INTEGER AS side FROM events")
def partition_stable(spark, d):
    sides = order.parallel_partition(events(spark, d), lambda v: v < 100)
    return dense_index(sides, ["side", "k0"], "rank").select("rank", F.col("k0").alias("event_id"), "side")


@query("SELECT count(*) FILTER (WHERE value < 100) AS matches FROM events")
def partition_point(spark, d):
    return order.partition_point(events(spark, d), lambda v: v < 100)


@query("SELECT bool_and(ok) AS is_sorted FROM (SELECT coalesce(lag(ts) OVER (ORDER BY event_id) <= ts, true) AS ok FROM events)")
def is_sorted(spark, d):
    return order.is_sorted(sequence(spark, d, "events", "ts"))


@query("SELECT count(*) FILTER (WHERE o_orderkey < 5000) AS lower_bound FROM orders")
def lower_bound(spark, d):
    return order.binary_search(sequence(spark, d, "orders", "o_orderkey"), 5000)


@query("SELECT (row_number() OVER (ORDER BY v, side, k) - 1)::BIGINT AS rank, v FROM (SELECT 0 AS side, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)")
def merge_sorted(spark, d):
    return order.ranked(compose.chain(sequence(spark, d, "customer", "c_acctbal"), sequence(spark, d, "supplier", "s_acctbal"))).select("rank", "v")


# Tasks and fallible forms


@query("SELECT (SELECT count(*) FROM orders) AS orders_n, (SELECT max(l_quantity) FROM lineitem) AS top_qty")
def join_two_tasks(spark, d):
    """Two jobs that run at the same time."""
    made = tasks.join(orders=(lambda: load(spark, d, "orders").count(),), lines=(lambda t: load(spark, d, t).agg(F.max("l_quantity")).first()[0], "lineitem"))
    return spark.createDataFrame([(made["orders"], made["lines"])], load(spark, d, "lineitem").select(F.lit(0).cast("long").alias("orders_n"), F.col("l_quantity").alias("top_qty")).schema)


@query("SELECT 'second: ' || max(event_id)::VARCHAR AS error FROM events")
def try_join_leftmost(spark, d):
    """All tasks run; of two that fail the one declared first counts."""

    def fail(name):
        raise ValueError(f"{name}: {load(spark, d, 'events').agg(F.max('event_id')).first()[0]}")

    try:
        tasks.try_join(first=(lambda: load(spark, d, "events").count(),), second=(fail, "second"), third=(fail, "third"))
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def scope_counts(spark, d):
    names = ["events", "orders", "part"]
    s = tasks.Scope()
    for t in names:
        s.spawn(lambda t: load(spark, d, t).count(), t)
    return spark.createDataFrame(list(zip(names, s.wait())), "name string, n long")


@query("SELECT bool_or(value > 400) AS stopped FROM events")
def early_exit(spark, d):
    return spark.createDataFrame([(tasks.parallel_for_with_early_exit(events(spark, d), lambda v: v > 400),)], "stopped boolean")


@query(f"SELECT count(*) AS n, sum({SQL_CENTS})::BIGINT AS total FROM events")
def for_each_counters(spark, d):
    """Side effects on the executors, as accumulators."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    transform.for_each(events(spark, d, "cents"), lambda v: (n.add(1), total.add(v)))
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@query("SELECT event_id AS i, round(sqrt(abs(value)), 6) AS v FROM events")
def sqrt_map(spark, d):
    return transform.map(events(spark, d), lambda v: F.round(F.sqrt(F.abs(v)), 6)).indexed()


def in_order(sorted_rows: DataFrame) -> DataFrame:
    """rank, v of rows as they come out of a sort."""
    return dense_index(sorted_rows.select("v", F.monotonically_increasing_id().alias("at")), ["at"], "rank").select("rank", "v")


@query(_sorted("o_totalprice", "o_totalprice", "orders", "o_orderkey"))
def sort_rows(spark, d):
    return in_order(order.sort_asc(sequence(spark, d, "orders", "o_totalprice")))


@query(_sorted("length(p_name)", "p_name", "part", "p_partkey"))
def sort_rows_by_cached_key(spark, d):
    return in_order(order.sort_by_cached_key(sequence(spark, d, "part", "p_name"), F.length))


@query("SELECT (row_number() OVER (ORDER BY v, side, k) - 1)::BIGINT AS rank, v FROM (SELECT 0 AS side, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)")
def merge_rows(spark, d):
    return in_order(order.merge(sequence(spark, d, "customer", "c_acctbal"), sequence(spark, d, "supplier", "s_acctbal")))


AFFINE = "struct_pack(a := event_id % 97 + 1, b := user_id % 89)"


@query(f"""WITH r AS (SELECT list_reduce(list({AFFINE} ORDER BY event_id), lambda x, y: struct_pack(a := x.a * y.a % 1000003, b := (y.a * x.b + y.b) % 1000003)) AS f FROM events)
SELECT f.a::BIGINT AS a, f.b::BIGINT AS b FROM r""")
def reduce_ordered_affine(spark, d):
    """All events' maps x -> a x + b, composed in order modulo a prime: a fold that doesn't commute, with a state of fixed size."""
    maps = sequence(spark, d, "events", F.struct((F.col("event_id") % 97 + 1).cast("long").alias("a"), (F.col("user_id") % 89).cast("long").alias("b")))
    after = lambda x, y: {"a": x["a"] * y["a"] % 1000003, "b": (y["a"] * x["b"] + y["b"]) % 1000003}
    return reduce.reduce(maps, None, after).select("reduce.a", "reduce.b")


@query("SELECT sum(l_quantity)::BIGINT AS qty, max(l_tax) AS tax, count(*) AS n FROM lineitem")
def join_named_stats(spark, d):
    return tasks.join_aggregates(sequence(spark, d, "lineitem", F.struct("l_quantity", "l_tax")), qty=lambda v: F.sum(v["l_quantity"]).cast("long"), tax=lambda v: F.max(v["l_tax"]), n=lambda v: F.count(F.lit(1)))


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 25) SELECT a AS fib FROM f WHERE n = 25")
def fib_recursive(spark, d):
    return recipes.fibonacci(spark, 25)


def parsed(spark, d) -> Seq:
    """The number in each event's properties, with every 1,000th one spoilt."""
    return sequence(spark, d, "events", F.expr("case when event_id % 1000 = 420 then 'bad' else get_json_object(props, '$.k') end"))


@query("SELECT sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS value, NULL::BIGINT AS error_index, NULL::VARCHAR AS error FROM events")
def try_reduce_ok(spark, d):
    s = sequence(spark, d, "events", F.expr("get_json_object(props, '$.k')"))
    return fallible.try_reduce_frame(s, lambda v: F.expr("try_cast(v as bigint)"), lambda v: fallible.failing(F.expr("try_cast(v as bigint)").isNull(), "MapFailed"), F.sum, 0)


@query("SELECT NULL::BIGINT AS value, min(event_id) AS error_index, 'MapFailed' AS error FROM events WHERE event_id % 1000 = 420")
def try_reduce_first_error(spark, d):
    return fallible.try_reduce_frame(parsed(spark, d), lambda v: F.expr("try_cast(v as bigint)"), lambda v: fallible.failing(F.expr("try_cast(v as bigint)").isNull(), "MapFailed"), F.sum, 0)


@query("SELECT min(event_id) AS index, 'ProcessFailed' AS error FROM events WHERE event_id % 1000 = 420")
def try_for_each_first_error(spark, d):
    return fallible.first_error(parsed(spark, d), lambda v: fallible.failing(F.expr("try_cast(v as bigint)").isNull(), "ProcessFailed"))


# Recipes


@query("SELECT coalesce(bool_or(event_type IN ('error', 'fatal')), false) AS any_level, coalesce(bool_or(contains(props, '77')), false) AS any_message FROM events")
def log_any(spark, d):
    return recipes.log_any(load(spark, d, "events"), "event_type", ["error", "fatal"], "77", "props")


@query("SELECT count(*) AS found FROM (SELECT 1 FROM events WHERE event_type = 'error' AND user_id < 50 LIMIT 1)")
def log_find(spark, d):
    s = Seq.of(load(spark, d, "events"), F.struct("event_type", "user_id"), "event_id", True)
    return search.find_any(s, lambda v: (v["event_type"] == "error") & (v["user_id"] < 50)).agg(F.count(F.lit(1)).alias("found"))


SQL_LEVELS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in TYPES)


@query(f"SELECT {SQL_LEVELS} FROM events")
def log_counts(spark, d):
    return load(spark, d, "events").agg(*recipes.level_counts("event_type", TYPES))


@query(f"SELECT coalesce(bool_or(event_type = 'error'), false) AS has_worst, {SQL_LEVELS}, coalesce(max(epoch_us(ts)) FILTER (WHERE event_type = 'error'), 0)::BIGINT AS latest_worst FROM events")
def log_comprehensive(spark, d):
    return recipes.log_comprehensive(load(spark, d, "events"), "event_type", TYPES, "error", F.unix_micros(F.col("ts").cast("timestamp")))


def rendered(spark, d) -> DataFrame:
    """lineitem as delimited lines, some with a field that doesn't parse."""
    price = F.when(F.col("l_orderkey") % 97 == 0, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return load(spark, d, "lineitem").select(F.concat_ws(",", price, F.col("l_quantity").cast("int").cast("string"), F.col("l_tax").cast("decimal(4,2)").cast("string")).alias("value"))


def _stats_sql(x: str, n: str) -> str:
    return f"round(coalesce(sum({x}), 0), 2) AS {n}_sum, min({x}) AS {n}_min, max({x}) AS {n}_max, count({x}) AS {n}_count, round(coalesce(avg({x}), 0), 6) AS {n}_avg"


LINES = "(SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice::DECIMAL(12,2)::DOUBLE END AS price, l_quantity AS qty, l_tax::DECIMAL(4,2)::DOUBLE AS tax FROM lineitem)"


@query(f"SELECT {_stats_sql('price', 'price')} FROM {LINES}")
def csv_column_stats(spark, d):
    return rendered(spark, d).agg(*recipes.column_stats(None, 0, "price"))


@query(f"SELECT {_stats_sql('price', 'price')}, {_stats_sql('qty', 'qty')}, {_stats_sql('tax', 'tax')} FROM {LINES}")
def csv_multi_column(spark, d):
    return rendered(spark, d).agg(*[c for k, n in enumerate(("price", "qty", "tax")) for c in recipes.column_stats(None, k, n)])


@query("WITH s AS (SELECT avg(value) AS m, avg(value * value) AS q FROM events) SELECT event_id, round((value - m) / sqrt(greatest(q - m * m, 1e-15)), 6) AS z FROM events, s")
def zscore(spark, d):
    return recipes.zscore(load(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", F.round("value_z", 6).alias("z"))


@query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled FROM events, s")
def minmax_scale(spark, d):
    return recipes.minmax(load(spark, d, "events").select("event_id", "value"), "value").select("event_id", F.round("value_scaled", 6).alias("scaled"))


@query("WITH s AS (SELECT avg(c_acctbal) AS m, avg(c_acctbal * c_acctbal) AS q, avg(c_nationkey) AS m2, avg(c_nationkey * c_nationkey) AS q2 FROM customer) SELECT c_custkey, round((c_acctbal - m) / sqrt(greatest(q - m * m, 1e-15)), 5) AS a, round((c_nationkey - m2) / sqrt(greatest(q2 - m2 * m2, 1e-15)), 5) AS b FROM customer, s")
def zscore_columns(spark, d):
    done = recipes.zscore(load(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n")), ["c_acctbal", "n"])
    return done.select("c_custkey", F.round("c_acctbal_z", 5).alias("a"), F.round("n_z", 5).alias("b"))


@query("SELECT t AS token, item_id AS doc_id, (p - 1)::BIGINT AS position FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS p FROM benchmark)")
def index_postings(spark, d):
    return recipes.postings(load(spark, d, "benchmark"), "item_id", "text")


@query("SELECT t AS token, doc_id, (p - 1)::BIGINT AS position FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS p FROM documents)")
def index_postings_documents(spark, d):
    return recipes.postings(load(spark, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS total_tokens, count(DISTINCT t) AS unique_terms FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents)")
def index_stats(spark, d):
    return recipes.index_stats(load(spark, d, "documents"), "doc_id", "text")


@query("SELECT count(*) FILTER (WHERE n_chars <= 5000) AS valid, count(*) FILTER (WHERE n_chars > 5000) AS errors, coalesce(sum(n_chars) FILTER (WHERE n_chars <= 5000), 0)::BIGINT AS total_bytes FROM documents")
def scan_stats(spark, d):
    from ..sources.files import scan_stats as stats

    return stats(load(spark, d, "documents").select(F.col("n_chars").alias("length")), 5000)


@query("WITH s AS (SELECT (i * 754877666 % 1000000000) / 1e9 AS x, (i * 569840291 % 1000000000) / 1e9 AS y FROM range(0, 100000) t(i)) SELECT count(*) FILTER (WHERE x * x + y * y <= 1) AS hits, round(count(*) FILTER (WHERE x * x + y * y <= 1) * 4.0::DOUBLE / 100000, 9) AS pi FROM s")
def pi_quasi(spark, d):
    return recipes.quasi_pi(spark, 100000)


@query("SELECT round(sum(sin(i * (pi() / 1000)) * CASE WHEN i IN (0, 1000) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (pi() / 1000), 9) AS integral FROM range(0, 1001) t(i)")
def trapezoid_sin(spark, d):
    import math

    return recipes.trapezoid(spark, F.sin, 0.0, math.pi, 1000)


@query("SELECT round(sum(sin(i * (pi() / 1000)) * CASE WHEN i IN (0, 1000) THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END) * (pi() / 1000 / 3), 9) AS integral FROM range(0, 1001) t(i)")
def simpson_sin(spark, d):
    import math

    return recipes.simpson(spark, F.sin, 0.0, math.pi, 1000)


NATIONS = "(SELECT c_nationkey AS i, c_custkey % 64 AS j, count(*) AS x FROM customer GROUP BY ALL)"
SHARES = "(SELECT s_suppkey % 64 AS i, s_nationkey AS j, count(*) AS x FROM supplier GROUP BY ALL)"


@query(f"SELECT a.i, b.j, sum(a.x * b.x)::BIGINT AS x FROM {NATIONS} a JOIN {SHARES} b ON a.j = b.i GROUP BY 1, 2")
def matmul_small(spark, d):
    """Two sparse matrices, of customers and of suppliers by nation and number."""
    cells = lambda t, i, j: load(spark, d, t).groupBy(i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("x"))
    return recipes.matmul(cells("customer", F.col("c_nationkey"), F.col("c_custkey") % 64), cells("supplier", F.col("s_suppkey") % 64, F.col("s_nationkey")))


ALL_ROWS = "(SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, round(unnest(embedding) * 1000)::BIGINT AS x FROM embeddings)"


@query(f"SELECT a.j AS i, b.j, sum(a.x * b.x)::BIGINT AS x FROM {ALL_ROWS} a JOIN {ALL_ROWS} b ON a.i = b.i GROUP BY 1, 2")
def matmul_gram(spark, d):
    """The transposed embeddings times the embeddings, over all vectors."""
    m = tiles.of_rows(load(spark, d, "embeddings").withColumn("x", F.expr(THOUSANDTHS)), "vec_id", "x")
    return tiles.cells(tiles.matmul(tiles.transposed(m), m))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def row_l2(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(recipes.norm(F.col("embedding")), 6).alias("norm"))


PIXELS = "(SELECT event_id AS idx, user_id * 7 % 256 AS r, event_id * 13 % 256 AS g, (event_id + user_id) % 256 AS b FROM events)"


def pixels(spark, d) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") * 7 % 256).alias("r"), (F.col("event_id") * 13 % 256).alias("g"), ((F.col("event_id") + F.col("user_id")) % 256).alias("b"))


@query(f"SELECT idx, (r * 299 + g * 587 + b * 114) // 1000 AS y, least(r * 3 // 2, 255) AS bright FROM {PIXELS}")
def pixel_luma(spark, d):
    return pixels(spark, d).select("idx", recipes.luma(F.col("r"), F.col("g"), F.col("b")).alias("y"), recipes.brightness(F.col("r"), 1.5).alias("bright"))


@query("""WITH p AS (SELECT vec_id AS y, generate_subscripts(embedding, 1) - 1 AS x, round(unnest(embedding)::DOUBLE * 100)::BIGINT + 1000 AS v FROM embeddings), n AS (SELECT max(y) AS last FROM p), s AS (SELECT dy, dx, (2 - abs(dy)) * (2 - abs(dx)) AS w FROM range(-1, 2) a(dy), range(-1, 2) b(dx))
SELECT t.y * 64 + t.x AS idx, (sum(q.v * s.w) // 16)::BIGINT AS v FROM p t, s, n JOIN p q ON q.y = greatest(0, least(n.last, t.y + s.dy)) AND q.x = greatest(0, least(63, t.x + s.dx)) GROUP BY t.y, t.x""")
def blur3x3(spark, d):
    """All embeddings as an image, a vector in a row."""
    image = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e")).select((F.col("vec_id") * 64 + F.col("x")).alias("idx"), (F.round(F.col("e").cast("double") * 100).cast("long") + 1000).alias("v"))
    return recipes.blur_image(image, 64)


@query(f"""WITH p AS (SELECT idx, r AS v, idx // 40 AS y, idx % 40 AS x FROM {PIXELS}), n AS (SELECT count(*) AS n FROM p), s AS (SELECT dy, dx, (2 - abs(dy)) * (2 - abs(dx)) AS w FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
t AS (SELECT idx, w, n, y + dy AS ny, greatest(0, least(least(40, n) - 1, x + dx)) AS nx FROM p, s, n), u AS (SELECT idx, w, greatest(0, least((n - 1 - nx) // 40, ny)) * 40 + nx AS at FROM t)
SELECT u.idx, (sum(p.v * u.w) // 16)::BIGINT AS v FROM u JOIN p ON p.idx = u.at GROUP BY u.idx""")
def blur_whole(spark, d):
    """The blur of all events' pixels, 40 in a row."""
    return recipes.blur_image(pixels(spark, d).select("idx", F.col("r").alias("v")), 40)


@query("""WITH p AS (SELECT event_id, event_type <> 'error' AS alive, 1.0 + user_id % 3 AS mass, user_id / 10.0::DOUBLE AS px, value / 100 - 2.5 AS vx FROM events),
s AS (SELECT event_id, alive, mass, px + vx * 0.5 AS q, vx FROM p), t AS (SELECT event_id, alive, mass, CASE WHEN q < 0 THEN 0.0 WHEN q > 10 THEN 10.0 ELSE q END AS px, CASE WHEN q < 0 OR q > 10 THEN -vx * 0.8 ELSE vx END AS vx FROM s)
SELECT round(coalesce(sum(mass::DOUBLE * (vx * vx) / 2) FILTER (WHERE alive), 0), 4) AS energy, count(*) FILTER (WHERE alive) AS alive, round(max(vx * vx) FILTER (WHERE alive), 6) AS max_speed2 FROM t""")
def particle_step(spark, d):
    zero = F.lit(0.0)
    p = load(spark, d, "events").select((F.col("event_type") != "error").alias("alive"), (F.col("user_id") % 3 + 1).cast("double").alias("mass"), (F.col("user_id") / 10.0).alias("px"), zero.alias("py"), zero.alias("pz"), (F.col("value") / 100 - 2.5).alias("vx"), zero.alias("vy"), zero.alias("vz"), *[zero.alias(f"a{a}") for a in "xyz"])
    return recipes.kinetic(recipes.euler_step(p, 0.5, 10.0))


@query("SELECT event_id AS i, sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT event_id, cast(round(value * 100) as bigint) AS v FROM events)")
def running_sum(spark, d):
    return prefix_sums(events(spark, d, "cents").indexed(), "i", "v").select("i", (F.col("before") + F.col("v")).alias("running"))


from . import catalog_ranges  # noqa: E402, F401  (it adds its queries to the ones above)
