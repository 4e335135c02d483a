"""Golden cases: literal inputs and results for each operator, with edges."""

import pytest
from pyspark.sql import functions as F

import parseq
from parseq import Seq, scalar
from parseq.operators import compose, fallible, order, place, reduce, search, tasks, transform
from parseq.operators.prefix import prefix_sums


def seq(spark, values, kind="bigint"):
    return Seq.from_list(spark, values, kind)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_sum_min_max(spark):
    assert scalar(seq(spark, [1, 2, 3, 4, 5]).sum()) == 15
    s = seq(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    assert (scalar(s.min()), scalar(s.max()), scalar(s.count())) == (1, 9, 8)


def test_empty(spark):
    s = seq(spark, [])
    assert scalar(s.sum()) == 0 and scalar(s.count()) == 0
    assert scalar(s.min()) is None and scalar(s.max()) is None
    assert scalar(s.min_by(lambda v: v)) is None and scalar(s.max_by_key(lambda v: v)) is None
    assert scalar(s.any(lambda v: v > 0)) is False and scalar(s.all(lambda v: v > 0)) is True
    assert scalar(s.find_first(lambda v: v > 0)) is None and scalar(s.position(lambda v: v > 0)) is None
    assert scalar(reduce.ordered_fold(s, 7, lambda a, b: a + b)) == 7
    assert scalar(s.is_sorted()) is True and scalar(s.chunks_count(3)) == 0


def test_fill_and_range(spark):
    assert transform.to_list(transform.fill(seq(spark, [1, 2, 3, 4, 5]), 42)) == [42] * 5
    assert scalar(reduce.sum(Seq.range(spark, 0, 10))) == 45
    assert scalar(reduce.count(Seq.range(spark, 5, 2))) == 0
    assert transform.to_list(Seq.range(spark, 3, 8, grain=2)) == [3, 4, 5, 6, 7]


def test_find(spark):
    s = seq(spark, list(range(1, 10)))
    assert scalar(s.find_any(lambda v: v > 5)) > 5
    assert scalar(s.position_any(lambda v: v > 5)) >= 5
    assert scalar(s.find_any(lambda v: v > 100)) is None
    s = seq(spark, [1, 2, 3, 10, 5, 10, 7, 10, 9])
    assert tuple(s.find_first(lambda v: v == 10).first()) == (3, 10)
    assert tuple(s.find_last(lambda v: v == 10).first()) == (7, 10)
    s = seq(spark, [1, 5, 3, 5, 5, 6, 7, 8, 9])
    assert scalar(s.rposition(lambda v: v == 5)) == 4 and scalar(s.position(lambda v: v == 5)) == 1
    assert scalar(s.parallel_find_value(7)) == 6


def test_sparse_keys_have_positions(spark):
    df = spark.createDataFrame([(k * 10, v) for k, v in enumerate([5, 8, 2, 8])], "k bigint, v bigint").repartition(3)
    s = Seq.of(df, "v", "k")
    assert tuple(s.find_first(lambda v: v == 8).first()) == (1, 8)
    assert tuple(s.find_last(lambda v: v == 8).first()) == (3, 8)
    assert scalar(s.position(lambda v: v == 2)) == 2 and scalar(s.position(lambda v: v == 99)) is None


def test_any_all(spark):
    s = seq(spark, list(range(1, 10)))
    assert scalar(s.any(lambda v: v % 2 == 0)) is True and scalar(s.any(lambda v: v < 0)) is False
    s = seq(spark, [2, 4, 6, 8, 10])
    assert scalar(s.all(lambda v: v % 2 == 0)) is True and scalar(s.all(lambda v: v < 5)) is False
    assert s.exists(lambda v: v == 8) and not s.exists(lambda v: v == 9)
    assert scalar(seq(spark, [1, None]).all(lambda v: v > 0)) is False


def test_by_key_and_ties(spark):
    rows = [(100, 3), (200, 1), (300, 2), (400, 1), (500, 3)]
    s = seq(spark, rows, "struct<value:bigint,priority:int>")
    assert scalar(s.min_by_key(lambda v: v["priority"]))["value"] == 200
    assert scalar(s.max_by_key(lambda v: v["priority"]))["value"] == 100
    assert [v["value"] for v in transform.to_list(Seq(order.ranked(s, lambda v: v["priority"]).select("v", F.col("rank").alias("k0")), ["k0"], True))] == [200, 400, 300, 100, 500]
    words = Seq.of(spark.createDataFrame([("b", 1), ("a", 9), ("c", 9)], "k string, v int"), "v", "k")
    assert scalar(reduce.max_by_key(words, lambda v: v)) == 9


def test_chunks(spark):
    s = seq(spark, list(range(1, 11)))
    assert [scalar(s.chunks_count(n)) for n in (3, 5, 10, 100)] == [4, 2, 1, 1]
    assert scalar(compose.chunks_reduce(s, 3, F.sum, F.sum)) == 55
    assert transform.to_list(compose.chunks_apply(seq(spark, list(range(1, 10))), 3, lambda _, x: [2 * y for y in x])) == list(range(2, 19, 2))
    with pytest.raises(ValueError):
        s.chunks_iter(0)


def test_enumerate(spark):
    s = seq(spark, [10, 20, 30, 40, 50])
    assert scalar(reduce.enumerate_reduce(s, lambda i, v: F.sum(i * v))) == 400
    assert scalar(search.enumerate_any(s, lambda i, v: (i % 2 == 1) & (v > 25))) is True
    assert scalar(search.enumerate_all(s, lambda i, v: v > 0)) is True
    assert transform.to_list(transform.enumerate_map(s, lambda i, v: v * (i + 1))) == [10, 40, 90, 160, 250]
    assert scalar(reduce.enumerate_reduce(seq(spark, [10, 20, 30]), lambda i, v: F.sum(i + v), 100)) == 363
    assert transform.to_list(transform.enumerate_map(seq(spark, [1, 2, 3, 4, 5]), lambda i, v: v + i)) == [1, 3, 5, 7, 9]


def test_chain_zip_flatten(spark):
    a, b, none = seq(spark, [1, 2, 3], "int"), seq(spark, [4, 5, 6], "int"), seq(spark, [], "int")
    assert transform.to_list(compose.chain(a, b)) == [1, 2, 3, 4, 5, 6]
    assert scalar(reduce.sum(compose.chain(a, none))) == scalar(reduce.sum(compose.chain(none, a))) == 6
    z = compose.zip(a, b)
    assert scalar(compose.dot_product(z)) == 32 and scalar(compose.dot_product(z, wide=True)) == 32
    assert pairs(z.indexed().select("v.a", "v.b")) == [(1, 4), (2, 5), (3, 6)]
    assert [transform.to_list(x) for x in compose.unzip(z)] == [[1, 2, 3], [4, 5, 6]]
    assert scalar(reduce.count(compose.zip(seq(spark, [1, 2, 3, 4, 5]), b))) == 3
    n = seq(spark, [[1, 2, 3], [], [4, 5], [6, 7, 8, 9]], "array<int>")
    assert transform.to_list(compose.flatten(n)) == list(range(1, 10))
    assert scalar(compose.flatten_sum(n)) == 45 and scalar(compose.flatten_len(n)) == 9
    none = seq(spark, [], "array<int>")
    assert scalar(compose.flatten_sum(none)) == 0 and scalar(compose.flatten_len(none)) == 0


def test_offsets_scatter_gather(spark):
    assert pairs(place.compute_offsets_into(seq(spark, [3, 0, 5, 2]))) == [(0, 3, 0), (1, 0, 3), (2, 5, 3), (3, 2, 8)]
    assert scalar(place.total(seq(spark, [3, 0, 5, 2]))) == 10
    n = seq(spark, [[10, 20], [30, 40, 50]], "array<bigint>")
    assert pairs(place.parallel_flatten_with_offsets(n, place.cap_and_offsets(n))) == [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50)]
    out = place.parallel_scatter(seq(spark, [0] * 10), seq(spark, [100, 200, 300, 400]), seq(spark, [3, 0, 7, 1]))
    assert transform.to_list(out) == [200, 400, 0, 100, 0, 0, 0, 300, 0, 0]
    out = place.parallel_scatter(seq(spark, [0, 0]), seq(spark, [1, 2, None]), seq(spark, [1, 1, 0]))
    assert transform.to_list(out) == [None, 2]
    assert transform.to_list(order.apply_permutation(seq(spark, [10, 20, 30, 40]), seq(spark, [1, 2, 3, 0]))) == [20, 30, 40, 10]
    df = Seq.range(spark, 0, 1000).indexed()
    assert scalar(prefix_sums(df, "i", "v", block=7).filter("before <> i * (i - 1) / 2").select(F.count(F.lit(1)))) == 0


@pytest.mark.parametrize("values", [[], [42], [5, 3], [5, 2, 8, 1, 9, 3, 7, 4, 6], list(range(50)), list(range(50))[::-1], [5] * 20, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]])
def test_sorts(spark, values):
    s = seq(spark, values)
    assert [r["v"] for r in s.sort_asc().collect()] == sorted(values)
    assert [r["v"] for r in s.sort_desc().collect()] == sorted(values, reverse=True)
    assert [r["v"] for r in s.sort_by_key(lambda v: -v).collect()] == sorted(values, reverse=True)
    assert [r["v"] for r in s.sort_by_cached_key(lambda v: F.abs(v - 5)).collect()] == sorted(values, key=lambda x: abs(x - 5))


def test_stable_and_partition(spark):
    rows = [(1, 0), (2, 1), (1, 2), (2, 3), (1, 4)]
    s = seq(spark, rows, "struct<key:int,order:bigint>")
    assert [tuple(r["v"]) for r in order.stable_sort(s, lambda v: v["key"]).collect()] == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 3)]
    s = seq(spark, [1, 6, 2, 8, 3, 7, 4, 9, 5])
    assert [r["v"] for r in s.parallel_partition(lambda v: v < 5).collect()] == [1, 2, 3, 4, 6, 8, 7, 9, 5]
    assert scalar(s.partition_point(lambda v: v < 5)) == 4
    s = seq(spark, [1, 3, 5, 7, 9])
    assert [scalar(s.binary_search(x)) for x in (0, 1, 4, 5, 10)] == [0, 0, 2, 2, 5]
    assert scalar(s.is_sorted()) and not scalar(s.is_sorted_desc())
    assert [r["v"] for r in order.merge(s, seq(spark, [2, 3])).collect()] == [1, 2, 3, 3, 5, 7, 9]


def test_folds(spark):
    letters = [chr(97 + k % 26) for k in range(200)]
    s = seq(spark, letters, "string")
    for n in (1, 3, 8):
        shuffled = s.with_values(s.df.orderBy(F.rand(3)).repartition(n))
        assert scalar(reduce.ordered_fold(shuffled, "", lambda a, b: a + b)) == "".join(letters)
    assert scalar(reduce.small_fold(seq(spark, [1, 2, 3]), F.lit(0).cast("long"), lambda a, x: a * 10 + x)) == 123
    assert scalar(seq(spark, [float(x) for x in range(10000)], "double").sum()) == pytest.approx(49_995_000)
    assert scalar(reduce.reduce(seq(spark, [6, 3]), 0, "xor")) == 5
    assert scalar(reduce.parallel_reduce_chunked(seq(spark, list(range(100))), sum, F.sum, "bigint")) == 4950


def test_overflow_raises_and_wide_sums(spark):
    s = seq(spark, [2**62, 2**62])
    with pytest.raises(Exception, match="OVERFLOW"):
        scalar(s.sum())
    assert scalar(s.sum(wide=True)) == 2**63


def test_fallible(spark):
    s = Seq.range(spark, 0, 100)
    bad = lambda v: fallible.failing((v == 42) | (v == 60), "MapFailed")
    with pytest.raises(fallible.SequenceError, match="MapFailed") as e:
        fallible.try_reduce(s, lambda v: v, bad, F.sum, 0)
    assert e.value.index == 42
    with pytest.raises(fallible.SequenceError):
        fallible.try_for_each(s, bad)
    good = lambda v: fallible.failing(v < 0, "MapFailed")
    assert fallible.try_reduce(Seq.range(spark, 0, 1000), lambda v: v, good, F.sum, 0) == 499500
    assert fallible.try_reduce(Seq.range(spark, 0, 0), lambda v: v, bad, F.sum, 42) == 42
    fallible.try_for_each(s, good)


def test_tasks(spark):
    assert tasks.join(a=lambda: 42, b=lambda: 100) == {"a": 42, "b": 100}
    assert tasks.join(x=(lambda n: 2 * n, 5), y=(lambda n: 3 * n, 7)) == {"x": 10, "y": 21}
    assert tasks.join() == {} and tasks.join(one=lambda: 1) == {"one": 1}
    done = []

    def fail(name):
        raise ValueError(name)

    with pytest.raises(ValueError, match="first"):
        tasks.try_join(a=(fail, "first"), b=(fail, "second"), c=lambda: done.append(1))
    assert done == [1]
    hits = []
    with tasks.scope() as s:
        for n in (1, 10, 100):
            s.spawn(hits.append, n)
    assert sum(hits) == 111
    with pytest.raises(ValueError):
        with tasks.scope() as s:
            for n in range(65):
                s.spawn(hits.append, n)
    assert tasks.broadcast(spark, lambda k: k, "bigint").count() == parseq.num_workers(spark)
    assert tasks.parallel_for(spark, 0, lambda s, e: 1).count() == 0
    ranges = sorted((r["start"], r["end"]) for r in tasks.parallel_for_with_grain(spark, 10, 4, lambda s, e: 1).collect())
    assert ranges[0][0] == 0 and ranges[-1][1] == 10 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert tasks.parallel_for_with_early_exit(Seq.range(spark, 0, 10), lambda v: v == 3)


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k")).repartition(5)
    got = parseq.dense_index(df, ["k"])
    assert got.filter("k <> i * i").count() == 0 and got.count() == 1000
    assert parseq.dense_index(df.limit(0), ["k"]).count() == 0
    down = parseq.dense_index(df, [F.col("k").desc()])
    assert down.filter("k <> (999 - i) * (999 - i)").count() == 0
    clustered = spark.range(2000).select((F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + (1 << 40))).alias("k"))
    got = parseq.dense_index(clustered, ["k"])
    assert got.filter("(k < 2000 and k <> 2 * i) or (k > 2000 and k <> 2 * (i - 1000) + 1 + 1099511627776)").count() == 0


def test_lengths_and_bounds(spark):
    for bad in ([0, 2], [0, -1], [0, None], [0]):
        with pytest.raises(ValueError):
            place.parallel_scatter(seq(spark, [0, 0]), seq(spark, [1, 2]), seq(spark, bad))
        with pytest.raises(ValueError):
            order.apply_permutation(seq(spark, [5, 6]), seq(spark, bad))
    arrays = Seq.from_list(spark, [[1], [2, 3]], "array<bigint>")
    for rows in ([(0, 0)], [(0, 0), (1, 1), (2, 3)], [(0, 0), (1, None)], [(0, 0), (0, 0), (1, 1)]):
        with pytest.raises(ValueError):
            place.parallel_flatten_with_offsets(arrays, spark.createDataFrame(rows, "i long, offset long"))
    with pytest.raises(Exception, match="not one row"):
        tasks.join_rows(a=spark.range(2), b=spark.range(1)).collect()


def test_comparators_grain_and_context(spark):
    s = seq(spark, [5, -7, 7, 3, -5])
    far = lambda a, b: (abs(a) > abs(b)) - (abs(a) < abs(b))
    assert scalar(s.max_by(far)) == -7 and scalar(s.min_by(far)) == 3
    assert scalar(s.min_by(lambda v: F.abs(v))) == 3
    assert scalar(seq(spark, []).min_by(far)) is None
    assert tuple(s.parallel_reduce_with_grain(2, total=F.sum, top=F.max).first()) == (3, 7)
    arrays = Seq.from_list(spark, [[1], [2, 3]], "array<bigint>")
    assert transform.to_list(compose.parallel_flatten_with_grain(arrays, 1)) == [1, 2, 3]
    assert scalar(tasks.parallel_for_range_with_context(spark, 0, 10, lambda i, k: F.sum(i * k), k=3)) == 135
    assert {r["value"] for r in tasks.broadcast_with_context(spark, lambda w, c: c["x"], {"x": 4}, "bigint").collect()} == {4}


def test_searches_over_sparse_keys(spark):
    df = spark.createDataFrame([(10 * k, v) for k, v in enumerate([1, 2, None, 2, 9])], "k long, v long").repartition(3)
    s = Seq.of(df, "v", "k")
    assert scalar(s.position_any(lambda v: v == 9)) == 4 and s.position_any(lambda v: v == 8).count() == 0
    assert scalar(s.is_sorted()) is False and scalar(s.filter(lambda v: v > 0).is_sorted()) is True and scalar(s.is_sorted(True)) is False
    e = lambda v: F.when(v == 2, "two")
    assert tuple(fallible.first_error(s, e).first()) == (1, "two")
    assert tuple(fallible.try_reduce_frame(s, lambda v: v, e, F.sum, 0).first()) == (None, 1, "two")
    assert tuple(fallible.try_reduce_frame(s, lambda v: v, lambda v: F.when(v > 99, "big"), F.sum, 0).first()) == (14, None, None)
    n = Seq.range(spark, 0, 500)
    assert all(scalar(Seq(n.df.withColumn("v", F.when(F.col("k0") == at, -1).otherwise(F.col("v"))), ["k0"]).is_sorted()) == (at == 0) for at in (0, 1, 250, 499))


def test_partition_invariance(spark):
    base = seq(spark, [(7 * k) % 13 for k in range(100)])
    want = None
    for n in (1, 3, 8):
        s = base.with_values(base.df.orderBy(F.rand(n)).repartition(n))
        got = (scalar(s.sum()), tuple(s.find_first(lambda v: v == 5).first()), tuple(s.find_last(lambda v: v == 5).first()), scalar(s.min_by_key(lambda v: v % 5)), scalar(s.max_by_key(lambda v: v % 5)), [r["v"] for r in s.sort_by_key(lambda v: v % 4).collect()], pairs(compose.chunks_aggregate(s, 7, t=F.sum)), transform.to_list(transform.filter(s, lambda v: v > 9)))
        want = want or got
        assert got == want


def test_mixed_case_names_and_transforms(spark):
    s = seq(spark, [1, 2, 3])
    assert transform.to_list(s.mapInPlace(lambda v, k: v * k, k=3)) == [3, 6, 9]
    assert scalar(s.findFirst(lambda v: v == 2)) == 1
    assert transform.to_list(transform.map_python(s, lambda x: x + 1, "bigint")) == [2, 3, 4]
    assert transform.to_list(transform.with_grain(s, 1)) == [1, 2, 3]
    with pytest.raises(AttributeError):
        s.no_such_operator  # noqa: B018
    seen = spark.sparkContext.accumulator(0)
    transform.for_each(s, lambda v: seen.add(v))
    assert seen.value == 6


def test_session_state(monkeypatch, spark):
    from parseq import session

    monkeypatch.setitem(session._state, "spark", None)
    assert not parseq.is_initialized()
    parseq.init()
    with pytest.raises(session.AlreadyInitialized):
        parseq.init()
    parseq.deinit(stop=False)
    session.set_grain_size(10)
    assert session.get_grain_size() == 10
    session.set_grain_size(0)
    assert session.get_grain_size() == session.default_grain_size()
    assert session.get_stats(spark)["active_jobs"] == 0
    session.reset_stats(spark)
    assert session.get_stats(spark)["jobs"] == 0
    spark.range(3).collect()
    assert session.get_stats(spark)["jobs"] >= 1


def test_streaming(spark, tmp_path):
    from parseq import streaming

    df = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1), ("2024-01-01 00:01:10", "a", 2), ("2024-01-01 00:00:40", "b", 3)], "ts string, k string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.read(spark, str(tmp_path / "in"), df.schema)
    q = streaming.running_summary(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("summary").start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("summary")) == [("a", 2, 3, 1, 2), ("b", 1, 3, 3, 3)]
    q = streaming.windowed_counts(stream, "ts", "k", "1 minute", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 3


def test_files(spark, tmp_path):
    from parseq.sources import files

    (tmp_path / "a.csv").write_text("1.5,x\nbad,y\n2.5,z\n")
    (tmp_path / "b.csv").write_text("9" * 100)
    assert files.delimited(spark, str(tmp_path / "a.csv"), "v double, s string").agg(F.sum("v")).first()[0] == 4.0
    assert files.lines(spark, str(tmp_path / "a.csv")).count() == 3
    assert tuple(files.scan_stats(files.files(spark, str(tmp_path), "*.csv"), 50).first()) == (1, 1, 18)
