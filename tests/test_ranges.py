"""Operators on ranges and blocks: edges, plans, and that nothing depends on how rows are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import parseq
from parseq.operators import compare, compose, halo, order, packed, place, reduce
from parseq.operators.prefix import scan
from parseq.plans import catalog, postings, recipes, tiles
from parseq.seq import Seq
from parseq.sources.fences import FenceIndex


def seq(spark, values, kind="bigint", parts=3, sparse=False):
    """A sequence in shuffled partitions; ``sparse``: with keys that have gaps."""
    rows = [(n * 7 - 3 if sparse else n, x) for n, x in enumerate(values)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), f"k bigint, v {kind}").repartition(parts)
    return Seq.of(df, "v", "k", dense=not sparse)


def listed(s: Seq) -> list:
    rows = sorted((r.k0, r.v) for r in s.df.select("k0", "v").collect())
    assert [k for k, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows]


def by_tens(a, b):
    return a // 10 - b // 10


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize(("n", "run"), [(0, 10), (1, 10), (500, 7), (500, 1000)])
def test_sort_by_comparator(spark, monkeypatch, n, run, sparse):
    monkeypatch.setattr(compare, "RUN", run)
    rng = random.Random(n)
    values = [rng.choice([rng.randint(-50, 50), 3, None]) for _ in range(n)]
    got = listed(compare.sort_by(seq(spark, values, sparse=sparse), by_tens, parts=5))
    assert got == sorted(values, key=lambda v: (v is not None, 0 if v is None else v // 10))
    assert parseq.scalar(compare.is_sorted_by(seq(spark, got, sparse=sparse), by_tens))
    assert parseq.scalar(compare.is_sorted_by(seq(spark, [5, 15, 14, 3], sparse=sparse), by_tens)) is False


def test_ties_of_comparators_are_dealt_to_many_ranges(spark):
    """A third of all values are equal: no range holds them all, and they keep their order."""
    values = [{"x": 0 if n % 3 == 0 else n, "n": n} for n in range(3000)]
    s = seq(spark, values, "struct<x:bigint,n:bigint>")
    done = compare.sort_by(s, lambda a, b: a["x"] - b["x"], parts=12)
    assert [r["n"] for r in listed(done)] == [v["n"] for v in sorted(values, key=lambda v: v["x"])]
    sizes = [r["count"] for r in done.df.groupBy((F.col("k0") - F.col("k0")).alias("all"), F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000


@pytest.mark.parametrize("kind", ["bigint", "double", "string"])
def test_merge_of_sorted_runs(spark, kind):
    rng = random.Random(kind)
    make = {"bigint": int, "double": float, "string": str}[kind]
    for n, m in ((0, 0), (0, 5), (700, 0), (900, 350), (5, 5000)):
        a, b = (sorted(make(rng.choice([7, rng.randint(0, 90)])) for _ in range(k)) for k in (n, m))
        got = listed(compare.merge_runs(seq(spark, a, kind), seq(spark, b, kind, sparse=True), parts=4))
        assert got == sorted(a + b)
    nulls = listed(compare.merge_runs(seq(spark, [None, None, make(1)], kind), seq(spark, [None, make(0)], kind)))
    assert nulls == [None, None, None, make(0), make(1)]


def test_merge_is_stable_and_sorts_no_rows(spark):
    pairs = "struct<x:bigint,s:string>"
    a, b = ([{"x": x, "s": s} for x in (1, 1, 2, 5, 5)] for s in "ab")
    s, t = (seq(spark, v, pairs) for v in (a, b))
    merged = compare.merge_runs(s, t, lambda x, y: x["x"] - y["x"])
    assert [(r["x"], r["s"]) for r in listed(merged)] == [(x, s) for x in (1, 2, 5) for s in "ab" for _ in range(1 if x == 2 else 2)]
    plain = compare.merge_runs(seq(spark, [1, 2, 3]), seq(spark, [2, 3, 4]))
    assert "Sort" not in plain.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sparse", [False, True])
def test_zip_by_blocks(spark, monkeypatch, sparse):
    monkeypatch.setattr(packed, "BLOCK", 16)
    for n, m in ((0, 3), (16, 16), (100, 37), (33, 1000)):
        a, b = seq(spark, list(range(n)), sparse=sparse), seq(spark, [str(k) for k in range(m)], "string", sparse=True)
        want = [(k, str(k)) for k in range(min(n, m))]
        assert [(r["a"], r["b"]) for r in listed(compose.zip(a, b))] == want
        x, y = packed.stored(a), packed.stored(b)
        assert [(r["a"], r["b"]) for r in listed(x.zip(y))] == want
        assert listed(x.seq()) == list(range(n))


def test_stored_zip_has_no_exchange(spark):
    a, b = packed.stored(seq(spark, list(range(9000)))), packed.stored(seq(spark, [None, *range(8000)], sparse=True))
    plan = a.zip(b).df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert parseq.scalar(a.dot_product(b)) == sum(k * (k - 1) for k in range(1, 8001))


def test_positions_that_are_missing_raise(spark):
    gap = Seq(spark.createDataFrame([(1, 0), (2, 2)], "v bigint, k0 bigint"), ["k0"], True)
    with pytest.raises(Exception, match="positions are missing"):
        compose.zip(gap, seq(spark, [1, 2, 3])).df.collect()


@pytest.mark.parametrize("sparse", [False, True])
def test_scatter_and_gather_by_blocks(spark, monkeypatch, sparse):
    monkeypatch.setattr(packed, "BLOCK", 8)
    rng = random.Random(2)
    out, at = list(range(100)), [rng.randrange(100) for _ in range(300)]
    new = [rng.choice([None, k]) for k in range(1000, 1300)]
    want = list(out)
    for k, x in zip(at, new):
        want[k] = x
    assert listed(place.parallel_scatter(seq(spark, out, sparse=sparse), seq(spark, new, sparse=True), seq(spark, at, sparse=sparse))) == want
    there = rng.sample(range(100), 100)
    assert listed(order.apply_permutation(seq(spark, new[:100], sparse=sparse), seq(spark, there))) == [new[k] for k in there]
    for bad in ([100], [-1], [None]):
        with pytest.raises(ValueError):
            place.parallel_scatter(seq(spark, out), seq(spark, [1]), seq(spark, bad))
    with pytest.raises(ValueError):
        place.parallel_scatter(seq(spark, out), seq(spark, [1, 2]), seq(spark, [3]))
    with pytest.raises(ValueError):
        order.apply_permutation(seq(spark, [1, 2]), seq(spark, [0]))


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_tiled_products(spark, tile):
    rng = np.random.default_rng(tile)
    for n, k, m in ((1, 1, 1), (7, 5, 9), (10, 1, 4)):
        a, b = rng.integers(-9, 9, (n, k)), rng.integers(-9, 9, (k, m))
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, x array<bigint>")
        some = spark.createDataFrame([(i, j, int(x)) for (i, j), x in np.ndenumerate(b) if x], "i long, j long, x long")
        done = tiles.matmul(tiles.of_rows(rows, "i", "x", tile), tiles.of_cells(some, tile=tile))
        got = np.zeros((n, m), np.int64)
        for r in tiles.cells(done, tile=tile).collect():
            got[r.i, r.j] = r.x
        assert (got == a @ b).all()
    big = spark.createDataFrame([(0, 0, 3037000499), (0, 1, 1)], "i long, j long, x long")
    t = tiles.of_cells(big, tile=tile)
    assert tiles.cells(tiles.matmul(t, tiles.transposed(t)), tile=tile).collect()[0].x == 3037000499**2 + 1
    floats = tiles.of_cells(spark.createDataFrame([(0, 0, 0.5), (1, 0, 2.0)], "i long, j long, x double"), tile=tile)
    done = tiles.cells(tiles.matmul(tiles.transposed(floats), floats, False), False, tile).collect()
    assert [r.x for r in done] == [4.25]


@pytest.mark.parametrize("sparse", [False, True])
def test_chunks_that_tasks_share(spark, sparse):
    for n, size in ((0, 3), (10, 3), (100, 7), (100, 1), (9, 100)):
        values = list(range(n))
        want = [sum(values[k // size * size : k // size * size + size]) + k // size for k in range(n)]
        got = halo.chunks_apply(seq(spark, values, sparse=sparse), size, lambda c, v: [sum(v) + c] * len(v))
        assert listed(got) == want
    whole = Seq(spark.range(0, 1000, 1, 4).select(F.col("id").alias("v"), F.col("id").alias("k0")), ["k0"], True)
    assert listed(compose.chunks_apply(whole, 100, lambda c, v: v[::-1])) == [k // 100 * 100 + 99 - k % 100 for k in range(1000)]


def test_stencils_travel_at_edges_only(spark, monkeypatch):
    frame = spark.range(0, 4000, 1, 4).select(F.col("id").alias("idx"), (F.col("id") * 37 % 256).alias("v"))
    monkeypatch.setattr(halo, "RUN", 1 << 20)
    want = {r.idx: r.v for r in recipes.blur_image(frame.coalesce(1), 40).collect()}
    assert {r.idx: r.v for r in recipes.blur_image(frame, 40).collect()} == want
    assert {r.idx: r.v for r in recipes.blur_image(frame.repartition(5), 40).collect()} == want
    monkeypatch.setattr(halo, "RUN", 30)
    assert {r.idx: r.v for r in recipes.blur_image(frame, 40).collect()} == want
    cuts = []
    monkeypatch.setattr(halo, "RUN", 1 << 20)
    monkeypatch.setattr(halo, "cut", lambda df, f=halo.cut: cuts.append(f(df)) or cuts[-1])
    recipes.blur_image(frame, 40).count()
    assert cuts[0].filter("not done").count() <= 3 * 4 * 41


@pytest.mark.parametrize("sparse", [False, True])
def test_scans(spark, sparse):
    rng = random.Random(4)
    values = [rng.choice([None, rng.randint(0, 99)]) for _ in range(400)]
    s = seq(spark, values, sparse=sparse)
    run = lambda *a, **b: [r.scan for r in scan(*a, **b).orderBy("k0").collect()]
    tops, top = [], None
    for v in values:
        top = v if top is None else top if v is None else max(top, v)
        tops.append(top)
    assert run(s, np.maximum) == tops and run(s, max) == tops
    assert run(s, np.maximum, exclusive=True, identity=-1) == [-1 if t is None else t for t in [None, *tops[:-1]]]
    words = ["".join(chr(97 + k % 26)) for k in range(120)]
    assert run(seq(spark, words, "string", sparse=sparse), lambda a, b: a + b) == ["".join(words[: k + 1]) for k in range(120)]
    assert run(seq(spark, [], sparse=sparse), np.add) == []
    full = [rng.randint(0, 9) for _ in range(300)]
    assert run(seq(spark, full, sparse=sparse), np.add) == np.cumsum(full).tolist()


def test_fence_index(spark, tmp_path):
    values = sorted(random.Random(5).choices(range(200), k=1000))
    index = FenceIndex.build(seq(spark, values, sparse=True), str(tmp_path / "index"), rows=60)
    index = FenceIndex(spark, index.path)
    assert index.fences.count() >= 17 and index.n() == 1000
    for v in (-5, 0, 3, 77, 199, 200):
        assert index.lower_bound(v) == sum(x < v for x in values)
    plan = index.lower_bound_plan(77)
    assert len(plan.inputFiles()) == 1
    assert [index.position(n * 7 - 3) for n in (0, 500, 999)] == [0, 500, 999] and index.position(5) is None and index.position(10**6) is None
    for offset, length in ((0, 5), (55, 130), (990, 50), (2000, 5), (10, 0)):
        assert [r.v for r in index.slice(offset, length).orderBy("i").collect()] == values[offset : offset + length]
    hit = index.find_any(lambda v: v % 2 == 1, low=150)
    assert hit.hit and hit.value >= 150 and hit.value % 2 and hit.files_read < hit.files
    none = index.find_any(lambda v: v > 1000)
    assert not none.hit and none.files_read == none.files
    assert FenceIndex.build(seq(spark, []), rows=5).lower_bound(1) == 0


def test_fence_bounds_that_are_excluded(spark):
    """A value on an excluded bound gives no file to read, at either end; an included one does."""
    index = FenceIndex.build(seq(spark, [0, 0, 1, 2, 3, 5, 5, 5]), rows=2)
    for bounds, reads in (({"below": 0}, False), ({"high": 0}, True), ({"above": 5}, False), ({"low": 5}, True), ({"above": 3, "below": 5}, True)):
        none = index.find_any(lambda v: v > 100, **bounds)
        assert not none.hit and (none.files_read > 0) is reads
    hit = index.find_any(lambda v: v >= 0, above=0, below=2)
    assert hit.hit and hit.value == 1
    assert not index.find_any(lambda v: v >= 0, above=3, below=5).hit
    both = index.find_any(lambda v: v < 3, low=2, above=1, high=3, below=3)
    assert both.value == 2


def test_early_exit_at_the_bound(spark, tmp_path):
    """Values of exactly 0 are not below 0, so no file is read for them."""
    spark.sql("SELECT id AS event_id, CASE WHEN id % 7 = 0 THEN 0D ELSE id + 0D END AS value FROM range(1000)").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(catalog.QUERIES["early_exit_waves"](spark, str(tmp_path)).first()) == (True, False, True, 0)


def test_folds_by_a_tree(spark):
    words = [chr(97 + k % 26) for k in range(200)]
    for fan_in in (2, 3, 16):
        assert parseq.scalar(reduce.ordered_fold(seq(spark, words, "string", sparse=True), "", lambda a, b: a + b, fan_in)) == "".join(words)
    with pytest.raises(ValueError):
        reduce.ordered_fold(seq(spark, words, "string"), "", lambda a, b: a + b, 1)
    assert parseq.scalar(reduce.ordered_fold(seq(spark, [], "string"), "e", lambda a, b: a + b)) == "e"


def test_codes_of_postings():
    rng = np.random.default_rng(6)
    for x in ([], [0], [127, 128, 16383, 16384, (1 << 53) - 1, 1 << 53, (1 << 56) - 1, 1 << 56, (1 << 62) + 5], rng.integers(0, 1 << 40, 500)):
        assert postings.uncoded(postings.coded(np.array(x, np.int64))).tolist() == list(x)
    docs, at = [5, 9, 1000], [[0, 3, 4], [7], [2, 2_000_000]]
    ids, places = postings.unblock(5, 3, postings.block(docs, at))
    assert ids.tolist() == docs and [p.tolist() for p in places] == at


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(postings, "DOCS", 3)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=rng.randint(0, 12))) for _ in range(60)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = postings.build(recipes.postings(docs, "doc_id", "text")).cache()
    for words in (["a"], ["a", "b"], ["a", "a", "a"], ["b", "a", "b"], ["zz", "a"]):
        want = {}
        for k, t in enumerate(texts):
            w = (t or "").split()
            n = sum(w[i : i + len(words)] == words for i in range(len(w)))
            want |= {k: n} if n else {}
        assert {r.doc_id: r.n for r in postings.phrase(index, words).collect()} == want
    assert index.filter("term = 'a'").count() > 5
    assert index.agg(F.max("docs")).first()[0] <= 3


def test_index_of_texts(spark, monkeypatch):
    """The index of texts is that of their postings, however documents are dealt and numbered, and a word's documents of one shelf go
    to its blocks in one row for each task that has read them."""
    import re

    monkeypatch.setattr(postings, "DOCS", 5)
    monkeypatch.setattr(postings, "POSITIONS", 40)
    monkeypatch.setattr(postings, "HELD", 2000)
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "b", " ", "é", "the ", "\n", "7", "Straße ", "zz "], k=rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " é 7 ", "a " * 500, "x" * 5000]
    ids = rng.sample(range(-1500, 1500), len(texts))
    want: dict = {}
    for k, t in zip(ids, texts):
        for place, w in enumerate(re.findall("[A-Za-z]+", t or "")):
            want.setdefault((w, k), []).append(place)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    sizes = []

    def cut(df, f=postings.cut):
        out = f(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(postings, "cut", cut)
    index = postings.build(postings.of_texts(docs, "doc_id", "text"))
    assert sizes[0] < len(want)
    assert {(r.term, r.doc_id): r.at for r in postings.opened(index).collect()} == want
    blocks = index.orderBy("offset").collect()
    assert [(r.term, r.low) for r in blocks] == sorted((r.term, r.low) for r in blocks)
    assert [r.offset for r in blocks] == np.cumsum([0, *(r.n for r in blocks[:-1])]).tolist()
    assert max(r.docs for r in blocks) == 5
    plain = postings.build(recipes.postings(docs, "doc_id", "text"))
    assert {(r.term, r.doc_id): r.at for r in postings.opened(plain).collect()} == want


def test_index_of_a_document_in_two_rows(spark):
    docs = spark.createDataFrame([(k, "a b a") for k in range(600)] + [(7, "b c"), (599, "a")], "doc_id long, text string").repartition(5)
    got = {r.term: (r.n, r.docs) for r in postings.build(postings.of_texts(docs, "doc_id", "text")).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert got == {"a": (1201, 600), "b": (601, 600), "c": (1, 1)}


def test_phrase_of_no_document(spark, tmp_path):
    """Without a document of two words there is no phrase, and no row."""
    spark.createDataFrame([(1, "one 7 é"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["phrase_documents"](spark, str(tmp_path)).collect() == []


def test_products(spark):
    product = lambda v, kind="bigint", one=1: parseq.scalar(reduce.reduce(seq(spark, v, kind), one, "mul"))
    assert product([3] * 39) == 3**39 and product([-2] * 63) == -(2**63) and product([2] * 63 + [-1]) == -(2**63)
    assert product([2] * 500 + [0, None]) == 0 and product([]) == 1 and product([None], one=5) == 5 and product([-1] * 3, "int") == -1
    assert product([2.5, None, 2.0], "double", 1.0) == 5.0
    for v in ([3037000499, 3037000507], [2] * 63, [2] * 64, [-2] * 64):
        with pytest.raises(Exception, match="overflow"):
            product(v)
    decimals = Seq(spark.sql("SELECT 1.5BD AS v, 0L AS k0"), ["k0"], True)
    with pytest.raises(TypeError):
        reduce.reduce(decimals, 1, "mul")


def test_nulls_in_sums_and_order(spark):
    assert parseq.scalar(compose.flatten_sum(seq(spark, [[1, None, 2], [5], None, []], "array<bigint>"))) == 8
    assert parseq.scalar(compose.flatten_sum(seq(spark, [], "array<bigint>"))) == 0
    for v, down, want in (([3, None, 1], False, False), ([None, None, 1, 3], False, True), ([1, None], False, False), ([3, 1, None], True, True), ([None, 3], True, False), ([], False, True)):
        assert parseq.scalar(order.is_sorted(seq(spark, v, sparse=True), down)) is want


def test_chains_of_different_keys(spark):
    a = Seq.of(spark.createDataFrame([("y", 2), ("x", 1)], "k string, v int"), "v", "k")
    b = Seq.of(spark.createDataFrame([(5, 3), (4, 4)], "k int, v int"), "v", "k")
    assert [r.v for r in order.sort(compose.chain(a, b), lambda v: v * 0).collect()] == [1, 2, 4, 3]
    assert [r.v for r in order.sort(compose.chain(compose.chain(b, a), b), lambda v: v * 0).collect()] == [4, 3, 1, 2, 4, 3]


def test_chunked_reduce_grain(spark):
    sizes = []
    out = reduce.parallel_reduce_chunked(seq(spark, list(range(100)), parts=1), len, F.max, "bigint", grain=7)
    assert parseq.scalar(out) == 7 and not sizes
    assert parseq.scalar(reduce.parallel_reduce_chunked(seq(spark, []), sum, F.sum, "bigint")) is None
    assert parseq.scalar(reduce.parallel_reduce_chunked(seq(spark, []), sum, F.sum, "bigint", identity=0)) == 0
