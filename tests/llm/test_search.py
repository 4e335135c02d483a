"""The prefix trie, exact dedup and hard negatives against their SQL, on small tables with hard rows and in small pieces."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import compared, duck, frame, hard_documents  # noqa: E402

from parseq.llm import exact, negatives, trie  # noqa: E402
from parseq.llm.common import Scratch  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, path string, n int"


def said(seed: int):
    """Conversations that share first turns, some equal, some without turns of their own, long ones, odd rows."""
    rng = random.Random(seed)
    rows = []
    starts = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "\u00fc" * 3])) for _ in range(rng.randint(0, 4))] for _ in range(6)]
    for c in [*range(0, 40), *range(100, 160), *range(250, 270), -3, -105]:
        own = rng.choice(starts) + [("user", rng.choice("xyz")) for _ in range(rng.randint(0, 3))]
        rows += [(c, k, *t, "p", 1) for k, t in enumerate(own)]
    rows += [(7, k, "user", f"t{k}", None, None) for k in range(10, 700)]
    rows += [(8, None, "user", "no number", "p", 2), (8, 0, "user", "tie", "p", 2), (8, 0, "user", "tie", "p", 2), (8, 0, "bot", None, "p", 2), (None, 0, "user", "nobody", "p", 2), (9, 3, "user", "long " * 20_000, "p", 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "block", "run"), [(1, 1 << 14, 1 << 20), (5, 7, 40), (9, 1, 1)])
def test_trie_same_as_sql(spark, monkeypatch, parts, block, run):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(trie, "RUN_TURNS", run)
    df = spark.createDataFrame(said(parts), TURNS).repartition(3)
    want = duck(conversations=df.toPandas().astype({"turn": "Int64", "conv_id": "Int64"})).execute(trie.ORACLE).df()
    got = trie.trie(df, parts).toPandas()
    assert compared(got.astype("object").where(got.notna(), None).astype({"parent_conv_id": "Int64"})) == compared(want.astype({"parent_conv_id": "Int64"}))


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    only_null = spark.createDataFrame([(None, 0, "user", "t", "p", 1)], TURNS)
    assert trie.trie(only_null).count() == 0
    one = trie.trie(spark.createDataFrame([(5, 0, None, None, "p", 1)], TURNS)).collect()
    assert {(r.depth, r.n_convs, r.saved_tokens) for r in one} <= {(0, 1, 0), (1, 1, 0)}


def test_loser_tree_of_conversations():
    rng = random.Random(3)
    keys = sorted({b"".join(bytes([rng.randint(0, 2)]) * trie.TOKEN for _ in range(rng.randint(0, 6))) for _ in range(300)})
    for n in (1, 2, 5, 8):
        runs = [[] for _ in range(n)]
        for k in keys:
            runs[rng.randrange(n)].append(k)
        streams = [iter([(k, trie.common(r[i - 1], k) if i else 0, i) for i, k in enumerate(r)]) for r in runs]
        got = list(trie.merged(streams))
        assert [g[0] for g in got] == keys
        assert [g[1] for g in got] == [trie.common(a, b) if a else 0 for a, b in zip([b"", *keys], keys)]


def test_exact_same_as_sql(spark):
    rows = [r for r in hard_documents() if "\x00" not in (r[1] or "")]
    rows += [(k, "one text of many", None, None, None, "c", 1, "f") for k in range(1000, 1060)] + [(1059, "one text of many", None, None, None, "c", 1, "f")]
    df = frame(spark, rows)
    want = duck(documents=df.toPandas().astype({"doc_id": "Int64"})).execute(exact.ORACLE).df()
    for batches in (1, 3):
        got = exact.dedup(df, batches).toPandas()
        assert compared(got.astype({"doc_id": "Int64", "keep_id": "Int64"})) == compared(want.astype({"doc_id": "Int64", "keep_id": "Int64"}))
    assert exact.dedup(frame(spark, [])).count() == 0


def test_digest_index_is_kept(spark):
    """Batches that come again change nothing, an opened index goes on, and a compacted one answers the same."""
    scratch = Scratch(spark)
    batch = lambda rows: scratch.cut(exact.tops(scratch.cut(exact.rows_of(spark.createDataFrame(rows, "doc_id long, text string")))))
    index = exact.DigestIndex(spark, scratch.folder(), buckets=3)
    first, second = batch([(1, "a"), (2, "a"), (5, "b")]), batch([(9, "a"), (3, "b"), (4, None)])
    index.add(first, 1)
    index.add(second, 2)
    index.add(second, 2)
    index.add(first, 1)
    answer = lambda x: sorted((r.keep_id, r.n) for r in x.lookup().collect())
    assert answer(index) == [(4, 1), (5, 2), (9, 3)]
    index.close()
    again = exact.DigestIndex(spark, index.path)
    assert again.buckets == 3 and answer(again) == [(4, 1), (5, 2), (9, 3)]
    again.add(batch([(7, ""), (8, "c")]), 3)
    assert answer(again) == [(5, 2), (7, 2), (8, 1), (9, 3)]
    small = again.compact(scratch.folder())
    assert answer(small) == answer(again)
    plan = first.join(again._table("seen").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


VECTORS = "vec_id long, embedding array<float>, label int, tile string, score long"


def points(seed: int):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [round(c + rng.gauss(0, 0.3), 2) for c in rng.choice(centres)], rng.choice([0, 1, 2, 9, -4]), "t", 1) for k in range(0, 420)]
    rows += [(500 + k, centres[0], 1 + k % 2, "t", 1) for k in range(60)] + [(500, centres[0], 1, "t", 1), (500, centres[0], 2, "t", 1), (600, centres[0], 1, "t", 1)]
    rows += [(700, None, 1, "t", 1), (800, centres[1], None, "t", 1), (None, centres[1], 1, "t", 1), (900, [1.0, None], 1, "t", 1), (901, [float("nan")] * 6, 1, "t", 1), (902, [float("inf")] * 6, 1, "t", 1), (903, [], 1, "t", 1), (1000, [0.0] * 6, 2, "t", 1)]
    rows += [(1100 + k, [1.0, float(k)], k % 2, "t", 1) for k in range(5)] + [(1200, [1.0, 2.0, 3.0], 1, "t", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("candidates", "anchors", "leaf", "anchor_leaf"), [(4096, 1024, 128, 16), (40, 3, 4, 1), (9, 2, 1, 1)])
def test_negatives_same_as_sql(spark, monkeypatch, candidates, anchors, leaf, anchor_leaf):
    for name, x in (("CANDIDATES", candidates), ("ANCHORS", anchors), ("LEAF", leaf), ("ANCHOR_LEAF", anchor_leaf), ("ROOTS", 7)):
        monkeypatch.setattr(negatives, name, x)
    df = spark.createDataFrame(points(leaf), VECTORS).repartition(3)
    con = duck()
    con.register("embeddings", df.toArrow())
    want = con.execute(negatives.ORACLE).df()
    got = negatives.mined(df).toPandas()
    assert len(want) > 20 and compared(got) == compared(want)


def test_negatives_of_nothing(spark):
    assert negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mined(spark.createDataFrame([(100, [1.0], 1, "t", 1)], VECTORS)).count() == 0
    huge = [(k, [1e30, 1.0], 1, "t", 1) for k in (100, 101)] + [(k, [3e6, 2e6], k % 2, "t", 1) for k in range(200, 206)]
    got = {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score) for r in negatives.mined(spark.createDataFrame(huge, VECTORS)).collect()}
    assert all(a == 200 and s == (3 * 256 * 10**6) ** 2 + (2 * 256 * 10**6) ** 2 for a, _, _, _, s in got) and got
