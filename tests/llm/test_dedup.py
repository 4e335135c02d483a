import hashlib
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import compared, duck, frame, hard_documents  # noqa: E402

from parseq.llm import neardup, substrings, suffixes, vectors  # noqa: E402
from parseq.llm.common import Scratch  # noqa: E402
from parseq.llm.components import components  # noqa: E402


def brute_windows(docs, width=100):
    """doc_id -> flags of bytes in windows that also start earlier; rows with one id share their flags."""
    seen, out = {}, {}
    for i, t in sorted(set(docs), key=lambda x: (x[0], x[1] or "")):
        b = (t or "").encode()
        flags = out.setdefault(i, bytearray(len(b)))
        for k in range(len(b) - width + 1):
            if seen.setdefault(b[k : k + width], (i, k)) != (i, k):
                flags[k : k + width] = b"\1" * width
    return out


@pytest.mark.parametrize(("parts", "most"), [(1, None), (7, None), (1, 1), (7, 1)])
def test_suffixes_same_as_brute_force(spark, parts, most):
    rows = hard_documents()
    got = suffixes.dedup(frame(spark, rows), parts=parts, most=most).collect()
    flags = brute_windows([(r[0], r[1]) for r in rows if r[0] is not None])
    by_id = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    assert any(r.n_removed for r in got)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        b, f = by_id[r.doc_id].encode(), flags[r.doc_id]
        runs = sum(1 for k in range(len(f)) if f[k] and (k == 0 or not f[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(f), runs, hashlib.sha256(bytes(x for x, y in zip(b, f) if not y)).hexdigest())


def test_suffixes_slices_and_small_runs(spark, monkeypatch):
    rng = random.Random(1)
    body = "".join(rng.choice("ab c") for _ in range(5000))
    rows = [(k, body[k * 300 : k * 300 + 2500] + str(k), "", "", 0, "", 0, "") for k in range(8)]
    flags = brute_windows([(r[0], r[1]) for r in rows])
    monkeypatch.setattr(suffixes, "STEP", 700)
    data = [r[1].encode() for r in rows]
    where, pieces = suffixes.slices(range(8), data)
    ends = np.cumsum([len(x) for x in pieces])
    of, first, last, anchor, h = suffixes.items(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(x) for x in pieces], ends)
    assert (last - first + 1).sum() == sum(len(d) - 99 for d in data)
    got = {r.doc_id: r.n_removed for r in suffixes.dedup(frame(spark, rows), parts=3).collect()}
    assert got == {i: sum(f) for i, f in flags.items()}


@pytest.mark.parametrize("some", [5, 1000])
def test_suffixes_of_one_passage_in_many_contexts(spark, monkeypatch, some):
    """A third of the texts hold one passage in contexts of their own; all its grams are split by offsets, many of a part."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    own = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(k, own(150) + (passage if k % 3 == 0 else "") + own(150), "", "", 0, "", 0, "") for k in range(90)]
    flags = brute_windows([(r[0], r[1]) for r in rows])
    press = zstandard.ZstdCompressor()
    z = pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "z": pa.array([press.compress(r[1].encode()) for r in rows])})
    told = pa.Table.from_batches(list(suffixes.sieved(20)(suffixes.sieve_blocks(1)(iter([z])))))
    assert told.num_rows - told["gram"].null_count > 16
    monkeypatch.setattr(suffixes, "SPLIT", some)
    for parts, most in ((1, 20), (3, 20), (3, None)):
        got = {r.doc_id: r.n_removed for r in suffixes.dedup(frame(spark, rows), parts=parts, most=most).collect()}
        assert got == {i: sum(f) for i, f in flags.items()}
    assert sum(got.values()) >= 29 * 1200


def test_suffix_items_split_into_their_windows():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 2, 400).astype(np.uint8)
    first = np.arange(0, 100)
    last = first + rng.integers(0, suffixes.LEFT + 1, 100)
    anchor = rng.integers(last, first + suffixes.LEFT + 1)
    made = suffixes.records(text, np.zeros(100, np.int64), first, last, anchor)
    rows, doc, start = suffixes.split(made, np.arange(100), anchor)
    assert sorted(zip(doc.tolist(), start.tolist())) == [(k, at) for k in range(100) for at in range(first[k], last[k] + 1)]
    assert all(rows[n, : suffixes.WINDOW].tobytes() == text[at : at + suffixes.WINDOW].tobytes() for n, at in enumerate(start))
    assert (rows[:, suffixes.WINDOW : -2] == 0).all() and (rows[:, -2:] == (suffixes.WINDOW, 0)).all()


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            m = rng.integers(0, 3, (rng.integers(0, 60), suffixes.RECORD)).astype(np.uint8)
            m[:, 4:] = 0
            runs.append(m[np.lexsort(m.T[::-1])])
        keys = [[r.tobytes() for r in m] for m in runs]
        order, lcp = suffixes.merged(keys, [suffixes.shared(m).tolist() for m in runs])
        every = [x for r in keys for x in r]
        out = [every[i] for i in order]
        assert out == sorted(every)
        assert all(lcp[i] == len(os.path.commonprefix([out[i - 1], out[i]])) for i in range(1, len(out)))


def test_front_coding_round_trip():

    rng = np.random.default_rng(4)
    rows = np.sort(rng.integers(0, 2, (500, suffixes.RECORD)).astype(np.uint8), axis=0)
    doc, anchor = rng.integers(-(2**40), 2**40, 500), rng.integers(0, 2**30, 500)
    back = suffixes.decoded(suffixes.front_coded(rows, doc, anchor, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
    assert (back[0] == rows).all() and (back[2] == doc).all() and (back[3] == anchor).all()


def test_empty_tables(spark):
    none = frame(spark, hard_documents()).limit(0)
    assert suffixes.dedup(none).count() == 0
    assert neardup.link(none).count() == 0
    assert substrings.dedup(none).count() == 0 and substrings.rewrite(none).count() == 0
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def words_of(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)])


@pytest.mark.parametrize("width", [4, 5])
def test_near_same_as_brute_force(spark, width, monkeypatch):
    if width == 4:
        for name in ("STAR", "HELD", "PASSING", "HELD_TEXTS", "PASSING_TEXTS"):
            monkeypatch.setattr(neardup, name, 5)  # so that stars, buckets and families are split
    rows = hard_documents()
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    for k in range(40):  # a group of near copies, some of which are only linked through others
        base[rng.randrange(60)] = f"n{k}"
        rows.append((1000 + k, " ".join(base), "en", "src0", 0, "", 0, ""))
    got = neardup.link(frame(spark, rows), width=width).collect()
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = words_of(r[1], width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    assert sum(1 for i in ids if find(i) != i) > 30
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_hyperminhash_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        r = neardup.registers([a, b])
        assert abs(float(neardup.estimate(r[0], r[1], n, n)) - share) < neardup.MARGIN
    assert 0 < neardup.accident(1000, 1000) < 0.01


def test_components(spark):
    scratch = Scratch(spark)
    path = [(k + 1, k) for k in range(60)] + [(200, 100), (150, 200), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(path, "u long, v long"), scratch).distinct().collect())
    assert all(got[k] == 0 for k in range(61)) and got[150] == got[200] == got[100] == 100 and len(got) == 64
    rng = random.Random(4)
    ids = [rng.getrandbits(64) - (1 << 63) for _ in range(4000)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(9000 + k, 5000) for k in range(300)] + [(5000, 17)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), scratch).collect())
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_vectors_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # so that buckets are split into blocks
    rng = np.random.default_rng(2)
    x = [rng.standard_normal(16) for _ in range(60)]
    for k in range(60):
        x.append(x[k % 6] + rng.standard_normal(16) * 0.12)
    x += [x[0]] * 30 + [x[1] * 3.0]
    rows = [(k * 3, [float(v) for v in np.float32(e)], 0, "s") for k, e in enumerate(x)]
    odd = [(1, None, 0, ""), (2, [], 0, ""), (4, [0.0] * 16, 0, ""), (5, [None] + [1.0] * 15, 0, ""), (7, [float("nan")] * 16, 0, ""), (8, [float("inf")] * 16, 0, ""), (None, rows[0][1], 0, ""), (10, [1.0, 2.0], 0, ""), (11, [1.0, 2.0], 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = {r.vec_id: r for r in vectors.link(df).collect()}
    m = vectors.normalised(np.array([r[1] for r in rows]))
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    label = vectors.least_labels(len(m), *np.nonzero(linked))
    assert len(got) == len(rows) + len(odd)
    missed = sum(int(linked[k].sum()) - got[r[0]].n_links for k, r in enumerate(rows))
    assert 0 <= missed <= 0.02 * linked.sum()
    assert sum(got[r[0]].component_id != 3 * label[k] for k, r in enumerate(rows)) <= 2
    for i in (1, 2, 4, 5, 7, 8):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert (got[10].n_links, got[11].component_id, got[11].kept) == (1, 10, False)


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01])]
    got = sorted(tuple(r) for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_vectors_recall():
    rng = np.random.default_rng(5)
    for cosine, least in ((0.98, 0.999), (0.95, 0.98), (0.92, 0.9)):
        a = vectors.normalised(rng.standard_normal((400, 64)))
        b = rng.standard_normal((400, 64))
        b = vectors.normalised(b - (a * b).sum(1, keepdims=True) * a)
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        assert (vectors.buckets(a) == vectors.buckets(vectors.normalised(b))).any(1).mean() >= least


def test_vectors_recall_at_the_limit():
    rng = np.random.default_rng(6)
    for cosine in (0.9, 0.91):
        a = vectors.normalised(rng.standard_normal((2000, 64)))
        b = rng.standard_normal((2000, 64))
        b = vectors.normalised(b - (a * b).sum(1, keepdims=True) * a)
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        assert (vectors.buckets(a) == vectors.buckets(vectors.normalised(b))).any(1).mean() >= 0.99


def test_vectors_plan_keeps_recall_and_bucket_sizes():
    """Beyond FEW vectors links at the limit are found as often, and unlike vectors in a bucket stay as few."""
    assert [vectors.plan(n) for n in (0, 1, 500, vectors.FEW)] == [(vectors.K, vectors.TABLES)] * 4
    rng = np.random.default_rng(7)
    a, other = (vectors.normalised(rng.standard_normal((800, 64))) for _ in range(2))
    b = vectors.normalised(other - (a * other).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    sizes = []
    for n in (vectors.FEW, 1 << 22):
        k, tables = vectors.plan(n)
        x, y, z = (vectors.buckets(v, k, tables) for v in (a, b, other))
        assert (x == y).any(1).mean() >= 0.985
        sizes.append(n * np.mean([(x[i] == z).mean() for i in range(800)]))
    assert sizes[1] < 3 * sizes[0]


def test_vectors_of_a_large_plan(spark, monkeypatch):
    """The same links by another number of projections and tables."""
    rows = [(k, [float(x) for x in np.random.default_rng(k % 40).standard_normal(8) + 0.01 * (k // 40)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in vectors.link(df).collect())
    assert sum(r[1] for r in want) >= 160
    monkeypatch.setattr(vectors, "FEW", 20)
    assert vectors.plan(120)[0] > vectors.K
    assert sorted(tuple(r) for r in vectors.link(df).collect()) == want


def test_substrings_same_as_sql(spark):
    rows = [r for r in dict.fromkeys(hard_documents()) if r[0] is not None and r[1] is not None and "\x00" not in r[1]]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    done = substrings.dedup(df, min_run=substrings.PASSAGE)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    got = done.select("doc_id", "n_units", "n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("removed_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), spans.alias("removed_spans"))
    want = duck(documents=df.toPandas()).execute(substrings.ORACLE).df()
    assert compared(got.toPandas()) == compared(want)
    again = {r.doc_id: r.text for r in substrings.rewrite(df, min_run=substrings.PASSAGE).collect()}
    assert again == {r.doc_id: r.kept_text for r in done.collect()}
    assert substrings.rewrite(df).columns == df.columns


def test_substrings_odd_rows(spark):
    line = "This very line has more than six words in it."
    rows = [(1, line, 1), (2, f"x\n{line.upper()}\ny", 2), (2, f"x\n{line.upper()}\ny", 2), (None, line, 3), (3, None, 4), (4, f"{line} {line}", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(((r.doc_id or -1, r.kept_text, [tuple(s) for s in r.removed]) for r in substrings.dedup(df, min_run=10).collect()), key=str)
    assert got == sorted([(1, line, []), (2, "x\ny", [(2, 3 + len(line))]), (2, "x\ny", [(2, 3 + len(line))]), (-1, line, []), (3, "", []), (4, "", [(0, 2 * len(line) + 1)])], key=str)


def test_substrings_runs(spark):
    lone, passage = "A common phrase of seven words here.", "\n".join(f"short line {k}" for k in range(6))
    rows = [(1, f"{lone}\n{passage}"), (2, f"First. {lone} Own text.\n{passage}\n\n{lone}\nLast."), (3, f"{lone}\nThird.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substrings.dedup(df).collect()} == {1: rows[0][1], 2: "First. Own text.\nLast.", 3: "Third."}
    got = {r.doc_id: r.kept_text for r in substrings.dedup(df, min_run=substrings.PASSAGE).collect()}
    assert got == {1: rows[0][1], 2: f"First. {lone} Own text.\nLast.", 3: rows[2][1]}


def test_substrings_of_short_lines(spark, tmp_path):
    lines = "\n".join(f"line number {k} of twelve" for k in range(12))
    rows = [r for r in dict.fromkeys(hard_documents()) if r[0] is not None and r[1] is not None and "\x00" not in r[1]]
    rows += [(k, f"Start {k}.\n{lines}\n\nEnd {k}.", None, None, None, None, None, None) for k in (1001, 1002)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    from parseq.llm import queries

    got = queries.QUERIES["op10_substrings_all"](spark, str(tmp_path)).toPandas()
    want = duck(documents=df.toPandas()).execute(queries.ORACLE["op10_substrings_all"]).df()
    assert compared(got) == compared(want)
    gone = dict(zip(got["doc_id"], got["n_removed"]))
    assert (gone[1001], gone[1002]) == (0, 12)
