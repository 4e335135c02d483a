"""Queries that must read their whole tables."""

import numpy as np
import pytest

from parseq.plans import catalog, recipes
from parseq.sources.tables import load

DATA = "/root/testdata/sf0.001"


def test_gram_of_all_vectors(spark):
    x = np.array([r.embedding for r in load(spark, DATA, "embeddings").collect()], dtype=np.float32)
    assert len(x) > 64
    x = np.round(x * np.float32(1000)).astype(np.int64)
    got = {(r.i, r.j): r.x for r in catalog.QUERIES["matmul_gram"](spark, DATA).collect()}
    assert got == {(i, j): int(v) for (i, j), v in np.ndenumerate(x.T @ x)}


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """A folder whose embeddings are floats that lie halfway between thousandths, or nearly so as doubles; its path, and their
    thousandths by the arithmetic of floats."""
    folder = str(tmp_path_factory.mktemp("halves"))
    x = np.float32([(k + 0.5) / 1000 for k in range(1280)]).reshape(-1, 64)
    whole = np.floor(x * np.float32(1000) + np.float32(0.5)).astype(np.int64)
    assert whole.sum() != np.floor(x.astype(float) * 1000 + 0.5).sum()
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    for t in ("orders", "part", "events"):
        load(spark, DATA, t).write.parquet(f"{folder}/{t}.parquet")
    return folder, whole


def test_for_each_of_halves(spark, halves):
    got = {r.form: (r.n, r.total) for r in catalog.QUERIES["for_each_forms"](spark, halves[0]).collect()}
    assert got["flatten"] == (halves[1].size, halves[1].sum())


def test_flatten_with_grain_of_halves(spark, halves):
    assert catalog.QUERIES["grain_and_context_forms"](spark, halves[0]).first()["items"] == halves[1].sum()


def test_gram_of_halves(spark, halves):
    got = {(r.i, r.j): r.x for r in catalog.QUERIES["matmul_gram"](spark, halves[0]).collect()}
    assert got == {(i, j): int(v) for (i, j), v in np.ndenumerate(halves[1].T @ halves[1])}


def test_blur_of_whole_images(spark):
    for n, width in ((1, 4), (3, 4), (4, 4), (9, 4), (10, 4), (12, 4), (101, 7), (5, 1)):
        v = [k * 37 % 256 for k in range(n)]
        want = {}
        for k in range(n):
            total = 0
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    x = max(0, min(min(width, n) - 1, k % width + dx))
                    column = v[x::width]
                    total += (2 - abs(dy)) * (2 - abs(dx)) * column[max(0, min(len(column) - 1, k // width + dy))]
            want[k] = total // 16
        got = recipes.blur_image(spark.createDataFrame(list(enumerate(v)), "idx long, v long"), width).collect()
        assert {r.idx: r.v for r in got} == want and len(got) == n
    d = DATA.replace("0.001", "0.01")
    assert catalog.QUERIES["blur_whole"](spark, d).count() == load(spark, d, "events").count() > 1000


def test_whole_texts_and_vectors(spark):
    docs = [r for r in load(spark, DATA, "documents").orderBy("doc_id").collect() if r.text is not None]
    words = [w for r in docs for w in r.text.split(" ")]
    got = {r.i: r.v for r in catalog.QUERIES["flatten_with_offsets_documents"](spark, DATA).collect()}
    assert got == dict(enumerate(words))
    assert catalog.QUERIES["flatten_reduce_documents"](spark, DATA).first()[0] == max(map(len, words))
    postings = catalog.QUERIES["index_postings_documents"](spark, DATA)
    assert postings.count() == catalog.QUERIES["index_stats"](spark, DATA).first().total_tokens
    assert catalog.QUERIES["flatten_collect_embeddings"](spark, DATA).count() == catalog.QUERIES["flatten_len"](spark, DATA).first()[0]
