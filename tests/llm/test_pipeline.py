"""The pipeline against its stages worked out plainly in Python on the smallest tables."""

import hashlib
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer  # noqa: E402

from parseq.llm import mixing, quality_rules, substrings  # noqa: E402
from parseq.llm.bpe import vocabulary_path  # noqa: E402
from parseq.llm.common import table  # noqa: E402

DATA = "/root/testdata/sf0.001"


def near(docs):
    sets = {}
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [r for r in docs if find(r["doc_id"]) == r["doc_id"]]


def repeated(docs):
    seen, out = set(), []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        pieces = [(r["text"][s:e], tuple(r["text"][s:e].lower().split())) for s, e in substrings.units(r["text"])]
        again = []
        for _, words in pieces:
            again.append(bool(words) and words in seen)
            seen.add(words)
        gone = set()
        for k in range(len(pieces)):  # every stretch of repeats and blanks, from repeat to repeat, that can't be made longer
            if again[k] and not any(again[j] and all(again[i] or not pieces[i][1] for i in range(j, k)) for j in range(k)):
                last = max(j for j in range(k, len(pieces)) if again[j] and all(again[i] or not pieces[i][1] for i in range(k, j)))
                if sum(len(w) for _, w in pieces[k : last + 1]) >= substrings.PASSAGE:
                    gone |= set(range(k, last + 1))
        kept = "".join(t for k, (t, _) in enumerate(pieces) if k not in gone)
        out.append(r | {"text": kept, "n_chars": len(kept)})
    return out


def mixed(docs, spark):
    """The budgets are the operator's own (they have SQL twins); the choice is made by hand."""
    leaves = {}
    for r in docs:
        domain = "web" if r["source"] == "src0" else "books" if len(r["source"]) == 4 else "forum"
        n = len(r["text"].encode().split())
        if n:
            leaves.setdefault((domain, r["lang"], r["source"]), []).append((r, n))
    sums = spark.createDataFrame([(*k, sum(n for _, n in v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    out = []
    for b in mixing.budgets(sums, corpus_pipeline.SHARE, 1, mixing.DOMAINS, mixing.LANGS, {}).collect():
        full, rest = divmod(b.budget, b.tokens)
        upto = 0
        for r, n in sorted(leaves[b.domain, b.lang, b.source], key=lambda x: (hashlib.md5(f"{mixing.SEED}/{full}/{x[0]['doc_id']}".encode()).hexdigest(), x[0]["doc_id"])):
            upto += n
            if full or upto <= rest:
                out.append(r)
    return out


def test_pipeline_same_as_brute_force(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    crf = quality_rules.train(docs, labels)
    rows = []
    for r in docs.collect():
        found = quality_rules.base(r.text or "")
        if not found["base_failed"]:
            x, n = quality_rules.line_features(found)
            if (n * crf.viterbi(x)).sum() >= quality_rules.LEAST_SHARE * found["n_words"]:
                rows.append(r.asDict())
    lib = Tokenizer.from_file(vocabulary_path())
    want = []
    for r in mixed(repeated(near(rows)), spark):
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
