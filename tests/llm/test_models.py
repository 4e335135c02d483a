import itertools
import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import DATA, frame, hard_documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from parseq.llm import quality_model, quality_rules, toxicity  # noqa: E402
from parseq.llm.common import table  # noqa: E402


def sums(crf, x, y):
    return (x @ crf.weights * y).sum() + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))


def test_crf_same_as_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        x = rng.integers(0, 2, (n, len(quality_rules.FEATURES))).astype(float)
        crf = quality_rules.Crf(rng.standard_normal(x.shape[1]), rng.standard_normal((2, 2)))
        paths = [np.array(p) for p in itertools.product((0, 1), repeat=n)]
        scores = np.array([sums(crf, x, p) for p in paths])
        assert np.isclose(sums(crf, x, crf.viterbi(x)), scores.max())
        p = np.exp(scores - scores.max())
        p /= p.sum()
        after, pairs = crf.marginals(x)
        assert np.allclose(after, sum(w * y for w, y in zip(p, paths)))
        want = np.zeros((2, 2))
        for w, y in zip(p, paths):
            for a, b in zip(y, y[1:]):
                want[a, b] += w
        assert np.allclose(pairs, want)


def slow_base(text):
    """The contract's counts, word by word."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeat = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            repeat |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def test_rules_counts(spark):
    rows = hard_documents() + [(900, "a b c a b c d", None, None, 0, "", 0, ""), (901, "é é x|y <z>\nq\nq\n\n\nq", None, None, 0, "", 0, "")]
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    got = quality_rules.judge(frame(spark, rows), None).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and len(texts[r.doc_id]) < 10_000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_base(texts[r.doc_id])
            assert r.kept == (not r.base_failed)
    kept = quality_rules.keep(frame(spark, rows), None)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)


def test_rules_learn(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    crf = quality_rules.train(docs, labels)
    m = quality_rules.judge(docs, crf).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rates = {r.quality: r.k for r in m}
    assert rates[1] > 0.95 and rates.get(0, 0) < 0.2
    assert quality_rules.train(docs, labels.limit(0)) is None
    assert quality_rules.train(docs.limit(0), labels) is None


def slow_features(text):
    """Line features of operator 8, character by character."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    again = {k + d for k, w in enumerate(windows) if w in many for d in range(3)}
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        n, data = len(own), line.encode()
        up, low = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
        symbols, digits = sum(chr(b) in "#*$%&|<>" for b in data), sum(48 <= b <= 57 for b in data)
        white, high = sum(chr(b) in " \t\n\v\f\r" for b in data), sum(b >= 128 for b in data)
        visible = max(1, len(data) - white)
        punct = len(data) - up - low - symbols - digits - white - high
        letters, some = max(1, up + low), max(1, n)
        repeats = sum(k in again for k in range(at, at + n))
        at += n
        out.append([1, n == 0, 0 < n < 4, 4 <= n < 10, n >= 30, up > 0.6 * letters, up > 0.3 * letters and n > 3, symbols > 0.04 * visible, symbols > 0.15 * visible, digits > 0.2 * visible, punct > 0.12 * visible,
                    len(set(own)) < 0.6 * some and n >= 6, len(set(own)) < 0.3 * some and n >= 6, n > 0 and line in seen, line.rstrip()[-1:] not in {".", "!", "?", ":", ";", '"'}, visible > 11 * some, visible < 3 * some, repeats > 0.3 * some])
        if n:
            seen.add(line)
    return np.array(out, dtype=float), [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in text.split("\n")]


def slow_share(text, crf):
    """Share of words in content lines on the best path, found with a table of best scores."""
    x, n = slow_features(text)
    best = [{0: (0.0, None), 1: (float(x[0] @ crf.weights), None)}]
    for row in x[1:]:
        best.append({b: max((best[-1][a][0] + crf.moves[a, b] + (row @ crf.weights if b else 0), a) for a in (0, 1)) for b in (0, 1)})
    state, path = max((0, 1), key=lambda b: best[-1][b][0]), []
    for step in reversed(best):
        path.append(state)
        state = step[state][1]
    return sum(w for w, y in zip(n, reversed(path)) if y) / max(1, sum(n))


def test_rules_verdict_same_as_plain_twin(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    crf = quality_rules.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(k, r[1]) for k, r in enumerate(hard_documents(), 10_000)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()}
    checked = 0
    for i, t in rows:
        if len(t or "") < 6000:
            share = slow_share(t or "", crf)
            assert abs(got[i].content_share - share) < 1e-9
            assert got[i].kept == (not slow_base(t or "")[-1] and share >= quality_rules.LEAST_SHARE)
            checked += 1
    assert checked > 200 and 20 < sum(r.kept for r in got.values())


def test_rules_label_lines_of_one_text(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    crf = quality_rules.train(docs, labels)
    content = [
        "The small rivers of the northern valley carry snow water down to the plains in spring, and farmers wait for it all winter long.",
        "When my grandmother was young she walked two hours to school each morning, whatever weather came over the hills behind our house.",
        "A good bridge lasts longer than those who built it, if somebody paints its iron every few years and clears leaves from the drains.",
        "They found old letters under that floor, tied with string, which nobody had opened since before both wars ended so long ago now.",
        "Most birds leave in autumn without any hurry, gathering along wires above fields where corn stood high only some weeks earlier still.",
        "She said no doctor would ever tell you such things plainly, because hope does more for sick people than figures could possibly do.",
    ]
    junk = ["HOME | ABOUT | $$$ | CLICK ###", "BUY*** NOW*** %%% &&& <<>> |||", "#### $$$$ %%%% #### $$$$", "HOME | ABOUT | $$$ | CLICK ###", "#### $$$$ %%%% #### $$$$"]
    lines = content[:3] + junk + content[3:]
    state = crf.viterbi(quality_rules.line_features(quality_rules.base("\n".join(lines)))[0])
    assert state.tolist() == [1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1]
    between = quality_rules.judge(docs, crf).filter("content_share > 0 and content_share < 1").count()
    assert between > 20


def test_rules_with_repeated_labels(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    a, b = (quality_rules.train(docs, x) for x in (labels, labels.unionByName(labels)))
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()


def test_rules_of_very_long_text(spark):
    text = "\n".join(f"line {k} says something of its own about number {k * 7919}." for k in range(60_000))
    got = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), quality_rules.Crf()).first()
    assert (got.n_words, got.n_dup_lines, got.base_failed) == (600_000, 0, True)
    assert toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxicity.Model(np.zeros((2, toxicity.BINS)), np.zeros((2, toxicity.BINS)))).first().passages == []


def brute_segments(s):
    """Maximal scoring segments by their definition: best segment, then the same left and right of it."""

    def split(a, b):
        best, total = None, np.concatenate([[0.0], np.cumsum(s)])
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                v = total[j] - total[i]
                if v > 1e-12 and (best is None or v > best[0] + 1e-12):
                    best = (v, i, j)
        return [] if best is None else split(a, best[1]) + [(best[1], best[2])] + split(best[2], b)

    return split(0, len(s))


def test_segments_same_as_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.standard_normal(rng.integers(0, 25)) - 0.2
        got = toxicity.segments(s)
        assert [x[:2] for x in got] == brute_segments(s)
        assert all(np.isclose(v, s[a:b].sum()) for a, b, v in got)


def test_segments_of_long_drifting_texts():
    for s in (np.tile([1.0, -2.0], 500_000), np.concatenate([np.tile([1.0, -2.0], 200_000), np.tile([2.0, -1.0], 200_000)]), np.arange(300_000) % 7 - 2.9):
        t = time.perf_counter()
        got = toxicity.segments(s)
        assert time.perf_counter() - t < 10
        assert all(v > 0 for *_, v in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert len(toxicity.segments(np.tile([1.0, -2.0], 500_000))) == 500_000


def test_size_of_extreme_values():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 5000, 20_000)
    best = (np.log(0.05 * n) + rng.gumbel(size=len(n))) / 1.3
    good = best > 0
    assert abs(toxicity.size_of(best[good], n[good], 1.3) / 0.05 - 1) < 0.1


def plain_scores(docs, labels, bins=None):
    """The scores of operator 6 worked out word by word with dictionaries: segments by their definition."""
    import math
    import re
    import zlib
    from collections import Counter

    out_of = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    tokens = {i: [(toxicity.CODE[w] >> toxicity.BITS, toxicity.CODE[w] & (toxicity.BINS - 1)) for w in re.findall(r"\w+", (t or "").lower())] for i, t in docs}
    learnt = {i: y for i, y in labels if not out_of(i)}
    odds, far = [], []
    for side in (0, 1):
        every, by = Counter(), (Counter(), Counter())
        for i, w in tokens.items():
            every.update(x[side] for x in w)
            if i in learnt:
                by[learnt[i]].update(x[side] for x in w)
        a = {b: toxicity.PRIOR * every[b] / max(1, sum(every.values())) + 0.01 for b in every}
        a0 = sum(a.values()) + 0.01 * (toxicity.BINS - len(a))
        n = [sum(c.values()) for c in by]
        share = n[1] / sum(n)
        o, z = {}, {}
        for b in every:
            lo = [math.log((c[b] + a[b]) / (m + a0 - c[b] - a[b])) for c, m in zip(by, n)]
            e = (by[0][b] + by[1][b]) * share
            z[b] = abs(by[1][b] - e) / math.sqrt(e * (1 - share) + 1)
            o[b] = max(-toxicity.CLIP, min(toxicity.CLIP, (lo[1] - lo[0]) * min(1, z[b] / 3)))
        odds.append(o)
        far.append(z)
    score = {i: [(odds[0][a] if far[0][a] >= far[1][b] else odds[1][b]) - toxicity.COST for a, b in w] for i, w in tokens.items()}
    bounds = np.linspace(-toxicity.CLIP - toxicity.COST, toxicity.CLIP, 48)
    hist = Counter(int(k) for i, y in learnt.items() if y == 0 and i in score for k in np.clip(np.searchsorted(bounds, score[i], "right") - 1, 0, 46))
    mass = sum(hist.values())
    f = lambda r: sum(c / mass * math.exp(r * (bounds[k] + bounds[k + 1]) / 2) for k, c in hist.items()) - 1
    low, high = 1e-6, 64.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if f((low + high) / 2) >= 0 else ((low + high) / 2, high)
    rate = min(4.0, max(0.2, high))
    parts = {i: [sum(s[a:b]) for a, b in brute_segments(np.array(s))] for i, s in score.items()}
    free = [rate * max(parts[i]) - math.log(len(score[i])) for i, y in learnt.items() if y == 0 and i in parts and parts[i]]
    k = math.exp(np.mean(free) - 0.5772156649015329)
    x = {}
    for i, p in parts.items():
        normal = [rate * v - math.log(len(score[i]) * k) for v in p]
        x[i] = (1.0, min(40, max(0, max(normal))) / 10, math.log1p(sum(v > 3 for v in normal))) if normal else (1.0, 0.0, 0.0)
    w = np.zeros(3)
    rows = [(np.array(x[i]), y) for i, y in learnt.items() if i in x]
    for _ in range(40):
        p = [1 / (1 + math.exp(-v @ w)) for v, _ in rows]
        h = sum(q * (1 - q) * np.outer(v, v) for q, (v, _) in zip(p, rows)) + 0.01 * np.eye(3)
        w = w + np.linalg.solve(h, sum((y - q) * v for q, (v, y) in zip(p, rows)) - 0.01 * w)
    return {i: 1 / (1 + math.exp(-(np.array(v) @ w))) for i, v in x.items()}


def test_toxicity_scores_same_as_plain_twin(spark):
    rng = np.random.default_rng(7)
    bad, good = ["vile", "scum", "rotten"], [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(160):
        w = [good[j] for j in rng.integers(0, 60, rng.integers(5, 40))]
        if i % 4 == 0:
            at = rng.integers(0, len(w))
            w[at:at] = [bad[j] for j in rng.integers(0, 3, rng.integers(1, 6))]
        elif i % 5 == 0:
            w[3:3] = [bad[i % 3]]  # so that clean texts have segments too
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(500, None), (501, ""), (502, "vile scum vile")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, y)).collect()}
    want = plain_scores(docs, labels)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 for i in want)
    assert max(want.values()) > 0.9 and min(want.values()) < 0.2


def test_models_with_repeated_labels(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    twice = labels.unionByName(labels)
    assert sorted(r.doc_id for r in toxicity.sampled(twice, 10).collect()) == sorted(r.doc_id for r in toxicity.sampled(labels, 10).collect())
    a, b = (sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(docs, toxicity.train(docs, x)).collect()) for x in (labels, twice))
    assert a == b


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    done = toxicity.score(docs, toxicity.train(docs, labels))
    rows = done.withColumn("h", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("h").collect()
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(0 <= p.start < p.end <= len(texts[r.doc_id]) for r in rows for p in r.passages)


def test_labels_are_no_input(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(docs, toxicity.train(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_models_bear_odd_rows(spark):
    rows = hard_documents()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], k % 2, (k + 1) % 2) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.train(df, labels)).count() == len(rows)
    assert {r.score for r in toxicity.score(df, toxicity.train(df, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(df.limit(0), None).count() == 0
    graded = labels.select("doc_id", F.col("quality").alias("grade"))
    assert quality_model.score(df, quality_model.train(df, graded)).count() == len(rows)
    assert quality_model.train(df, graded.limit(0)) is None
    assert {r.kept for r in quality_model.score(df, None).collect()} == {True}
    assert quality_rules.judge(df, quality_rules.train(df, labels)).count() == len(rows)
    assert quality_rules.judge(df.limit(0), None).count() == 0


def test_ordinal_recovers_order():
    rng = np.random.default_rng(4)
    rows = []
    for g in (0, 1, 2) * 60:
        bins = np.unique(np.concatenate([[g + 10], rng.integers(100, 200, 5)])).astype(np.int32)
        rows.append((bins, np.full(len(bins), 1 / np.sqrt(len(bins))), g))
    m = quality_model.fit(rows)
    assert (np.diff(m.cuts) > 0).all()
    p = [m.reached(float(m.weights[b] @ x)) for b, x, _ in rows]
    assert all(q[0] >= q[1] for q in p)
    assert np.mean([round(q.sum()) == g for q, (*_, g) in zip(p, rows)]) > 0.95


def plain_features(text):
    """The hashed features of operator 4, word by word."""
    import re
    from collections import Counter

    n, last = Counter([quality_model.ALWAYS]), None
    for word in text.split():
        shape = re.sub(r"(\W)\1+", r"\1\1", re.sub(r"[0-9]+", "0", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[a-zà-ÿ]+", "a", word))))
        bins = tuple(quality_model._bin(k, v) for k, v in (("shape", shape[:12]), ("tail", re.search(r"\W*$", word)[0][:4]), ("start", word.lower()[:4])))
        n.update(bins)
        n[quality_model.AGAIN] += bins == last
        last = bins
    x = {b: np.log1p(c) for b, c in n.items() if c}
    size = sum(v * v for v in x.values()) ** 0.5
    return {b: v / size for b, v in x.items()}


def test_quality_scores_same_as_plain_twin(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    graded = labels.select("doc_id", F.expr("case when quality > 0 then 1 + cast(toxic = 0 as int) else 0 end").alias("grade"))
    model = quality_model.train(docs, graded)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(k, r[1]) for k, r in enumerate(hard_documents(), 10_000)]
    got = {r.doc_id: r for r in quality_model.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        s = sum(float(model.weights[b]) * v for b, v in plain_features(t or "").items())
        reached = [1 / (1 + np.exp(c - s)) for c in model.cuts]
        assert abs(got[i].expected_grade - sum(reached)) < 1e-5 and abs(got[i].tail_probability - reached[0]) < 1e-5
        assert got[i].kept == (got[i].tail_probability >= 0.5)


def test_ordinal_fit_same_as_plain_likelihood():
    """The fit against a plain search that improves one parameter at a time on the likelihood as it is written."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(240):
        a = rng.random()
        y = int(np.digitize(4 * a - 2 + rng.logistic(), [-1.0, 1.0]))
        rows.append((np.array([1, 2], np.int32), np.array([a, 1 - a]), y))

    def like(p):
        w, cuts = p[:2], (p[2], p[2] + np.exp(p[3]))
        below = lambda k, s: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + np.exp(s - cuts[k]))
        return np.mean([np.log(below(y, w @ x) - below(y - 1, w @ x)) for _, x, y in rows]) - 0.5e-5 * (w @ w)

    p, step = np.zeros(4), 0.5
    best = like(p)
    while step > 1e-4:
        moved = False
        for k in range(4):
            for d in (step, -step):
                q = p.copy()
                q[k] += d
                if (v := like(q)) > best:
                    p, best, moved = q, v, True
        step = step if moved else step / 2
    m = quality_model.fit(rows, steps=2000)
    q = np.array([m.weights[1], m.weights[2], m.cuts[0], np.log(m.cuts[1] - m.cuts[0])])
    assert abs(like(q) - best) < 1e-3
    for _, x, _ in rows[:50]:
        a = m.reached(float(q[:2] @ x))
        b = [1 / (1 + np.exp(c - p[:2] @ x)) for c in (p[2], p[2] + np.exp(p[3]))]
        assert np.allclose(a, b, atol=0.03)


def test_quality_with_repeated_labels(spark):
    docs, graded = table(spark, DATA, "documents"), table(spark, DATA, "labels").select("doc_id", F.col("quality").alias("grade"))
    a, b = (quality_model.train(docs, g) for g in (graded, graded.unionByName(graded)))
    assert (a.weights == b.weights).all() and (a.cuts == b.cuts).all()


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    graded = labels.select("doc_id", F.expr("case when quality > 0 then 1 + cast(toxic = 0 as int) else 0 end").alias("grade"))
    rows = quality_model.score(docs, quality_model.train(docs, graded)).join(graded, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.kept == (r.grade > 0) for r in rows]) > 0.9


def test_training_is_bounded_by_ids_and_lines(spark):
    """Many rows of one id count as one, and of a text of very many lines LINES are used; verdicts are of whole texts."""
    good = [(k, "A plain sentence that ends well and says something.\n" * 3, 1) for k in range(6)]
    bad = [(10 + k, "click here | home | * | share\n" * 3, 0) for k in range(6)]
    long = "\n".join(f"A line number {k} of a long text." for k in range(1_000_000))
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(3, good[3][1])] * 5000 + [(30, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 1 - q) for i, _, q in good + bad] + [(30, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality_rules.Crf.fit
    quality_rules.Crf.fit = lambda self, sequences, **a: seen.extend(len(x) for x, _ in sequences) or fit(self, sequences, **a)
    try:
        model = quality_rules.train(docs, labels)
    finally:
        quality_rules.Crf.fit = fit
    assert len(seen) == 13 and max(seen) == quality_rules.LINES
    judged = {r.doc_id: r for r in quality_rules.judge(docs.filter("doc_id = 30"), model).collect()}
    assert judged[30].n_words == 8_000_000
