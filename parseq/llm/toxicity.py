"""Operator 6: toxicity by maximum-scoring segments.

Each token (a lower-cased word) has a log-odds of being written in toxic against clean text, with an informative Dirichlet
prior: the counts of the whole corpus, scaled to ``PRIOR`` tokens. Words are hashed to a fixed number of bins, and so are
their first four letters; the one of the two whose counts are further from chance speaks for the token, and log-odds
of counts near chance are shrunk. A linear scan (Ruzzo and Tompa) finds every maximal segment of positive score. A segment's
score S becomes an E-value K n exp(-lambda S): lambda comes from the scores of clean tokens (Karlin and Altschul), K from
the mean of the best scores of clean texts, which follow an extreme-value distribution. The best normalised score and the
number of significant segments of a text give its probability by a logistic fit.

Parameters: ``sample`` bounds the labelled ids used for fitting (chosen by hash); the counts of the prior cover every
document. What reaches the driver is three fixed-size tables of 2 x ``BINS`` counts, a histogram for each task, and three
numbers for each labelled text; one table of weights is sent back.

Defined results: null and empty texts have no segments and get the score of a text without any; without labels of both
kinds to learn from all scores are 0; an id with several labels is toxic if one of them says so; repeated rows score
alike; whole texts are read, however long; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, Scratch, batch, documents, one_text, only, table, texts

BITS = 18
BINS, BLOCKS, PRIOR, SAMPLE, COST, CLIP, THRESHOLD = 1 << BITS, 64, 2000.0, 12000, 0.7, 6.0, 0.7
#: Nats above chance from which a segment counts as significant (an E-value of 0.05).
SIGNIFICANT = 3.0
TOKEN = re.compile(r"\w+")


def _bins(word: str) -> int:
    """Bin of the word and of its first four letters, as one integer."""
    return (xxhash.xxh64_intdigest(word) >> (64 - BITS)) << BITS | xxhash.xxh64_intdigest(word[:4], seed=1) >> (64 - BITS)


CODE = Cache(_bins)


def codes(text: str) -> np.ndarray:
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(CODE.__getitem__, words), dtype=np.int64, count=len(words))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    own = only(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def counted(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Counts of bins: [all documents, clean sample, toxic sample] x [words, first letters] x bins."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    width = 6 * BINS // BLOCKS

    def emit(sums):
        press = zstandard.ZstdCompressor(level=1)
        parts = sums.reshape(BLOCKS, width)
        return batch(schema, list(range(BLOCKS)), [press.compress(p.tobytes()) for p in parts])

    def run(batches):
        sums, any_rows = np.zeros((3, 2, BINS), np.int64), False
        for b in batches:
            held: list[list[np.ndarray]] = [[], [], []]
            size = 0
            for k, (toxic, text) in enumerate(zip(b.column(0).to_pylist(), texts(b.column(1)))):
                c = codes(text)
                held[0].append(c)
                if toxic is not None:
                    held[1 + toxic].append(c)
                size += len(c)
                if size > 1_000_000 or k == b.num_rows - 1:
                    for at, group in enumerate(held):
                        if group:
                            every = np.concatenate(group)
                            sums[at, 0] += np.bincount(every >> BITS, minlength=BINS)
                            sums[at, 1] += np.bincount(every & (BINS - 1), minlength=BINS)
                    held, size, any_rows = [[], [], []], 0, True
        if any_rows:
            yield emit(sums)

    def add(batches):
        opener, sums = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(opener.decompress(raw), np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield batch(schema, list(sums), [x.tobytes() for x in sums.values()])

    kinds = "block int, counts binary"
    joined = docs.join(F.broadcast(chosen), "doc_id", "left").select("toxic", "text")
    rows = joined.mapInArrow(run, kinds).repartition("block").mapInArrow(add, kinds).collect()
    out = np.zeros((BLOCKS, width), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(3, 2, BINS)


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each bin, and how many standard deviations its toxic count is off the expected one, for words and first letters."""
    every, clean, toxic = counts.astype(np.float64)
    prior = PRIOR * every / np.maximum(1, every.sum(1, keepdims=True)) + 0.01
    total = prior.sum(1, keepdims=True)
    odds = lambda y: np.log((y + prior) / (y.sum(1, keepdims=True) + total - y - prior))
    share = toxic.sum(1, keepdims=True) / np.maximum(1, (toxic + clean).sum(1, keepdims=True))
    expected = (toxic + clean) * share
    return odds(toxic) - odds(clean), (toxic - expected) / np.sqrt(expected * (1 - share) + 1)


class Model:
    def __init__(self, delta: np.ndarray, z: np.ndarray):
        shrunk = np.clip(delta * np.minimum(1, np.abs(z) / 3), -CLIP, CLIP).astype(np.float32)
        self.table = np.stack([shrunk, np.abs(z).astype(np.float32)])
        self.rate, self.size, self.curve = 1.0, 0.1, np.zeros(3)

    def scores(self, c: np.ndarray) -> np.ndarray:
        w, p = c >> BITS, c & (BINS - 1)
        word, letters = self.table[:, 0][:, w], self.table[:, 1][:, p]
        return np.where(word[1] >= letters[1], word[0], letters[0]).astype(np.float64) - COST

    def normal(self, s, n: int):
        """Score in nats above what the best of n clean tokens would reach by chance."""
        return self.rate * s - np.log(max(1, n) * self.size)

    def normals(self, c: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """The segments of a text and their normalised scores."""
        found = segments(self.scores(c))
        return found, self.normal(np.array([s for *_, s in found]), len(c))

    @staticmethod
    def features(normals: np.ndarray) -> tuple[float, float]:
        if not len(normals):
            return 0.0, 0.0
        return float(np.clip(normals.max(), 0, 40) / 10), float(np.log1p((normals > SIGNIFICANT).sum()))

    def probability(self, normals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1:] @ self.features(normals)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in linear time: each candidate remembers the nearest one
    before it with a smaller sum on its left, so a search jumps over candidates that no later search can want."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts, ends, lefts, rights, links = [], [], [], [], []
    for i, left, right in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        start, j = i, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= right:
                break
            # The candidate grows back to j's start; what lies between is part of it.
            start, left, after = starts[j], lefts[j], links[j]
            for x in (starts, ends, lefts, rights, links):
                del x[j:]
            j = after
        starts.append(start)
        ends.append(i + 1)
        lefts.append(left)
        rights.append(right)
        links.append(j)
    return [(s, e, b - a) for s, e, a, b in zip(starts, ends, lefts, rights)]


def solve_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1; 1 if clean tokens never score above 0."""
    p = weights / max(1e-9, weights.sum())
    if not ((values > 0) & (p > 0)).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * values)).sum() < 1 else (low, middle)
    return float(np.clip(high, 0.2, 4.0))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, shrink: float = 1e-2) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - shrink * w)
    return w


def size_of(best: np.ndarray, n: np.ndarray, rate: float) -> float:
    """K from the best scores of clean texts of n tokens: rate * best - ln n has the mean ln K + Euler's constant."""
    there = best > 0
    return float(np.exp(np.clip((rate * best[there] - np.log(n[there])).mean() - np.euler_gamma, -10, 3))) if there.any() else 0.1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    slim = only(docs, doc_id="long", text="string")
    chosen = sampled(labels, sample)
    counts = counted(slim, chosen)
    if not counts[1].sum() or not counts[2].sum():
        return None
    model = Model(*log_odds(counts))
    scratch = Scratch(docs.sparkSession)
    labelled = scratch.cut(one_text(slim.join(F.broadcast(chosen), "doc_id"), "toxic").select("toxic", "text"))
    bounds = np.linspace(-CLIP - COST, CLIP, 48)
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("hist", pa.list_(pa.int64()))])

    def first(batches):
        hist = np.zeros(len(bounds) - 1, np.int64)
        for b in batches:
            rows = []
            for toxic, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                s = model.scores(codes(text))
                if toxic == 0:
                    hist += np.histogram(s, bounds)[0]
                    rows.append((0, len(s), max((x for *_, x in segments(s)), default=0.0), None))
            yield batch(schema, *(zip(*rows) if rows else [()] * 4))
        yield batch(schema, [None], [None], [None], [hist.tolist()])

    found = labelled.mapInArrow(first, "toxic int, n long, best double, hist array<long>").collect()
    model.rate = solve_rate((bounds[:-1] + bounds[1:]) / 2, np.sum([r.hist for r in found if r.hist], axis=0).astype(float))
    clean = [(r.best, r.n) for r in found if not r.hist]
    model.size = size_of(*np.array(sorted(clean), dtype=float).reshape(-1, 2).T, model.rate)

    def second(batches):
        for b in batches:
            x = [model.features(model.normals(codes(t))[1]) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in x], pa.float64()), pa.array([q for _, q in x], pa.float64())], names=["toxic", "a", "b"])

    rows = sorted(tuple(r) for r in labelled.mapInArrow(second, "toxic int, a double, b double").collect())
    scratch.drop(labelled)
    y, *x = np.array(rows).T
    model.curve = logistic(np.stack(x, 1), y)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, passages: significant segments as [start, end) in characters, with their E-values."""
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", passage)])
    kinds = "doc_id long, score double, passages array<struct<start:long,end:long,e_value:double>>"

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                if model is None:
                    rows.append((doc, 0.0, []))
                    continue
                found, normals = model.normals(codes(text))
                out = [(s, e, float(np.exp(-v))) for (s, e, _), v in zip(found, normals.tolist()) if v > SIGNIFICANT]
                if out:
                    spans = [m.span() for m in TOKEN.finditer(text.lower())]
                    out = [{"start": spans[s][0], "end": spans[e - 1][1], "e_value": v} for s, e, v in out]
                rows.append((doc, model.probability(normals), out))
            yield batch(schema, *(zip(*rows) if rows else [()] * 3))

    return only(docs, doc_id="long", text="string").mapInArrow(run, kinds)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
