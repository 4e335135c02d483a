"""Operator 4: quality classifier by ordinal cumulative-link regression.

Grades 0, 1, ... are ordered; one weight vector over hashed text features is shared by all of them and ordered thresholds
cut its score: P(grade <= k) = 1 / (1 + exp(w x - t_k)). From that come the expected grade and the probability of reaching a
given grade, on which documents are selected.

Features are hashed to ``BINS`` bins: the shape of each word (letters, digits and marks without their number), its marks at
the end, its first four letters, whether it repeats the word before; counts are log-scaled and the vector has length 1.

Parameters: ``sample`` bounds the labelled ids used for fitting (chosen by hash; of several grades of an id the least counts,
of several texts one), and so what comes to the driver: at most BINS numbers for each; everything else reads all rows.
The ratings of the test tables are two marks, quality and toxic; they grade as 0 poor, 1 good but toxic, 2 good.

Defined results: null and empty texts have only the feature that all have; without labels of two grades the expected grade is null, the
probability null and the document is kept; repeated rows score alike; whole texts are read; no shuffle of documents but the sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, batch, documents, one_text, only, table, texts
from .toxicity import held_out

BITS, SAMPLE, KEEP_GRADE, LEAST = 15, 5000, 1, 0.5
BINS = 1 << BITS
RUNS = [(re.compile(p), r) for p, r in ((r"[a-zà-ÿ]+", "a"), (r"[A-ZÀ-Þ]+", "A"), (r"\d+", "0"), (r"(\W)\1+", r"\1\1"))]
TAIL = re.compile(r"\W*\Z")


def _bin(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}/{value}") >> (64 - BITS)


def _word(word: str) -> int:
    """The three bins of a word in one integer."""
    shape = word
    for pattern, to in RUNS:
        shape = pattern.sub(to, shape)
    return _bin("shape", shape[:12]) << 2 * BITS | _bin("tail", TAIL.search(word)[0][:4]) << BITS | _bin("start", word.lower()[:4])


WORD = Cache(_word)
ALWAYS, AGAIN = _bin("always", ""), _bin("again", "")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    c = np.fromiter(map(WORD.__getitem__, words), dtype=np.int64, count=len(words))
    every = np.concatenate([c >> 2 * BITS, c >> BITS & (BINS - 1), c & (BINS - 1), [ALWAYS], np.full(int((c[1:] == c[:-1]).sum()), AGAIN)])
    bins, n = np.unique(every, return_counts=True)
    x = np.log1p(n)
    return bins.astype(np.int32), x / np.sqrt((x * x).sum())


class Ordinal:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def reached(self, score) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts - np.asarray(score)[..., None], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 250, rate: float = 0.1, shrink: float = 1e-5) -> Ordinal | None:
    """Maximum likelihood by Adam; thresholds stay ordered as sums of exponentials. None if only one grade is there."""
    y = np.array([g for *_, g in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    top = int(y.max())
    bins, x = np.concatenate([b for b, *_ in rows]), np.concatenate([v for _, v, _ in rows])
    at = np.cumsum([0] + [len(b) for b, *_ in rows[:-1]])
    of = np.repeat(np.arange(len(rows)), [len(b) for b, *_ in rows])
    p = np.zeros(BINS + top)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, cuts = p[:BINS], np.cumsum(np.concatenate([p[BINS : BINS + 1], np.exp(p[BINS + 1 :])]))
        s = np.add.reduceat(w[bins] * x, at)
        # P(grade <= k) at the cuts around each grade; the outer ones are 0 and 1.
        below = np.concatenate([np.zeros((len(y), 1)), 1 / (1 + np.exp(np.clip(s[:, None] - cuts, -40, 40))), np.ones((len(y), 1))], 1)
        rows_ = np.arange(len(y))
        high, low = below[rows_, y + 1], below[rows_, y]
        like = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / like, low * (1 - low) / like
        gs = -(dh - dl) / len(y)
        gc = np.zeros(top)
        np.add.at(gc, np.minimum(y, top - 1), np.where(y < top, dh, 0) / len(y))
        np.add.at(gc, np.maximum(y - 1, 0), np.where(y > 0, -dl, 0) / len(y))
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([np.bincount(bins, weights=x * gs[of], minlength=BINS), tail[:1], tail[1:] * np.exp(p[BINS + 1 :])]) - shrink * np.concatenate([w, np.zeros(top)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ordinal(p[:BINS].astype(np.float32), np.cumsum(np.concatenate([p[BINS : BINS + 1], np.exp(p[BINS + 1 :])])))


def train(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """``graded`` (doc_id, grade): at most ``sample`` of its rows are used, never those that are held out."""
    own = only(graded, doc_id="long", grade="int").filter("doc_id is not null and grade >= 0").filter(~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = one_text(only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"), "grade")
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("bins", pa.binary()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            found = [features(t) for t in texts(b.column(2))]
            yield batch(schema, b.column(0), b.column(1), [i.tobytes() for i, _ in found], [x.astype(np.float32).tobytes() for _, x in found])

    rows = joined.mapInArrow(run, "doc_id long, grade int, bins binary, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.grade, r.bins))
    return fit([(np.frombuffer(r.bins, np.int32), np.frombuffer(r.x, np.float32).astype(np.float64), r.grade) for r in rows])


def score(docs: DataFrame, model: Ordinal | None, keep_grade: int = KEEP_GRADE, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``keep_grade`` or more), kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for b in batches:
            s = []
            for t in texts(b.column(1)) if model is not None else ():
                bins, x = features(t)
                s.append(float(model.weights[bins] @ x))
            if model is None:
                yield batch(schema, b.column(0), [None] * b.num_rows, [None] * b.num_rows, [True] * b.num_rows)
            else:
                p = model.reached(np.array(s).reshape(-1))
                yield batch(schema, b.column(0), p.sum(1), p[:, min(keep_grade, p.shape[1]) - 1], p[:, min(keep_grade, p.shape[1]) - 1] >= least)

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", F.expr("case when quality > 0 then 1 + cast(toxic = 0 as int) else 0 end").alias("grade"))
    return score(docs, train(docs, graded))
