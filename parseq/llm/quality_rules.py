"""Operator 8: quality rules with line labels from a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated three-word windows. For what passes them, each line gets
features; a two-state linear-chain CRF, decoded with Viterbi, marks it as content or boilerplate, and a text stays when
enough of its words are in content lines. The CRF is trained here by maximum conditional likelihood (exact forward and
backward sums) on the lines of a bounded sample of documents with a quality label. Lines get labels of their own: features
give each line log-odds of standing in a good or a poor document, its document's label adds or takes ``TRUST``, and the
sign is the line's label (blank lines: that of the line before). So a poor text's decent lines count as content and a good
text's junk as boilerplate, and the CRF sees both states, and moves between them, within a text.

Parameters: ``sample`` bounds the labelled documents for training (chosen by hash, not by order); ``least_share`` is the
share of words that must be in content lines. Without labels the CRF has no say and the base rules decide alone; an id
with several labels counts as poor if one of them says so.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged alike; null ids stay
null; whole texts are read; other columns are left out. No shuffle: rows are judged where they are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, batch, documents, one_text, only, table, texts

SYMBOLS = "#*$%&|<>"
SAMPLE, LINES, LEAST_SHARE, TRUST = 1500, 2048, 0.5, 1.0
KINDS = 7  # upper, lower, symbol, digit, white, other ASCII punctuation, the rest


def _kind(b: int) -> int:
    c = chr(b)
    return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c in SYMBOLS else 3 if "0" <= c <= "9" else 4 if c in WHITESPACE else 6 if b >= 0x80 else 5


KIND = np.array([_kind(b) for b in range(256)], dtype=np.int64)
FEATURES = ["always", "blank", "1-3 words", "4-9 words", "30 or more words", "mostly upper case", "some upper case", "symbols", "many symbols", "digits", "much punctuation", "few distinct words", "very few distinct words", "earlier line", "no sentence end", "long words", "short words", "repeats inside"]


def base(text: str) -> dict:
    """Counts of a text, as the contract defines them, and what the line features need."""
    data = text.encode()
    words = data.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    repeat = np.zeros(n, bool)
    if n >= 3 and len(number) < n:
        if len(number) < 1 << 21:
            window = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            window = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(window, kind="stable")
        same = np.diff(window[order]) == 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeat[k : n - 2 + k] |= twice
    lines = text.split("\n")
    seen: set[str] = set()
    earlier = []
    for line in lines:
        worded = bool(line.strip(WHITESPACE))
        earlier.append(worded and line in seen)
        if worded:
            seen.add(line)
    n_repeat = int(repeat.sum())
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in WHITESPACE),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": sum(earlier),
        "n_repeat_words": n_repeat,
        "base_failed": n < 50 or 100 * n_repeat > 50 * n,
        "data": data, "lines": lines, "earlier": earlier, "ids": ids, "repeat": repeat,
    }


def line_features(b: dict) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each line, and the words of each line."""
    raw = np.frombuffer(b["data"], dtype=np.uint8)
    kinds = KIND[raw]
    of = np.zeros(len(raw), dtype=np.int64)
    of[1:] = np.cumsum(raw[:-1] == 10)
    count = len(b["lines"])
    tally = np.bincount(of * KINDS + kinds, minlength=count * KINDS).reshape(count, KINDS).astype(float)
    start = (kinds != 4) & np.concatenate(([True], kinds[:-1] == 4)) if len(raw) else np.zeros(0, bool)
    line_of = of[start]
    n = np.bincount(line_of, minlength=count)
    pairs = np.unique((line_of << 32) | b["ids"]) if len(line_of) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs >> 32, minlength=count) if len(pairs) else np.zeros(count)
    again = np.bincount(line_of, weights=b["repeat"], minlength=count) if len(line_of) else np.zeros(count)
    upper, lower, symbol, digit, _, punct, rest = tally.T
    visible = np.maximum(1, tally.sum(1) - tally[:, 4])
    letters, words = np.maximum(1, upper + lower), np.maximum(1, n)
    ends = np.array([x.rstrip()[-1:] in {".", "!", "?", ":", ";", '"'} for x in b["lines"]])
    flags = [np.ones(count), n == 0, (n > 0) & (n < 4), (n >= 4) & (n < 10), n >= 30, upper > 0.6 * letters, (upper > 0.3 * letters) & (n > 3), symbol > 0.04 * visible, symbol > 0.15 * visible,
             digit > 0.2 * visible, punct > 0.12 * visible, (distinct < 0.6 * words) & (n >= 6), (distinct < 0.3 * words) & (n >= 6), np.array(b["earlier"]), ~ends, visible > 11 * words, visible < 3 * words, again > 0.3 * words]
    return np.stack([np.asarray(f, dtype=float) for f in flags], 1), n


class Crf:
    """Two states, 1 content and 0 boilerplate: state 1 scores ``weights`` times features, and pairs of states score ``moves``."""

    def __init__(self, weights=None, moves=None):
        self.weights = np.zeros(len(FEATURES)) if weights is None else np.asarray(weights)
        self.moves = np.zeros((2, 2)) if moves is None else np.asarray(moves)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        score = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, score[0] if score else 0.0, []
        for s in score[1:]:
            from0, from1 = (a + m00 < b + m10), (a + m01 <= b + m11)
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + s
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return np.array(out[::-1][: len(score)], dtype=np.int64)

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, rate: float = 0.15, shrink: float = 1e-3) -> Crf:
        """Gradient ascent (Adam) on the mean conditional log-likelihood of lines' features with a label for each line."""
        total = sum(len(x) for x, _ in sequences)
        seen = np.zeros(len(self.weights)), np.zeros((2, 2))
        for x, labels in sequences:
            seen[0][:] += labels @ x
            np.add.at(seen[1], (labels[:-1], labels[1:]), 1)
        m = v = np.zeros(len(self.weights) + 4)
        for t in range(1, steps + 1):
            gw, gm = seen[0].copy(), seen[1].copy()
            for x, _ in sequences:
                p, pairs = self.marginals(x)
                gw -= p @ x
                gm -= pairs
            g = np.concatenate([gw, gm.ravel()]) / total - shrink * np.concatenate([self.weights, self.moves.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.weights, self.moves = self.weights + step[:-4], self.moves + step[-4:].reshape(2, 2)
        return self

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content for each line, and expected counts of pairs of states (normalised at each line)."""
        up = np.exp(np.clip(x @ self.weights, -30, 30)).tolist()
        (m00, m01), (m10, m11) = np.exp(np.clip(self.moves, -30, 30)).tolist()
        f = [(1 / (1 + up[0]), up[0] / (1 + up[0]))]
        for u in up[1:]:
            a, b = f[-1]
            p, q = a * m00 + b * m10, (a * m01 + b * m11) * u
            f.append((p / (p + q), q / (p + q)))
        c, d, after = 1.0, 1.0, [0.0] * len(up)
        pairs = [0.0] * 4
        for i in range(len(up) - 1, -1, -1):
            a, b = f[i]
            z = a * c + b * d
            after[i] = b * d / z
            if i:
                a, b = f[i - 1]
                e = (a * m00 * c, a * m01 * up[i] * d, b * m10 * c, b * m11 * up[i] * d)
                z = sum(e)
                pairs = [w + y / z for w, y in zip(pairs, e)]
                c, d = m00 * c + m01 * up[i] * d, m10 * c + m11 * up[i] * d
                z = c + d
                c, d = c / z, d / z
        return np.array(after), np.array(pairs).reshape(2, 2)


def line_labels(documents: list[tuple[np.ndarray, int]], trust: float = TRUST) -> list[np.ndarray]:
    """A label for each line of documents (line features, whether it is good)."""
    seen, lines = np.ones((2, len(FEATURES))), np.full(2, 2.0)
    for x, good in documents:
        worded = x[x[:, 1] == 0]
        seen[good] += worded.sum(0)
        lines[good] += len(worded)
    p = seen / lines[:, None]
    p[:, :2] = 0.5  # that a line is there, and not blank, says nothing
    there, missing = np.log(p[1] / p[0]), np.log((1 - np.minimum(p[1], 1 - 1e-9)) / (1 - np.minimum(p[0], 1 - 1e-9)))
    out = []
    for x, good in documents:
        label = (x @ there + (1 - x) @ missing + (trust if good else -trust) > 0).astype(np.int64)
        blank = x[:, 1] > 0
        before = np.maximum.accumulate(np.where(blank, -1, np.arange(len(x))))
        out.append(np.where(before < 0, good, label[before]))
    return out


def piece(text: str, x: np.ndarray) -> np.ndarray:
    """At most LINES lines that follow each other, from a place that the text's checksum gives."""
    start = zlib.crc32(text.encode()) % (len(x) - LINES + 1) if len(x) > LINES else 0
    return x[start : start + LINES]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """A CRF from at most ``sample`` labelled documents, LINES neighbouring lines of each (features are those of the whole text);
    None if there are none of either kind."""
    own = only(labels, doc_id="long", quality="int").filter("doc_id is not null and quality is not null")
    chosen = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = one_text(only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"), "quality").select("quality", "text")
    schema = pa.schema([("quality", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column(0), [piece(t, line_features(base(t))[0]).astype(np.uint8).tobytes() for t in texts(b.column(1))])

    rows = joined.mapInArrow(run, "quality int, x binary").collect()
    found = [(np.frombuffer(r.x, np.uint8).reshape(-1, len(FEATURES)).astype(float), int(r.quality > 0)) for r in rows]
    if len({q for _, q in found}) < 2:
        return None
    found.sort(key=lambda s: (s[1], len(s[0]), s[0].tobytes()))
    return Crf().fit([(x, y) for (x, _), y in zip(found, line_labels(found))])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, crf: Crf | None, least_share: float = LEAST_SHARE) -> DataFrame:
    """The counts, base_failed, content_share and kept of each document."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])
    weights, moves = (crf.weights, crf.moves) if crf else (None, None)

    def run(batches):
        model = Crf(weights, moves) if crf else None
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                at = base(text)
                share = 1.0 if at["n_words"] else 0.0
                if model is not None and at["n_words"]:
                    x, n = line_features(at)
                    share = float((n * model.viterbi(x)).sum() / at["n_words"])
                rows.append((doc, *(at[c] for c in COUNTS), at["base_failed"], share, not at["base_failed"] and share >= least_share))
            yield batch(schema, *(zip(*rows) if rows else [()] * len(schema)))

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return only(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, content_share double, kept boolean")


def keep(docs: DataFrame, crf: Crf | None, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        model = Crf(crf.weights, crf.moves) if crf else None
        for b in batches:
            mask = []
            for text in texts(b.column(at)):
                found = base(text)
                good = not found["base_failed"]
                if good and model is not None:
                    x, n = line_features(found)
                    good = (n * model.viterbi(x)).sum() >= least_share * found["n_words"]
                mask.append(bool(good))
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
