"""Operator 5: near-duplicate documents by HyperMinHash.

A document's words (ASCII lower-cased) give a set of word shingles. Each of ``BANDS * ROWS`` buckets keeps, for its own
hash function, the least hash in compressed form: the count of leading zeros and the mantissa bits after them, 16 bits in
all. Four registers are one band; equal bands make candidates. A candidate's similarity is first estimated from equal
registers, corrected for accidental collisions of compressed registers, and links are then confirmed on the full sets.

Copies never meet each other: documents with equal sets are one class, and classes stand in for them. A band's bucket is
not expanded into pairs either: it is a star around its least node, and a star's links are confirmed by tasks of ``STAR``
nodes each. Then only nodes that the stars left in different components are looked at: in each bucket, those outside its
most frequent component meet the others' registers, and what these don't rule out is tied into families; in each family,
those outside its most frequent component meet the others' full sets. So every pair that shares a band is in one
component, ruled out by its estimate, or compared on full sets. Nodes of a most frequent component never meet again, so
only a bucket's nodes that link with nothing are compared with all the others; a text is sent once for each ``HELD`` of them.

Sets are named by 64-bit digests; two of n different sets share a name with a chance of about n * n / 2^65.

Defined results: null or wordless texts have an empty set and link with nothing; rows without an id link with nothing
(component null, kept); rows that share an id are versions of one document; repeated rows give repeated results; texts of
any length are read whole; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, Scratch, batch, documents, groups, mix64, only, texts
from .components import components, grouped, least_labels, meetings

BANDS, ROWS, MANTISSA = 32, 4, 10
#: Nodes of a star in one task; odd nodes that a task holds, and nodes that pass it, for registers and for texts.
STAR, HELD, PASSING, HELD_TEXTS, PASSING_TEXTS = 512, 2048, 1 << 16, 512, 2048
REGISTERS = BANDS * ROWS
#: Estimates this far below the limit still go to the exact check: five standard deviations at 0.8 and 128 registers.
MARGIN = 0.18
WORD = Cache(lambda w: xxhash.xxh64_intdigest(w))
_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text with fewer words than ``width`` is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed minima of non-empty sets: 6 bits of leading zeros, then MANTISSA bits."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat(every * FACTORS[i] + TERMS[i], at)
        as_float = (least | np.uint64(1)).astype(np.float64).view(np.int64) >> (52 - MANTISSA)
        zeros = 63 - ((as_float >> MANTISSA) - 1023)
        out[:, i] = np.clip(zeros, 0, 63) << MANTISSA | as_float & ((1 << MANTISSA) - 1)
    return out


def band_keys() -> str:
    """SQL for the bands' keys of a row with ``regs``."""
    return f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(regs, 1 + b * {2 * ROWS}, {2 * ROWS})))"


@lru_cache(4096)
def accident(m: int, n: int) -> float:
    """Chance that the compressed minima of two disjoint sets of about m and n elements agree."""
    edges = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(48, -1, -1)] + [[1.0]])
    p, q = (-np.diff(np.exp(k * np.log1p(-np.minimum(edges, 1 - 1e-15)))) for k in (m, n))
    return float((p * q).sum())


def estimate(a: np.ndarray, b: np.ndarray, m: int, n: int) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for accidents."""
    c = accident(1 << max(0, m - 1).bit_length(), 1 << max(0, n - 1).bit_length())
    return np.clip(((a == b).mean(-1) - c) / (1 - c), 0, 1)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (64-bit digest of the set), regs. The last is empty for an empty set and for one that the same
    task has had before, so copies leave a task once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("regs", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            rows, new, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                s = shingles(text, width)
                node = int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)
                if len(s) and doc is not None and node not in seen:
                    seen.add(node)
                    new.append((len(rows), s))
                    size += len(s)
                rows.append((doc, len(s), node))
                if size > 300_000:
                    yield out(rows, new)
                    rows, new, size = [], [], 0
            if rows:
                yield out(rows, new)

    def out(rows, new):
        raw = [b""] * len(rows)
        for (k, _), r in zip(new, registers([s for _, s in new])):
            raw[k] = r.tobytes()
        return batch(schema, *zip(*rows), raw)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, regs binary")


def payloads(docs: DataFrame) -> DataFrame:
    """doc_id, z: the compressed text of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield batch(schema, b.column(0), [press.compress(t.encode()) for t in texts(b.column(1))])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, z binary")


def stars(sign: DataFrame, total: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The buckets of two or more nodes, as (band, node), and pairs (u, v, part): the least node of a bucket with each other."""
    buckets = sign.filter(F.length("regs") > 0).select("node", F.explode(F.expr(band_keys())).alias("band"))
    sums = buckets.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("u < last")
    sums = scratch.cut(sums.drop("last"))
    live = scratch.cut(grouped(buckets, sums, ["band"], total * BANDS))
    pairs = live.filter("node <> u").groupBy("u", F.col("node").alias("v")).agg(F.max("n").alias("n"))
    return live, scratch.cut(pairs.select("u", "v", F.expr(f"cast(pmod(xxhash64(v), 1 + n div {STAR}) as int)").alias("part")))


def confirmed(pairs: DataFrame, texts_of: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. A part of u's pairs gathers around u in sorted order, so that a
    worker holds one set of u at a time and streams the others past it."""
    need = pairs.select("u", "part", F.col("v").alias("node"), F.lit(1).alias("side")).unionAll(pairs.select("u", "part", F.col("u").alias("node"), F.lit(0).alias("side")).distinct())
    rows = need.join(texts_of, "node").repartition("u", "part").sortWithinPartitions("u", "part", "side", "node").select("u", "node", "side", "z")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        centre, sets = None, []
        for b in batches:
            u, v = [], []
            for c, node, side, z in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = shingles(opener.decompress(z).decode(), width)
                if side == 0:
                    if c != centre:
                        centre, sets = c, []
                    sets.append(s)
                    continue
                for t in sets:
                    small, big = sorted((len(s), len(t)))
                    if not small or 100 * small < least * big:
                        continue
                    both = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * both >= least * (len(s) + len(t) - both):
                        u.append(c)
                        v.append(node)
                        break
            yield batch(schema, u, v)

    return rows.mapInArrow(run, "u long, v long")


class Families:
    """Held nodes, and nodes that pass and are tied to some of them; gives each tied node with a held one of its family."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.label, self.passed = nodes, np.arange(len(nodes)), []

    def tie(self, node: int, held: np.ndarray) -> None:
        if len(held):
            labels = np.unique(self.label[held])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]
            self.passed.append((node, held[0]))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != np.arange(len(self.nodes)))
        node, held = np.array(self.passed, dtype=np.int64).reshape(-1, 2).T
        return np.concatenate([self.nodes[own], node]), self.nodes[np.concatenate([self.label[own], self.label[held]])]


def resembling(dealt: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """u, v: nodes that meet in a bucket, have compatible sizes and registers that don't rule a link out are tied together; a
    node comes with one node of its family, not with every pair."""
    rows = dealt.join(heads, "node").repartition("band", "block", "split").sortWithinPartitions("band", "block", "split", "side")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for g in groups(batches, ["band", "block", "split"]):
            node, c, n, side, odd = (g.column(k).to_numpy() for k in ("node", "c", "n_shingles", "side", "odd"))
            regs = np.frombuffer(b"".join(g.column("regs").to_pylist()), np.uint16).reshape(len(node), REGISTERS)
            held = int(np.searchsorted(side, 1))
            if held == 0:
                continue
            found = Families(node[:held])
            own, size, parts, own_regs = node[:held], n[:held], c[:held], regs[:held]
            for k in range(held, len(node)):
                # Two odd nodes meet twice: once is enough.
                fits = (parts != c[k]) & (100 * np.minimum(size, n[k]) >= least * np.maximum(size, n[k]))
                j = np.flatnonzero(fits & (own < node[k]) if odd[k] else fits)
                if len(j):
                    found.tie(node[k], j[estimate(regs[k], own_regs[j], int(n[k]), int(n[k])) >= least / 100 - MARGIN])
            if found.passed:
                yield batch(schema, *found.rows())

    return rows.select("band", "block", "split", "side", "node", "c", "odd", "n_shingles", "regs").mapInArrow(run, "u long, v long").filter("u <> v").distinct()


class Index:
    """Shingles of held sets, to count what another set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.values, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))

    def shared(self, s: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        k = k[self.values[k] == s]
        start, count = self.at[k], self.at[k + 1] - self.at[k]
        where = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(k) else np.zeros(0, np.int64)
        return np.bincount(self.owner[where], minlength=len(self.size))


def compared(dealt: DataFrame, texts_of: DataFrame, width: int, least: int) -> DataFrame:
    """u, v: links between texts that meet in a family, on full sets; a node comes with one node that it is linked to."""
    rows = dealt.join(texts_of, "node").repartition("family", "block", "split").sortWithinPartitions("family", "block", "split", "side")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for g in groups(batches, ["family", "block", "split"]):
            node, c, side, odd = (g.column(k).to_numpy() for k in ("node", "c", "side", "odd"))
            held = int(np.searchsorted(side, 1))
            sets = (shingles(opener.decompress(z.as_py()).decode(), width) for z in g.column("z"))
            if held == 0:
                continue
            index = Index([next(sets) for _ in range(held)])
            if not len(index.values):
                continue
            found = Families(node[:held])
            for k, s in zip(range(held, len(node)), sets):
                fits = (c[:held] != c[k]) & (100 * np.minimum(index.size, len(s)) >= least * np.maximum(index.size, len(s)))
                if odd[k]:
                    fits &= node[:held] < node[k]
                if len(s) and fits.any():
                    both = index.shared(s)
                    found.tie(node[k], np.flatnonzero(fits & (100 * both >= least * (index.size + len(s) - both))))
            if found.passed:
                yield batch(schema, *found.rows())

    return rows.select("family", "block", "split", "side", "node", "c", "odd", "z").mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def link(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text)."""
    slim = only(docs, doc_id="long", text="string")
    scratch = Scratch(docs.sparkSession)
    sign = scratch.cut(signatures(slim, width))
    #: A class is a set, its node the set's digest.
    classes = scratch.cut(sign.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")))
    total = sign.count()
    live, pairs = stars(sign, total, scratch)
    met = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    text_of = scratch.cut(payloads(slim).join(classes.join(met, "node", "left_semi").select("node", "doc_id"), "doc_id").select("node", "z"))
    edges = scratch.cut(confirmed(pairs, text_of, width, least))
    known = scratch.cut(components(edges, scratch))
    named = scratch.cut(live.select("band", "node").distinct().join(known, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c")))
    dealt = scratch.cut(meetings(named, "band", HELD, PASSING, total * BANDS))
    heads = sign.filter(F.length("regs") > 0).select("node", "n_shingles", "regs").join(dealt.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    ties = scratch.cut(resembling(dealt, heads, least))
    if not ties.isEmpty():
        families = components(ties, scratch).join(known.withColumnRenamed("component", "c"), "node", "left").select(F.col("component").alias("family"), "node", F.coalesce("c", "node").alias("c"))
        more = scratch.cut(compared(meetings(scratch.cut(families), "family", HELD_TEXTS, PASSING_TEXTS, total), text_of, width, least))
        if not more.isEmpty():
            known = scratch.cut(components(edges.unionAll(more), scratch))
    found = scratch.cut(classes.join(known, "node").select("node", "doc_id", "component"))
    least_of = scratch.cut(found.groupBy("component").agg(F.min("doc_id").alias("found"), F.count(F.lit(1)).alias("n")))
    renamed = grouped(found.select("node", "component"), least_of, ["component"], total).select("node", "found")
    names = scratch.cut(classes.select("node", "doc_id", "n").join(renamed, "node", "left").select("node", "n", F.coalesce("found", "doc_id").alias("found")))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node"))
    out = grouped(sign.select("doc_id", "n_shingles", own.alias("node")), names, ["node"], total, "left")
    scratch.drop_all_but(sign, names)
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir), width=4, least=80)
