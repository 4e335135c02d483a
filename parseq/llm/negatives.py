"""Operator 13: hard negatives by dual-tree search.

An anchor's positives are its best rows of the same label; for each of them the best rows of other labels count whose score lies
between ``LEAST`` hundredths of the positive's score and that score. Scores are inner products of integers, exact.

1. Tiles. A tree from a bounded sample (labels first, then far directions) deals vectors to leaves, leaves to tiles of bounded
   size by hash, so a vector that a third of all rows share is many tiles. Anchors get tiles of their own from the same tree.
2. Trees. A tile is ordered by halving (by label, then along its longest direction); its nodes are the halves' halves, each with
   centre, radius and labels. The tree is the order: a task that gets a tile has its nodes by sums over ranges.
3. Tile pairs. Roots of anchor tiles and of candidate tiles meet in blocks. An inner product lies within
   ``ra * |cb| + rb * |ca| + ra * rb`` of that of the centres; pairs whose interval or labels rule out every anchor go no further.
4. Search. A task holds one anchor tile and lets candidate tiles pass, those with the highest bounds first. Both trees are
   descended together, level by level: a node pair whose interval misses what all anchors of the node still look for goes with
   everything below it; what is left are leaf pairs, scored exactly. The candidates of an anchor tile are dealt to stripes, so
   that few anchors keep all cores busy; the best of each stripe are then merged.

Step 3 and 4 run twice, for positives (same label, at least the fifth best score so far) and for negatives (other labels,
between the bounds of the positives and at least the fifth best so far).

Defined results: rows with a null id, label or vector, an empty vector, null or non-finite components, or a sum of squares (of
the integers) of 2^62 or more, whose scores might not be longs, take no part. Vectors of different lengths never meet. Each row
is a vector: rows that share an id are rows of their own, other ones for each other. Ties go to the smaller id. An anchor
without positives, and a positive without negatives between its bounds, give no rows. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, groups, only, shuffles, table

#: How many positives and negatives; the least share of a positive's score, in hundredths; the factor of components.
POSITIVES, NEGATIVES, LEAST, SCALE = 5, 5, 80, 256.0
#: Rows of a tile of candidates and of anchors, and of a leaf of their trees.
CANDIDATES, ANCHORS, LEAF, ANCHOR_LEAF = 4096, 1024, 128, 16
#: Leaves of the sampled tree at most, sampled rows for each of them, roots that meet in one group.
MOST_LEAVES, SAMPLED, ROOTS = 4096, 16, 1024
NONE = np.iinfo(np.int64).min
VECTOR = "row long, vec_id long, label long, dim int, q binary"


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, label, embedding) -> the rows that take part, with labels changed and components made integers."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("q", pa.binary())])
    for b in batches:
        out = []
        for row, i, label, v in zip(*(b.column(k).to_pylist() for k in range(4))):
            x = np.floor(np.array([np.nan if e is None else e for e in v or ()], dtype=np.float64) * SCALE)
            if i is not None and label is not None and len(x) and np.isfinite(x).all() and float(x @ x) < 2.0**62:
                out.append((row, i, int(np.fmod(label + 1, 10)) if i % 7 == 0 else label, len(x), x.astype("<i4").tobytes()))
        if out:
            yield batch(schema, *zip(*out))


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)


def direction(x: np.ndarray) -> np.ndarray:
    """From a far point to the point farthest from it; zero if all are equal."""
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    return x[((x - far) ** 2).sum(1).argmax()] - far


def grown(labels: np.ndarray, x: np.ndarray, leaves: int, names: Iterator[int]):
    """A tree over sampled rows: a leaf's name, or (direction or None for labels, threshold, left, right)."""
    if leaves > 1 and len(x) > 1:
        kinds = np.unique(labels)
        if len(kinds) > 1:
            axis, at = None, labels
            cuts = kinds[:-1]
            edge = cuts[np.abs(np.searchsorted(np.sort(labels), cuts, "right") - len(x) / 2).argmin()]
        else:
            axis = direction(x)
            at = x @ axis
            edge = np.median(at) if np.median(at) < at.max() else at.min()
        left = at <= edge
        if left.any() and not left.all():
            share = min(leaves - 1, max(1, round(leaves * left.mean())))
            return axis, float(edge), grown(labels[left], x[left], share, names), grown(labels[~left], x[~left], leaves - share, names)
    return next(names)


def route(tree, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree)
    axis, edge, low, high = tree
    left = (labels if axis is None else x @ axis) <= edge
    out = np.empty(len(x), np.int64)
    out[left], out[~left] = route(low, labels[left], x[left]), route(high, labels[~left], x[~left])
    return out


def routed(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with the leaf of a tree grown from a sample of at most about SAMPLED * MOST_LEAVES of them."""
    leaves = min(MOST_LEAVES, max(1, -(-total // CANDIDATES)))
    every = max(1, total // (SAMPLED * leaves))
    by_dim: dict[int, list] = {}
    for r in rows.filter(F.pmod(F.xxhash64("vec_id", "q"), F.lit(every)) == 0).collect():
        by_dim.setdefault(r.dim, []).append((r.label, r.q))
    names, sampled = iter(range(1 << 62)), sum(map(len, by_dim.values()))
    trees = {dim: grown(np.array([label for label, _ in some]), np.stack([np.frombuffer(q, "<i4") for _, q in some]).astype(np.float64), max(1, leaves * len(some) // sampled), names) for dim, some in sorted(by_dim.items())}

    def run(batches):
        for b in batches:
            dims, labels = b.column(3).to_numpy(), b.column(2).to_numpy()
            leaf = np.full(b.num_rows, -1)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                if dim in trees:
                    leaf[own] = route(trees[dim], labels[own], matrix(b.column(4).take(pa.array(own)), int(dim)))
            yield b.append_column("leaf", pa.array(leaf, pa.int64()))

    return rows.mapInArrow(run, f"{VECTOR}, leaf long")


def ordered(labels: np.ndarray, x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in an order whose halves, and their halves, are the nodes of a tree."""
    out = np.arange(len(x))
    for bounds in levels(len(x), leaf)[:-1]:
        for s, e in zip(bounds, bounds[1:]):
            own = out[s:e]
            at = labels[own] if labels[own].min() < labels[own].max() else x[own] @ direction(x[own])
            out[s:e] = own[np.argsort(at, kind="stable")]
    return out


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level, from the root; nodes of the last hold ``leaf`` rows or up to twice as many."""
    out = [np.array([0, n])]
    while n >= 2 * leaf:
        b = out[-1]
        out.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
        n //= 2
    return out


class Tree:
    """Nodes of ordered rows by level: bounds, centres and their norms, radii, least and greatest labels."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, leaf: int):
        self.at = levels(len(x), leaf)
        self.nodes = []
        for b in self.at:
            centre = np.add.reduceat(x, b[:-1]) / np.diff(b)[:, None]
            radius = np.sqrt(np.maximum.reduceat(((x - np.repeat(centre, np.diff(b), 0)) ** 2).sum(1), b[:-1]))
            self.nodes.append((centre, np.sqrt((centre**2).sum(1)), radius, np.minimum.reduceat(labels, b[:-1]), np.maximum.reduceat(labels, b[:-1])))


def interval(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of rows of node i of ``a`` with rows of node j of ``b``, rounded outwards."""
    mid = np.einsum("nd,nd->n", a[0][i], b[0][j])
    norms = a[1][i] * b[1][j]
    reach = a[2][i] * b[1][j] + b[2][j] * a[1][i] + a[2][i] * b[2][j] + 1e-9 * norms + 1e-6
    reach += 1e-9 * reach
    return mid - reach, mid + reach


class Best:
    """For each anchor and each of ``width`` ranges of scores the first ``keep`` candidates found so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low, high, keep
        self.score = np.full((*low.shape, keep), NONE)
        self.id = np.zeros((*low.shape, keep), np.int64)

    def least(self) -> np.ndarray:
        """The least score that can still come in, of each anchor and range."""
        return np.maximum(self.low, self.score[:, :, -1])

    def offer(self, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Scores of the anchors ``own`` (rows) with candidates (columns), of which those that ``fit`` count."""
        least = self.least()[own]
        for k in range(self.low.shape[1]):
            live = fit & (scores >= least[:, k, None]) & (scores <= self.high[own, k, None])
            if live.shape[1] > self.keep:
                held = np.where(live, scores, NONE)
                live &= scores >= np.partition(held, -self.keep, axis=1)[:, -self.keep, None]
            a, c = np.nonzero(live)
            if not len(a):
                continue
            who = np.unique(a)
            old = self.score[own[who], k] > NONE
            of = np.concatenate([a, np.repeat(who, old.sum(1))])
            score = np.concatenate([scores[a, c], self.score[own[who], k][old]])
            name = np.concatenate([ids[c], self.id[own[who], k][old]])
            order = np.lexsort((name, -score, of))
            of, score, name = of[order], score[order], name[order]
            first = np.concatenate([[True], of[1:] != of[:-1]])
            rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
            good = rank < self.keep
            self.score[own[of[good]], k, rank[good]], self.id[own[of[good]], k, rank[good]] = score[good], name[good]


class Search:
    """An anchor tile, and what it has found in the candidate tiles that passed."""

    def __init__(self, row: np.ndarray, labels: np.ndarray, x: np.ndarray, best: Best, same: bool):
        self.row, self.labels, self.x, self.best, self.same = row, labels, x, best, same
        self.tree, self.norm = Tree(labels, x, ANCHOR_LEAF), float((x * x).sum(1).max()) ** 0.5

    def live(self, level: int, pair: tuple[np.ndarray, np.ndarray], nodes: tuple) -> np.ndarray:
        """Which node pairs may hold what anchors of the node look for."""
        mine = self.tree.nodes[level]
        i, j = pair
        low, high = interval(mine, nodes, i, j)
        bounds = self.tree.at[level][:-1]
        good = high >= np.minimum.reduceat(self.best.least().min(1), bounds)[i]
        good &= low <= np.maximum.reduceat(self.best.high.max(1), bounds)[i]
        if self.same:
            return good & (mine[3][i] <= nodes[4][j]) & (nodes[3][j] <= mine[4][i])
        return good & ~((mine[3][i] == mine[4][i]) & (nodes[3][j] == nodes[4][j]) & (mine[3][i] == nodes[3][j]))

    def tile(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        tree = Tree(labels, x, LEAF)
        i = j = np.zeros(1, np.int64)
        m = n = 0
        while True:
            good = self.live(m, (i, j), tree.nodes[n])
            i, j = i[good], j[good]
            more_m, more_n = m + 1 < len(self.tree.at), n + 1 < len(tree.at)
            if not len(i) or not (more_m or more_n):
                break
            if more_m:
                i, j, m = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), m + 1
            if more_n:
                i, j, n = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), n + 1
        exact = self.norm * float((x * x).sum(1).max()) ** 0.5 < 2.0**52
        for node in np.unique(i):
            s, e = self.tree.at[m][node : node + 2]
            some = np.concatenate([np.arange(*tree.at[n][k : k + 2]) for k in np.sort(j[i == node])])
            mine, other = self.x[s:e], x[some]
            scores = (mine @ other.T).astype(np.int64) if exact else mine.astype(np.int64) @ other.T.astype(np.int64)
            fit = (self.labels[s:e, None] == labels[some]) == self.same
            self.best.offer(np.arange(s, e), scores, ids[some], fit & (self.row[s:e, None] != row[some]))


def summed(x: np.ndarray, labels: np.ndarray) -> tuple:
    """Centre, radius and labels of a tile."""
    centre, _, radius, low, high = (v[0] for v in Tree(labels, x, len(x)).nodes[0])
    return centre.tobytes(), float(radius), int(low), int(high)


TILE = pa.schema([("tile", pa.string()), ("place", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("q", pa.binary()), ("radius", pa.float64()), ("low", pa.int64()), ("high", pa.int64())])
TILES = "tile string, place int, row long, vec_id long, label long, dim int, q binary, radius double, low long, high long"


def tiles(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """Rows in tiles of about ``size``, in the order of their trees, and for each tile a row of its root (place -1). Leaves with
    more rows than a tile, of which the sampled tree has at most MOST_LEAVES, are dealt by hash."""
    large = F.broadcast(rows.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size))
    dealt = rows.join(large, ["dim", "leaf"], "left").withColumn("salt", F.expr(f"coalesce(pmod(xxhash64(row), n div {size} + 1), 0)"))

    def run(batches):
        for g in groups(batches, ["dim", "leaf", "salt"]):
            dim, at, salt = (g.column(c)[0].as_py() for c in ("dim", "leaf", "salt"))
            row, ids, labels = (g.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            x, raw, name = matrix(g.column("q"), dim), g.column("q").to_pylist(), f"{dim}.{at}.{salt}"
            order = ordered(labels, x, leaf)
            n, none = len(order), pa.nulls(len(order), pa.int64())
            yield batch(TILE, [name] * n, np.arange(n), row[order], ids[order], labels[order], [dim] * n, [raw[k] for k in order], pa.nulls(n, pa.float64()), none, none)
            centre, radius, low, high = summed(x, labels)
            yield batch(TILE, [name], [-1], [None], [None], [None], [dim], [centre], [radius], [low], [high])

    keys = ["dim", "leaf", "salt"]
    return dealt.select("row", "vec_id", "label", "q", *keys).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, TILES)


def meetings(anchors: DataFrame, candidates: DataFrame, same: bool, n_anchors: int, n_candidates: int) -> DataFrame:
    """(tile, dim, centre, radius, low, high; anchors also least and most, what they look for) -> at, ct, bound: tile pairs that
    may hold something, with the upper bound of their scores. Roots meet in groups of about ROOTS of either side."""
    groups_a, groups_c = -(-n_anchors // ROOTS), -(-n_candidates // ROOTS)
    part = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["tile", "dim", "centre", "radius", "low", "high", "least", "most"]
    left = anchors.select(*columns, F.lit(0).alias("side"), part(groups_a).alias("ga"), each(groups_c).alias("gc"))
    right = candidates.select(*columns[:-2], F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.lit(1).alias("side"), each(groups_a).alias("ga"), part(groups_c).alias("gc"))
    schema = pa.schema([("at", pa.string()), ("ct", pa.string()), ("bound", pa.float64())])

    def run(batches):
        for g in groups(batches, ["dim", "ga", "gc"]):
            sides = [g.filter(pc.equal(g.column("side"), k)) for k in (0, 1)]
            if not all(s.num_rows for s in sides):
                continue
            a, b = ((c := np.frombuffer(b"".join(s.column("centre").to_pylist())).reshape(s.num_rows, -1), np.sqrt((c**2).sum(1)), *(s.column(k).to_numpy() for k in ("radius", "low", "high"))) for s in sides)
            least, most = (sides[0].column(k).to_numpy() for k in ("least", "most"))
            names = [s.column("tile").to_pylist() for s in sides]
            for i in range(len(names[0])):
                all_j = np.arange(len(names[1]))
                at = np.full(len(all_j), i)
                low, high = interval(a, b, at, all_j)
                good = (high >= least[i]) & (low <= most[i])
                if same:
                    good &= (a[3][i] <= b[4]) & (b[3] <= a[4][i])
                else:
                    good &= ~((a[3][i] == a[4][i]) & (b[3] == b[4]) & (a[3][i] == b[3]))
                j = np.flatnonzero(good)
                if len(j):
                    yield batch(schema, [names[0][i]] * len(j), [names[1][k] for k in j], high[j])

    keys = ["dim", "ga", "gc"]
    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "at string, ct string, bound double")


def found(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, stripes: int, same: bool) -> DataFrame:
    """row, vec_id (of the anchor), k (number of the range), name, score of the best candidates of each anchor in each stripe.
    ``anchors``: rows of tiles with their positives' scores (``goals``, an array; null while positives are looked for)."""
    columns = ["row", "vec_id", "label", "dim", "q"]
    stripe = F.pmod(F.xxhash64("ct"), F.lit(stripes)).cast("int")
    held = anchors.select(F.col("tile").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("side"), F.lit(0.0).alias("rank"), F.lit("").alias("ct"), "place", *columns, "goals")
    passing = candidates.withColumnRenamed("tile", "ct").join(pairs, "ct").select("at", stripe.alias("stripe"), F.lit(1).alias("side"), (-F.col("bound")).alias("rank"), "ct", "place", *columns, F.lit(None).cast("array<long>").alias("goals"))
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("k", pa.int32()), ("name", pa.int64()), ("score", pa.int64())])

    def begun(g: pa.Table) -> tuple[np.ndarray, Search]:
        row, ids, labels = (g.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        if same:
            best = Best(np.full((len(row), 1), NONE), np.full((len(row), 1), np.iinfo(np.int64).max), POSITIVES)
        else:
            # Ranges that hold nothing (no such positive, or a negative score) have a lower bound above the upper one.
            low, high = np.full((len(row), POSITIVES), np.iinfo(np.int64).max), np.full((len(row), POSITIVES), NONE)
            for n, goals in enumerate(g.column("goals").to_pylist()):
                for k, p in enumerate(goals or ()):
                    if p >= 0:
                        low[n, k], high[n, k] = -(-LEAST * p // 100), p
            best = Best(low, high, NEGATIVES)
        return ids, Search(row, labels, matrix(g.column("q"), g.column("dim")[0].as_py()), best, same)

    def results(ids: np.ndarray, search: Search) -> Iterator[pa.RecordBatch]:
        a, k, at = np.nonzero(search.best.score > NONE)
        if len(a):
            yield batch(schema, search.row[a], ids[a], k, search.best.id[a, k, at], search.best.score[a, k, at])

    def run(batches):
        state = None
        for g in groups(batches, ["at", "stripe", "side", "ct"]):
            if g.column("side")[0].as_py() == 0:
                if state:
                    yield from results(*state)
                state = begun(g)
            else:
                row, ids, labels = (g.column(c).to_numpy() for c in ("row", "vec_id", "label"))
                state[1].tile(row, ids, labels, matrix(g.column("q"), g.column("dim")[0].as_py()))
        if state:
            yield from results(*state)

    rows = held.unionByName(passing).repartition("at", "stripe").sortWithinPartitions("at", "stripe", "side", "rank", "ct", "place")
    return rows.mapInArrow(run, "row long, vec_id long, k int, name long, score long")


def merged(rows: DataFrame, keep: int) -> DataFrame:
    """The best of all stripes (at most ``keep`` of each): place from 1."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "name")))
    tops = rows.groupBy("row", "vec_id", "k").agg(F.slice(best, 1, keep).alias("best"))
    return tops.select("row", "vec_id", "k", F.posexplode("best").alias("place", "b")).select("row", "vec_id", "k", (F.col("place") + 1).alias("place"), F.col("b.name").alias("name"), (-F.col("b.down")).alias("score"))


def mined(vectors: DataFrame, every: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding); anchors are rows
    whose id ``every`` divides. What the result reads stays in ``scratch``."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    slim = only(vectors, vec_id="long", label="long", embedding="array<double>")
    all_rows = scratch.cut(slim.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding").mapInArrow(integers, VECTOR))
    rows = routed(all_rows, all_rows.count())
    candidates = scratch.cut(tiles(rows, CANDIDATES, LEAF))
    anchors = scratch.cut(tiles(rows.filter(F.col("vec_id") % every == 0), ANCHORS, ANCHOR_LEAF))
    roots = [t.filter("place < 0").select("tile", "dim", F.col("q").alias("centre"), "radius", "low", "high") for t in (candidates, anchors)]
    sizes = [r.count() for r in roots]
    here = [t.filter("place >= 0").select("tile", "place", "row", "vec_id", "label", "dim", "q") for t in (candidates, anchors)]
    stripes = max(1, min(sizes[0], -(-2 * shuffles(spark) // max(1, sizes[1]))))
    limit = lambda x: F.lit(float(x))
    pairs = meetings(roots[1].withColumns({"least": limit("-inf"), "most": limit("inf")}), roots[0], True, sizes[1], sizes[0])
    positives = scratch.cut(merged(found(here[1].withColumn("goals", F.lit(None).cast("array<long>")), here[0], pairs, stripes, True), POSITIVES).select("row", "vec_id", (F.col("place") - 1).alias("k"), "name", "score"))
    goals = positives.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("goals"))
    ready = scratch.cut(here[1].join(goals, "row"))
    looked = ready.select("tile", F.explode("goals").alias("p")).filter("p >= 0").groupBy("tile").agg((F.min("p").cast("double") * (LEAST / 100 - 1e-9) - 1).alias("least"), (F.max("p").cast("double") * (1 + 1e-9) + 1).alias("most"))
    pairs = meetings(roots[1].join(looked, "tile"), roots[0], False, sizes[1], sizes[0])
    negatives = merged(found(ready, here[0], pairs, stripes, False), NEGATIVES)
    both = negatives.join(positives.select("row", "k", F.col("name").alias("positive_id"), F.col("score").alias("positive_score")), ["row", "k"])
    return both.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("name").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS id, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (SELECT a.id AS aid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
pos AS (SELECT aid, anchor_id, other AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY s DESC, other) AS k FROM score WHERE same QUALIFY k <= {POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.aid, k ORDER BY s DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, s AS negative_score
FROM pos p JOIN score n ON n.aid = p.aid AND NOT n.same AND {LEAST} * positive_score <= 100 * s AND s <= positive_score QUALIFY rank <= {NEGATIVES}
"""
