"""Connected components of an edge list, and how groups of any size meet in tasks of bounded size; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, shuffles

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("moved", pa.bool_())])
EDGES = "u long, v long, moved boolean"


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def forest(u: np.ndarray, v: np.ndarray, moved: bool) -> pa.RecordBatch:
    """The same components as stars: every node but the least of each, and that least one; a marked row if these are other
    links than the given ones, or ``moved``."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = least_labels(len(nodes), at[: len(u)], at[len(u) :])
    low = np.flatnonzero(label != np.arange(len(nodes)))
    a, b = nodes[low], nodes[label[low]]
    order = np.lexsort((v, u))
    first = np.ones(len(u), bool)
    first[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    mark = int(moved or not (np.array_equal(u[order][first], a) and np.array_equal(v[order][first], b)))
    pad = np.zeros(mark, np.int64)
    return batch(EDGE, np.concatenate([a, pad]), np.concatenate([b, pad]), np.arange(len(a) + mark) >= len(a))


def _columns(batches, width: int) -> list[np.ndarray]:
    held = [[] for _ in range(width)]
    for b in batches:
        for k in range(width):
            held[k].append(b.column(k).to_numpy(zero_copy_only=False))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in held]


def _local(edges: DataFrame) -> DataFrame:
    """Each task's links as stars around their least nodes, so that a star given around its greatest node is dealt evenly."""

    def run(batches):
        u, v, _ = _columns(batches, 3)
        yield forest(u, v, True)

    return edges.mapInArrow(run, EDGES).filter("not moved")


def _joined(edges: DataFrame) -> DataFrame:
    """All links of a node to smaller ones meet at the node; each task leaves stars of what it sees."""

    def run(batches):
        u, v, moved = _columns(batches, 3)
        moved = moved.astype(bool)
        yield forest(u[~moved], v[~moved], moved.any())

    return edges.repartition("u").mapInArrow(run, EDGES)


def _spread(edges: DataFrame) -> DataFrame:
    """Links of a node to larger ones meet its links to smaller ones. A node with more larger neighbours than a task's share
    is dealt to several tasks, each of which gets the node's own links; there are at most as many as shuffle partitions."""
    most = max(1000, edges.count() // shuffles(edges.sparkSession))
    sizes = edges.groupBy(F.col("v").alias("at")).agg(F.expr(f"cast(1 + count(1) div {most} as int)").alias("tasks")).filter("tasks > 1")
    hot, tasks = F.broadcast(sizes), F.coalesce("tasks", F.lit(1))
    down = edges.withColumn("at", F.col("v")).join(hot, "at", "left").select("at", F.pmod(F.xxhash64("u"), tasks).cast("int").alias("salt"), "u", "v", F.lit(0).alias("own"))
    up = edges.withColumn("at", F.col("u")).join(hot, "at", "left").select("at", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), "u", "v", F.lit(1).alias("own"))

    def run(batches):
        at, u, v, own = _columns(batches, 4)
        own = own.astype(bool)
        # A copy of a node's own link is of use only where the node has larger neighbours; the link itself stays with those of its parent.
        useful = ~own | np.isin(at, at[~own])
        yield forest(u[useful], v[useful], False)

    return down.unionAll(up).repartition("at", "salt").select("at", "u", "v", "own").mapInArrow(run, EDGES)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u long, v long) -> node, component (the least node that can be reached), for nodes that have an edge.

    A round is two shuffles of narrow rows and a written table. Tasks contract what they see to stars, so the number of
    rounds is at most about the logarithm of a component's diameter. A task holds its shuffle partition's links, 16 bytes each.
    """
    now = scratch.cut(_joined(_local(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(False).alias("moved")).filter("u <> v"))))
    while True:
        new = scratch.cut(_joined(_spread(now.filter("not moved"))))
        done = new.filter("moved").isEmpty()
        scratch.drop(now)
        now = new
        if done:
            break  # no task changed anything: all links are stars
    stars = now.filter("not moved")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def grouped(rows: DataFrame, sums: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``sums``, which has one row per key and the number ``n`` of its rows. Keys with more than a
    task's share of the ``total`` rows are joined by broadcast: there are at most as many as shuffle partitions."""
    most = max(1000, total // shuffles(rows.sparkSession))
    hot = F.broadcast(sums.filter(F.col("n") > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(sums.filter(F.col("n") <= most), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def meetings(rows: DataFrame, key: str, held: int, streamed: int, total: int) -> DataFrame:
    """Rows (key, node, c) of groups that hold several components c, dealt so that in each group every node outside the
    most frequent component meets every other node: key, block, split, side (0: held, 1: passing), node, c, odd.

    Nodes of the most frequent component never meet each other. A task's group holds at most about ``held`` odd nodes and
    lets about ``streamed`` nodes pass; a node passes once for each block of held ones, so what is sent stays proportional
    to a group as long as its odd nodes fit one block.
    """
    counts = rows.groupBy(key, "c").agg(F.count(F.lit(1)).alias("m"))
    sums = counts.groupBy(key).agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    sums = sums.select(key, "n", "main", F.expr(f"cast(ceil((n - most) / {held}) as int)").alias("blocks"), F.expr(f"cast(ceil(n / {streamed}) as int)").alias("splits"))
    live = grouped(rows, sums, [key], total).withColumn("odd", F.col("c") != F.col("main"))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = [F.col(key), F.col("node"), F.col("c"), F.col("odd")]
    kept = live.filter("odd").select(*keep, F.lit(0).alias("side"), own("blocks", 1).alias("block"), every("splits").alias("split"))
    passing = live.select(*keep, F.lit(1).alias("side"), every("blocks").alias("block"), own("splits", 2).alias("split"))
    return kept.unionByName(passing)


def blocks(rows: DataFrame, keys: list[str], size: int, total: int) -> DataFrame:
    """Rows (node and keys) of groups of two or more, dealt to blocks of about ``size``; each row comes once for each pair
    of blocks (b1 <= b2) that its own block is in, so that all pairs of a group meet without one task holding the group."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = grouped(rows, sizes, keys, total).withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    live = live.withColumn("block", F.pmod(F.xxhash64("node", *keys), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return live.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")}).drop("n", "blocks", "other")
