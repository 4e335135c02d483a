"""Products of matrices in tiles: dense blocks as bytes, joined by tile index, one kernel for a pair of tiles, sums over k.

A tile has at most ``TILE`` x ``TILE`` numbers of 8 bytes. Products of integers are exact: by the fast kernel for doubles where
no sum can reach 2^53, and by the one for integers elsewhere (which wraps around as longs do). Entries that aren't given are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, HELD = 256, 64
TILES = "r long, c long, h int, w int, data binary"
SCHEMA = pa.schema([("r", pa.int64()), ("c", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])


def _kind(df: DataFrame, column: str) -> str:
    text = df.schema[column].dataType.simpleString()
    return "<f8" if "double" in text or "float" in text or "decimal" in text else "<i8"


def of_rows(df: DataFrame, i: str, x: str, tile: int = TILE) -> DataFrame:
    """Tiles of a matrix given as rows (i from 0, array of numbers): a row is cut into slices, of which ``tile`` meet."""
    kind = _kind(df, x)
    number = "double" if kind == "<f8" else "long"
    slices = F.expr(f"transform(sequence(0, (size({x}) - 1) div {tile}), c -> struct(c, slice({x}, c * {tile} + 1, {tile}) as s))")
    cut = df.filter(F.size(x) > 0).select(F.col(i).cast("long").alias("i"), F.explode(slices).alias("s")).select(F.expr(f"i div {tile}").alias("r"), F.col("s.c").cast("long").alias("c"), "i", F.col("s.s").cast(f"array<{number}>").alias("s"))

    def run(key, t):
        at = (t.column("i").to_numpy() % tile).astype(int)
        lists = t.column("s").to_pylist()
        out = np.zeros((at.max() + 1, max(map(len, lists))), kind)
        for k, s in zip(at, lists):
            out[k, : len(s)] = s
        return pa.Table.from_pylist([{"r": key[0].as_py(), "c": key[1].as_py(), "h": out.shape[0], "w": out.shape[1], "data": out.tobytes()}], SCHEMA)

    return cut.groupBy("r", "c").applyInArrow(run, TILES)


def of_cells(df: DataFrame, i: str = "i", j: str = "j", x: str = "x", tile: int = TILE) -> DataFrame:
    """Tiles of a matrix given as cells (i, j, x); cells that are given twice add up."""
    kind = _kind(df, x)
    number = "double" if kind == "<f8" else "long"
    keyed = df.select(F.expr(f"{i} div {tile}").alias("r"), F.expr(f"{j} div {tile}").alias("c"), F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(x).cast(number).alias("x")).filter("x is not null")

    def run(key, t):
        a, b = (t.column(c).to_numpy() % tile for c in ("i", "j"))
        out = np.zeros((a.max() + 1, b.max() + 1), kind)
        np.add.at(out, (a, b), t.column("x").to_numpy())
        return pa.Table.from_pylist([{"r": key[0].as_py(), "c": key[1].as_py(), "h": out.shape[0], "w": out.shape[1], "data": out.tobytes()}], SCHEMA)

    return keyed.groupBy("r", "c").applyInArrow(run, TILES)


def transposed(tiles: DataFrame) -> DataFrame:
    """Each tile is turned where it is."""

    def run(batches):
        for b in batches:
            r, c, h, w, data = (b.column(k).to_pylist() for k in range(5))
            turned = [np.frombuffer(d, np.uint64).reshape(x, y).T.tobytes() for d, x, y in zip(data, h, w)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((c, r, w, h, turned), SCHEMA)], schema=SCHEMA)

    return tiles.mapInArrow(run, TILES)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "f" or b.dtype.kind == "f":
        return a @ b
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype("<i8") if most < 2.0**53 else a @ b


def padded(sum_: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """The sum of two arrays that begin at the same corner."""
    if sum_ is None:
        return x
    if sum_.shape != x.shape:
        out = np.zeros(np.maximum(sum_.shape, x.shape), x.dtype)
        out[: sum_.shape[0], : sum_.shape[1]] += sum_
        out[: x.shape[0], : x.shape[1]] += x
        return out
    return sum_ + x


def matmul(a: DataFrame, b: DataFrame, whole_numbers: bool = True) -> DataFrame:
    """Tiles of the product. A pair of tiles that share k is one kernel; a task adds up at most HELD products before they go to
    the task that adds those of their place. ``whole_numbers``: both are tiles of integers."""
    kind = "<i8" if whole_numbers else "<f8"
    left = a.select("r", F.col("c").alias("k"), F.col("h").alias("lh"), F.col("w").alias("lw"), F.col("data").alias("ld"))
    right = b.select(F.col("r").alias("k"), "c", F.col("h").alias("rh"), F.col("w").alias("rw"), F.col("data").alias("rd"))

    def out(sums: dict) -> pa.RecordBatch:
        rows = [{"r": r, "c": c, "h": x.shape[0], "w": x.shape[1], "data": x.tobytes()} for (r, c), x in sums.items()]
        return pa.RecordBatch.from_pylist(rows, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                r, c, lh, lw, ld, rh, rw, rd = (batch.column(k)[row].as_py() for k in range(8))
                x, y = np.frombuffer(ld, kind).reshape(lh, lw), np.frombuffer(rd, kind).reshape(rh, rw)
                k = min(lw, rh)
                sums[r, c] = padded(sums.get((r, c)), product(x[:, :k], y[:k]))
                if len(sums) >= HELD:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    def added(batches: Iterator[pa.RecordBatch]):
        at, sum_ = None, None
        for batch in batches:
            for r, c, h, w, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if at not in (None, (r, c)):
                    yield out({at: sum_})
                    sum_ = None
                at, sum_ = (r, c), padded(sum_, np.frombuffer(data, kind).reshape(h, w))
        if at:
            yield out({at: sum_})

    pairs = left.join(right, "k").select("r", "c", "lh", "lw", "ld", "rh", "rw", "rd").mapInArrow(run, TILES)
    return pairs.repartition("r", "c").sortWithinPartitions("r", "c").mapInArrow(added, TILES)


def cells(tiles: DataFrame, whole_numbers: bool = True, tile: int = TILE) -> DataFrame:
    """i, j, x of every entry of every tile."""
    kind, number = ("<i8", pa.int64()) if whole_numbers else ("<f8", pa.float64())

    def run(batches):
        for b in batches:
            for r, c, h, w, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                i, j = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.array(i + r * tile), pa.array(j + c * tile), pa.array(np.frombuffer(data, kind), number)], names=["i", "j", "x"])

    return tiles.mapInArrow(run, f"i long, j long, x {'long' if whole_numbers else 'double'}")
