"""Neighbourhoods without moving rows: tasks work on the runs of positions they read, and only what lies at the edges of runs travels.

Chunks that a run holds whole are done where they are; the rows of the others, at most one chunk at either end of a run, meet by
chunk. A stencil is summed inside runs; targets whose sources lie in several runs go on as partial sums. How rows are laid out
changes what travels, not the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..seq import Seq, cut

#: Positions of a run that a task holds at most.
RUN = 1 << 20


def chunks_apply(seq: Seq, size: int, f: Callable[[int, list], list]) -> Seq:
    """``f(chunk, values)`` gives a chunk's new values, of the sequence's own type."""
    kind = seq.df.schema["v"].dataType
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind), T.StructField("done", T.BooleanType())])

    def batch_of(i: list, v: list, done: bool, out_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(v, out_type), pa.array([done] * len(i))], names=schema.names)

    def run(batches):
        i: list = []
        v: list = []
        out_type = None
        for b in batches:
            out_type = b.schema.field("v").type
            at, values = b.column(0).to_numpy(), b.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(at // size)) + 1).tolist(), len(at)] if len(at) else []
            for s, e in zip(edges, edges[1:]):
                if i and i[-1] // size != at[s] // size:
                    yield closed(i, v, out_type)
                    i, v = [], []
                i += at[s:e].tolist()
                v += values[s:e]
        if i:
            yield closed(i, v, out_type)

    def closed(i: list, v: list, out_type: pa.DataType) -> pa.RecordBatch:
        """A chunk's rows, in order of positions: done if all are here, else as they are."""
        whole = len(i) == size and i[0] % size == 0 and i[-1] == i[0] + size - 1
        return batch_of(i, list(f(i[0] // size, v)) if whole else v, whole, out_type)

    def split(key, t):
        t = t.sort_by("i")
        return pa.Table.from_arrays([t.column("i"), pa.array(f(key[0].as_py(), t.column("v").to_pylist()), t.schema.field("v").type)], names=["i", "v"])

    if size <= 0:
        raise ValueError("chunk size must be positive")
    rows = seq.indexed().select("i", "v").sortWithinPartitions("i")
    done = cut(rows.mapInArrow(run, schema))
    edges = done.filter("not done").select("i", "v").groupBy(F.expr(f"i div {size}").alias("chunk")).applyInArrow(split, T.StructType(schema.fields[:2]))
    return Seq(done.filter("done").select("i", "v").unionByName(edges).select("v", F.col("i").alias("k0")), ["k0"], True)


def stencil(pixels: DataFrame, width: int, weights: dict[tuple[int, int], int]) -> DataFrame:
    """idx, total: the weighted sum around each pixel of an image (idx from 0 without gaps, v), ``width`` in a row. ``weights``: by
    (dy, dx), at most one row and one column away. A source outside is the nearest column's nearest pixel."""
    n = pixels.count()
    w, reach = max(1, min(n, width)), width + 1
    if any(abs(d) > 1 for at in weights for d in at):
        raise ValueError("weights reach one row and one column")

    def summed(start: int, v: np.ndarray) -> pa.RecordBatch:
        t = np.arange(max(0, start - reach), min(n, start + len(v) + reach))
        y, x = np.divmod(t, width)
        total, here = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for (dy, dx), weight in weights.items():
            sx = np.clip(x + dx, 0, w - 1)
            source = np.clip(y + dy, 0, (n - 1 - sx) // width) * width + sx - start
            own = (source >= 0) & (source < len(v))
            total[own] += weight * v[source[own]]
            here += own
        some = here > 0
        return pa.RecordBatch.from_arrays([pa.array(t[some]), pa.array(total[some]), pa.array(here[some] == len(weights))], names=["idx", "total", "done"])

    def run(batches):
        held, start, end = [], 0, None
        for b in batches:
            at, v = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)] if len(at) else []
            for s, e in zip(edges, edges[1:]):
                if held and (at[s] != end or end - start >= RUN):
                    yield summed(start, np.concatenate(held))
                    held = []
                if not held:
                    start = int(at[s])
                held.append(v[s:e])
                end = int(at[e - 1]) + 1
        if held:
            yield summed(start, np.concatenate(held))

    done = cut(pixels.select(F.col("idx").cast("long").alias("idx"), F.col("v").cast("long").alias("v")).sortWithinPartitions("idx").mapInArrow(run, "idx long, total long, done boolean"))
    edges = done.filter("not done").groupBy("idx").agg(F.sum("total").alias("total"))
    return done.filter("done").select("idx", "total").unionByName(edges)
