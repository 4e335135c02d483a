"""Prefix sums and scans without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..seq import Seq, cut

#: Positions per block. Blocks are summed first; one row for each block goes through the ordered window.
BLOCK = 1 << 16


def prefix_sums(df: DataFrame, i: str, v: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``before``: the sum of ``v`` over smaller positions ``i`` (dense, 0-based)."""
    dealt = df.withColumn("b__", F.expr(f"{i} div {block}"))
    sums = dealt.groupBy("b__").agg(F.sum(v).alias("s__"))
    starts = sums.select("b__", F.coalesce(F.sum("s__").over(Window.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at__"))
    inside = F.coalesce(F.sum(v).over(Window.partitionBy("b__").orderBy(i).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(starts, "b__").withColumn("before", F.col("at__") + inside).drop("b__", "at__")


def scan(seq: Seq, combine: Callable, exclusive: bool = False, identity=None, kind: str | None = None) -> DataFrame:
    """keys, v, scan: the values so far combined in order, by any associative ``combine(a, b)`` of two values (it need not
    commute), or a NumPy function of two arrays, such as ``np.maximum``. ``exclusive``: without the row's own value; the first
    row gets the ``identity``. Nulls change nothing; before the first value an inclusive scan is null.

    One pass sorts ranges of the keys and writes each row with what its own range gives so far. The ranges' last states, one
    for each shuffle partition, are combined to what each range carries in; a map over the written rows applies it."""
    names = [*seq.keys, "v"]
    state = T.DataType.fromDDL(kind) if kind else seq.df.schema["v"].dataType
    local = T.StructType([T.StructField("p__", T.IntegerType()), *seq.df.select(*names).schema.fields, T.StructField("s__", state), T.StructField("e__", state)])
    fast = isinstance(combine, np.ufunc)
    both = (lambda a, b: combine(a, b).item()) if fast else combine
    parts = int(seq.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def within(batches):
        from pyspark import TaskContext

        now, p = None, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(len(names) - 1)
            if fast and not column.null_count:
                v = column.to_numpy()
                own = combine.accumulate(v) if now is None else combine(combine.accumulate(v), now)
                after = pa.array(own, column.type)
                before = pa.concat_arrays([pa.array([now], column.type), after.slice(0, len(after) - 1)])
                now = own[-1].item()
            else:
                seen, past = [], []
                for x in column.to_pylist():
                    past.append(now)
                    now = now if x is None else x if now is None else both(now, x)
                    seen.append(now)
                kind_ = to_arrow_type(state)
                after, before = pa.array(seen, kind_), pa.array(past, kind_)
            yield pa.RecordBatch.from_arrays([pa.array([p] * b.num_rows, pa.int32()), *b.columns, after, before], names=local.names)

    done = cut(seq.df.select(*names).repartitionByRange(parts, *seq.keys).sortWithinPartitions(*seq.keys).mapInArrow(within, local))
    # One row for each shuffle partition.
    last = done.groupBy("p__").agg(F.max_by("s__", F.struct(*seq.keys)).alias("s")).toArrow()
    states = dict(zip(last.column(0).to_pylist(), last.column(1).to_pylist()))
    carried, now = {}, None
    for p in sorted(states):
        carried[p] = now
        now = states[p] if now is None else now if states[p] is None else both(now, states[p])
    shown = len(names) + (2 if exclusive else 1)

    def carry(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column, ps = b.column(shown), b.column(0).to_numpy()
            if fast and not column.null_count and not exclusive:
                s = column.to_numpy()
                out = np.array(s)
                for p in np.unique(ps):
                    if carried[p] is not None:
                        out[ps == p] = combine(carried[p], s[ps == p])
                column = pa.array(out, column.type)
            else:
                out = []
                for p, s in zip(ps.tolist(), column.to_pylist()):
                    c = carried[p]
                    x = s if c is None else c if s is None else both(c, s)
                    out.append(identity if x is None and exclusive else x)
                column = pa.array(out, column.type)
            yield pa.RecordBatch.from_arrays([*b.columns[1 : len(names) + 1], column], names=[*names, "scan"])

    return done.mapInArrow(carry, T.StructType([*local.fields[1 : len(names) + 1], T.StructField("scan", state)]))
