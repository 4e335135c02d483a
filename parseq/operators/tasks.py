"""Fork-join of named tasks, scopes and ranges.

Tasks over the same sequence should be one aggregate (:func:`join_aggregates`); independent jobs run on driver threads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..seq import Fn, Seq
from ..session import num_workers

#: Tasks that a scope takes.
MOST_TASKS = 64


def join_aggregates(seq: Seq, **tasks: Fn) -> DataFrame:
    """One row with each task's aggregate by name: a single scan."""
    return seq.df.agg(*[f(F.col("v")).alias(n) for n, f in tasks.items()])


def join_rows(**frames: DataFrame) -> DataFrame:
    """One row with a struct for each result, by name; ValueError in the job if a result has another number of rows than one."""
    out = None
    for name, df in frames.items():
        one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*df.columns))).otherwise(F.raise_error(F.lit(f"{name} is not one row")))
        row = df.agg(one.alias(name))
        out = row if out is None else out.crossJoin(row)
    return out


def _started(pool: ThreadPoolExecutor, task) -> Callable:
    f, args = (task[0], task[1:]) if isinstance(task, tuple) else (task, ())
    return pool.submit(inheritable_thread_target(f), *args)


def join(**tasks) -> dict:
    """Run functions, or (function, *arguments), at the same time; results by name. All finish before the first error (in
    the order of declaration) is raised."""
    if len(tasks) < 2:
        return {n: (t[0](*t[1:]) if isinstance(t, tuple) else t()) for n, t in tasks.items()}
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = {n: _started(pool, t) for n, t in tasks.items()}
    return {n: r.result() for n, r in running.items()}


try_join = join


class Scope:
    """Collects tasks and runs them when it is waited for, or left."""

    def __init__(self):
        self.tasks: list = []

    def spawn(self, f: Callable, *args) -> None:
        if len(self.tasks) >= MOST_TASKS:
            raise ValueError(f"a scope takes at most {MOST_TASKS} tasks")
        self.tasks.append((f, *args))

    spawn_with_context = spawn

    def wait(self) -> list:
        tasks, self.tasks = self.tasks, []
        return list(join(**{str(n): t for n, t in enumerate(tasks)}).values())


@contextmanager
def scope() -> Iterator[Scope]:
    s = Scope()
    yield s
    s.wait()


scope_with_context = scope


def spawn(f: Callable, *args):
    """Runs the task at once; a deferred one belongs in a scope."""
    return f(*args)


spawn_with_context = spawn


def broadcast(spark: SparkSession, f: Callable[[int], object], kind: str = "string") -> DataFrame:
    """worker, value of ``f`` for each worker number, one task for each."""
    n = num_workers(spark)

    def run(frames):
        for pdf in frames:
            yield pdf.assign(worker=pdf["id"], value=[f(int(i)) for i in pdf["id"]])[["worker", "value"]]

    return spark.range(0, n, 1, n).mapInPandas(run, f"worker long, value {kind}")


def parallel_for(spark: SparkSession, n: int, body: Callable[[int, int], object], kind: str = "bigint", grain: int | None = None) -> DataFrame:
    """start, end, value of ``body(start, end)`` over disjoint ranges that cover [0, n); never called for n = 0."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            if len(pdf):
                s, e = int(pdf["id"].iloc[0]), int(pdf["id"].iloc[-1]) + 1
                yield pd.DataFrame({"start": [s], "end": [e], "value": [body(s, e)]})

    ids = spark.range(0, n, 1, max(1, -(-n // grain))) if grain else spark.range(0, n)
    return ids.mapInPandas(run, f"start long, end long, value {kind}")


def parallel_for_with_grain(spark: SparkSession, n: int, grain: int, body: Callable[[int, int], object], kind: str = "bigint") -> DataFrame:
    return parallel_for(spark, n, body, kind, grain)


def parallel_for_with_early_exit(seq: Seq, stop: Fn) -> bool:
    """Whether some value asks to stop; partitions after the first one that does aren't run."""
    return not seq.df.filter(F.coalesce(stop(F.col("v")), F.lit(False))).isEmpty()


def parallel_for_range(spark: SparkSession, start: int, end: int, aggregate: Fn) -> DataFrame:
    """An aggregate over the indices of [start, end)."""
    return Seq.range(spark, start, end).df.agg(aggregate(F.col("v")).alias("reduce"))


def parallel_for_range_with_context(spark: SparkSession, start: int, end: int, aggregate: Callable[..., Column], **context) -> DataFrame:
    """The same with ``aggregate(index, **context)``; plain context values become literals."""
    return parallel_for_range(spark, start, end, lambda i: aggregate(i, **{k: x if isinstance(x, Column) else F.lit(x) for k, x in context.items()}))


def broadcast_with_context(spark: SparkSession, f: Callable[[int, object], object], context, kind: str = "string") -> DataFrame:
    """worker, value of ``f(worker, context)``; the context is sent along with the function."""
    return broadcast(spark, lambda worker: f(worker, context), kind)


def gather_all(df: DataFrame, share: Callable, workers: int | None = None) -> DataFrame:
    """worker, share, total: ``share(batches)`` of each worker's part of the rows (Arrow batches in, an integer out), and the sum
    of all. Workers run together, as one barrier stage, and exchange their shares; if one is lost, all start again. There have
    to be as many slots as workers (default: tasks that run at a time)."""
    n = workers or num_workers(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        context, own = BarrierTaskContext.get(), int(share(batches))
        total = sum(map(int, context.allGather(str(own))))
        yield pa.RecordBatch.from_pydict({"worker": pa.array([context.partitionId()], pa.int64()), "share": pa.array([own], pa.int64()), "total": pa.array([total], pa.int64())})

    return df.repartition(n).mapInArrow(run, "worker long, share long, total long", barrier=True)
