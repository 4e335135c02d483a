"""Session and configuration: the counterpart of a thread pool's start-up calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

DEFAULT_GRAIN = 65536


class AlreadyInitialized(RuntimeError):
    """A second ``init`` without ``deinit``."""


@dataclass(frozen=True)
class Config:
    """``workers``: threads of a local session (None: one for each CPU); ``master`` and ``options`` go to Spark as they are."""

    workers: int | None = None
    master: str | None = None
    app_name: str = "parseq"
    options: tuple[tuple[str, str], ...] = ()


_state: dict = {"spark": None, "grain": DEFAULT_GRAIN, "seen": set()}


def init(config: Config | None = None) -> SparkSession:
    if _state["spark"] is not None:
        raise AlreadyInitialized("init() was called before")
    config = config or Config()
    builder = SparkSession.builder.appName(config.app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if config.master or config.workers:
        builder = builder.master(config.master or f"local[{config.workers}]")
    for k, v in config.options:
        builder = builder.config(k, v)
    _state["spark"] = builder.getOrCreate()
    return _state["spark"]


init_with_config = init


def deinit(stop: bool = True) -> None:
    from .seq import release

    spark, _state["spark"] = _state["spark"], None
    if spark is not None:
        release(spark)
    if spark is not None and stop:
        spark.stop()


def is_initialized() -> bool:
    return _state["spark"] is not None


def num_workers(spark: SparkSession | None = None) -> int:
    """Tasks that run at a time; 1 without a session."""
    spark = spark or _state["spark"] or SparkSession.getActiveSession()
    return 1 if spark is None else max(1, spark.sparkContext.defaultParallelism)


def get_grain_size() -> int:
    return _state["grain"]


def set_grain_size(n: int) -> None:
    """Rows per task for the ``with_grain`` forms; 0 goes back to the default."""
    if n < 0:
        raise ValueError("grain must not be negative")
    _state["grain"] = n or DEFAULT_GRAIN


def default_grain_size() -> int:
    return DEFAULT_GRAIN


def get_stats(spark: SparkSession | None = None) -> dict[str, int]:
    """Jobs started since :func:`reset_stats` in this thread's job group (or outside any), and jobs and stages that run now,
    from Spark's status tracker."""
    spark = spark or _state["spark"] or SparkSession.getActiveSession()
    if spark is None:
        return {"jobs": 0, "active_jobs": 0, "active_stages": 0}
    tracker = spark.sparkContext.statusTracker()
    return {"jobs": len(_jobs(spark) - _state["seen"]), "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds())}


def _jobs(spark: SparkSession) -> set[int]:
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup(spark.sparkContext.getLocalProperty("spark.jobGroup.id")))


def reset_stats(spark: SparkSession | None = None) -> None:
    """Count jobs from now on."""
    spark = spark or _state["spark"] or SparkSession.getActiveSession()
    _state["seen"] = set() if spark is None else _jobs(spark)
