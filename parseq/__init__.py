"""parseq: ordered-sequence analytics on Spark DataFrames."""

from .seq import Seq, dense_index, scalar
from .session import Config, deinit, init, init_with_config, is_initialized, num_workers

#: The constructors under the names that collection libraries use; sequences are immutable, so both scans are one.
iter = iter_mut = Seq.of  # noqa: A001
range = Seq.range  # noqa: A001

__all__ = ["Config", "Seq", "deinit", "dense_index", "init", "init_with_config", "is_initialized", "iter", "iter_mut", "num_workers", "range", "scalar"]
