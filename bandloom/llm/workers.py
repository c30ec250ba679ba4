"""Memory of Python workers, which outlive their partitions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

Step = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def give_back() -> None:
    """Return to the machine what this process has freed and keeps for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(step: Step) -> Step:
    """`step`, after whose last batch the process gives freed memory back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(batches)
        give_back()

    return run
