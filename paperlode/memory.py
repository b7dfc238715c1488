"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def hand_back() -> None:
    """Memory that this process holds but no longer uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def handing_back(run: Run) -> Run:
    """``run`` over a task's batches; at its end, the Python worker hands memory back. Workers live on
    between tasks, beside those of other steps and the JVM of their executor, so what one keeps is
    missing to the others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return whole
