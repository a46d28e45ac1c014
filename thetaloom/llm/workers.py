"""What a Python worker gives back at the end of a task, so that a worker that goes on to other work doesn't hold it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from thetaloom.llm import ragged

LONG_ROWS = 1_000
"""Rows of an Arrow batch where rows are whole documents."""


def release() -> None:
    """Free memory that allocators hold back."""
    ragged.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def each(work: Callable[[pa.Array], pa.Array], batches: Iterator[pa.Array], *forgets: Callable[[], None]) -> Iterator[pa.Array]:
    """``work`` on each batch; at the end of the task ``forgets`` drop what the work kept."""
    try:
        for batch in batches:
            yield work(batch)
    finally:
        for forget in forgets:
            forget()
        release()
