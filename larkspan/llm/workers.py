"""Memory of Python workers.

A worker outlives its task and runs the next stage's tasks too. What the
allocators keep of a finished task counts on the executor all that time, once
for each worker, beside the JVM.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

RELEASE_BYTES = 1 << 22


def release() -> None:
    """Give what the allocators hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, with free Arrow memory given back every few MB read and all free memory at its end."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            read += batch.nbytes
            yield batch
            if read >= RELEASE_BYTES:
                del batch
                pa.default_memory_pool().release_unused()
                read = 0

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(counted(batches))
        finally:
            release()

    return tidied
