"""Python workers that give memory back.

A worker outlives its task, and a core has one for each Python step of a stage.
Freed buffers stay with Arrow's pool and the C allocator unless they are asked
for, so idle workers would count with all that their largest task ever held.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory of this process to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def freeing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` over batches, memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def freeing_group(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``task`` over one group, memory given back before each: what the group before held is freed by then."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        return task(table)

    return run
