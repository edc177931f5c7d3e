"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

from stationdays.llm.tokens import forget_encoders

SECONDS = 1.0
"""A task that runs longer gives memory back on its way too, so often."""

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns to the machine what allocators keep of freed arrays, texts and batches.

    A worker that waits for its next task counts as memory of its executor all the while.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(rows: Rows, encodes: bool = False) -> Rows:
    """The same function of batches for a task that leaves no unused memory to its worker.

    One that doesn't encode also drops the pieces which encoding tasks before remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoders()
        last = time.monotonic()
        try:
            for batch in rows(batches):
                yield batch
                if time.monotonic() - last > SECONDS:
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return run
