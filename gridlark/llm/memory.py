"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa

Batch = TypeVar("Batch")


def tidy(run: Callable[[Iterator[Batch]], Iterator[Batch]]) -> Callable[[Iterator[Batch]], Iterator[Batch]]:
    """The same function over batches; after a task's last batch freed memory goes back to the system.

    A worker stays for the next task, often of a stage that needs none of its memory but has to share the
    executor's with it. Both allocators keep what was freed unless they are asked.
    """

    @wraps(run)
    def whole(batches: Iterator[Batch]) -> Iterator[Batch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole
