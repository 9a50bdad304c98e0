"""What a Python worker remembers between tasks, held by one operator at a time.

Spark hands a worker from job to job. An operator that keeps something across
tasks registers how to forget it; when another operator's task comes, that is
done and the memory goes back to the system, so that the bounds of several
operators never add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: str | None = None
_forget: list[Callable[[], None]] = []


def forgettable(clear: Callable[[], None]) -> None:
    _forget.append(clear)


def claim(owner: str) -> None:
    """Called by a task before it works."""
    global _owner
    if _owner == owner:
        return
    for clear in _forget:
        clear()
    gc.collect()
    rest()
    _owner = owner


def rest() -> None:
    """Called by a task when it has worked: what it no longer uses goes back to the system, which may start no other Python for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
