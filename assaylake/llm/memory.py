"""Memory of Python workers, which live on between tasks beside their executor's JVM."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _LIBC = ctypes.CDLL(None)
    #: Arrays from this size on go back to the system when they are freed (M_MMAP_THRESHOLD, which else grows by itself).
    _LIBC.mallopt(-3, 1 << 20)
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Returns what has been freed to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; what it has freed is returned when its task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def lean_group(run: Callable) -> Callable:
    """run(key, group), for applyInArrow; what it has freed is returned after each group."""

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        out = run(key, group)
        give_back()
        return out

    whole.__name__ = run.__name__
    return whole


def lean_cogroup(run: Callable) -> Callable:
    """run(key, one, other), for applyInArrow of two; what it has freed is returned after each group."""

    def whole(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        out = run(key, one, other)
        give_back()
        return out

    whole.__name__ = run.__name__
    return whole
