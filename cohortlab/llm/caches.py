"""Memory of Python workers, which Spark keeps from task to task and from query to query.

A worker holds the caches of one operator: a task that starts under another name first drops
what the former one left (word ids, tree memos), so a session's memory does not add up. A
task also starts by giving back what the former one freed: allocators keep such pages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext

_HELD: dict[str, Callable[[], None]] = {}
_LAST: list[int] = []  # the task that ran here last


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def enter(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called by a task of operator ``name``, with what empties its caches, if it has any."""
    for other in [n for n in _HELD if n != name]:
        _HELD.pop(other)()
    if clear is not None:
        _HELD[name] = clear
    context = TaskContext.get()
    task = [context.taskAttemptId()] if context else []
    if task != _LAST:
        _LAST[:] = task
        _give_back()
