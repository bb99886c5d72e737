"""What a Python worker keeps between its tasks: the tables of one operator at a time.

Spark reuses a worker for the tasks of any operator, so without this the tables
of all that ran before would stay beside those of the present one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_drops: dict[str, list[Callable[[], None]]] = {}
_owner: list[str] = []


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """``drop`` empties a table that ``owner`` keeps in this process."""
    _drops.setdefault(owner, []).append(drop)


def works_for(owner: str) -> None:
    """Called at the start of a task: where another operator worked here before, its tables go and freed memory returns to the system."""
    if _owner == [owner]:
        return
    worked, _owner[:] = bool(_owner), [owner]
    if not worked:
        return
    for name, drops in _drops.items():
        if name != owner:
            for drop in drops:
                drop()
    release()


def release() -> None:
    """Give memory that Python, Arrow and the C library hold free back to the system; the last where it has such a call."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
