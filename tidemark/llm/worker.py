"""What a Python worker keeps from one task to the next.

Workers are reused, and serve one operator after the other. A worker holds one thing at a time: whoever asks for
another one, or for none, frees what was held before, so that memos of stages that are over do not add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

Held = TypeVar("Held")
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], Held]) -> Held:
    """What the worker holds under ``key``; made anew if it holds something else."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Free what is held, and give the memory back to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
