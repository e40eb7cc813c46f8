"""What a Python worker keeps between tasks: the tables of one operator at a time, so that operators that run one after another don't add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: dict = {}


def held(key, make: Callable):
    """The object kept under this key; making another lets go of what was kept before."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what is kept and gives free memory back to the system; operators without tables call it as a task begins."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
