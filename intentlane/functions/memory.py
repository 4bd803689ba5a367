"""Memory of Python workers, which live on between tasks and stages."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system.
    An idle worker holds it otherwise, beside the busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # of glibc
    if trim is not None:
        trim(0)
