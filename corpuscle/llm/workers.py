"""Python workers that stay small."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def frugal(run):
    """run, a function from Arrow batches to Arrow batches, after which its worker gives freed memory back.

    Executors keep their workers for later tasks, also those of other stages; what they hold then is no one else's.
    """

    def kept(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return kept
