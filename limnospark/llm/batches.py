"""Arrow batches cut into portions of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ship

ship(__name__)


def portions(b: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``b`` in order, whole rows: a new one starts where the text
    of ``column`` passes the next multiple of ``limit`` bytes."""
    if not len(b):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // limit)) + 1).tolist(), len(b)]
    for a, z in zip(cuts, cuts[1:]):
        yield b.slice(a, z - a)
