"""Small helpers shared by this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step handles at once; one longer text is a step of its own.
STEP_BYTES = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that memory does not follow the length of texts."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(size) or size[-1] <= most:
            yield b
            continue
        at = 0
        while at < len(size):
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end
