"""Arrow batches a few texts at a time, so that what a task holds follows from bytes, not rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 4 << 20  # bytes of texts, or 16 for each entry of lists, that are worked on at once


def _is_list(kind: pa.DataType) -> bool:
    return pa.types.is_list(kind) or pa.types.is_large_list(kind)


def slices(column: pa.Array, most: int = MOST) -> Iterator[pa.Array]:
    """Consecutive rows of at most `most` bytes, one row at least; a batch without rows is one."""
    size = pc.list_value_length(column) if _is_list(column.type) else pc.binary_length(column)
    held = np.cumsum(np.asarray(pc.fill_null(size, 0)).astype(np.int64) * (16 if _is_list(column.type) else 1))
    start = 0
    while True:
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + most, side="right")))
        yield column.slice(start, end - start)
        start = end
        if start >= len(column):
            return


def in_slices(run: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The same function of a batch, row by row results of its slices put together."""
    return lambda column: pa.concat_arrays([run(part) for part in slices(column)])
