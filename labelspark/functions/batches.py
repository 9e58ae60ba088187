"""Python functions over Arrow batches in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

SLICE_ROWS = 64  # rows that are Python objects at a time


def in_slices(values: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    """``function`` of every value.  However long a batch is, only a slice of it is held as Python objects besides its Arrow form."""
    done = [pa.array(map(function, values.slice(at, SLICE_ROWS).to_pylist()), kind) for at in range(0, len(values), SLICE_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)
