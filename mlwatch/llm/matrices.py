"""List columns of Arrow batches as matrices, with exact sums of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Sums that stay under this can be taken in 64 bits.
SAFE = 1 << 62


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of a column of lists without nulls, one for each length that occurs."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        some = column if len(at) == len(column) else column.take(pa.array(at))
        yield length, at, some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)


def exact_sums(values: np.ndarray, bound: int) -> list[int]:
    """Column sums of whole numbers, exact; ``bound`` is the largest size of one value."""
    if bound * max(1, len(values)) < SAFE:
        return values.sum(axis=0, dtype=np.int64).tolist()
    return values.astype(object).sum(axis=0).tolist() if len(values) else [0] * values.shape[1]
