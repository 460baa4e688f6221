"""Vectors as whole numbers, so that their sums and products don't depend on order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 64
#: Scaled components must be smaller: with 64 of them, squared distances and products stay under 2**62.
LIMIT = 1 << 26


def whole(column: str) -> Column:
    """floor(SCALE * x) of each component; a component that would overflow sums is an error, never a wrong number."""
    fits = F.forall(column, lambda x: F.abs(x.cast("double")) * SCALE < LIMIT)
    made = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE))
    return F.when(fits, made).otherwise(F.raise_error(F.lit(f"a component is {LIMIT // SCALE} or more")))


def usable(column: str) -> Column:
    """Whether a vector is there and none of its components is null or not finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & finite


def flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a column of lists one after another, and each list's length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
