"""What the operators on embeddings share: which vectors count, and a batch's vectors by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """The vector isn't null and has no null, infinite or not-a-number entry."""
    own = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, own)


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows without nulls -> for each length, the places of the rows that have it and these as a matrix."""
    upto = lists.offsets.to_numpy().astype(np.int64)
    values, size = lists.values.to_numpy(zero_copy_only=False), np.diff(upto)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        if len(at) == len(size):
            yield at, values[upto[0] : upto[-1]].reshape(len(at), d)
        else:
            yield at, values[upto[at][:, None] + np.arange(d)]
