"""Arrow batches in parts, so that what Python makes of them is bounded in bytes whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

Batch = TypeVar("Batch", pa.RecordBatch, pa.Array)


def slices(batch: Batch, most: int = 1 << 22, rows: int = 1024) -> Iterator[Batch]:
    """Parts of some ``most`` bytes, of ``rows`` rows at most, in order; a part has a row at least."""
    n = len(batch) if isinstance(batch, pa.Array) else batch.num_rows
    step = max(1, min(rows, n * most // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def of_each(texts: pa.Array, fn: Callable[[str], str]) -> pa.Array:
    """A function's text for each text that isn't null, the texts of a part in Python at a time."""
    parts = [pa.array([None if t is None else fn(t) for t in part.to_pylist()], pa.string()) for part in slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
