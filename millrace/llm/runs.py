"""Reading sorted partitions run by run inside a task, without holding a whole group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first always does."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) \
        if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def whole_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches sorted by the keys.

    For groups of bounded size: a group that spans batches is gathered until it ends.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        new = np.flatnonzero(changes(*(numbers(table, k) for k in keys)))
        if new[-1] > 0:
            yield table.slice(0, int(new[-1]))
        held = table.slice(int(new[-1])).to_batches()
    if held:
        yield pa.Table.from_batches(held)
