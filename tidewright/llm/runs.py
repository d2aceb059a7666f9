"""Runs of equal keys in the sorted rows of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal values in the columns of `by`, of rows sorted by them; many short runs in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy() for c in by]
        last = np.logical_or.reduce([c != c[-1] for c in cols])
        cut_at = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        same = held and all(held[-1][c][-1].as_py() == batch[c][0].as_py() for c in by)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def bounds(t: pa.Table, by: list[str]) -> np.ndarray:
    """Where the runs of a table begin, and its length."""
    cols = [t[c].to_numpy() for c in by]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols]) if t.num_rows > 1 else np.empty(0, bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
