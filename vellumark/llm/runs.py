"""Groups of rows with an equal key, met as runs of a sorted stream.

``repartition(key)`` and ``sortWithinPartitions(key)`` put each group together; this reads the Arrow stream and hands
over whole groups, holding one batch and one group at most. Millions of small groups cost no more than their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, bounds): rows ordered by the first ``keys`` columns, and where each group starts, with the end.

    All columns are read as numpy arrays (no nulls). The last group of a batch waits for the next batch.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        bounds = np.flatnonzero(new)
        last = bounds[-1]
        held = [c[last:].copy() for c in cols]
        if last:
            yield [c[:last] for c in cols], bounds
    if held is not None:
        yield held, np.array([0, len(held[0])])
