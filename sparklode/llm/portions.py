"""Arrow batches in portions of bounded size: a batch is bounded in rows, and rows can be long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def portions(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of whole rows that hold about `most` bytes (of texts) or entries (of lists) in `column`; a row with more is
    a slice of its own. An empty batch gives none."""
    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    part = (np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // most
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if batch.num_rows else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(int(a), int(b - a))
