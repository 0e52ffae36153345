"""Batches in portions."""

import pyarrow as pa

from sparklode.llm.portions import portions


def test_portions_keep_every_row():
    texts = ["aa", None, "", "b" * 50, "c", "d" * 9, None]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts), pa.array([[1] * len(t) if t else None for t in texts])], ["k", "t", "l"])
    for column in (1, 2):
        parts = list(portions(batch, column, 10))
        assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(7)) and len(parts) > 2
    assert list(portions(batch.slice(0, 0), 1, 10)) == []
