"""Chunks that arrive as files are handed over once."""

import datetime as dt

from sparklode.operators.incremental import CommitLog
from sparklode.streaming.index import CHUNKS, follow


def test_files_arrive(spark, tmp_path):
    log, seen = CommitLog(spark, str(tmp_path / "state")), []
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def put(*rows):
        full = [tuple({"id": i, "fileId": "f", "hash": h, "seenAt": dt.datetime(2025, 1, 1) + dt.timedelta(hours=t)}.get(c) for c in columns) for i, h, t in rows]
        spark.createDataFrame(full, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        seen.clear()
        follow(spark, str(tmp_path / "in"), log, str(tmp_path / "stream"), lambda df: seen.extend(r.chunkId for r in df.collect())).awaitTermination()
        return sorted(seen)

    put(("a", "1", 0), ("b", "1", 0), ("a", "0", -1))
    assert run() == ["a", "b"]
    assert run() == []
    put(("a", "1", 1), ("b", "2", 1), ("c", "9", 1))
    assert run() == ["b", "c"]
