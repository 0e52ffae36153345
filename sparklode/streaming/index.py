"""Keeping a store of chunks up to date from a stream of chunk files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import CommitLog, run_once

CHUNKS = "id string, fileId string, moduleId string, startLine int, endLine int, symbolId string, symbolName string, symbolKind string, kind string, text string, tokens array<string>, hash string, seenAt timestamp_ntz"


def follow(spark: SparkSession, folder: str, log: CommitLog, checkpoint: str, handle: Callable[[DataFrame], None] | None = None, once: bool = True, produce: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> StreamingQuery:
    """Hands the new and changed chunks of each arriving batch of Parquet files to `handle`, through the commit log.

    What `produce` makes of a batch is committed with its watermark. A micro-batch that is repeated after a failure finds its rows recorded and hands over none twice. With `once`, what is there
    is taken and the query ends. Late and outdated rows within a batch lose against the current one; a late row with an older
    hash than the recorded one is handed over as changed, as the log knows hashes, not times.
    """
    stream = spark.readStream.schema(CHUNKS).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: run_once(log, batch, handle, produce) and None)
    return writer.trigger(availableNow=True).start() if once else writer.start()
