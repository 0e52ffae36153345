"""Queries of problem 1 over the tables chunks, index_runs and index_ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import pending
from ..sources.tables import table


def p1_pending(spark: SparkSession, folder: str) -> DataFrame:
    return pending(table(spark, folder, "chunks"), table(spark, folder, "index_ledger"), table(spark, folder, "index_runs"), carry=("fileId",))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pending(spark, folder).select("id")


_STATE = """
WITH last_log AS (
  SELECT runId, lower(trim(status)) AS status, row_number() OVER (PARTITION BY runId ORDER BY loggedAt DESC NULLS LAST, lower(trim(status)) DESC) AS k FROM index_runs),
good AS (SELECT runId FROM last_log WHERE k = 1 AND status = 'succeeded'),
deciding AS (
  SELECT chunkId, lower(hash) AS hash, row_number() OVER (PARTITION BY chunkId ORDER BY runId DESC, processedAt DESC NULLS LAST, lower(hash) DESC) AS k
  FROM index_ledger WHERE runId IN (SELECT runId FROM good)),
done AS (SELECT chunkId, hash FROM deciding WHERE k = 1),
now AS (
  SELECT id, fileId, lower(hash) AS hash, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_pending": p1_pending}
ORACLES = {
    "p1_found": _STATE + "SELECT id FROM now LEFT JOIN done ON id = chunkId WHERE k = 1 AND (chunkId IS NULL OR now.hash IS NULL OR done.hash IS NULL OR now.hash <> done.hash)",
    "p1_pending": _STATE + """SELECT id, now.hash AS hash, CASE WHEN chunkId IS NULL THEN 'new' WHEN now.hash IS NULL THEN 'unhashed' ELSE 'changed' END AS reason, fileId
      FROM now LEFT JOIN done ON id = chunkId WHERE k = 1 AND (chunkId IS NULL OR now.hash IS NULL OR done.hash IS NULL OR now.hash <> done.hash)""",
}
