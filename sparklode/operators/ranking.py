"""Ranks over groups of any size, top lists and exact neighbour search in blocks."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ranked(rows: DataFrame, group: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """`rows` with their place, from 1, in the order of their group.

    A group may hold all rows, so no window sorts a whole one: rows are range-partitioned by group and order, numbered within
    their partition, and the counts of the partitions before are added. `order` should decide every tie; rows it leaves equal
    stay in one partition in any order.
    """
    parts = stored(rows.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    return parts.withColumn("__k", inner).join(offsets, [group, "__part"]).withColumn(name, F.col("__k") + F.col("__before")).drop("__part", "__before", "__k")


def top(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with `rank`. Spark cuts each task's part to k rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def reciprocal_ranks(lists: Sequence[DataFrame], group: str, key: str, k: int = 60) -> DataFrame:
    """group, key and fused, the sum of 1 / (k + rank) over lists with group, key and rank."""
    parts = [r.select(group, key, (1.0 / (F.lit(k) + F.col("rank"))).alias("__r")) for r in lists]
    all_of = parts[0]
    for part in parts[1:]:
        all_of = all_of.unionByName(part)
    return all_of.groupBy(group, key).agg(F.sum("__r").alias("fused"))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """query, key, similarity and rank of the k rows with the highest cosine to each query, the query's own row left out; ties by key.

    Exact: every row meets every query, in blocks of `block` queries against batches of rows as matrix products, one block after the
    other in a task. Each task keeps k rows a query and batch, so what is shuffled does not grow with the pairs. Null vectors and vectors of another length than a
    query's have no similarity; zero vectors have similarity 0. An empty table on either side gives an empty result.
    """
    kind = rows.schema[key].dataType.simpleString()
    numbered = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    several = -(-numbered.count() // (64 * block))  # 64 blocks are broadcast at once: a bounded matrix
    if several > 1:
        group = F.pmod(F.xxhash64(key), F.lit(several))
        parts = [nearest(rows, queries.where(group == g), key, vector, k, block) for g in range(several)]
        return functools.reduce(DataFrame.unionByName, parts)
    asked = numbered.toArrow()
    lists = asked.column(1).combine_chunks()
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    matrices = []
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        matrices.append((w, asked.column(0).take(pa.array(at)).combine_chunks(), _unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w))))
    shared = rows.sparkSession.sparkContext.broadcast(matrices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for w, ids, matrix in shared.value:
                at = np.flatnonzero(widths == w)
                if not len(at):
                    continue
                held = _unit(np.nan_to_num(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(at), w))
                take = min(k + 1, len(at))
                for a in range(0, len(matrix), block):
                    score = np.clip(matrix[a : a + block] @ held.T, -1, 1)
                    best = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    # rows tied with the last one taken are kept, so that the key can decide
                    floor = np.take_along_axis(score, best, 1).min(1)
                    q, r = np.nonzero(score >= floor[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + q)), batch.column(0).take(pa.array(at[r])), pa.array(score[q, r])], ["query", "key", "similarity"])

    found = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"query {kind}, key {kind}, similarity double")
    return top(found.where("query != key").withColumn("similarity", F.round("similarity", 6)), "query", [F.desc("similarity"), F.col("key")], k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
