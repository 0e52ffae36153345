"""Readers of the project's Parquet tables and the rule for their current rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; Parquet carries the schema, nothing is inferred."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest_first(at: str) -> Column:
    """`at` as an ordering in which a null counts as older than every time."""
    return F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def current_rows(df: DataFrame, columns: Sequence[str], key: str = "id", at: str = "seenAt") -> DataFrame:
    """One row per `key`: that with the latest `at`, with `key` and `columns` only.

    One shuffle on `key`, of the named columns alone. Rows equal in `at` are copies, so any of them is the current row. A null
    `at` is older than any other; rows with a null `key` identify nothing and are left out. An empty table gives an empty one.
    """
    held = [c for c in columns if c != key]
    latest = F.max_by(F.struct(*[F.col(c) for c in held]), newest_first(at)).alias("__row")
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(latest)
    return rows.select(F.col(key), *[F.col("__row")[c].alias(c) for c in held])


#: Slots of the filter that names keys with several rows, 64 to a number: at most 262,144 rows of two numbers are broadcast.
SLOTS = 1 << 24


def settled(df: DataFrame, columns: Sequence[str], key: str = "id", at: str = "seenAt", slots: int = SLOTS) -> DataFrame:
    """The rows of `current_rows`, where only keys that have several rows are shuffled with their columns.

    The hashes of all keys are counted first (one number a row); those that occur more than once set a bit in a filter of fixed
    size. A row whose bit is not set is the only one of its key and stays where it is read. The others, and few that share a bit
    by chance, take the shuffle of `current_rows`: should the repeated keys ever fill the filter, all rows do. For columns that
    are wide next to the key, such as texts and lists; the table is read twice for it. A table of fewer splits than there are cores
    takes the shuffle of `current_rows` altogether: it is small, and what follows would else run in as few tasks. Nulls and ties as
    in `current_rows`.
    """
    held = [c for c in columns if c != key]
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return current_rows(df, held, key, at)
    hashed = F.pmod(F.xxhash64(key), F.lit(slots))
    rows = df.where(F.col(key).isNotNull()).select(*{c: F.col(c) for c in (key, at, *held)}.values())
    repeated = rows.select(F.xxhash64(key).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = F.pmod("h", F.lit(slots))
    filled = repeated.groupBy(F.shiftright(slot, 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))).alias("__bits"))
    marked = rows.withColumn("__word", F.shiftright(hashed, 6)).join(F.broadcast(filled), "__word", "left")
    several = F.coalesce(F.bit_get("__bits", (hashed % 64).cast("int")) == 1, F.lit(False))
    alone = marked.where(~several).select(key, *held)
    return alone.unionByName(current_rows(marked.where(several), held, key, at))
