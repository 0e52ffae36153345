"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plan quality; sizes stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "sparklode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` (dots as `__`) and the submitter's settings go before them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode alone a fresh temporary one.

    On a cluster with the setting missing this raises: a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    if held := context.getCheckpointDir():
        return held
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="sparklode-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


_kept: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared checkpoint folder and read back: its lineage is cut, columns are pruned when it is
    read, and values such as monotonically_increasing_id stay what they were. `release` removes what was stored, at the latest
    when the driver ends."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(release)
    _kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(keep: Sequence[str] = ()) -> int:
    """Removes what `stored` has written in this driver, apart from paths in `keep`, and gives how many folders that were. For a
    service that runs many queries: call it when no result that reads them is in use any more."""
    gone = 0
    for path in [p for p in _kept if p not in keep]:
        try:
            jvm = SparkContext._jvm
            file = jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(file.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(file, True))
        except Exception:  # noqa: BLE001 - the JVM may be gone before the driver's Python
            continue
        finally:
            _kept.remove(path)
    return gone
