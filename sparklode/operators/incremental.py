"""Processing only new or changed records, each exactly once.

The commit sequence is the run number: it only grows, and a run counts only after its `succeeded` entry is in the run log, so
whatever a failed run left in the ledger is invisible. A run fixes its upper bound before it reads anything; rows that later
runs add to the ledger meanwhile lie above the bound and can't shift under it. `commit` publishes a run's output and its
watermark with one atomic rename of one manifest: a crash before it leaves no trace that a reader sees, a crash after it leaves
a finished run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import current_rows, newest_first

LEDGER_SCHEMA = "runId int, chunkId string, fileId string, hash string, processedAt timestamp_ntz"


def final_status(runs: DataFrame) -> DataFrame:
    """One row per runId: the status, trimmed and in lower case, of its latest log row; of equal times the alphabetically last."""
    last = F.max_by(F.lower(F.trim("status")), F.struct(newest_first("loggedAt"), F.lower(F.trim("status"))))
    return runs.where(F.col("runId").isNotNull()).groupBy("runId").agg(last.alias("status"))


def upper_bound(runs: DataFrame) -> int:
    """The highest runId in the log at the start, -1 for an empty log: the limit this run reads up to. One number reaches the driver."""
    row = runs.agg(F.max("runId").alias("upper")).first()
    return -1 if row is None or row.upper is None else int(row.upper)


def committed_state(ledger: DataFrame, runs: DataFrame, upper: int) -> DataFrame:
    """chunkId, hash and runId that the succeeded runs up to `upper` recorded last for each chunk.

    The run numbers of succeeded runs are joined before the shuffle on chunkId; the run log does not grow with the corpus, but
    only Spark's own size check may broadcast it.
    """
    good = final_status(runs).where((F.col("status") == "succeeded") & (F.col("runId") <= upper)).select("runId")
    seen = ledger.where((F.col("runId") <= upper) & F.col("chunkId").isNotNull())
    seen = seen.select("runId", "chunkId", newest_first("processedAt").alias("__at"), F.lower("hash").alias("hash"))
    last = F.max_by(F.struct("hash", "runId"), F.struct("runId", "__at", "hash")).alias("__last")
    return seen.join(good, "runId", "left_semi").groupBy("chunkId").agg(last).select("chunkId", "__last.hash", "__last.runId")


def pending(rows: DataFrame, ledger: DataFrame, runs: DataFrame, upper: int | None = None, key: str = "id", at: str = "seenAt", hash_column: str = "hash", carry: tuple[str, ...] = ()) -> DataFrame:
    """The current rows that no succeeded run up to `upper` has recorded with their present hash: key, hash, reason and `carry`.

    reason is `new` (no counting ledger row), `unhashed` (null hash, so nothing proves it unchanged) or `changed`. Letter case of a
    hash does not matter. A ledger row with a null hash never equals a hash. Only key, hash, time and `carry` are shuffled, on the
    unique key, so a module holding a third of all rows spreads evenly. Empty rows give an empty result; an empty ledger or log
    makes every row new. Extra columns are not read.
    """
    upper = upper_bound(runs) if upper is None else upper
    now = current_rows(rows, [hash_column, *carry], key, at).withColumn("__hash", F.lower(hash_column))
    state = committed_state(ledger, runs, upper).select(F.col("chunkId").alias("__id"), F.col("hash").alias("__done"))
    reason = F.when(F.col("__id").isNull(), "new").when(F.col("__hash").isNull(), "unhashed").when(~F.col("__hash").eqNullSafe(F.col("__done")), "changed")
    joined = now.join(state, now[key] == state["__id"], "left").withColumn("reason", reason)
    return joined.where(F.col("reason").isNotNull()).select(key, F.col("__hash").alias("hash"), "reason", *carry)


class CommitLog:
    """A folder of numbered manifests on any Hadoop file system; manifest n holds run n's watermark and the names of its outputs.

    `watermark` is the highest number present. Output without a manifest belongs to a failed run: no reader opens it, and
    `vacuum` removes it. A manifest may carry a snapshot of the ledger up to its run (see `compact`), so that a reader opens the
    manifests after the last snapshot only, however many runs there were.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def sequence(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit())

    def watermark(self) -> int:
        return max(self.sequence(), default=0)

    def manifest(self, number: int) -> dict:
        return self._read("commits", f"{number:012d}.json")

    def _read(self, *parts: str) -> dict:
        stream = self._fs.open(self._path(*parts))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _since_snapshot(self, upper: int | None) -> tuple[str | None, list[int]]:
        """The latest snapshot that goes no further than `upper`, if any, and the numbers of the runs after it."""
        numbers = [n for n in self.sequence() if upper is None or n <= upper]
        last = numbers[-1] if numbers else 0
        taken = max((n for n in (int(x[5:-5]) for x in self._names("snapshots") if x.startswith("upto-") and x.endswith(".json")) if n <= last), default=0)
        if not taken:
            return None, numbers
        return self._read("snapshots", f"upto-{taken:012d}.json")["output"], [n for n in numbers if n > taken]

    def ledger(self, upper: int | None = None) -> DataFrame:
        """What the committed runs up to `upper` handed over; of runs before the last snapshot the deciding row of each chunk."""
        snapshot, numbers = self._since_snapshot(upper)
        paths = [f"{self.root}/data/{m['output']}" for m in map(self.manifest, numbers) if m["rows"]]
        if snapshot:
            paths.append(f"{self.root}/snapshots/{snapshot}")
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def results(self, name: str = "result", upper: int | None = None) -> DataFrame | None:
        """What `produce` made in the committed runs up to `upper`, None if nothing yet. Rows of failed runs are never among them."""
        numbers = [n for n in self.sequence() if upper is None or n <= upper]
        paths = [f"{self.root}/data/{m['output']}-{name}" for m in map(self.manifest, numbers) if name in m.get("results", ())]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self) -> int:
        """Writes one snapshot of the ledger up to the watermark, with the deciding row of each chunk, and gives its number. It becomes
        visible by one rename like a manifest, and the ledger reads the same before and after; run it every hundred runs or so."""
        upper = self.watermark()
        _, numbers = self._since_snapshot(upper)
        if not numbers:
            return upper
        last = F.max_by(F.struct("runId", "fileId", "hash", "processedAt"), F.struct("runId", newest_first("processedAt"), F.lower("hash"))).alias("r")
        output = f"ledger-{upper:012d}-{uuid.uuid4().hex[:8]}"
        rows = self.ledger(upper).groupBy("chunkId").agg(last).select("r.runId", "chunkId", "r.fileId", "r.hash", "r.processedAt")
        rows.write.mode("errorifexists").parquet(f"{self.root}/snapshots/{output}")
        try:
            self._publish({"upTo": upper, "output": output}, "snapshots", f"upto-{upper:012d}.json")
        except Exception:  # noqa: BLE001 - another compaction was first; its snapshot says the same
            self._fs.delete(self._path("snapshots", output), True)
        return upper

    def runs(self) -> DataFrame:
        """The log in the form of index_runs; only what has a manifest succeeded."""
        rows = [(n, "succeeded", None) for n in self.sequence()]  # two numbers a run; nothing is opened for them
        return self.spark.createDataFrame(rows, "runId int, status string, loggedAt timestamp_ntz")

    def commit(self, number: int, output: str, rows: int, upper: int, results: Sequence[str] = ()) -> None:
        """Publishes run `number` with all its outputs. Raises if another run took the number first: its writer must plan again."""
        try:
            self._publish({"run": number, "output": output, "rows": rows, "readUpTo": upper, "results": list(results)}, "commits", f"{number:012d}.json")
        except Exception as error:
            raise RuntimeError(f"run {number} is committed already") from error

    def _publish(self, body: dict, folder: str, name: str) -> None:
        """One file, whole or not at all: written under another name and renamed, which fails if the name is taken."""
        staged = self._path(folder, f".{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, self._path(folder, name), none)
        except Exception:
            self._fs.delete(staged, False)
            raise

    def vacuum(self) -> list[str]:
        """Removes and names the output of runs that never committed; call it while no run is active."""
        kept = set()
        for n in self.sequence():
            m = self.manifest(n)
            kept |= {m["output"], *[f"{m['output']}-{r}" for r in m.get("results", ())]}
        lost = [n for n in self._names("data") if n not in kept]
        for name in lost:
            self._fs.delete(self._path("data", name), True)
        return lost


def run_once(log: CommitLog, rows: DataFrame, process: Callable[[DataFrame], None] | None = None, produce: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> dict:
    """One run: fixes the bound, hands the pending rows over, then commits them, what was made of them and the new watermark at once.

    The plan is written once to the run's own folder and what follows reads that file, so a retried task or a second look at `rows`
    can't hand over anything else than what is committed. `produce` gives named results of the handed rows; they are written
    beside them and become visible with the same manifest as the watermark (`CommitLog.results`), so no result is ever half there,
    missing or repeated. `process` is for effects elsewhere, which this log can't roll back: it must itself be idempotent per
    folder. If either or a write fails, nothing is committed and the next run hands over the same rows again; after a commit it
    never does.
    """
    upper = log.watermark()
    number, output = upper + 1, f"run-{upper + 1:012d}-{uuid.uuid4().hex[:8]}"
    todo = pending(rows, log.ledger(upper), log.runs(), upper, carry=("fileId",))
    at = F.current_timestamp().cast("timestamp_ntz")
    done = todo.select(F.lit(number).alias("runId"), F.col("id").alias("chunkId"), "fileId", "hash", at.alias("processedAt"))
    path = f"{log.root}/data/{output}"
    done.write.mode("errorifexists").parquet(path)
    handed = log.spark.read.schema(LEDGER_SCHEMA).parquet(path)
    count = handed.count()
    results: list[str] = []
    if count:
        for name, made in (produce(handed) if produce else {}).items():
            made.write.mode("errorifexists").parquet(f"{path}-{name}")
            results.append(name)
        if process is not None:
            process(handed)
    log.commit(number, output, count, upper, results)
    return {"run": number, "rows": count, "readUpTo": upper}
