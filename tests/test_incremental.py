"""Problem 1: what a run hands over, and that it does so exactly once."""

import datetime as dt

import pytest

from sparklode.operators.incremental import CommitLog, pending, run_once, upper_bound

T0 = dt.datetime(2025, 1, 1)
CHUNKS = "id string, fileId string, hash string, seenAt timestamp_ntz, text string, runId int, status string"
LEDGER = "runId int, chunkId string, fileId string, moduleId string, hash string, processedAt timestamp_ntz"
RUNS = "runId int, status string, loggedAt timestamp_ntz, worker string"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def chunks(spark, *rows):
    return spark.createDataFrame([(i, "f", h, at(s), "x", 1, "clash") for i, h, s in rows], CHUNKS)


def ledger(spark, *rows):
    return spark.createDataFrame([(r, c, "f", "m", h, at(p)) for r, c, h, p in rows], LEDGER)


def runs(spark, *rows):
    return spark.createDataFrame([(r, s, at(t), None) for r, s, t in rows], RUNS)


def found(df):
    return {(r.id, r.reason) for r in df.collect()}


def test_only_succeeded_runs_count(spark):
    now = chunks(spark, ("a", "AA", 1), ("b", "bb", 1), ("c", "cc", 1), ("d", None, 1), ("e", "ee", 1), ("a", "AA", 1), ("e", "old", 0), (None, "zz", 1))
    done = ledger(spark, (1, "a", "aa", 1), (2, "b", "bb", 1), (3, "c", "old", 2), (1, "c", "cc", 5), (1, "d", "dd", 1), (1, "e", "old", 1), (1, "gone", "x", 1), (1, "a", "aa", 1), (None, "a", "zz", 9))
    log = runs(spark, (1, " Succeeded ", 2), (1, "started", 1), (2, "failed", 1), (3, "SUCCEEDED", 1), (3, "SUCCEEDED", 1), (4, "succeeded", 1), (4, "rolled_back", 2), (None, "succeeded", 1))
    assert found(pending(now, done, log)) == {("b", "new"), ("c", "changed"), ("d", "unhashed"), ("e", "changed")}


def test_the_bound_hides_later_runs(spark):
    now, done = chunks(spark, ("a", "1", 1)), ledger(spark, (5, "a", "1", 1))
    log = runs(spark, (5, "succeeded", 1))
    assert upper_bound(log) == 5 and found(pending(now, done, log)) == set()
    assert found(pending(now, done, log, upper=4)) == {("a", "new")}


def test_ties_nulls_and_empty_tables(spark):
    now = chunks(spark, ("a", "1", None), ("a", "2", 0))
    assert [r.hash for r in pending(now, ledger(spark), runs(spark)).collect()] == ["2"]
    assert pending(chunks(spark), ledger(spark, (1, "a", "1", 1)), runs(spark, (1, "succeeded", 1))).count() == 0
    assert upper_bound(runs(spark)) == -1
    log = runs(spark, (1, "succeeded", 1), (2, None, 1))
    assert found(pending(chunks(spark, ("a", "1", 1)), ledger(spark, (1, "a", None, 1)), log)) == {("a", "changed")}
    # the later processedAt decides within a run, a null one comes first
    tied = ledger(spark, (1, "a", "9", None), (1, "a", "1", 3), (1, "a", "8", 2))
    assert found(pending(chunks(spark, ("a", "1", 1)), tied, log)) == set()


def test_commit_log_hands_over_exactly_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "state"))
    now = chunks(spark, ("a", "1", 1), ("b", "2", 1))

    def fails(df):
        assert df.count() == 2
        raise OSError("executor lost")

    with pytest.raises(OSError):
        run_once(log, now, fails)
    assert log.watermark() == 0 and log.ledger().count() == 0
    seen = []
    assert run_once(log, now, lambda df: seen.extend(r.chunkId for r in df.collect()))["rows"] == 2
    assert sorted(seen) == ["a", "b"] and log.watermark() == 1
    assert run_once(log, now)["rows"] == 0
    later = chunks(spark, ("a", "1", 1), ("b", "3", 2), ("b", "2", 1), ("c", None, 1))
    assert run_once(log, later)["rows"] == 2
    # an unhashed row is handed over each time, as nothing proves it unchanged
    assert run_once(log, later)["rows"] == 1
    assert len(log.vacuum()) == 1 and log.ledger().count() == 5


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "state"))
    run_once(log, chunks(spark, ("a", "1", 1)))
    with pytest.raises(RuntimeError, match="committed already"):
        log.commit(1, "other", 0, 0)
    assert log.manifest(1)["rows"] == 1 and log.sequence() == [1]


def test_results_are_committed_with_the_watermark(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "state"))
    now = chunks(spark, ("a", "1", 1), ("b", "2", 1))
    made = lambda df: {"names": df.select("chunkId", "hash")}

    def broken(df):
        return {"names": df.select("chunkId", "hash"), "other": df.selectExpr("assert_true(false, 'lost')")}

    assert log.results("names") is None
    with pytest.raises(Exception, match="lost"):
        run_once(log, now, produce=broken)
    assert log.watermark() == 0 and log.results("names") is None
    run_once(log, now, produce=made)
    run_once(log, now, produce=made)
    run_once(log, chunks(spark, ("a", "1", 1), ("b", "3", 2)), produce=made)
    assert sorted(tuple(r) for r in log.results("names").collect()) == [("a", "1"), ("b", "2"), ("b", "3")]
    assert [tuple(r) for r in log.results("names", upper=1).orderBy("chunkId").collect()] == [("a", "1"), ("b", "2")]
    assert len(log.vacuum()) == 3 and log.results("names").count() == 3  # all that the broken run left


def test_a_snapshot_changes_nothing_but_what_is_opened(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "state"))
    for k in range(4):
        run_once(log, chunks(spark, ("a", "1", 1), ("b", str(k), k)))
    last = lambda: sorted((r.chunkId, r.runId, r.hash) for r in log.ledger().collect())
    assert len(last()) == 5
    assert log.compact() == 4 and last() == [("a", 1, "1"), ("b", 4, "3")] and log.compact() == 4
    opened = []
    log.manifest = lambda n, read=log.manifest: opened.append(n) or read(n)
    assert run_once(log, chunks(spark, ("a", "1", 1), ("b", "9", 9)))["rows"] == 1 and opened == []
    assert last() == [("a", 1, "1"), ("b", 4, "3"), ("b", 5, "9")] and log.ledger(2).count() == 3
    assert run_once(log, chunks(spark, ("a", "1", 1), ("b", "9", 9)))["rows"] == 0
    assert log.compact() == 6 and last() == [("a", 1, "1"), ("b", 5, "9")]
