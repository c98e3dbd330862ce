import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracewell.operators.incremental import CommitLog, IncrementalJob, canonical_path, changed_records, replay

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
AT = [T0 + timedelta(hours=h) for h in range(12)]
SCAN = "scan_id long, path string, last_modified double, file_hash string, seen_at timestamp, run string"


def scans(spark, *r):
    return spark.createDataFrame([(*x, "clash") for x in r], SCAN)


def known(spark, *r):
    return spark.createDataFrame(list(r), "path string, file_hash string")


def test_paths_are_canonical(spark):
    df = spark.createDataFrame([("./a\\b.py",), ("././x",), (".hidden/y",), (None,)], "path string")
    assert rows(df.select(canonical_path(df.path))) == sorted([("a/b.py",), ("x",), (".hidden/y",), (None,)], key=repr)


def test_changes_per_commit(spark):
    s = scans(
        spark,
        (1, "a", 0.0, "H1", AT[1]),  # same content in upper case
        (2, "./b", 0.0, "h2", AT[1]),  # new
        (3, "b", 0.0, None, AT[2]),  # unreadable: passed over
        (4, "a", None, "h9", AT[3]),
        (4, "a", None, "h9", AT[3]),  # repeated
        (5, "c", 1.0, "x", AT[4]),
        (6, "c", 1.0, "y", AT[4]),  # same time: the larger scan_id counts
        (7, None, 1.0, "y", AT[4]),
        (8, "late", 1.0, "y", None),
        (9, "beyond", 1.0, "y", AT[11]),
    )
    got = rows(changed_records(s, known(spark, ("a", "h1"), ("gone", "g")), [AT[2], AT[4]]))
    assert got == sorted([(1, "b", "h2", None), (2, "a", "h9", "h1"), (2, "c", "y", None)], key=repr)


def test_back_to_the_old_content_is_a_change(spark):
    s = scans(spark, (1, "a", 0.0, "x", AT[1]), (2, "a", 0.0, "h", AT[3]))
    assert [r[:2] for r in rows(changed_records(s, known(spark, ("a", "h")), [AT[2], AT[4], AT[6]]))] == [(1, "a"), (2, "a")]


def test_there_and_back_between_commits_is_none(spark):
    s = scans(spark, (1, "a", 0.0, "x", AT[1]), (2, "a", 0.0, "h", AT[2]))
    assert rows(changed_records(s, known(spark, ("a", "h")), [AT[4]])) == []


def test_empty_inputs(spark):
    assert rows(changed_records(scans(spark), known(spark), [])) == []
    assert rows(changed_records(scans(spark, (1, "a", 0.0, "x", AT[1])), known(spark), [])) == []


def test_many_bounds_take_the_other_search(spark):
    bounds = [T0 + timedelta(minutes=m) for m in range(300)]
    s = scans(spark, (1, "a", 0.0, "x", T0 + timedelta(minutes=7, seconds=1)), (2, "a", 0.0, "y", T0 + timedelta(minutes=9)))
    assert sorted((r[0], r[2]) for r in rows(changed_records(s, known(spark), bounds))) == [(9, "x"), (10, "y")]


def test_descending_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        changed_records(scans(spark), known(spark), [AT[3], AT[1]])


def test_failed_runs_commit_nothing(spark):
    runs = spark.createDataFrame([(1, AT[2], "ok"), (2, AT[3], "failed"), (3, AT[5], "killed"), (4, AT[6], "ok")], "run_id int, started_at timestamp, status string")
    s = scans(spark, (1, "a", 0.0, "x", AT[1]), (2, "b", 0.0, "y", AT[3]), (3, "c", 0.0, "z", AT[6]))
    assert rows(replay(s, known(spark), runs), "run_id", "path") == [(1, "a"), (4, "b"), (4, "c")]


def sourced(df, seq):
    return df.withColumn("ingest_seq", F.lit(seq).cast("long"))


def test_job_survives_a_failure_exactly_once(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path))
    base = known(spark, ("a", "h0"))
    s = sourced(scans(spark, (1, "a", 0.0, "h1", AT[1]), (2, "b", 0.0, "b1", AT[1])), 1)
    assert job.run(s, base, AT[2]) == 1

    def breaks(df):
        df.write.format("noop").mode("overwrite").save()
        raise RuntimeError("lost")

    more = s.unionByName(sourced(scans(spark, (3, "a", 0.0, "h2", AT[3]), (4, "c", 0.0, "c1", AT[3]), (5, "early", 0.0, "l", AT[9])), 2))
    with pytest.raises(RuntimeError):
        job.run(more, base, AT[4], breaks)
    assert job.watermark()[:2] == (1, 1)
    assert job.run(more, base, AT[4]) == 2
    assert rows(job.output(), "_seq", "path", "file_hash") == [(1, "a", "h1"), (1, "b", "b1"), (2, "a", "h2"), (2, "c", "c1")]
    assert job.run(more, base, AT[5]) == 3
    assert job.output().where("_seq = 3").count() == 0
    # The row seen beyond the bounds waited, though its number lies behind the watermark.
    assert job.run(more, base, AT[10]) == 4
    assert rows(job.output().where("_seq = 4"), "path", "file_hash") == [("early", "l")]
    with pytest.raises(ValueError):
        job.run(more, base, AT[1])


def test_late_rows_are_processed_once(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path), compact_every=2)
    base = known(spark, ("a", "h0"))
    s = sourced(scans(spark, (1, "a", 0.0, "h5", AT[5]), (2, "b", 0.0, "b1", AT[5])), 1)
    job.run(s, base, AT[6])
    # Arriving after the commit: a new path seen before it, an old state of a path known better, and the state before that.
    s = s.unionByName(sourced(scans(spark, (3, "late", 0.0, "l", AT[2]), (4, "a", 0.0, "h2", AT[2]), (5, "b", 0.0, "b2", AT[6])), 2))
    job.run(s, base, AT[7])
    assert rows(job.output().where("_seq = 2"), "path", "file_hash", "previous_hash") == [("b", "b2", "b1"), ("late", "l", None)]
    for k in (8, 9, 10):
        job.run(s, base, AT[k])
    assert job.output().where("_seq > 2").count() == 0
    assert len(job.log.last()["chain"]) <= 2
    assert rows(job.known(base), "path", "file_hash") == [("a", "h5"), ("b", "b2"), ("late", "l")]


def test_rows_that_arrive_while_a_run_works_belong_to_the_next(spark, tmp_path):
    where = str(tmp_path / "scans")
    sourced(scans(spark, (1, "a", 0.0, "x", AT[1])), 1).write.parquet(where)
    job = IncrementalJob(spark, str(tmp_path / "job"))

    def slow(df):
        sourced(scans(spark, (2, "b", 0.0, "y", AT[1])), 2).write.mode("append").parquet(where)
        return df

    job.run(spark.read.parquet(where), known(spark), AT[2], slow)
    assert rows(job.output(), "path") == [("a",)] and job.watermark()[1] == 1
    job.run(spark.read.parquet(where), known(spark), AT[2], lambda df: df)
    assert rows(job.output(), "_seq", "path") == [(1, "a"), (2, "b")]


def test_run_by_run_equals_catching_up(spark, tmp_path):
    rng = random.Random(2)
    rows_in = [(i, f"p{rng.randint(0, 6)}", 0.0, rng.choice(["x", "y", "Z", None]), T0 + timedelta(minutes=rng.randint(0, 600))) for i in range(120)]
    s = sourced(scans(spark, *rows_in), 1)
    base = known(spark, ("p0", "x"), ("p1", "z"))
    bounds = [T0 + timedelta(minutes=m) for m in (50, 200, 210, 599)]
    job = IncrementalJob(spark, str(tmp_path / "single"))
    for b in bounds:
        job.run(s, base, b)
    single = rows(job.output(), "_seq", "path", "file_hash", "previous_hash")
    assert single == rows(changed_records(s, base, bounds), "run", "path", "file_hash", "previous_hash")
    runs = spark.createDataFrame([(k, b, "ok") for k, b in enumerate(bounds, 1)], "run_id int, started_at timestamp, status string")
    assert single == rows(replay(s, base, runs, str(tmp_path / "replay")), "run_id", "path", "file_hash", "previous_hash")


def test_a_commit_number_is_taken_once(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        tries = [pool.submit(CommitLog(spark, str(tmp_path)).commit, {"seq": 1, "by": k}) for k in range(16)]
    won = [k for k, t in enumerate(tries) if t.exception() is None]
    assert len(won) == 1 and job.log.entries() == [{"seq": 1, "by": won[0]}] and job.log.has(1) and not job.log.has(2)
    assert all(isinstance(t.exception(), RuntimeError) for k, t in enumerate(tries) if k not in won)


def test_a_crash_before_the_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    s, base = sourced(scans(spark, (1, "a", 0.0, "x", AT[1])), 1), known(spark)
    job = IncrementalJob(spark, str(tmp_path))
    monkeypatch.setattr(job.log, "commit", lambda entry: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        job.run(s, base, AT[2])
    again = IncrementalJob(spark, str(tmp_path))
    assert again.watermark() == (0, 0, None) and again.output().count() == 0
    assert again.run(s, base, AT[2]) == 1
    assert rows(again.output(), "path") == [("a",)]


def test_a_mount_without_hard_links(spark, tmp_path, monkeypatch):
    import os

    def refused(*a, **k):
        raise PermissionError("no links here")

    monkeypatch.setattr(os, "link", refused)
    log = CommitLog(spark, str(tmp_path))
    log.commit({"seq": 1, "by": "a"})
    with pytest.raises(RuntimeError):
        log.commit({"seq": 1, "by": "b"})
    assert log.last() == {"seq": 1, "by": "a"}
