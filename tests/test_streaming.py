"""Streams in several batches: late rows, state that goes, restarts, silent runs."""

import numpy as np
from pyspark.sql import functions as F

from cohortia.streaming import jobs


def arrive(spark, folder, n, rows, schema):
    """File n of a folder that a stream reads."""
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{folder}/part={n}")


def test_closed_days_are_judged_once_and_late_tries_refused(spark, tmp_path):
    folder, out, day = str(tmp_path / "in"), str(tmp_path / "out"), 86_400
    tries = lambda d, n, bad: [(d * day + i, "bad" if i < bad else "ok") for i in range(n)]
    job = lambda: jobs.run(jobs.soft_blocks(jobs.read_files(spark, f"{folder}/*"), "at", F.col("o") == "bad", least=20), "append", out)
    schema = "s long, o string"

    arrive(spark, folder, 1, tries(0, 30, 20) + tries(1, 10, 0) + [(day + 7200, "ok")], schema)
    got, batches = job()
    # Day 0 is closed, as the latest try is over an hour past it, and its state has gone.
    assert [r.tries for r in got.collect()] == [30] and max(b["state"] for b in batches) == 2 and batches[-1]["state"] == 1

    arrive(spark, folder, 2, tries(2, 25, 25) + [(2 * day + 7200, "ok")], schema)
    got, batches = job()
    assert sorted(r.tries for r in got.collect()) == [30] and batches[-1]["state"] == 1  # day 1 is closed, with too few tries

    arrive(spark, folder, 3, tries(0, 50, 50) + tries(3, 1, 0) + [(3 * day + 7200, "ok")], schema)
    got, batches = job()
    rows = {str(r.start)[:10]: r.tries for r in got.collect()}
    # The fifty late tries of day 0 are refused; they do not open it again.
    assert rows == {"1970-01-01": 30, "1970-01-03": 26} and sum(b["late"] for b in batches) >= 1 and batches[-1]["state"] == 1


def test_updates_hand_on_changed_keys_only(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    job = lambda: jobs.run(jobs.latest_outcomes(jobs.read_files(spark, f"{folder}/*"), "k", "s", F.col("o")), "update", out)[0]
    arrive(spark, folder, 1, [(1, "a", 1), (2, "b", 2), (3, "a", 3)], "s long, o string, k long")
    assert job().count() == 3
    arrive(spark, folder, 2, [(9, "c", 2)], "s long, o string, k long")
    updates = job()
    assert updates.count() == 4
    assert sorted(map(tuple, jobs.latest_update(updates, ["k"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "a", 1)]


def test_watch_goes_on_after_a_restart_and_tells_silent_runs(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "s long, run long, step long, w array<double>, rank double"
    near = lambda i: [0.7, 0.2 + 1e-4 * i, 0.1 - 1e-4 * i]
    job = lambda: jobs.run(jobs.watch_runs(jobs.read_files(spark, f"{folder}/*"), "run", "step", "w", "rank", lag=2, patience=3, at="at", silent_seconds=100), "update", out)[0]
    arrive(spark, folder, 1, [(1000 + 10 * i, 1, i, near(i), 10.0) for i in range(4)] + [(1010, 2, 0, near(0), 10.0)], schema)
    one = {r.run: r for r in jobs.latest_update(job(), ["run"]).collect()}
    assert (one[1].checks, one[1].streak, one[1].converged, one[2].checks) == (4, 2, False, 1)
    # The next driver goes on from the checkpoint: one more small move makes the third in a row.
    arrive(spark, folder, 2, [(1500, 1, 4, near(4), 4.0)], schema)
    updates = job()
    two = {r.run: r for r in jobs.latest_update(updates, ["run"]).collect()}
    assert (two[1].checks, two[1].streak, two[1].converged, two[1].collapsed, two[1].silent) == (5, 3, True, True, False)
    assert (two[2].checks, two[2].silent) == (1, True)
    # A silent run may come back.
    arrive(spark, folder, 3, [(1560, 2, 1, near(1), 9.0)], schema)
    three = {r.run: r for r in jobs.latest_update(job(), ["run"]).collect()}
    assert (three[2].checks, three[2].silent, three[1].silent) == (2, False, False)
    assert np.isclose(sum(r.checks for r in three.values()), 7)
