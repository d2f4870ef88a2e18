"""Streaming jobs run over all the events there are, to their final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.functions.text import stem
from cohortia.plans.registry import query, table
from cohortia.plans.windows import CONVERGENCE, runs_of_users
from cohortia.sources.scratch import new_folder
from cohortia.streaming import jobs


def events(spark, d):
    # A glob, as the table may be one file, which a stream takes no folder path for.
    return jobs.read_files(spark, f"{d}/event[s].parquet")


@query("T1_outcome_monitor", "SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS tries FROM events GROUP BY 1")
def t1(spark, d):
    updates, _ = jobs.run(jobs.latest_outcomes(events(spark, d), "user_id", "event_id", F.col("event_type")), "update")
    return jobs.latest_update(updates, ["user_id"])


@query("T2_soft_blocks", "SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS start, count(*) AS tries, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (event_type = 'error') > 0.2 * count(*) AND time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def t2(spark, d):
    """Closed days only: what the watermark has not passed yet may still change."""
    out = jobs.finish(jobs.soft_blocks(events(spark, d), "ts", F.col("event_type") == "error", share=0.2), "append")
    return out.select(F.col("start").cast("string").alias("start"), "tries", "bad")


@query("T3_request_rates", "SELECT s::VARCHAR AS start, count(*) AS n FROM (SELECT unnest(list_transform(range(5), lambda k: time_bucket(INTERVAL 60 SECONDS, ts) - to_seconds(60 * k))) AS s FROM events) GROUP BY 1")
def t3(spark, d):
    """Every window, those still open at the end too, and no event refused as late: a batch hands on the windows that it changed."""
    updates, _ = jobs.run(jobs.request_rates(events(spark, d), "ts", late=None), "update")
    return jobs.latest_update(updates, ["start"]).select(F.col("start").cast("string").alias("start"), "n")


@query("T4_resumable_scoring", "SELECT event_type, user_id, CASE WHEN count(*) >= 3 THEN round(min(value), 6) END AS low, CASE WHEN count(*) < 3 THEN 'too short' END AS skipped FROM events GROUP BY 1, 2")
def t4(spark, d):
    """Songs arrive as files; some have been scored before, some fail at first and are retried, the short are final."""
    songs, path = new_folder(spark, "songs"), new_folder(spark, "scored")
    grouped = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.collect_list("value").alias("windows"))
    grouped.write.parquet(songs)
    keys, short = ["event_type", "user_id"], F.size("windows") < 3

    def score(fails):
        return lambda df: df.select(*keys, F.round(F.array_min("windows"), 6).alias("low"), F.when(fails, F.lit("no answer")).alias("error"))

    early = grouped.filter((F.col("user_id") % 2 == 0) & ~short)
    score(F.lit(False))(early).select(*keys, "low", F.lit(None).cast("string").alias("skipped")).write.parquet(path)
    jobs.score_as_they_come(jobs.read_files(spark, songs, 1), keys, score(F.col("user_id") % 7 == 3), path, short)
    jobs.score_as_they_come(jobs.read_files(spark, songs, 1), keys, score(F.lit(False)), path, short)
    return spark.read.parquet(path)


@query("T5_arrived_files", "SELECT DISTINCT 'u' || user_id AS key FROM events")
def t5(spark, d):
    names = F.concat(F.lit("in/u"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, ".mp3").otherwise(".wav"))
    return jobs.finish(jobs.arrived_once(events(spark, d), stem(names)), mode="append")


@query("T6_run_watch", f"WITH {CONVERGENCE}, f AS (SELECT run, max(step) AS checks, max((streak >= 3)::INTEGER) = 1 AS converged FROM s GROUP BY 1), c AS (SELECT user_id AS run, bool_or(value < 0.5 * first) AS collapsed FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events) GROUP BY 1) SELECT run, checks::BIGINT AS checks, converged, collapsed FROM f JOIN c USING (run)")
def t6(spark, d):
    path = new_folder(spark, "metrics")
    runs_of_users(spark, d).write.parquet(path)
    updates, _ = jobs.run(jobs.watch_runs(jobs.read_files(spark, path), "run", "step", "w", "value"), "update")
    return jobs.latest_update(updates, ["run"]).select("run", "checks", "converged", "collapsed")
