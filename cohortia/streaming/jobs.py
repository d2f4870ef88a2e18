"""Structured Streaming jobs: monitors, audits, resumable scoring, watches.

Each takes a streaming DataFrame and gives one; `finish` runs a stream over what there is, to a table.
Checkpoints lie in the shared scratch folder, so a restarted driver goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from cohortia.sources.scratch import new_folder, stash


def read_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet folder's rows; local timestamps become instants (UTC session) for watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.parquet(path)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def run(stream: DataFrame, mode: str = "complete", out: str | None = None, name: str = "stream") -> tuple[DataFrame, list[dict]]:
    """Run a stream over all there is; what it leaves, and for each batch its rows, late rows and rows of state.

    In complete mode that is the last table, else all that was handed on, with the batch's number in `batch`. `out`
    goes on from what an earlier run left there. late counts what the watermark refused, after rows of one
    task and group are summed; state counts the groups that are kept.
    """
    spark = stream.sparkSession
    out = out or new_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    of = lambda p, k: sum(s[k] for s in p["stateOperators"])
    batches = [{"batch": p["batchId"], "rows": p["numInputRows"], "late": of(p, "numRowsDroppedByWatermark"), "state": of(p, "numRowsTotal")} for p in query.recentProgress]
    schema = stream.schema if mode == "complete" else StructType([*stream.schema.fields, StructField("batch", LongType())])
    try:
        got = spark.read.schema(schema).parquet(out)
    except AnalysisException:
        got = spark.createDataFrame([], schema)
    return got.select(*stream.columns, *([] if mode == "complete" else ["batch"])), batches


def finish(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Run a stream over all there is and read what it leaves: the last table in complete mode, else all handed on."""
    return run(stream, mode, name=name)[0].select(*stream.columns)


def latest_outcomes(log: DataFrame, key: str, order: str, status: Column) -> DataFrame:
    """(key, status, tries): the latest class of each key, as state that grows with the keys.

    In update mode a batch hands on the keys that it changed; `latest_update` reads the last of each.
    """
    return log.groupBy(key).agg(F.max_by(status, order).alias("status"), F.count("*").alias("tries"))


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of what update mode handed on, with `batch` from `run`, the last row of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def soft_blocks(log: DataFrame, at: str, suspect: Column, bucket: str = "1 day", least: int = 20, share: float = 0.5, late: str = "1 hour") -> DataFrame:
    """(start, tries, bad) of the buckets with `least` tries or more of which over `share` are suspect.

    For append mode: a bucket is judged once the watermark, `late` behind the latest try, has passed its end; then
    its state goes, and tries that come later are refused.
    """
    g = log.withWatermark(at, late).groupBy(F.window(at, bucket)).agg(F.count("*").alias("tries"), F.count_if(suspect).alias("bad"))
    return g.filter((F.col("tries") >= least) & (F.col("bad") > share * F.col("tries"))).select(F.col("window.start").alias("start"), "tries", "bad")


def request_rates(log: DataFrame, at: str, window: str = "300 seconds", slide: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """(start, n): requests in sliding windows, to hold against a quota; closed windows only, in append mode.

    With `late` None, for update or complete mode, no request is refused and open windows are handed on, too; state is then
    as long as the result.
    """
    return (log.withWatermark(at, late) if late else log).groupBy(F.window(at, window, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def score_as_they_come(songs: DataFrame, keys: list[str], score, path: str, too_short: Column | None = None) -> None:
    """Score each song once, into the table at `path`: `score` gives keys, scores and an error, null where there is none.

    A batch leaves out songs that the table has and appends the rest, so one that is run again after a
    failure adds nothing twice. Songs with an error are kept beside the table and tried again by the
    next call; songs that are `too_short` are final, with no score, and say so in `skipped`.
    """
    spark, failed = songs.sparkSession, f"{path}-failed"
    short = F.lit(False) if too_short is None else too_short

    def left(df: DataFrame) -> DataFrame:
        try:
            return df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except AnalysisException:
            return df

    def attempt(df: DataFrame, name: str) -> None:
        todo = stash(left(df).dropDuplicates(keys).withColumn("_short", short), "todo")
        scored = stash(score(todo.filter("NOT _short").drop("_short")), "scored")
        done = scored.filter("error IS NULL").drop("error").withColumn("skipped", F.lit(None).cast("string"))
        final = todo.filter("_short").select(*keys, F.lit("too short").alias("skipped"))
        # The failed go first: a batch that is run again writes the same folder.
        todo.drop("_short").join(scored.filter("error IS NOT NULL").select(*keys), keys, "left_semi").write.mode("overwrite").parquet(f"{failed}/{name}")
        done.unionByName(final, allowMissingColumns=True).write.mode("append").parquet(path)

    try:
        again = stash(spark.read.schema(songs.schema).option("recursiveFileLookup", "true").parquet(failed), "again")
        attempt(again, f"run={uuid.uuid4().hex}")
    except AnalysisException:
        pass
    run = uuid.uuid4().hex
    query = songs.writeStream.foreachBatch(lambda df, n: attempt(df, f"run={run}-{n}")).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def arrived_once(files: DataFrame, key: Column) -> DataFrame:
    """(key) of files not seen before, once each."""
    return files.select(key.alias("key")).dropDuplicates(["key"])


WATCH = "run long, checks long, streak long, converged boolean, collapsed boolean, silent boolean"
_KEPT = "checks long, streak long, converged boolean, first double, collapsed boolean"


class _Watch(StatefulProcessor):
    """State of a run: its last `lag` weights as a list, counts and verdicts as a value, a timer for its silence."""

    def __init__(self, lag: int, tol: float, patience: int, ratio: float, silent_ms: int | None):
        self.lag, self.tol, self.patience, self.ratio, self.silent_ms = lag, tol, patience, ratio, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "w array<double>")
        self.kept = handle.getValueState("kept", _KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        checks, streak, converged, first, collapsed = self.kept.get() if self.kept.exists() else (0, 0, False, None, False)
        recent = [np.asarray(r[0], float) for r in self.recent.get()] if self.recent.exists() else []
        pdf = pd.concat(list(rows)).sort_values("step")
        for v, r in zip(pdf["w"], pdf["rank"]):
            v = np.asarray(v, float)
            first = float(r) if first is None else first
            collapsed = bool(collapsed or r < self.ratio * first)
            away = np.linalg.norm(v - 1 / len(v))
            small = len(recent) == self.lag and away > 0 and np.linalg.norm(v - recent[0]) / away < self.tol
            streak = streak + 1 if small else 0
            converged, checks = bool(converged or streak >= self.patience), checks + 1
            recent = [*recent, v][-self.lag :]
        self.recent.put([(list(map(float, v)),) for v in recent])
        self.kept.update((checks, streak, converged, first, collapsed))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pdf["at"].max().timestamp() * 1000) + self.silent_ms)
        yield self.row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.row(key, True)

    def row(self, key: tuple, silent: bool) -> pd.DataFrame:
        checks, streak, converged, _, collapsed = self.kept.get()
        return pd.DataFrame([(key[0], checks, streak, converged, collapsed, silent)], columns=["run", "checks", "streak", "converged", "collapsed", "silent"])

    def close(self) -> None:
        pass


def watch_runs(metrics: DataFrame, run: str, step: str, w: str, rank: str, lag: int = 4, tol: float = 0.02, patience: int = 3, ratio: float = 0.5, at: str | None = None, silent_seconds: int | None = None) -> DataFrame:
    """A row per run and batch: checks so far, the streak of small moves, convergence and rank collapse.

    Rows of a batch go by step. With `at`, the rows' times, and `silent_seconds`, a run whose last row is so much
    older than the newest of all runs gets one more row, with `silent`; its state stays, as it may go on.
    The query needs Spark's RocksDB state store, which this sets for the session.
    """
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = at is not None and silent_seconds is not None
    when = F.col(at) if timed else F.lit(None).cast("timestamp")
    rows = metrics.select(F.col(run).cast("long").alias("run"), F.col(step).alias("step"), F.col(w).alias("w"), F.col(rank).cast("double").alias("rank"), when.alias("at"))
    if timed:
        rows = rows.withWatermark("at", "0 seconds")
    watch = _Watch(lag, tol, patience, ratio, 1000 * silent_seconds if timed else None)
    return rows.groupBy("run").transformWithStateInPandas(watch, WATCH, "update", "eventTime" if timed else "none")
