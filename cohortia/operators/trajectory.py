"""Trajectories of runs: convergence, collapse, peaks, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.arrays import dot, norm
from cohortia.operators.metrics import quantile_table
from cohortia.operators.ranks import numbered, running_before
from cohortia.sources.scratch import stash


def peak_best_final(rows: DataFrame, run: str, step: str, x: str) -> DataFrame:
    """(run, peak_step, peak, final_step, final): the first of equal peaks."""
    return rows.groupBy(run).agg(
        F.max_by(step, F.struct(F.col(x), -F.col(step))).alias("peak_step"),
        F.max(x).alias("peak"),
        F.max(step).alias("final_step"),
        F.max_by(x, step).alias("final"),
    )


def convergence(rows: DataFrame, run: str, step: str, w: str, lag: int = 4, tol: float = 0.02, patience: int = 3, near_uniform: float = 0.9995) -> DataFrame:
    """Rows with moved, passed, streak, converged and never_left.

    moved is how far w went over `lag` checks relative to how far it is from uniform; it converged once
    moved stays under `tol` for `patience` checks in a row. never_left: cosine to uniform is above
    `near_uniform`, so convergence says little.
    """
    by = W.partitionBy(run).orderBy(step)
    before = F.lag(w, lag).over(by)
    flat = F.transform(w, lambda _: 1.0 / F.size(w))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    rows = rows.withColumn("_before", before).withColumn("_flat", flat)
    away = norm(minus(F.col(w), F.col("_flat")))
    rows = rows.withColumn("moved", F.when(F.col("_before").isNotNull() & (away > 0), norm(minus(F.col(w), F.col("_before"))) / away))
    rows = rows.withColumn("passed", F.coalesce(F.col("moved") < tol, F.lit(False)))
    rows = rows.withColumn("_gap", F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(by))
    streak = F.sum(F.when(F.col("passed"), 1).otherwise(0)).over(W.partitionBy(run, "_gap").orderBy(step))
    rows = rows.withColumn("streak", streak).withColumn("converged", F.max((F.col("streak") >= patience).cast("int")).over(by) == 1)
    cos = dot(F.col(w), F.col("_flat")) / (norm(F.col(w)) * norm(F.col("_flat")))
    return rows.withColumn("never_left", cos > near_uniform).drop("_before", "_flat", "_gap")


def collapse_alarm(rows: DataFrame, run: str, step: str, rank: str, ratio: float) -> DataFrame:
    """Rows with `alarm`: the effective rank is under `ratio` times the run's first."""
    return rows.withColumn("alarm", F.col(rank) < ratio * F.first(rank).over(W.partitionBy(run).orderBy(step)))


def extreme_groups(rows: DataFrame, key: str, x: str, n: int) -> DataFrame:
    """(key, group): the n highest, the n nearest the median and the n lowest; n is at most half the rows."""
    count = rows.count()
    middle = quantile_table(rows, x, [0.5]).first()
    n = min(n, count // 2)
    orders = {"high": F.desc(x), "middle": F.abs(F.col(x) - F.lit(middle["value"] if middle else None)), "low": F.asc(x)}
    out = None
    for name, order in orders.items():  # top-n each, no global sort
        part = rows.orderBy(order, key).limit(n).select(key, F.lit(name).alias("group"))
        out = part if out is None else out.unionByName(part)
    return out


def percent_ranks(rows: DataFrame, key: str, x: str) -> DataFrame:
    """(key, pct): 100 times the place over n - 1, ties in order of key; one row has 0."""
    placed = numbered(rows.select(key, x), [x, key], "_r")
    n = placed.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("_n"))
    return placed.crossJoin(F.broadcast(n)).select(key, (100.0 * F.col("_r") / F.col("_n")).alias("pct"))


def with_margin(candidates: DataFrame, key: str, x: str) -> DataFrame:
    """(key, x, place, margin): ranked, and how far each is ahead of the next."""
    placed = stash(numbered(candidates.select(key, x), [F.desc(x), key], "_at"), "ranked")
    after = placed.select((F.col("_at") - 1).alias("_at"), F.col(x).alias("_next"))
    return placed.join(after, "_at", "left").select(key, x, (F.col("_at") + 1).cast("int").alias("place"), (F.col(x) - F.col("_next")).alias("margin"))


def cumulative_bands(parts: DataFrame, order: str, x: str, bands: int) -> DataFrame:
    """(order, upto, rest, band): running sums over ordered components, and linspace bands."""
    run = running_before(numbered(parts.select(order, x), [order], "_at"), (), "_at", x, "_before")
    whole = F.broadcast(parts.agg(F.sum(x).alias("_all"), F.count("*").alias("_n")))  # one row
    upto = F.col("_before") + F.col(x)
    return run.crossJoin(whole).select(order, upto.alias("upto"), (F.col("_all") - upto).alias("rest"), F.floor(F.col("_at") * bands / F.col("_n")).alias("band"))
