"""Range joins, paired comparison, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.operators.metrics import auroc
from cohortia.sources.scratch import stash


def in_windows(windows: DataFrame, items: DataFrame, keys: list[str], length: float) -> DataFrame:
    """Items whose t lies in [start, start + length) of a window of the same keys.

    Both sides are bucketed by `length`, so a window meets two buckets and the join is an equality.
    """
    b = lambda c: F.floor(F.col(c) / length)
    wide = windows.withColumn("_b", F.explode(F.array(b("start"), b("start") + 1)))
    return wide.join(items.withColumn("_b", b("t")), [*keys, "_b"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + length)).drop("_b")


def under_all(rows: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Rows of the units that occur under every condition there is."""
    n = rows.agg(F.count_distinct(condition).alias("all"))
    there = rows.groupBy(*keys).agg(F.count_distinct(condition).alias("has")).crossJoin(F.broadcast(n)).filter("has = all")
    return rows.join(there.select(*keys), keys, "left_semi")


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, gain): b - a of the same units; refuses runs whose units differ."""
    if not a.select(*keys).exceptAll(b.select(*keys)).isEmpty() or not b.select(*keys).exceptAll(a.select(*keys)).isEmpty():
        raise ValueError("the runs have different units")
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).select(*keys, (F.col("_b") - F.col("_a")).alias("gain"))


def ordinal(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Adds the place, from 0, of each row in its group."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def counterfactual(base: DataFrame, changed: DataFrame, keys: list[str], source: str, x: str, y: str, threshold: float) -> DataFrame:
    """(source, flagged_before, flagged_after, lost, shift_auroc) over the songs that both tables have.

    A song is flagged below the threshold; shift_auroc is the chance that a song as it was scores above a changed one.
    """
    met = base.select(*keys, x).join(changed.select(*keys, y), keys).select(source, F.col(x).alias("_x"), F.col(y).alias("_y"))
    met = stash(met, "counterfactual")
    was, now = F.col("_x") < threshold, F.col("_y") < threshold
    counts = met.groupBy(source).agg(F.count_if(was).alias("flagged_before"), F.count_if(now).alias("flagged_after"), F.count_if(was & ~now).alias("lost"))
    sides = met.select(source, F.explode(F.array(F.struct(F.col("_x").alias("v"), F.lit(True).alias("was")), F.struct(F.col("_y").alias("v"), F.lit(False).alias("was")))).alias("s")).select(source, "s.v", "s.was")
    return counts.join(auroc(sides, "v", F.col("was"), (source,)).withColumnRenamed("auroc", "shift_auroc"), source, "left")
