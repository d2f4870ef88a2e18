"""Select once, test once: a detector is chosen on development sources, frozen, and tested on others."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators import metrics, resample
from cohortia.operators.curate import require_disjoint
from cohortia.operators.metrics import usable
from cohortia.sources.scratch import stash


def candidates(songs: DataFrame, source: str, reference: str, dev: list[str], scores: list[str]) -> DataFrame:
    """(score, auroc): each candidate's AUROC of the reference over all development sources together."""
    kept = songs.filter(F.col(source).isin(reference, *dev))
    long = kept.unpivot([source], scores, "score", "x")
    return metrics.auroc(long, "x", F.col(source) == reference, ("score",))


def select(songs: DataFrame, source: str, reference: str, dev: list[str], scores: list[str], most_fpr: float = 0.2) -> dict:
    """The protocol: the best score (by name among equals), its operating point, its threshold and a checksum."""
    best = candidates(songs, source, reference, dev, scores).orderBy(F.desc("auroc"), "score").first()
    kept = songs.filter(F.col(source).isin(reference, *dev))
    point = metrics.operating_grid(kept, best["score"], source, reference, most_fpr).first()
    threshold = metrics.quantile_table(kept.filter(F.col(source) == reference), best["score"], [point["fpr"]]).first()["value"]
    made = {"score": best["score"], "auroc": best["auroc"], "fpr": point["fpr"], "threshold": threshold, "dev": sorted(dev), "reference": reference}
    return made | {"checksum": checksum(songs.sparkSession, made)}


def checksum(spark, protocol: dict) -> str:
    text = json.dumps({k: v for k, v in protocol.items() if k != "checksum"}, sort_keys=True)
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def earlier_tests(spark, record: str) -> int:
    """How often a protocol was tested with its record kept in this folder."""
    try:
        return spark.read.parquet(record).select("run").distinct().count()
    except AnalysisException:
        return 0


def test(songs: DataFrame, seen: DataFrame, key: str, unit: str, source: str, protocol: dict, record: str, others: tuple[str, ...] = (), again: bool = False, reps: int = 100, seed: str = "test") -> DataFrame:
    """A frozen protocol on songs it has not seen, once: the record at `record` refuses a second time.

    (row, source, songs, flagged, flagged_low, flagged_high, auroc, auroc_low, auroc_high, delta_low,
    delta_high, repeat): a row for the protocol's score and each of `others` by source. The protocol's
    songs are flagged below its threshold, those of others below the reference's own quantile at its rate.
    Intervals resample units within each source, all scores under the same draws; delta is the protocol's
    AUROC less the row's. `again` overrides the refusal, and the result says that it is a repeat.
    """
    spark = songs.sparkSession
    runs = earlier_tests(spark, record)
    if runs and not again:
        raise ValueError("this protocol was tested before")
    if protocol["checksum"] != checksum(spark, protocol):
        raise ValueError("the protocol was changed after it was frozen")
    songs = require_disjoint(songs, seen, key)
    mine, reference, scores = protocol["score"], protocol["reference"], [protocol["score"], *others]
    long = stash(songs.unpivot([unit, source], scores, "row", "_x"), "test-scores")
    own = metrics.quantile_table(long.filter(F.col(source) == reference), "_x", [protocol["fpr"]], ("row",)).select("row", F.when(F.col("row") == mine, F.lit(float(protocol["threshold"]))).otherwise(F.col("value")).alias("_t"))
    marked = long.join(F.broadcast(own), "row").withColumn("_f", (F.col("_x") < F.col("_t")).cast("int"))  # a row for each score
    flagged = marked.groupBy("row", source).agg(F.count("*").alias("songs"), F.avg("_f").alias("flagged"))
    times = stash(resample.drawn_times(songs, unit, reps, seed, source), "test-times")
    share = resample.interval(resample.drawn_mean(marked.filter(F.col("row") == mine), times, unit, "_f", source), "value", (source,))
    share = share.select(F.lit(mine).alias("row"), source, F.col("low").alias("flagged_low"), F.col("high").alias("flagged_high"))
    draws = stash(resample.source_auroc_replicates(songs, times, unit, scores, source, reference), "test-draws").withColumnRenamed("score", "row")
    ranked = metrics.auroc_against(long, "_x", source, reference, by=("row",))
    spread = resample.interval(draws, "auroc", ("row", source)).select("row", source, F.col("low").alias("auroc_low"), F.col("high").alias("auroc_high"))
    base = draws.filter(F.col("row") == mine).select("rep", source, F.col("auroc").alias("_base"))
    deltas = draws.filter(F.col("row") != mine).join(base, ["rep", source]).withColumn("_d", F.col("_base") - F.col("auroc"))
    deltas = resample.interval(deltas, "_d", ("row", source)).select("row", source, F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
    out = flagged
    for part in (share, ranked, spread, deltas):
        out = out.join(part, ["row", source], "left")
    out.withColumn("repeat", F.lit(runs > 0)).withColumn("run", F.lit(runs)).write.mode("append").parquet(record)
    columns = ["row", source, "songs", "flagged", "flagged_low", "flagged_high", "auroc", "auroc_low", "auroc_high", "delta_low", "delta_high", "repeat"]
    return spark.read.parquet(record).filter(F.col("run") == runs).select(*columns)


def moved_threshold(threshold: float, log_det_from: float, log_det_to: float) -> float:
    """A log-density threshold of one fit in the units of another.

    A fit's log_det, minus the sum of the logarithms of its deviations, turns the log density of its
    standardised features into that of the features themselves, so the same density has the same sum.
    """
    return threshold + log_det_from - log_det_to


def fixed_threshold(before: DataFrame, after: DataFrame, key: str, source: str, score: str, reference: str, pools: dict[str, list[str]], fpr: float, log_det_before: float = 0.0, log_det_after: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A second fit at the first one's threshold: (pool, threshold, fpr, tpr, before_tpr) and flag changes of the reference.

    The threshold is the first fit's fpr-quantile of the reference, in the second fit's units; fpr is what the
    second fit then flags of the reference, tpr of each pool of sources, and before_tpr what the first flags of the
    pool at that same fpr. Both have key, source and score; a score that is null or NaN is not flagged.
    """
    human = lambda df: df.filter((F.col(source) == reference) & usable(score))
    cut = metrics.quantile_table(human(before), score, [fpr]).first()
    if cut is None:
        raise ValueError(f"no usable score of {reference}")
    moved = moved_threshold(cut["value"], log_det_before, log_det_after)
    reached = human(after).agg(F.avg((F.col(score) < moved).cast("double")).alias("fpr")).first()["fpr"]
    own = metrics.quantile_table(human(before), score, [reached]).first()["value"] if reached is not None else None
    share = lambda df, t, name: metrics.pooled(df.filter(usable(score)), source, pools).groupBy("pool").agg(F.avg((F.col(score) < F.lit(t)).cast("double")).alias(name))
    rates = share(after, moved, "tpr").join(share(before, own, "before_tpr"), "pool", "full")
    rates = rates.select("pool", F.lit(moved).alias("threshold"), F.lit(reached).alias("fpr"), "tpr", "before_tpr")
    flagged = lambda df, t: df.filter(F.col(source) == reference).select(key, F.coalesce(usable(score) & (F.col(score) < t), F.lit(False)).alias("flagged"))
    return rates, flag_changes(flagged(before, cut["value"]), flagged(after, moved), key)


def flag_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of songs newly or no longer flagged; both have key and flagged."""
    both = before.select(key, F.col("flagged").alias("_was")).join(after.select(key, "flagged"), key)
    return both.filter("_was <> flagged").select(key, F.when(F.col("flagged"), "newly").otherwise("no longer").alias("change"))
