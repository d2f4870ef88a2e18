"""Bootstraps by reweighting: units are drawn by a portable hash and pieces are weighted, never copied.

A unit's multiplicity in a replicate is how many of the n draws fell on it. Draws are made on the units'
table alone, so a replicate costs as many rows as there are units, whatever stands behind each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.hashing import uniform
from cohortia.operators.metrics import auroc, quantile, usable
from cohortia.operators.ranks import beside, in_ranges, numbered
from cohortia.sources.scratch import stash


def _draws(units: DataFrame, key: str, reps: int, seed: str, within: str | None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Numbered units (within, key, carry..., _at) and draws (rep, _at), a row for each, of units by their number.

    Units are numbered in ranges of (group, key), so no task holds all of a group's; a draw is a number of the
    group's range, so one long is all that is shuffled and joined on besides the replicate.
    """
    groups = [within] if within else []
    units = units.select(*groups, key, *carry) if carry else units.select(*groups, key).distinct()
    placed = numbered(units, [*groups, key], "_at")
    # A row for each group.
    sizes = stash(placed.groupBy(*groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "unit-groups")
    draws = beside(placed.select(*groups, "_at"), sizes, groups).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = F.floor(uniform(seed, F.col("rep"), *[F.col(g) for g in groups], F.col("_at") - F.col("_first")) * F.col("_n"))
    return placed, draws.select("rep", (F.col("_first") + drawn).alias("_at"))


def multiplicities(units: DataFrame, key: str, reps: int, seed: str, within: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(rep, within, key, carry..., times): draws with replacement of as many units as there are (within each group).

    With `carry`, columns of the units that come along, `units` has one row for each. Null groups and keys are
    drawn like others.
    """
    placed, draws = _draws(units, key, reps, seed, within, carry)
    times = draws.groupBy("rep", "_at").agg(F.count("*").alias("times"))
    return times.join(placed.hint("shuffle_hash"), "_at").select("rep", *([within] if within else []), key, *carry, "times")


#: Draws that one task counts at a time, about.
DEALT = 1 << 20


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _table(column) -> np.ndarray:
    """The lists of a column, all of one length, as rows; there is one at least."""
    x = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def drawn_times(units: DataFrame, key: str, reps: int, seed: str, within: str | None = None) -> DataFrame:
    """(within, key, times): `multiplicities` in an array of all replicates, of the units that any of them draws.

    So what is joined and ranked by unit has a row for each unit, not for each unit and replicate. Draws are dealt by
    stretches of units and counted there.
    """
    placed, draws = _draws(units, key, reps, seed, within)

    def count(part: pa.Table) -> pa.Table:
        at, rep = (part.column(c).to_numpy() for c in ("_at", "rep"))
        first = at.min()
        times = np.bincount((at - first) * reps + rep, minlength=(at.max() - first + 1) * reps).reshape(-1, reps)
        hit = np.flatnonzero(times.any(1))
        return pa.table({"_at": first + hit, "times": _lists(times[hit].astype(np.int32))})

    dealt = draws.select("_at", "rep", F.expr(f"_at div {max(1, DEALT // reps)}").alias("_lot"))
    times = dealt.groupBy("_lot").applyInArrow(count, "_at long, times array<int>")
    return times.join(placed.hint("shuffle_hash"), "_at").select(*([within] if within else []), key, "times")


def interval(replicates: DataFrame, x: str, by: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    """(by..., low, high): the percentile interval of replicates, of which each group has some hundreds or thousands."""
    a = (1 - level) / 2
    return replicates.groupBy(*by).agg(quantile(x, a).alias("low"), quantile(x, 1 - a).alias("high"))


def clustered_mean(rows: DataFrame, cluster: str, x: str, reps: int, seed: str, by: str | None = None) -> DataFrame:
    """(rep, by, value): means over resampled clusters, from each cluster's sum and count."""
    groups = [by] if by else []
    pieces = rows.groupBy(*groups, cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    placed, draws = _draws(pieces, cluster, reps, seed, by, ("_s", "_c"))
    # Draws meet their piece one by one: counting them by unit first would be another shuffle, of nearly as many rows.
    drawn = draws.join(placed.hint("shuffle_hash"), "_at")
    n = F.sum("_c")
    return drawn.groupBy("rep", *groups).agg(F.when(n > 0, F.sum("_s") / n).alias("value"))


def drawn_mean(rows: DataFrame, times: DataFrame, cluster: str, x: str, by: str | None = None) -> DataFrame:
    """(rep, by, value): `clustered_mean` under draws made before by `drawn_times` of the same clusters."""
    groups = [by] if by else []
    pieces = rows.groupBy(*groups, cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    drawn = beside(pieces, times, [*groups, cluster]).select(*groups, "_s", "_c", F.posexplode("times").alias("rep", "_k")).filter("_k > 0")
    n = F.sum(F.col("_c") * F.col("_k"))
    return drawn.groupBy("rep", *groups).agg(F.when(n > 0, F.sum(F.col("_s") * F.col("_k")) / n).alias("value"))


def auroc_replicates(rows: DataFrame, unit: str, score: str, positive: str, reps: int, seed: str) -> DataFrame:
    """(rep, auroc): units are drawn within each side; their rows' scores are weighted."""
    m = multiplicities(rows, unit, reps, seed, positive)
    return auroc(beside(rows, m, [positive, unit]), score, F.col(positive), ("rep",), F.col("times"))


def paired_auroc_replicates(a: DataFrame, b: DataFrame, unit: str, score: str, positive: str, reps: int, seed: str) -> DataFrame:
    """(rep, delta): AUROC of b less a, both under the same draws."""
    m = stash(multiplicities(a, unit, reps, seed, positive), "draws")
    runs = a.select(positive, unit, F.col(score).alias("_x"), F.lit(0).alias("_of")).unionByName(b.select(positive, unit, F.col(score).alias("_x"), F.lit(1).alias("_of")))
    both = beside(runs, m, [positive, unit])
    found = auroc(both, "_x", F.col(positive), ("rep", "_of"), F.col("times"))
    of = lambda k: F.max(F.when(F.col("_of") == k, F.col("auroc")))
    return found.groupBy("rep").agg((of(1) - of(0)).alias("delta"))


def source_auroc_replicates(rows: DataFrame, times: DataFrame, unit: str, scores: list[str], source: str, reference: str) -> DataFrame:
    """(rep, score, source, auroc) of each score and source against the reference, all scores under the same draws.

    `times` are the `drawn_times` of the units within each source.
    """
    long = beside(rows.select(source, unit, *scores), times, [source, unit]).unpivot([source, "times"], scores, "score", "_x")
    return drawn_auroc(long, "_x", source, reference, ("score",))


def drawn_auroc(rows: DataFrame, score: str, source: str, reference: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(rep, by..., source, auroc): `metrics.auroc_against` in every replicate, of rows with an array `times` of all of them.

    Rows are summed by distinct score where they lie, then dealt by ranges of scores, each of which ranks its rows once
    for all replicates; a table of one row for each range, source and replicate carries what lies in the ranges before.
    """
    keys = [*by, source, "_x"]
    ok = rows.filter(usable(score)).select(*by, source, F.col(score).alias("_x"), "times")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                group = np.zeros(len(batch), np.int64)
                for codes in (batch.column(k).dictionary_encode("encode").indices.to_numpy().astype(np.int64) for k in keys):
                    group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
                times = np.add.reduceat(_table(batch.column("times"))[order].astype(np.int64), first, axis=0)
                one = batch.select(keys).take(pa.array(order[first]))
                yield pa.RecordBatch.from_arrays([*one.columns, _lists(times)], [*keys, "times"])

    counts = stash(ok.mapInArrow(summed, ok.withColumn("times", F.col("times").cast("array<long>")).schema), "score-counts")

    def ranked(key: tuple, part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part.column("_x").to_numpy(), kind="stable")))
        x, times, sources = part.column("_x").to_numpy(), _table(part.column("times")), part.column(source).combine_chunks().dictionary_encode("encode")
        codes = sources.indices.to_numpy(zero_copy_only=False)
        names = sources.dictionary.to_pylist()
        upto = np.cumsum(times * (codes == names.index(reference) if reference in names else np.zeros(len(x), bool))[:, None], axis=0)
        # Twice what lies below, and at, a score: all up to before its first row and all up to its last.
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        last = np.append(first[1:], len(x)) - 1
        value = np.repeat(np.arange(len(first)), last - first + 1)
        twice = (upto[last] + np.where(first[:, None] > 0, upto[first - 1], 0))[value]
        sums = [(times[codes == c].sum(0), (times * twice)[codes == c].sum(0)) for c in range(len(names))]
        n = len(names)
        fixed = {c: pa.array([k.as_py()] * n, part.schema.field(c).type) for c, k in zip([*by, "_b"], key)}
        return pa.table(fixed | {source: sources.dictionary, "_k": _lists(np.array([k for k, _ in sums])), "_u": _lists(np.array([u for _, u in sums]))})

    ranges = in_ranges(counts, "_x", "_b")
    to = ranges.select(*by, "_b", source, F.col("times").alias("_k"), F.col("times").alias("_u")).schema
    parts = ranges.groupBy(*by, "_b").applyInArrow(ranked, to)
    parts = parts.select(*by, "_b", source, F.posexplode(F.arrays_zip("_k", "_u")).alias("rep", "_p")).select("rep", *by, "_b", source, "_p.*").filter("_k > 0")
    of_ref = F.when(F.col(source) == reference, F.col("_k")).otherwise(0)
    all_ = W.partitionBy("rep", *by)
    before = F.coalesce(F.sum(of_ref).over(all_.orderBy("_b").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_ahead", before).withColumn("_all", F.sum(of_ref).over(all_)).filter(~F.col(source).eqNullSafe(reference))
    below = F.sum(F.col("_u") + 2 * F.col("_k") * F.col("_ahead")) / 2 / (F.sum("_k") * F.max("_all"))
    return parts.groupBy("rep", *by, source).agg(F.when(F.max("_all") > 0, 1 - below).alias("auroc"))
