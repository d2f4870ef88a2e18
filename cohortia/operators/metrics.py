"""Detection metrics: AUROC by ranks, quantiles, operating points, pooled roll-ups.

A score that is NaN or null is a failed one and takes no part; infinities rank at the ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.operators.ranks import beside, numbered, running_before, standings
from cohortia.sources.scratch import stash


def usable(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x)


def clipped(x: Column | str) -> Column:
    """Infinities brought to +-1e300, so that quantiles can interpolate."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300))


def auroc(rows: DataFrame, score: str, positive: Column, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by..., auroc): the chance that a positive scores above a negative, ties counting a half.

    Rows are first summed by distinct score, so the running sum runs over distinct values, in ranges; with
    weights it is the AUROC of rows repeated so often. Null where a side is empty.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    d = rows.filter(usable(score)).groupBy(*by, score).agg(F.sum(F.when(positive, w).otherwise(0.0)).alias("_p"), F.sum(F.when(positive, F.lit(0.0)).otherwise(w)).alias("_n"))
    d = running_before(stash(d, "by-score"), by, score, "_n", "_below")
    u = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    sides = F.sum("_p") * F.sum("_n")
    return d.groupBy(*by).agg(F.when(sides > 0, u / sides).alias("auroc"))


def auroc_against(rows: DataFrame, score: str, source: str, reference: str, higher_is_reference: bool = True, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by..., source, auroc) of each source against the reference source; null where the reference has no usable score.

    Rows are counted by score, and the counts of all sources are ranked beside the reference's together, so
    the reference is not repeated for each source.
    """
    w = F.lit(1) if weight is None else weight
    counts = stash(rows.filter(usable(score)).groupBy(*by, source, score).agg(F.sum(w).alias("_k")), "score-counts")
    placed = standings(counts, by, source, score, "_k", reference).filter(~F.col(source).eqNullSafe(reference))
    return beside(placed, _of_reference(counts, by, source, reference), by, "left").groupBy(*by, source).agg(_auroc(higher_is_reference).alias("auroc"))


def _of_reference(counts: DataFrame, by: tuple[str, ...], source: str, reference) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum(F.when(F.col(source) == reference, F.col("_k"))).alias("_all"))


def _auroc(higher_is_reference: bool) -> Column:
    """From counts `_k` and the reference's below (`_ref`), at (`_tie`) and in all (`_all`); null without a reference."""
    below_ = F.sum(F.col("_k") * (F.col("_ref") + F.col("_tie") / 2)) / (F.sum("_k") * F.max("_all"))
    share = 1 - below_ if higher_is_reference else below_
    return F.when((F.sum("_k") > 0) & (F.max("_all") > 0), share)


def quantile(x: Column | str, q: float | list[float], approximate: bool = False) -> Column:
    """Linear-interpolated quantile of a group that one task holds; `approximate` trades exactness for a sketch.

    For groups of any size there is `quantile_table`.
    """
    if approximate:
        return F.percentile_approx(clipped(x), q)
    return F.percentile(clipped(x), F.array(*[F.lit(float(v)) for v in q]) if isinstance(q, list) else F.lit(float(q)))


#: Parts of the sketch that bounds a quantile, and margin of a bound in parts. Groups of fewer rows need no bounds.
PARTS, MARGIN = 10_000, 3
#: One task orders so many values between two bounds; larger groups get narrower bounds first.
ORDERED = 1 << 20
#: Points of the sketch that narrows bounds.
_POINTS = 256


def _narrowed(ok: DataFrame, brackets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Bounds about a hundred times narrower, from a sketch of the values between the bounds."""
    met = beside(ok, brackets, by)
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    points = [i / _POINTS for i in range(_POINTS + 1)]
    found = met.groupBy(*by, "_p", "_n", "_lo", "_hi").agg(F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_in"), F.percentile_approx(F.when(inside, F.col("_x")), points, PARTS).alias("_e"))
    place = F.col("_p") * (F.col("_n") - 1)
    point = lambda at: (at - F.col("_below") + 1) / F.col("_in") * _POINTS
    bound = lambda k: F.element_at("_e", F.least(F.greatest(k, F.lit(0)), F.lit(_POINTS)).cast("int") + 1)
    # One point to either side covers the sketch's error.
    low, high = bound(F.floor(point(F.floor(place))) - 1), bound(F.ceil(point(F.ceil(place))) + 1)
    return found.select(*by, "_p", "_n", low.alias("_lo"), high.alias("_hi"))


def quantile_table(rows: DataFrame, x: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p, value): quantiles as rows (see `_quantiles`)."""
    return _quantiles(rows, x, qs, by).withColumnRenamed("_p", "p")


def _quantiles(rows: DataFrame, x: str, qs: list[float], by: tuple[str, ...]) -> DataFrame:
    """(by..., _p, value): linear-interpolated quantiles, exact for groups of any size; nulls are a group, too.

    A sketch of each group gives two bounds of each quantile. One pass counts what lies below and, by value,
    what lies between; the quantile picks the one or two values at its place among the latter.
    """
    ok = rows.filter(usable(x)).select(*by, clipped(x).alias("_x"))
    edges = [e for q in qs for e in (max(0.0, q - MARGIN / PARTS), min(1.0, q + MARGIN / PARTS))]
    sketch = ok.groupBy(*by).agg(F.percentile_approx("_x", edges, PARTS).alias("_e"), F.count("*").alias("_n")).filter("_n > 0")
    few = F.col("_n") <= PARTS
    each = [F.struct(F.lit(float(q)).alias("_p"), F.when(few, -1e300).otherwise(F.col("_e")[2 * i]).alias("_lo"), F.when(few, 1e300).otherwise(F.col("_e")[2 * i + 1]).alias("_hi")) for i, q in enumerate(qs)]
    brackets = stash(sketch.select(*by, "_n", F.explode(F.array(*each)).alias("_q")).select(*by, "_n", "_q.*"), "quantile-bounds")
    between = (brackets.agg(F.max("_n")).first()[0] or 0) * 4 * MARGIN / PARTS
    while between > ORDERED:
        brackets, between = stash(_narrowed(ok, brackets, by), "quantile-bounds"), between * 8 / _POINTS
    # What lies below a lower bound is counted under null.
    met = beside(ok, brackets, by).filter(F.col("_x") <= F.col("_hi"))
    d = met.groupBy(*by, "_p", "_n", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_x")).agg(F.count("*").alias("_k"))
    run = W.partitionBy(*by, "_p").orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_below", F.coalesce(F.sum("_k").over(run), F.lit(0))).withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    holds = lambda place: (F.col("_below") <= place) & (place < F.col("_below") + F.col("_k"))
    return d.groupBy(*by, "_p").agg(_picked(F.max("_at"), lambda place: F.max(F.when(holds(place), F.col("_x"))), F.col("_at")).alias("value"))


def _picked(place: Column, at, row_place: Column) -> Column:
    """The value at a place between two rows' values, just theirs if they are equal: `at` gives the value whose row holds a place."""
    low, high = at(F.floor(row_place)), at(F.ceil(row_place))
    return low + (place - F.floor(place)) * (high - low)


def quantiles(rows: DataFrame, x: str, names: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a column for each of `names`): quantiles of each group (see `_quantiles`)."""
    t = _quantiles(rows, x, sorted(set(names.values())), by)
    return t.groupBy(*by).agg(*[F.max(F.when(F.col("_p") == float(q), F.col("value"))).alias(n) for n, q in names.items()])


def summary(rows: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, mean, p5, p25, p50, p75, p95) of usable values."""
    ok = rows.filter(usable(x))
    qs = quantiles(ok, x, {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, by)
    n = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    return beside(n, qs, by)


def operating_points(rows: DataFrame, score: str, source: str, reference: str, fpr: list[float]) -> DataFrame:
    """(source, fpr, threshold, flagged): the share of each source strictly below the reference's fpr-quantile."""
    # Read by the sketch, by the threshold and by the shares.
    ok = stash(rows.filter(usable(score)).select(source, clipped(score).alias("x")), "scores")
    cuts = quantile_table(ok.filter(F.col(source) == reference), "x", fpr).select(F.col("p").alias("fpr"), F.col("value").alias("threshold"))
    met = ok.crossJoin(F.broadcast(cuts))  # a row for each rate asked for
    return met.groupBy(source, "fpr", "threshold").agg(F.avg((F.col("x") < F.col("threshold")).cast("double")).alias("flagged"))


def source_report(rows: DataFrame, score: str, source: str, reference: str, fpr: float = 0.05) -> DataFrame:
    """One row per source: songs, failed, q1, median, q3, auroc against the reference, share below its fpr-quantile.

    Rows are counted by source and score once. One ranking of these counts beside the reference's gives
    quantiles and AUROC of all sources, and the threshold; a second reading of the counts what lies below it.
    The null source is a source, too; the reference has no AUROC.
    """
    counts = stash(rows.groupBy(source, score).agg(F.count("*").alias("_k")), "score-counts")
    ok = counts.filter(usable(score)).select(source, clipped(score).alias("_x"), F.col(score).alias("_s"), "_k")
    sums = counts.groupBy(source).agg(F.sum("_k").alias("songs"), F.coalesce(F.sum(F.when(~usable(score), F.col("_k"))), F.lit(0)).alias("failed"))
    placed = beside(standings(ok, (), source, "_s", "_k", reference), sums, [source])
    placed = placed.withColumn("_n", F.col("songs") - F.col("failed")).crossJoin(F.broadcast(_of_reference(ok, (), source, reference)))  # one row
    holds = lambda place: (F.col("_own") <= place) & (place < F.col("_own") + F.col("_k"))

    def value(q: float) -> Column:
        place = F.col("_n").cast("double") - 1
        return _picked(F.max(place) * q, lambda p: F.max(F.when(holds(p), F.col("_x"))), place * q)

    at = placed.groupBy(source).agg(*[value(q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("_cut", fpr))], _auroc(True).alias("auroc"))
    at = stash(at.withColumn("auroc", F.when(~F.col(source).eqNullSafe(reference), F.col("auroc"))), "source-report")
    cut = F.broadcast(at.filter(F.col(source) == reference).select(F.col("_cut").alias("_t")))  # one row
    under = ok.crossJoin(cut).groupBy(source).agg((F.sum(F.when(F.col("_x") < F.col("_t"), F.col("_k")).otherwise(0)) / F.sum("_k")).alias("below"))
    return beside(beside(sums, at.drop("_cut"), [source], "left"), under, [source], "left")


def pooled(rows: DataFrame, source: str, pools: dict[str, list[str]]) -> DataFrame:
    """Rows with `pool`: one for each pool that the row's source is in; pools may overlap."""
    names = F.array_compact(F.array(*[F.when(F.col(source).isin(*members), F.lit(name)) for name, members in pools.items()]))
    return rows.withColumn("pool", F.explode(names))


def spearman(rows: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """(rho): correlation of ordinal ranks, ties in order of `tie`."""
    one = numbered(rows.select(a, b, tie), [a, tie], "_a")
    return numbered(one, [b, tie], "_b").agg(F.corr("_a", "_b").alias("rho"))


def squared_correlation(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., r2): null with under three rows or no variance."""
    ok = (F.count("*") >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return rows.groupBy(*by).agg(F.when(ok, F.pow(F.corr(a, b), 2)).alias("r2"))


def leave_one_out_means(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Rows of groups of two or more with `loo`: the mean of the others of its group."""
    w = W.partitionBy(group)
    out = rows.withColumn("_n", F.count(x).over(w)).filter("_n > 1")
    return out.withColumn("loo", (F.sum(x).over(w) - F.col(x)) / (F.col("_n") - 1)).drop("_n")


def operating_grid(rows: DataFrame, score: str, source: str, reference: str, most: float = 0.2, weight: float = 1.0) -> DataFrame:
    """(fpr, tpr): the 1 %-grid point up to `most` with the largest tpr - weight * fpr, the smallest of equals."""
    grid = [round(0.01 * i, 2) for i in range(1, int(round(most * 100)) + 1)]
    points = operating_points(rows.withColumn("_pool", F.when(F.col(source) == reference, "r").otherwise("s")), score, "_pool", "r", grid)
    points = points.filter("_pool = 's'").select("fpr", F.col("flagged").alias("tpr"))
    return points.withColumn("gain", F.round(F.col("tpr") - weight * F.col("fpr"), 12)).orderBy(F.desc("gain"), "fpr").limit(1).select("fpr", "tpr")


def cross_fitted(shares: DataFrame, item: str, a: str, b: str, levels: list[float]) -> DataFrame:
    """(level, k): how many items, ranked by half A, hold so much of half B."""
    placed = numbered(shares.select(item, a, b), [F.desc(a), item], "_at")
    run = running_before(placed, (), "_at", b, "_before")
    whole = F.broadcast(shares.agg(F.sum(b).alias("_all")))  # one row
    out = run.crossJoin(whole).select((F.col("_at") + 1).alias("k"), ((F.col("_before") + F.coalesce(b, F.lit(0))) / F.col("_all")).alias("share"), F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    return out.filter("share >= level - 1e-12").groupBy("level").agg(F.min("k").cast("int").alias("k"))
