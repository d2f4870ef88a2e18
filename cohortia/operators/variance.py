"""Unit moments and nested variance components, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.operators.resample import interval, multiplicities
from cohortia.sources.scratch import stash


def unit_moments(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, mean, var): population variance, not below 0."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.greatest(F.var_pop(x), F.lit(0.0)).alias("var"))


def with_geometric_mean(rows: DataFrame, unit: str, x: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.exp(F.avg(F.ln(x)).over(W.partitionBy(unit))))


def _dispersion(k: Column, m: Column, v: Column) -> Column:
    t, km = F.sum(k), F.sum(k * m)
    own = t * F.sum(k * v) - F.sum(k * k * v)
    far = t * F.sum(k * m * m) - F.sum(k * k * m * m) - (km * km - F.sum(k * k * m * m))
    return F.when(t * t - F.sum(k * k) > 0, (own + far) / (t * t - F.sum(k * k)))


def pair_dispersion(units: DataFrame, by: tuple[str, ...] = (), k: str = "n", m: str = "mean", v: str = "var") -> DataFrame:
    """(by, dispersion): half the mean squared difference of items of two units, without listing pairs.

    From sums over units with weight k, mean m and population variance v; null for less than two.
    """
    return units.groupBy(*by).agg(_dispersion(F.col(k).cast("double"), F.col(m), F.col(v)).alias("dispersion"))


def component_pieces(rows: DataFrame, work: str, recording: str, x: str) -> DataFrame:
    """One row per work with what its windows, recordings and itself add to the nested components.

    win_sum, win_count: variances with n - 1 of its recordings of two or more windows. rec_disp: the
    dispersion between its recordings, each weighing the same; null for less than two. mean, var: of all its windows.
    """
    rec = unit_moments(rows, [work, recording], x)
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    mean = F.sum(n * m) / F.sum("n")
    return rec.groupBy(work).agg(
        F.coalesce(F.sum(F.when(n > 1, v * n / (n - 1))), F.lit(0.0)).alias("win_sum"),
        F.count_if(n > 1).alias("win_count"),
        F.when(F.count("*") > 1, _dispersion(F.lit(1.0), m, v)).alias("rec_disp"),
        mean.alias("mean"),
        F.greatest(F.sum(n * (v + m * m)) / F.sum("n") - mean * mean, F.lit(0.0)).alias("var"),
    )


def components_of(pieces: DataFrame, weight: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., works, recordings, windows, total): components with each work's pieces weighted.

    windows: the mean of recordings' variances. recordings: the mean of works' dispersions between
    recordings, less windows. works: the dispersion between works, less the former; a copy of a work makes no
    pair with itself. The parts sum to the dispersion between works; null where there is nothing to compare.
    """
    k = weight.cast("double")
    has = F.col("rec_disp").isNotNull()
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    sums = pieces.groupBy(*by).agg(
        ratio(k * F.col("win_sum"), k * F.col("win_count")).alias("windows"),
        ratio(F.when(has, k * F.col("rec_disp")), F.when(has, k)).alias("_rec"),
        _dispersion(k, F.col("mean"), F.col("var")).alias("total"),
    )
    return sums.select(*by, (F.col("total") - F.col("_rec")).alias("works"), (F.col("_rec") - F.col("windows")).alias("recordings"), "windows", "total")


def components(rows: DataFrame, work: str, recording: str, x: str) -> DataFrame:
    """(works, recordings, windows, total): nested variance components, every work and recording weighing the same."""
    return components_of(component_pieces(rows, work, recording, x), F.lit(1.0))


#: Levels of the components, from the outside.
LEVELS = ("works", "recordings", "windows")


def component_intervals(rows: DataFrame, work: str, recording: str, x: str, reps: int, seed: str, level: float = 0.95) -> DataFrame:
    """(level, variance, share, low, high): each component, its share of the total and that share's interval over resampled works.

    A replicate weights the works' pieces by how often it drew them; no window is copied.
    """
    pieces = stash(component_pieces(rows, work, recording, x), "component-pieces")
    drawn = multiplicities(pieces, work, reps, seed, carry=("win_sum", "win_count", "rec_disp", "mean", "var"))
    each = lambda df, *by: df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("variance"), (F.col(n) / F.col("total")).alias("share")) for n in LEVELS])).alias("_l")).select(*by, "_l.*")
    spread = interval(each(components_of(drawn, F.col("times"), ("rep",)), "rep"), "share", ("level",), level)
    return each(components_of(pieces, F.lit(1.0))).join(spread, "level", "left")


def slot_effects(rows: DataFrame, recording: str, order: str, x: str, k: int) -> DataFrame:
    """(slot, effect, n, explained): the mean deviation of each slot from its recording's mean, over recordings of k windows.

    explained, the same in each row, is the share of these recordings' inner squares that the slots' means make up.
    """
    w = W.partitionBy(recording)
    full = rows.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") == k)
    full = full.withColumn("slot", F.row_number().over(w.orderBy(order)) - 1).withColumn("dev", F.col(x) - F.avg(x).over(w))
    slots = full.groupBy("slot").agg(F.avg("dev").alias("effect"), F.count("*").alias("n"), F.sum(F.col("dev") * F.col("dev")).alias("_ss"))
    all_ = W.partitionBy()  # k rows
    explained = F.sum(F.col("n") * F.col("effect") * F.col("effect")).over(all_) / F.sum("_ss").over(all_)
    return slots.select("slot", "effect", "n", F.when(F.sum("_ss").over(all_) > 0, explained).alias("explained"))


def squared_mean(units: DataFrame, by: list[str], pos: str, a: str, k: str) -> DataFrame:
    """(by, delta2): the sum over dimensions of an unbiased squared mean, over pairs of different units."""
    w = F.col(k).cast("double")
    x = F.col(a)
    each = units.groupBy(*by, pos).agg(((F.pow(F.sum(w * x), 2) - F.sum(w * w * x * x)) / (F.pow(F.sum(w), 2) - F.sum(w * w))).alias("u"))
    return each.groupBy(*by).agg(F.sum("u").alias("delta2"))


def recording_deviation(rows: DataFrame, work: str, recording: str, x: str) -> DataFrame:
    """(work, recording, deviation): a recording's mean less its work's, in works of two or more recordings."""
    rec = rows.groupBy(work, recording).agg(F.avg(x).alias("m"))
    w = W.partitionBy(work)
    return rec.withColumn("r", F.count("*").over(w)).filter("r > 1").withColumn("deviation", F.col("m") - F.avg("m").over(w)).select(work, recording, "deviation")
