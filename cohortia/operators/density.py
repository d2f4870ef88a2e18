"""Two-dimensional densities of points by kernels, for maps, in time linear in the points.

Sample points are counted in cells of a grid a fraction of a bandwidth wide, each shared out among the four
nodes around it. The kernel is a product, so it is laid over the nodes along one axis and then the other, and
the density at a point is read between the four nodes around it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.metrics import quantile_table, quantiles
from cohortia.sources.scratch import stash

#: Fixed value: interquartile range of a normal distribution in standard deviations.
IQR_OF_NORMAL = 1.349
#: Nodes a bandwidth, and bandwidths that a kernel reaches.
NODES, REACH = 8, 5


def bandwidths(sample: DataFrame) -> DataFrame:
    """One row (n, hx, hy): Silverman's rule in two dimensions with the smaller of deviation and scaled interquartile range.

    An axis whose quartiles are equal takes the deviation, one without any spread the bandwidth 1.
    """
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in ("x", "y")])
    long = sample.select(F.explode(axes).alias("_a")).select("_a.*")
    q = quantiles(long, "v", {"q1": 0.25, "q3": 0.75}, ("axis",)).join(long.groupBy("axis").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("sd")), "axis")
    iqr, sd = (F.col("q3") - F.col("q1")) / IQR_OF_NORMAL, F.col("sd")
    spread = F.when(iqr > 0, F.least(sd, iqr)).otherwise(sd)
    h = F.when(spread > 0, spread * F.pow(F.col("n").cast("double"), F.lit(-1 / 6))).otherwise(F.lit(1.0))
    of = lambda c: F.coalesce(F.max(F.when(F.col("axis") == c, F.col("h"))), F.lit(1.0)).alias(f"h{c}")
    return q.withColumn("h", h).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), of("x"), of("y"))


def _around(points: DataFrame, *keep: str) -> DataFrame:
    """(keep..., i, j, w): the four nodes around each point and its share of each."""
    at = {c: F.col(c) / (F.col(f"h{c}") / NODES) for c in ("x", "y")}
    low = {c: F.floor(at[c]) for c in at}
    part = {c: at[c] - low[c] for c in at}
    nodes = [
        F.struct((low["x"] + a).alias("i"), (low["y"] + b).alias("j"), ((part["x"] if a else 1 - part["x"]) * (part["y"] if b else 1 - part["y"])).alias("w"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return points.select(*keep, F.explode(F.array(*nodes)).alias("_n")).select(*keep, "_n.*")


def density_grid(sample: DataFrame, widths: DataFrame) -> DataFrame:
    """(i, j, density): a product-kernel estimate at the nodes that the kernels of the (x, y) in `sample` reach.

    A node lies at i, j times an eighth of a bandwidth. Kernels end at five bandwidths, where they are
    4e-6 of their peak. Sharing a point among nodes and reading between nodes are linear: together they
    are off by at most 4 axes' errors of 1 / 8 * (1 / 8)^2 of one kernel's peak, 0.8 %, and by far
    less where the density is smooth over a bandwidth.
    """
    cells = _around(sample.select("x", "y").filter("x IS NOT NULL AND y IS NOT NULL").crossJoin(F.broadcast(widths))).groupBy("i", "j").agg(F.sum("w").alias("w"))
    reach = F.explode(F.sequence(F.lit(-NODES * REACH), F.lit(NODES * REACH)))
    kernel = F.exp(-0.5 * F.pow(F.col("d") / NODES, F.lit(2)))
    for axis, other in (("i", "j"), ("j", "i")):
        spread = cells.withColumn("d", reach)
        cells = spread.groupBy((F.col(axis) + F.col("d")).alias(axis), other).agg(F.sum(F.col("w") * kernel).alias("w"))
    return cells.crossJoin(F.broadcast(widths)).select("i", "j", (F.col("w") / (2 * math.pi * F.col("hx") * F.col("hy") * F.col("n"))).alias("density"))


def density_at(points: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """(key, density): a product-kernel estimate at each (x, y) of `points` from those of `sample`, of any size.

    Points out of reach of the sample have density 0; points without x or y are left out. See `density_grid` for the error.
    """
    widths = stash(bandwidths(sample.filter("x IS NOT NULL AND y IS NOT NULL")), "bandwidths")
    grid = density_grid(sample, widths)
    near = _around(points.select(key, "x", "y").filter("x IS NOT NULL AND y IS NOT NULL").crossJoin(F.broadcast(widths)), key)
    return near.join(grid, ["i", "j"], "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce("density", F.lit(0.0))).alias("density"))


def coverage(densities: DataFrame, source: str, reference: str, masses: list[float]) -> DataFrame:
    """(source, mass, level, covered): the share of each source in the smallest region that holds each mass of the reference.

    The region is where the density is at least `level`, the (1 - mass)-quantile over the reference's own points.
    """
    densities = stash(densities, "densities")
    levels = quantile_table(densities.filter(F.col(source) == reference), "density", [1 - m for m in masses])
    named = F.create_map(*[x for m in masses for x in (F.lit(float(1 - m)), F.lit(float(m)))])
    levels = levels.select(named[F.col("p")].alias("mass"), F.col("value").alias("level"))
    met = densities.crossJoin(F.broadcast(levels))  # a row for each mass
    return met.groupBy(source, "mass", "level").agg(F.avg((F.col("density") >= F.col("level")).cast("int")).alias("covered"))


def framed(points: DataFrame, frame_of: DataFrame, share: float = 0.99, pad: float = 0.1) -> DataFrame:
    """`points` with x and y brought into a frame, and `outside`: whether that moved them.

    The frame holds the middle `share` of `frame_of` on each axis, and `pad` of its width more on either side.
    """
    a = (1 - share) / 2
    for c in ("x", "y"):
        q = quantiles(frame_of, c, {"_lo": a, "_hi": 1 - a}).select(*[(F.col(k) + sign * pad * (F.col("_hi") - F.col("_lo"))).alias(f"{k}{c}") for k, sign in (("_lo", -1), ("_hi", 1))])
        points = points.crossJoin(F.broadcast(q))  # one row
    inside = F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy"))
    points = points.withColumn("outside", ~inside)
    for c in ("x", "y"):
        points = points.withColumn(c, F.least(F.greatest(F.col(c), F.col(f"_lo{c}")), F.col(f"_hi{c}")))
    return points.drop("_lox", "_hix", "_loy", "_hiy")
