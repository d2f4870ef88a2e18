"""Score expressions and aggregates by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def views(style: str = "style", content: str = "content", alpha: float = 1.0) -> dict[str, Column]:
    """Named window scores: the factorised score and each term alone."""
    return {"score": F.col(style) + alpha * F.col(content), style: F.col(style), content: F.col(content)}


#: Named ways from a unit's window scores to its own.
AGGREGATES: dict[str, callable] = {
    "min": lambda x: F.min(x),
    "mean": lambda x: F.avg(x),
    "p10": lambda x: F.percentile(x, F.lit(0.1)),
}


def unit_scores(windows: DataFrame, keys: list[str], value: Column | str, aggregates: tuple[str, ...] = ("min", "mean", "p10")) -> DataFrame:
    """One row per unit with the named aggregates of its windows' values.

    Windows are dealt by unit before anything is summed: a task that reads a large file would else keep the values of all
    its units for the quantile.
    """
    value = F.col(value) if isinstance(value, str) else value
    dealt = windows.select(*keys, value.alias("_value")).repartition(*keys)
    value = F.col("_value")
    return dealt.groupBy(*keys).agg(*[AGGREGATES[a](value).alias(a) for a in aggregates])


def scaled_density(logp: Column, q: Column, h: Column, dims: int) -> Column:
    """Log density after a change of scale by h."""
    return logp - 0.5 * q * (F.exp(-h) - 1) - dims / 2 * h


def density_ratio(q: Column, h: Column) -> Column:
    return -q * F.exp(-h)
