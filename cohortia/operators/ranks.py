"""Global ranks and running sums that no single task holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.arrays import below
from cohortia.sources.scratch import stash


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the place, from 0, of each row in a total order of the whole table.

    Rows are range-partitioned and sorted; a row's place is its place in the partition plus the sizes of
    the partitions before, a table of one row for each. Ties must be broken by `order` for reruns to agree.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = stash(placed, "numbered")
    part = F.shiftrightunsigned("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before_part"))
    # One row for each partition of the range shuffle.
    out = placed.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return out.withColumn(name, F.col("_before_part") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_before_part")


def beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` with the columns of their group's row in `groups`; null keys are a group, too. Without keys `groups` is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    names = {k: f"_on{i}" for i, k in enumerate(keys)}
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(groups.withColumnsRenamed(names), met, how).drop(*names.values())


def places(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str, size: str | None = None) -> DataFrame:
    """Adds each row's place in its group, from 0, by a total order, and with `size` the group's number of rows.

    A group may hold any share of the table: rows are numbered in ranges of (group, order), so its rows lie in as many
    tasks as they need, and a place is the number less that of the group's first row. Null groups are groups.
    """
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    placed = numbered(rows.select("*", *[c.alias(n) for n, c in keys.items()]), [*groups, *keys], "_at").drop(*keys)
    firsts = placed.groupBy(*groups).agg(F.min("_at").alias("_at_first"), F.count("*").alias("_in_group"))
    out = beside(placed, firsts, groups).withColumn(name, F.col("_at") - F.col("_at_first"))
    return (out.withColumn(size, F.col("_in_group")) if size else out).drop("_at", "_at_first", "_in_group")


def in_ranges(rows: DataFrame, order: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds the number of a row's range: `order` is cut at quantiles of the whole table, by default once for each shuffle partition."""
    n = buckets or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], max(1000, 4 * n))).first()[0] or []
    cuts = sorted({c for c in cuts if c is not None})
    marks = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    return rows.withColumn(name, below(marks, len(cuts), F.col(order).cast("double")) if cuts else F.lit(0))


def running_before(rows: DataFrame, by: tuple[str, ...], order: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows of a group that come before by `order`, which is unique in it.

    Sums run inside ranges of `order`, and over the ranges' sums.
    """
    rows = in_ranges(rows, order, "_b", buckets)
    sums = rows.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    # One row for each group and range.
    ahead = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_ahead"))
    own = F.coalesce(F.sum(value).over(W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return beside(rows.withColumn("_own", own), ahead, [*by, "_b"]).withColumn(name, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_b")


def standings(counts: DataFrame, by: tuple[str, ...], source: str, score: str, times: str, reference) -> DataFrame:
    """Adds to counts by (by..., source, score) how many of the own source lie below, and of the reference below and at it.

    `_own`, `_ref` and `_tie`: all sources' counts go through ranges of scores together, in one shuffle, and
    a table of one row for each range and source carries what lies in the ranges before.
    """
    rows = in_ranges(counts, score, "_b")
    of_ref = F.when(F.col(source) == reference, F.col(times)).otherwise(0)
    sums = rows.groupBy(*by, "_b", source).agg(F.sum(times).alias("_s"), F.sum(of_ref).alias("_r"))
    before = lambda v, *keys: F.coalesce(F.sum(v).over(W.partitionBy(*keys).orderBy("_b").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(*by, "_b", source, before("_s", *by, source).alias("_s_ahead"), before("_r", *by).alias("_r_ahead"))
    here = W.partitionBy(*by, "_b")
    own = F.coalesce(F.sum(times).over(W.partitionBy(*by, "_b", source).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_upto", F.sum(of_ref).over(here.orderBy(score).rangeBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_tie", F.sum(of_ref).over(W.partitionBy(*by, "_b", score))).withColumn("_before", own)
    rows = beside(rows, ahead, [*by, "_b", source])
    rows = rows.withColumn("_own", F.col("_before") + F.col("_s_ahead")).withColumn("_ref", F.col("_upto") - F.col("_tie") + F.col("_r_ahead"))
    return rows.drop("_b", "_upto", "_before", "_s_ahead", "_r_ahead")
