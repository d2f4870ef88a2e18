"""Catalogue curation: duplicates, leaks, gates with reasons, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by `order`."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest_per_key(rows: DataFrame, key: str, order: str | Column, value: str) -> DataFrame:
    """(key, value): the value of each key's last row, by partial maxima."""
    order = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def leak_reasons(train: DataFrame, held_out: DataFrame, work: str, item: str) -> DataFrame:
    """`train` with `leak`: work, item or null; a shared work is named before a shared item.

    Two equi-joins: an OR in one condition would compare all pairs of rows.
    """
    works = held_out.select(F.col(work)).distinct().withColumn("_work", F.lit(True))
    items = held_out.select(F.col(item)).distinct().withColumn("_item", F.lit(True))
    flagged = train.join(works, work, "left").join(items, item, "left")
    leak = F.when(F.col("_work"), F.lit("work")).when(F.col("_item"), F.lit("item"))
    return flagged.select(*train.columns, leak.alias("leak"))


def leak_free(train: DataFrame, held_out: DataFrame, work: str, item: str) -> DataFrame:
    """Rows of `train` that share neither work nor item with `held_out`."""
    return train.join(held_out.select(work).distinct(), work, "left_anti").join(held_out.select(item).distinct(), item, "left_anti").select(*train.columns)


def overlap(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """(column, shared): how many distinct values two splits share in each column."""
    out = None
    for c in columns:
        n = a.select(c).intersect(b.select(c)).agg(F.count("*").alias("shared")).select(F.lit(c).alias("column"), "shared")
        out = n if out is None else out.unionByName(n)
    return out


def usable_assets(assets: DataFrame, allowed: DataFrame, dataset: DataFrame, held_out: DataFrame, key: str, work: str) -> DataFrame:
    """Assets with `reason`: stale (no longer in the dataset), leaked (not allowed), held out, or ok."""
    mark = lambda df, c, name: df.select(c).distinct().withColumn(name, F.lit(True))
    flagged = assets.join(mark(dataset, key, "_known"), key, "left").join(mark(allowed, key, "_allowed"), key, "left").join(mark(held_out, work, "_held"), work, "left")
    reason = F.when(F.col("_known").isNull(), "stale").when(F.col("_held"), "held out").when(F.col("_allowed").isNull(), "leaked").otherwise("ok")
    return flagged.select(*assets.columns, reason.alias("reason"))


def pair_gate(pairs: DataFrame, tracks: DataFrame, files: DataFrame, least: float) -> DataFrame:
    """Pairs with `reason`, in this order: missing track, missing file, low score, or ok."""
    out = pairs
    for side in ("a", "b"):
        known = tracks.select(F.col("key").alias(f"key_{side}")).distinct().withColumn(f"_t{side}", F.lit(True))
        there = files.select(F.col("key").alias(f"key_{side}")).distinct().withColumn(f"_f{side}", F.lit(True))
        out = out.join(known, f"key_{side}", "left").join(there, f"key_{side}", "left")
    reason = F.when(F.col("_ta").isNull() | F.col("_tb").isNull(), "missing track").when(F.col("_fa").isNull() | F.col("_fb").isNull(), "missing file").when(F.col("score") < least, "low score").otherwise("ok")
    return out.select(*pairs.columns, reason.alias("reason"))


def problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, problem): a row for each check that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return rows.select(key, F.explode(found).alias("problem"))


def complete_units(windows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Windows of units that have exactly `k`."""
    return windows.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter(F.col("_n") == k).drop("_n")


def all_or_nothing(windows: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Windows of units in which every window is ok."""
    return windows.withColumn("_ok", F.bool_and(ok).over(W.partitionBy(*keys))).filter("_ok").drop("_ok")


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one of two tables lacks."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.filter("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "a").otherwise("b").alias("side"))


def todo(wanted: DataFrame, done: DataFrame, failed: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """What is wanted and neither done nor failed for good, in order of key."""
    left = wanted.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti").orderBy(key)
    return left.limit(most) if most is not None else left


def require_equal(left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    """`left`, after checking that two one-row tables of settings agree."""
    a, b = left.first().asDict(), right.first().asDict()
    if a != b:
        raise ValueError(f"{what} differ: {a} and {b}")
    return left


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """`a`, after checking that it shares no key with `b`."""
    shared = a.join(b.select(key).distinct(), key, "left_semi").select(key).limit(3).collect()
    if shared:
        raise ValueError(f"{key} in both: {[r[0] for r in shared]}")
    return a


def collisions(paths: DataFrame, key: Column) -> DataFrame:
    """(key, paths, n) of keys that more than one path falls on; `paths` has a column path."""
    return paths.select(key.alias("key"), "path").distinct().groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n")).filter("n > 1")


def reuse(candidates: DataFrame, results: DataFrame, keys: list[str], compute) -> DataFrame:
    """Results of all candidates: those there are, and `compute` of the others."""
    have = candidates.join(results, keys, "inner")
    return have.unionByName(compute(candidates.join(results.select(*keys), keys, "left_anti")))
