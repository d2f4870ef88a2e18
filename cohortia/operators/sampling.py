"""Deterministic samples: seeded by portable hashes, extendable, nested, stratified, balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.hashing import shuffle_key, uniform
from cohortia.operators.ranks import beside, numbered, places


def nested_fractions(works: DataFrame, work: str, order: list[str | Column], block: int, seed: str) -> DataFrame:
    """Works with `u` in [0, 1): {u < f} is a stratified subset, those for smaller f lie inside it.

    Works in order of size are cut into blocks; inside each they stand in hash order, u being
    (place + a draw) / the block's length, so a subset takes its share of every block.
    """
    w = numbered(works, order, "_b").withColumn("_b", F.floor(F.col("_b") / block))
    inside = W.partitionBy("_b")
    place = F.row_number().over(inside.orderBy(shuffle_key(seed, F.col(work)), work)) - 1
    return w.withColumn("u", (place + uniform(seed, F.lit("jitter"), F.col(work))) / F.count("*").over(inside)).drop("_b")


def size_stratified(works: DataFrame, work: str, order: list[str | Column], n: int, seed: str) -> DataFrame:
    """One work, by hash, of each of n contiguous bins by size; place p of N is in bin ((p + 1) n - 1) div N."""
    w = numbered(works, order, "_place").crossJoin(F.broadcast(works.agg(F.count("*").alias("_n"))))
    w = w.withColumn("bin", F.expr(f"((_place + 1) * {n} - 1) div _n"))
    return w.groupBy("bin").agg(F.min_by(work, F.struct(shuffle_key(seed, F.col(work)), F.col(work))).alias(work))


def matched_halves(works: DataFrame, work: str, order: list[str | Column], seed: str) -> DataFrame:
    """Works with `half`, a or b: neighbours by size are pairs and a draw for each pair says who goes where."""
    w = numbered(works, order, "_r")
    pair = F.expr("_r div 2")
    first = (uniform(seed, pair) < 0.5) == (F.col("_r") % 2 == 0)
    return w.withColumn("half", F.when(first, "a").otherwise("b")).drop("_r")


def best_source(counts: DataFrame, work: str, source: str, n: str, ordinal: str, least: int) -> DataFrame:
    """The source with most of each work, the first of equals by `ordinal`; works under `least` are left out."""
    w = W.partitionBy(work).orderBy(F.desc(n), ordinal)
    return counts.filter(F.col(n) >= least).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def capped(rows: DataFrame, group: str, key: str, first: Column, cap: int, seed: str) -> DataFrame:
    """All rows where `first` holds, even over the cap, then others by hash up to `cap`.

    Of the others each task hands on `cap` of a group at most.
    """
    always = F.coalesce(first, F.lit(False))
    others = rows.filter(~always).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(shuffle_key(seed, F.col(key)), key))).filter(F.col("_r") <= cap)
    taken = rows.filter(always).groupBy(group).agg(F.count("*").alias("_taken"))
    others = beside(others, taken, [group], "left").filter(F.col("_r") <= cap - F.coalesce("_taken", F.lit(0)))
    return rows.filter(always).unionByName(others.drop("_r", "_taken"))


def extendable(rows: DataFrame, by: str, key: str, n: int, seed: str, skip: int = 0) -> DataFrame:
    """n rows of each source in seeded order, after the first `skip`: a larger n keeps what a smaller took."""
    w = W.partitionBy(by).orderBy(shuffle_key(seed, F.col(by), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") > skip) & (F.col("_r") <= skip + n)).drop("_r")


def interleaved(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with `turn`: the first of each source, then the second of each, and so on."""
    return numbered(places(rows, [by], [order], "_r"), ["_r", by], "turn").withColumn("turn", F.col("turn") + 1).drop("_r")


def chunked(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Rows with `chunk`: at most `cap` consecutive rows of a group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / cap))


def sharded(groups: DataFrame, group: str, n: int) -> DataFrame:
    """(group, shard): groups in order, dealt to n shards in turn; all rows of a group share a shard."""
    return numbered(groups.select(group).distinct(), [group], "shard").withColumn("shard", F.pmod("shard", F.lit(n)))


def held_out_groups(rows: DataFrame, by: str, group: str, fraction: float, seed: str) -> DataFrame:
    """Rows with `val`: of each source's groups the first by hash, a fraction, at least one and not all."""
    g = places(rows.select(by, group).distinct(), [by], [shuffle_key(seed, F.col(by), F.col(group)), group], "_r", "_n")
    take = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * fraction).cast("bigint")))
    return beside(rows, g.select(by, group, (F.col("_r") < take).alias("val")), [by, group])


def one_per_group(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """A row by hash of each of n groups, the groups by hash too."""
    w = W.partitionBy(group).orderBy(shuffle_key(seed, F.col(group), F.col(key)), key)
    one = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return one.orderBy(shuffle_key(seed, F.lit("groups"), F.col(group)), group).limit(n)
