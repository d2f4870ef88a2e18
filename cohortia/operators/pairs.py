"""Pairs within groups: all of them, capped samples, round-robin schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.hashing import shuffle_key, uniform
from cohortia.operators import ranks
from cohortia.sources.scratch import stash


def clique_pairs(items: DataFrame, group: str, key: str, block: int = 512) -> DataFrame:
    """(group, key_a, key_b), key_a < key_b: every unordered pair of a group.

    A group of more than `block` items is dealt in blocks, each pair of which is a join key of its own, so a
    large group's pairs are made in many tasks. The result is as long as there are pairs; capped samples and
    round robins list fewer.
    """
    parts = items.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_parts"))
    rows = ranks.beside(items.select(group, key), parts.filter(F.col(group).isNotNull()), [group])
    own = rows.withColumn("_own", F.pmod(F.xxhash64(key), "_parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    a = own.select(group, F.col(key).alias("key_a"), F.col("_own").alias("_a"), every.alias("_b"))
    b = own.select(group, F.col(key).alias("key_b"), F.col("_own").alias("_b"), every.alias("_a"))
    return a.join(b, [group, "_a", "_b"]).filter("key_a < key_b").drop("_a", "_b")


def clique_profile(items: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, span): how many pairs `clique_pairs` gives for a group, and the sum of key_b - key_a over them.

    Read off the keys' places, so groups whose pairs nobody could list have it in the time of a sort: a key at place i of
    m is taken away m - 1 - i times and added i times; equal keys make no pair. Groups without pairs have no row.
    """
    placed = ranks.places(items.select(group, key).dropna(), [group], [key], "_i", "_m")
    signed = placed.groupBy(group, key).agg(F.count("*").alias("_k"), F.sum(2 * F.col("_i") - F.col("_m") + 1).alias("_w"), F.max("_m").alias("_m"))
    equal = F.sum(F.expr("_k * (_k - 1) div 2"))
    sums = signed.groupBy(group).agg((F.expr("max(_m) * (max(_m) - 1) div 2") - equal).alias("n"), F.sum(F.col("_w") * F.col(key)).alias("span"))
    return sums.filter("n > 0")


def numbered(items: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """(group, key, i, n): places from 0 in the group's shuffled order, and the group's size."""
    return ranks.places(items.select(group, key), [group], [shuffle_key(seed, F.col(group), F.col(key)), key], "i", "n").select(group, key, "i", "n")


def _looked_up(slots: DataFrame, places: DataFrame, group: str, key: str) -> DataFrame:
    """Slots of two places (a, b) with the keys that stand there, the smaller first."""
    one = places.select(group, F.col("i").alias("a"), F.col(key).alias("_x"))
    two = places.select(group, F.col("i").alias("b"), F.col(key).alias("_y"))
    out = slots.join(one, [group, "a"]).join(two, [group, "b"])
    return out.withColumn("key_a", F.least("_x", "_y")).withColumn("key_b", F.greatest("_x", "_y")).drop("_x", "_y", "a", "b")


def capped_pairs(items: DataFrame, group: str, key: str, most: int, seed: str = "pairs") -> DataFrame:
    """(group, key_a, key_b): all pairs of a group, or about `most` drawn without repeats from a large one.

    Pair numbers are drawn and unranked, so a large group's pairs are never listed: number t is the pair
    (i, j) with j = floor((1 + sqrt(1 + 8 t)) / 2) and i = t - j (j - 1) / 2. A group with more pairs
    than `most` gets a number from each of `most` equal ranges.
    """
    places = numbered(items, group, key, seed)
    sizes = places.groupBy(group).agg(F.max("n").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2")).filter("pairs > 0")
    draws = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("pairs", F.lit(most)) - 1)))
    low = F.expr(f"k * pairs div {most}")
    width = F.expr(f"(k + 1) * pairs div {most}") - low
    drawn = low + F.floor(uniform(seed, F.col(group), F.col("k")) * width)
    draws = draws.withColumn("t", F.when(F.col("pairs") <= most, F.col("k")).otherwise(drawn))
    draws = draws.withColumn("b", F.floor((1 + F.sqrt(1 + 8 * F.col("t"))) / 2))
    # The root of a large number may be off by one.
    draws = draws.withColumn("b", F.when(F.expr("b * (b - 1) div 2") > F.col("t"), F.col("b") - 1).when(F.expr("b * (b + 1) div 2") <= F.col("t"), F.col("b") + 1).otherwise(F.col("b")))
    draws = draws.withColumn("a", F.col("t") - F.expr("b * (b - 1) div 2"))
    return _looked_up(draws.select(group, "a", "b"), places, group, key).select(group, "key_a", "key_b")


def round_robin(items: DataFrame, group: str, key: str, seed: str = "rounds", rounds: int | None = None) -> DataFrame:
    """(group, round, slot, key_a, key_b): each round pairs everyone once, all rounds pair each two once.

    By the circle method, in closed form; `rounds` stops after so many, which bounds a large group.
    """
    places = numbered(items, group, key, seed)
    sizes = places.groupBy(group).agg(F.max("n").alias("n")).filter("n > 1").withColumn("m", F.col("n") + F.col("n") % 2)
    last = F.col("m") - 2 if rounds is None else F.least(F.col("m") - 2, F.lit(rounds - 1))
    slots = sizes.withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("m div 2 - 1"))))
    slots = slots.withColumn("a", F.expr("CASE WHEN slot = 0 THEN 0 ELSE (round + slot - 1) % (m - 1) + 1 END")).withColumn("b", F.expr("(round + m - 2 - slot) % (m - 1) + 1"))
    slots = slots.filter("a < n AND b < n").select(group, "round", "slot", "a", "b")
    return _looked_up(slots, places, group, key)


def cross_group_pairs(items: DataFrame, group: str, key: str, n: int, seed: str = "negatives") -> DataFrame:
    """(draw, key_a, key_b, group_a, group_b): n pairs of items from two different groups, drawn by hash.

    A draw takes two different groups, each as likely as any other, then an item of each; so n pairs come
    of it however large a group is. A pair can be drawn again. No pairs where there is one group only.
    """
    spark = items.sparkSession
    placed = stash(ranks.numbered(items.select(group, key), [group, key], "_at"), "items")
    sizes = ranks.numbered(placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_size")), [group], "_g")
    sizes = stash(sizes, "groups")
    groups = sizes.count()
    u = lambda what: uniform(seed, what, F.col("draw"))
    draws = spark.range(n if groups > 1 else 0).select(F.col("id").alias("draw")).withColumn("_a", F.floor(u("group_a") * groups))
    draws = draws.withColumn("_b", (F.col("_a") + 1 + F.floor(u("group_b") * (groups - 1))) % max(groups, 1))
    for s in "ab":
        of = sizes.select(F.col("_g").alias(f"_{s}"), F.col(group).alias(f"group_{s}"), "_first", "_size")
        draws = draws.join(of, f"_{s}").withColumn("_at", F.col("_first") + F.floor(u(f"key_{s}") * F.col("_size"))).drop("_first", "_size")
        draws = draws.join(placed.select("_at", F.col(key).alias(f"key_{s}")), "_at").drop("_at")
    return draws.select("draw", "key_a", "key_b", "group_a", "group_b")


def first_passing(candidates: DataFrame, group: str, order: str, passed: Column, most: int, budget: int) -> DataFrame:
    """The first `most` candidates of each group that pass, within the first `budget` of its order."""
    w = W.partitionBy(group).orderBy(order)
    tried = candidates.withColumn("_ok", passed).withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= budget)
    tried = tried.withColumn("_k", F.sum(F.col("_ok").cast("bigint")).over(w))
    return tried.filter("_ok").filter(F.col("_k") <= most).drop("_ok", "_at", "_k")


def shortfalls(candidates: DataFrame, group: str, passed: Column, most: int, budget: int) -> DataFrame:
    """(group, kept, reason): groups that keep fewer than `most`: exhausted, or budget if more were left."""
    g = candidates.withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy("ord")))
    g = g.groupBy(group).agg(F.count_if(passed & (F.col("_at") <= budget)).alias("ok"), F.count("*").alias("n"))
    return g.filter(F.col("ok") < most).select(group, F.least("ok", F.lit(most)).alias("kept"), F.when(F.col("n") > budget, "budget").otherwise("exhausted").alias("reason"))


def adaptive_rounds(candidates: DataFrame, group: str, score, most: int, prior: float = 0.4, budget: int = 400) -> DataFrame:
    """The first `most` passing candidates of each group, scored in rounds that stop as soon as they can.

    `candidates` has `group` and `ord` (from 0); `score` takes some of them and adds a boolean `passed`.
    A round asks ceil(need / rate) more of each group, the rate being what passed there, at least 0.05,
    or `prior` until ten are known. Each round is one job over the new candidates; results are written,
    so a lost executor repeats no finished round. Rounds end when no group is asked for more: each asks at
    least one more candidate of a group that is short, so there are `budget` at most.
    """
    done = None
    while True:
        if done is None:
            state = candidates.select(group).distinct().select(group, F.lit(0).cast("bigint").alias("tried"), F.lit(0).cast("bigint").alias("ok"))
        else:
            state = done.groupBy(group).agg(F.count("*").alias("tried"), F.count_if("passed").alias("ok"))
        rate = F.when(F.col("tried") < 10, F.lit(prior)).otherwise(F.greatest(F.col("ok") / F.col("tried"), F.lit(0.05)))
        ask = state.filter(F.col("ok") < most).select(group, "tried", F.least(F.lit(budget).cast("bigint"), F.col("tried") + F.ceil((F.lit(most) - F.col("ok")) / rate)).alias("upto"))
        new = candidates.join(ask, group).filter("ord >= tried AND ord < upto").drop("tried", "upto")
        new = stash(score(new), "round")
        if new.isEmpty():
            break
        done = new if done is None else done.unionByName(new)
    if done is None:
        return candidates.withColumn("passed", F.lit(True)).limit(0)
    return first_passing(done, group, "ord", F.col("passed"), most, budget)
