"""Tables that grow: vectors, score records, mirrored files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.sources import versions


def write_vectors(vectors: DataFrame, path: str, by: str | None = None) -> None:
    """Append vectors; Spark's commit makes the new files visible at once or not at all."""
    writer = vectors.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def gather(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The stored rows of `ids`; ids that repeat are read once."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def capped(vectors: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each group, the first by `order`."""
    return vectors.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("_r") <= most).drop("_r")


def resume_scores(spark: SparkSession, path: str, scored: DataFrame, keys: list[str], identity: str) -> None:
    """Append records whose keys are not there yet; refuse a folder that another identity began."""
    try:
        kept = spark.read.text(f"{path}/identity").first()[0]
    except AnalysisException:
        spark.range(1).select(F.lit(identity)).write.text(f"{path}/identity")
        kept = identity
    if kept != identity:
        raise ValueError(f"{path} holds records of {kept}, not of {identity}")
    try:
        done = spark.read.schema(scored.schema).json(f"{path}/records").select(*keys).distinct()
        scored = scored.join(done, keys, "left_anti")
    except AnalysisException:
        pass
    scored.write.mode("append").json(f"{path}/records")


def read_scores(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/records")


def report(problems: DataFrame, path: str) -> bool:
    """Write a problem report with a header; true if there is none, for a gate's exit code."""
    problems.write.mode("overwrite").option("header", "true").csv(path)
    return problems.isEmpty()


def listing_of(spark: SparkSession, path: str, wanted: list[str], make: Callable[[list[str]], DataFrame], group: str = "group") -> DataFrame:
    """The listed rows of the wanted groups: from the listing kept at `path` if that covers them all and is sound, else made anew.

    What a listing covers is kept beside it, as a group may have no rows. Both are versioned tables.
    """
    rows, covers = f"{path}/rows", f"{path}/covers"
    sound = all(versions.commits(spark, p) and versions.problems(spark, p).isEmpty() for p in (rows, covers))
    if not sound or set(wanted) - {r[0] for r in versions.read(spark, covers).collect()}:
        versions.replace(make(wanted), rows)
        versions.replace(spark.createDataFrame([(g,) for g in wanted], f"`{group}` string").coalesce(1), covers)
    return versions.read(spark, rows).filter(F.col(group).isin(*wanted))


def mirror_index(listing: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, path) of all files there are; those the plan does not know have an empty path."""
    return listing.join(plan, "key", "left").select("key", F.coalesce("path", F.lit("")).alias("path"))
