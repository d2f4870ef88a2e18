"""Tables that are replaced whole: a folder for each version and a pointer that is switched last.

A write goes to a new folder; its files are listed in a manifest, and one row in `commits` then makes the
version the current one. Readers follow the newest commit, so a write that fails half-way leaves them the
whole old table. Counts and digest are observed while the rows are written, without reading them again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

_COMMIT = "number long, name string, rows long, digest string, at double"


def _at(spark: SparkSession, path: str):
    """The store that holds a path, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def _digest(df: DataFrame) -> Column:
    """The sum of all rows' hashes, whatever their order."""
    hashed = F.xxhash64(*[F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema])
    return F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length), from the listing alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def commits(spark: SparkSession, path: str) -> list[Row]:
    """All commits, oldest first; two writers that took one number follow each other by time."""
    if not _there(spark, f"{path}/commits"):
        return []
    return spark.read.schema(_COMMIT).json(f"{path}/commits").orderBy("number", "at", "name").collect()


def _commit_of(spark: SparkSession, path: str, number: int | None) -> Row:
    found = [c for c in commits(spark, path) if number in (None, c.number)]
    if not found:
        raise ValueError(f"{path} has no version {'' if number is None else number}".rstrip())
    return found[-1]


def replace(df: DataFrame, path: str) -> int:
    """Write `df` as the new version of the table at `path` and return its number; it is current once all is written."""
    spark, name, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), _digest(df).alias("digest")).write.parquet(f"{path}/versions/{name}")
    _files(spark, f"{path}/versions/{name}").coalesce(1).write.parquet(f"{path}/manifests/{name}")
    number = max((c.number for c in commits(spark, path)), default=0) + 1
    row = spark.createDataFrame([(number, name, seen.get["rows"], seen.get["digest"], time.time())], _COMMIT)
    row.coalesce(1).write.mode("append").json(f"{path}/commits")
    return number


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current version, or version `number` while it is kept."""
    return spark.read.parquet(f"{path}/versions/{_commit_of(spark, path, number).name}")


def problems(spark: SparkSession, path: str, number: int | None = None, deep: bool = False) -> DataFrame:
    """(file, problem) of a committed version: files that are missing, strange or of another length.

    `deep` reads the rows of a version without such files, too, and compares their count and digest.
    """
    commit = _commit_of(spark, path, number)
    want = spark.read.parquet(f"{path}/manifests/{commit.name}").select("file", F.col("length").alias("want"))
    folder = f"{path}/versions/{commit.name}"
    here = _files(spark, folder) if _there(spark, folder) else spark.createDataFrame([], "file string, length long")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("want").isNull(), "strange").when(F.col("length") != F.col("want"), "cut or changed")
    found = want.join(here, "file", "full").select("file", problem.alias("problem")).filter("problem IS NOT NULL")
    if deep and found.isEmpty():
        rows = read(spark, path, commit.number)
        now = rows.agg(F.count(F.lit(1)).alias("rows"), _digest(rows).alias("digest"))
        found = now.filter((F.col("rows") != commit.rows) | (F.col("digest") != commit.digest)).select(F.lit("").alias("file"), F.lit("rows changed").alias("problem"))
    return found


def ensure(spark: SparkSession, path: str, make: Callable[[], DataFrame], deep: bool = False) -> DataFrame:
    """The current version; if there is none, or it is broken, `make` gives the rows of a new one first."""
    if not commits(spark, path) or not problems(spark, path, deep=deep).isEmpty():
        replace(make(), path)
    return read(spark, path)


def expire(spark: SparkSession, path: str, seconds: float) -> list[str]:
    """Remove versions that another replaced more than `seconds` ago and writes begun before that and never committed.

    The current version stays. Readers of a version have `seconds` after it was replaced to finish.
    """
    now = time.time()
    fs, folder = _at(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    log = commits(spark, path)
    current, replaced = log[-1].name if log else None, {a.name: b.at for a, b in zip(log, log[1:])}
    gone = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name != current and now - replaced.get(name, status.getModificationTime() / 1000) > seconds:
            fs.delete(status.getPath(), True)
            fs.delete(_at(spark, f"{path}/manifests/{name}")[1], True)
            gone.append(name)
    return sorted(gone)
