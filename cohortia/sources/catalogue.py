"""Catalogue, manifest and ledger files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import stem

#: A catalogue file has no header; the performance comes before the work.
CATALOGUE = "performance string, work string, title string, artist string, video string"
PAIRS = "key_a string, key_b string, song_id long, score double, oti int, n_points int"
OUTCOMES = "key string, url string, status string, retryable string, detail string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a catalogue with `ok`: false where ids are no integers or a field is missing or empty.

    work_id, version_id, title, artist, video_id are trimmed; quotes are doubled inside quoted fields.
    """
    raw = spark.read.schema(CATALOGUE).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return checked_catalogue(raw)


def checked_catalogue(raw: DataFrame) -> DataFrame:
    trimmed = raw.select(*[F.trim(c).alias(c) for c in raw.columns])
    out = trimmed.select(
        F.expr("try_cast(work AS bigint)").alias("work_id"),
        F.expr("try_cast(performance AS bigint)").alias("version_id"),
        "title",
        "artist",
        F.when(F.col("video") != "", F.col("video")).alias("video_id"),
    )
    return out.withColumn("ok", F.col("work_id").isNotNull() & F.col("version_id").isNotNull() & F.col("video_id").isNotNull())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Manifest rows under a fixed schema: files that lack a field give nulls."""
    return spark.read.schema(schema).json(path)


def list_assets(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(name, key, length, folder) of the files under `path`; hidden and partial files are skipped.

    Only file metadata is read, never contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    files = files.select(F.element_at(parts, -1).alias("name"), "length", F.try_element_at(parts, F.lit(-2)).alias("folder"))
    files = files.filter(~F.col("name").startswith(".") & ~F.col("name").endswith(".part"))
    if suffixes:
        files = files.filter(F.col("name").rlike(f"({'|'.join(s.replace('.', '[.]') for s in suffixes)})$"))
    return files.select("name", stem(F.col("name")).alias("key"), "length", "folder")


def unlisted(arrived: DataFrame, ledger: DataFrame, name: str = "name") -> DataFrame:
    """Names whose stem the ledger does not list, one for each stem (the least): what to append to it."""
    new = arrived.select(F.col(name).alias("name")).withColumn("key", stem(F.col("name"))).groupBy("key").agg(F.min("name").alias("name"))
    return new.join(ledger.select(stem(F.col(name)).alias("key")).distinct(), "key", "left_anti").select("name")


def append_ledger(spark: SparkSession, path: str, arrived: DataFrame) -> None:
    """Append what is not listed yet to a one-column text ledger; a second run adds nothing."""
    from pyspark.errors import AnalysisException

    try:
        ledger = spark.read.schema("name string").text(path).withColumnRenamed("value", "name")
        ledger = ledger.select("name")
    except AnalysisException:
        ledger = spark.createDataFrame([], "name string")
    unlisted(arrived, ledger).write.mode("append").text(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome rows of files with four columns (older) or five; header rows are left out."""
    raw = spark.read.schema(OUTCOMES).option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(path)
    return raw.filter(F.col("key") != "key")


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (epoch, step, total, term, value) of lines `epoch E step S/T  k=v k=v`; others are skipped."""
    head = r"^epoch (\d+) step (\d+)/(\d+) "
    lines = spark.read.text(path).filter(F.col("value").rlike(head))
    number = lambda k: F.regexp_extract("value", head, k).cast("bigint")
    pairs = F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z_/]+=[-+0-9.eE]+)"), F.lit(1)))
    rows = lines.select(number(1).alias("epoch"), number(2).alias("step"), number(3).alias("total"), pairs.alias("kv"))
    return rows.select("epoch", "step", "total", F.split("kv", "=")[0].alias("term"), F.split("kv", "=")[1].cast("double").alias("value"))


def shared_terms(history: DataFrame, step: str = "step") -> DataFrame:
    """(term) that a wide run history holds under both `train/` and `val/`, with values in each."""
    values = [c for c in history.columns if "/" in c]
    long = history.select(step, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    long = long.unpivot([step], [F.col(f"`{c}`") for c in values], "name", "value").filter("value IS NOT NULL")
    long = long.select(F.split("name", "/")[0].alias("phase"), F.split("name", "/")[1].alias("term"))
    return long.filter(F.col("phase").isin("train", "val")).groupBy("term").agg(F.count_distinct("phase").alias("phases")).filter("phases = 2").select("term")


def write_designation(works: DataFrame, path: str, most: int = 1000) -> None:
    """Write (split, work, source, n_tracks) as designation lines of about `most` works of a split each.

    Every line is a whole designation object; read together they are one. `work` must be there once a split.
    """
    blocks = max(1, -(-works.count() // most))
    parts = works.groupBy("split", F.pmod(F.xxhash64("work"), F.lit(blocks)).alias("part"))
    body = F.map_from_entries(F.collect_list(F.struct(F.col("work").cast("string"), F.struct("source", "n_tracks"))))
    lines = parts.agg(F.struct(body.alias("works")).alias("body"))
    lines.select(F.create_map("split", "body").alias("splits")).write.json(path)


def read_designation(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(split, work, source, n_tracks) of nested designation files, one object a file or, with `lines`, a line."""
    kind = "splits map<string, struct<works: map<string, struct<source: string, n_tracks: bigint>>>>"
    raw = spark.read.schema(kind).option("multiLine", str(not lines).lower()).json(path)
    works = raw.select(F.explode("splits").alias("split", "body")).select("split", F.explode("body.works").alias("work", "is"))
    return works.select("split", F.col("work").cast("bigint").alias("work"), F.col("is.source").alias("source"), F.col("is.n_tracks").alias("n_tracks"))


def one_shape(source: Column | str, song: Column | str) -> tuple[Column, Column]:
    """Source and song of a row of either cache layout: no source is human, no song is the key."""
    return F.coalesce(source, F.lit("human")).alias("source"), F.coalesce(song, F.col("key")).alias("song")
