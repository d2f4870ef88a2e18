"""Tables that are replaced whole: failing writes, broken files, old versions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortia.sources import catalogue, scratch, versions


def test_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert versions.replace(old, path) == 1
    # Some tasks finish before one fails.
    bad = spark.range(0, 1000, 1, 8).withColumn("x", F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        versions.replace(bad.select("id", F.col("x").cast("long").alias("x")), path)
    assert sorted(map(tuple, versions.read(spark, path).collect())) == sorted(map(tuple, old.collect()))
    assert len(os.listdir(f"{path}/versions")) == 2 and versions.problems(spark, path, deep=True).isEmpty()
    assert versions.replace(old.limit(3), path) == 2 and versions.read(spark, path).count() == 3
    assert versions.read(spark, path, 1).count() == 1000


def test_a_cut_or_lost_file_is_found_and_the_version_made_again(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda: spark.range(0, 500, 1, 4).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    assert versions.ensure(spark, path, make).count() == 500 and len(versions.commits(spark, path)) == 1
    versions.ensure(spark, path, make, deep=True)
    assert len(versions.commits(spark, path)) == 1  # a sound table is left alone
    files = sorted(glob.glob(f"{path}/versions/*/*.parquet"))
    with open(files[1], "r+b") as f:
        f.truncate(20)
    os.remove(files[2])
    assert sorted(tuple(r) for r in versions.problems(spark, path).collect()) == [(os.path.basename(files[1]), "cut or changed"), (os.path.basename(files[2]), "missing")]
    assert versions.ensure(spark, path, make).count() == 500 and len(versions.commits(spark, path)) == 2
    assert versions.problems(spark, path, deep=True).isEmpty()


def test_changed_rows_are_found_by_reading_them(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(10).coalesce(1), path)
    name = versions.commits(spark, path)[0].name
    spark.range(1, 11).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{name}")
    versions._files(spark, f"{path}/versions/{name}").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{name}")
    assert versions.problems(spark, path).isEmpty() and [r.problem for r in versions.problems(spark, path, deep=True).collect()] == ["rows changed"]


def test_old_versions_go_by_age(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        versions.replace(spark.range(n), path)
    assert versions.expire(spark, path, 3600) == [] and len(os.listdir(f"{path}/versions")) == 3
    gone = versions.expire(spark, path, -1)
    assert len(gone) == 2 and versions.read(spark, path).count() == 3
    assert versions.expire(spark, str(tmp_path / "none"), 0) == []
    with pytest.raises(ValueError):
        versions.read(spark, str(tmp_path / "none"))


def test_empty_tables_have_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(0), path)
    assert versions.read(spark, path).columns == ["id"] and versions.problems(spark, path, deep=True).isEmpty()


def test_designation_lines_part_a_split(spark, tmp_path):
    works = spark.range(5000).select(F.lit("val").alias("split"), F.col("id").alias("work"), F.lit("s").alias("source"), (F.col("id") % 4).alias("n_tracks"))
    catalogue.write_designation(works, str(tmp_path / "d"), most=100)
    assert max(len(line) for f in glob.glob(str(tmp_path / "d/*.json")) for line in open(f)) < 20_000
    back = catalogue.read_designation(spark, str(tmp_path / "d"), lines=True)
    assert back.exceptAll(works.select(*back.columns)).isEmpty() and back.count() == 5000
    whole = tmp_path / "one.json"
    whole.write_text('{\n "splits": {"test": {"works": {"7": {"source": "val", "n_tracks": 3}}}}\n}')
    assert [tuple(r) for r in catalogue.read_designation(spark, str(whole)).collect()] == [("test", 7, "val", 3)]


def test_settled_steps_leave_their_result_only(spark):
    made = []

    def step():
        made.append(scratch.new_folder(spark, "inner"))
        spark.range(5).write.parquet(made[0])
        return scratch.stash(spark.read.parquet(made[0]), "inner").filter("id > 1")

    out = scratch.settled(step, "step")
    assert sorted(r.id for r in out.collect()) == [2, 3, 4] and not os.path.exists(made[0])
    assert sum(os.path.exists(f) for f in scratch._folders[-2:]) >= 1
    scratch.remove(spark, made[0])  # nothing is there
