"""Scans and sinks: files are derived from the given tables, written to the scratch folder and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.plans.registry import query, table
from cohortia.sources import catalogue as C
from cohortia.sources import stores, versions
from cohortia.sources.scratch import new_folder

RAW = "CASE WHEN doc_id % 17 = 3 THEN 'x' || doc_id ELSE ' ' || doc_id || ' ' END AS performance, CASE WHEN doc_id % 19 = 4 THEN '' ELSE (doc_id % 97)::VARCHAR END AS work, 'Title \"' || doc_id || '\", part' AS title, source AS artist, CASE WHEN doc_id % 23 = 5 THEN '' ELSE substr(md5(text), 1, 11) END AS video"


def raw_catalogue(spark, d):
    return table(spark, d, "documents").select(
        F.expr("if(doc_id % 17 = 3, concat('x', doc_id), concat(' ', doc_id, ' '))").alias("performance"),
        F.expr("if(doc_id % 19 = 4, '', string(doc_id % 97))").alias("work"),
        F.expr("concat('Title \"', doc_id, '\", part')").alias("title"),
        F.col("source").alias("artist"),
        F.expr("if(doc_id % 23 = 5, '', substr(md5(text), 1, 11))").alias("video"),
    )


def catalogue_file(spark, d) -> str:
    path = new_folder(spark, "catalogue")
    raw_catalogue(spark, d).write.option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


@query("S1_catalogue_scan", f"SELECT work::BIGINT AS work_id, trim(performance)::BIGINT AS version_id, title, artist, video AS video_id FROM (SELECT {RAW} FROM documents) WHERE performance NOT LIKE 'x%' AND work <> '' AND video <> ''")
def s1(spark, d):
    return C.read_catalogue(spark, catalogue_file(spark, d)).filter("ok").drop("ok")


@query("S1_malformed_count", f"SELECT count(*) FILTER (performance LIKE 'x%' OR work = '' OR video = '') AS malformed, count(*) AS lines FROM (SELECT {RAW} FROM documents)")
def s1_malformed(spark, d):
    return C.read_catalogue(spark, catalogue_file(spark, d)).agg(F.count_if(~F.col("ok")).alias("malformed"), F.count("*").alias("lines"))


PAIRS = "concat(o_custkey, '_', o_orderkey) AS key_a, concat(o_custkey, '_', o_orderkey + 1) AS key_b, o_custkey AS song_id, o_totalprice AS score, cast(o_orderkey % 12 AS int) AS oti, cast(o_orderkey % 100 AS int) AS n_points"


@query("S2_manifest_jsonl", f"SELECT {PAIRS} FROM orders")
def s2(spark, d):
    path = new_folder(spark, "pairs")
    pairs = table(spark, d, "orders").select(
        F.expr("concat(o_custkey, '_', o_orderkey)").alias("key_a"),
        F.expr("concat(o_custkey, '_', o_orderkey + 1)").alias("key_b"),
        F.col("o_custkey").alias("song_id"),
        F.col("o_totalprice").alias("score"),
        F.expr("int(o_orderkey % 12)").alias("oti"),
        F.expr("int(o_orderkey % 100)").alias("n_points"),
    )
    C.write_jsonl(pairs, path)
    return C.read_jsonl(spark, path, C.PAIRS)


@query("S3_asset_listing", "SELECT label::BIGINT AS label, 1::BIGINT AS files FROM (SELECT DISTINCT label FROM embeddings)")
def s3(spark, d):
    """A folder of vectors for each label, a file in each; marker and checksum files are none."""
    path = new_folder(spark, "assets")
    table(spark, d, "embeddings").repartition("label").write.partitionBy("label").parquet(path)
    found = C.list_assets(spark, path, (".parquet",))
    return found.groupBy(F.regexp_extract("folder", "label=(.*)", 1).cast("bigint").alias("label")).agg(F.count_distinct("key").alias("files"))


@query("S4_ledger_append", "SELECT name FROM (SELECT min(source || '_' || doc_id % 400 || '.mp3') AS name FROM documents WHERE doc_id % 3 = 0 GROUP BY source || '_' || doc_id % 400) UNION ALL SELECT min(source || '_' || doc_id % 400 || '.wav') FROM documents WHERE source || '_' || doc_id % 400 NOT IN (SELECT source || '_' || doc_id % 400 FROM documents WHERE doc_id % 3 = 0) GROUP BY source || '_' || doc_id % 400")
def s4(spark, d):
    docs, path = table(spark, d, "documents"), new_folder(spark, "ledger")
    C.append_ledger(spark, path, docs.filter("doc_id % 3 = 0").selectExpr("concat(source, '_', doc_id % 400, '.mp3') AS name"))
    for _ in range(2):  # the second is a no-op
        C.append_ledger(spark, path, docs.selectExpr("concat(source, '_', doc_id % 400, '.wav') AS name"))
    return spark.read.text(path).select(F.col("value").alias("name"))


@query("S5_outcome_log", "SELECT user_id::VARCHAR AS key, 'u' || event_id AS url, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS retryable, CASE WHEN event_id % 3 = 0 THEN 'late' END AS detail FROM events")
def s5(spark, d):
    path, e = new_folder(spark, "outcomes"), table(spark, d, "events")
    row = ["string(user_id)", "concat('u', event_id)", "event_type", "if(event_id % 2 = 0, 'True', 'False')"]
    lines = e.filter("event_id % 3 <> 0").selectExpr(f"concat_ws(',', {', '.join(row)}) AS l")
    lines = lines.unionByName(e.filter("event_id % 3 = 0").selectExpr(f"concat_ws(',', {', '.join(row)}, 'late') AS l"))
    lines.unionByName(spark.range(1).selectExpr("'key,url,status,retryable,detail' AS l")).write.text(path)
    return C.read_outcomes(spark, path)


@query("S6_vector_gather", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings WHERE vec_id % 7 = 1 AND label < 8")
def s6(spark, d):
    store = new_folder(spark, "vectors")
    e = table(spark, d, "embeddings")
    stores.write_vectors(e.filter("label < 8"), store)
    found = stores.gather(spark, store, e.filter("vec_id % 7 = 1").select("vec_id"), "vec_id")
    return found.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query("S6_vector_cap", "SELECT label, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 20 GROUP BY label")
def s6_cap(spark, d):
    return stores.capped(table(spark, d, "embeddings"), "label", "vec_id", 20).groupBy("label").agg(F.count("*").alias("n"))


@query("S7_array_archive", "SELECT vec_id, (i - 1)::INTEGER AS pos, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) t(i)")
def s7(spark, d):
    path = new_folder(spark, "arrays")
    table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(path)
    rows = spark.read.parquet(path).select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("S8_designation", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, doc_id AS work, min(source) AS source, count(*) AS n_tracks FROM documents GROUP BY 1, 2")
def s8(spark, d):
    """One line for each split and some thousand works, so that no row holds a whole split."""
    works = table(spark, d, "documents").groupBy(F.expr("if(doc_id % 2 = 0, 'val', 'test')").alias("split"), F.col("doc_id").alias("work")).agg(F.min("source").alias("source"), F.count("*").alias("n_tracks"))
    path = new_folder(spark, "designation")
    C.write_designation(works, path)
    return C.read_designation(spark, path, lines=True)


@query("S9_score_records", "SELECT event_type AS source, user_id AS song, round(min(value), 6) AS low, count(*) AS windows FROM events GROUP BY 1, 2")
def s9(spark, d):
    path = new_folder(spark, "scores")
    songs = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("song")).agg(F.round(F.min("value"), 6).alias("low"), F.count("*").alias("windows"))
    for part in (songs.filter("song % 2 = 0"), songs, songs):
        stores.resume_scores(spark, path, part, ["source", "song"], identity="run-1")
    return stores.read_scores(spark, path, songs.schema)


@query("S10_train_log", "SELECT (event_id // 100)::BIGINT AS epoch, event_id AS step, 1000::BIGINT AS total, unnest(['loss', 'aux/n']) AS term, unnest([round(value, 3), (user_id % 7)::DOUBLE]) AS value FROM events")
def s10(spark, d):
    path = new_folder(spark, "log")
    e = table(spark, d, "events")
    lines = e.selectExpr("concat('epoch ', event_id div 100, ' step ', event_id, '/1000  loss=', round(value, 3), ' aux/n=', user_id % 7) AS l")
    lines.unionByName(e.selectExpr("concat('saving ', event_id) AS l")).write.text(path)
    return C.read_train_log(spark, path)


@query("S11_shared_terms", "SELECT unnest(['loss', 'mse']) AS term")
def s11(spark, d):
    path = new_folder(spark, "history")
    e = table(spark, d, "events")
    e.selectExpr("event_id AS step", "if(event_id % 2 = 0, value, null) AS `train/loss`", "if(event_id % 2 = 1, value, null) AS `val/loss`", "value AS `train/mse`", "value AS `val/mse`", "value AS `train/only`", "user_id AS epoch").write.json(path)
    return C.shared_terms(spark.read.json(path))


@query("S12_problem_report", "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too short' ELSE 'too long' END AS problem FROM documents WHERE n_chars < 200 OR n_chars > 9000")
def s12(spark, d):
    path = new_folder(spark, "problems")
    found = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 9000 THEN 'too long' END").alias("problem")).filter("problem IS NOT NULL")
    stores.report(found, path)
    return spark.read.schema("doc_id bigint, problem string").option("header", "true").csv(path)


@query("S13_mirror_index", "SELECT d.doc_id AS key, coalesce(p.url, '') AS path FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def s13(spark, d):
    """The plan is listed for two groups, then for three, which the first does not cover, and then read again."""
    path, pages = new_folder(spark, "listing"), table(spark, d, "pages").withColumn("group", F.format_string("g%d", F.col("page_id") % 3))
    make = lambda groups: pages.filter(F.col("group").isin(*groups)).select("group", F.col("page_id").alias("key"), F.col("url").alias("path"))
    for groups in (["g0", "g1"], ["g0", "g1", "g2"], ["g2", "g0", "g1"]):
        plan = stores.listing_of(spark, path, groups, make)
    listing = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    return stores.mirror_index(listing, plan.select("key", "path"))


@query("S14_one_shape", "SELECT coalesce(source, 'human') AS source, coalesce(song, key) AS song, start FROM (SELECT event_type AS source, user_id::VARCHAR AS song, NULL AS key, value AS start FROM events UNION ALL SELECT NULL, NULL, o_custkey || '_' || o_orderkey, o_totalprice FROM orders)")
def s14(spark, d):
    new = table(spark, d, "events").selectExpr("event_type AS source", "string(user_id) AS song", "value AS start")
    old = table(spark, d, "orders").selectExpr("concat(o_custkey, '_', o_orderkey) AS key", "o_totalprice AS start")
    rows = new.unionByName(old, allowMissingColumns=True)
    return rows.select(*C.one_shape(F.col("source"), F.col("song")), "start")


@query("S15_atomic_sink", "SELECT o_orderkey, o_totalprice, 2 AS version FROM orders")
def s15(spark, d):
    """A table that is replaced whole; the second version is checked, and would be written again if it were broken."""
    path = new_folder(spark, "atomic")
    make = lambda n: table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(n).alias("version"))
    for n in (1, 2):
        versions.replace(make(n), path)
    versions.expire(spark, path, seconds=0)
    return versions.ensure(spark, path, lambda: make(2))


@query("S16_sidecar", "SELECT count(*) AS pairs, count(DISTINCT o_custkey) AS works, min(o_totalprice) AS min_score FROM orders WHERE o_totalprice > 1000")
def s16(spark, d):
    path = new_folder(spark, "subset")
    kept = table(spark, d, "orders").filter("o_totalprice > 1000")
    kept.agg(F.count("*").alias("pairs"), F.count_distinct("o_custkey").alias("works"), F.min("o_totalprice").alias("min_score")).write.json(path)
    return spark.read.schema("pairs long, works long, min_score double").json(path)
