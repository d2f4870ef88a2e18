"""Filters and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import curate, moments
from cohortia.plans.registry import query, table


@query("G1_first_per_key", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def g1(spark, d):
    return curate.first_per_key(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("G2_usable_assets", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'stale' WHEN source IN ('src1', 'src2') THEN 'held out' WHEN doc_id % 7 = 0 THEN 'leaked' ELSE 'ok' END AS reason FROM documents) GROUP BY reason")
def g2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return curate.usable_assets(docs, docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 11 <> 0"), docs.filter("source IN ('src1', 'src2')"), "doc_id", "source").groupBy("reason").agg(F.count("*").alias("n"))


@query("G3_long_enough", "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_totalprice >= 200000 AND b.o_totalprice >= 200000")
def g3(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice >= 200000").select("o_orderkey")
    return o.join(o.select(F.col("o_orderkey").alias("other")), F.col("other") == F.col("o_orderkey") + 1)


@query("G4_pair_gate", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 OR (doc_id + 1) % 9 = 0 THEN 'missing track' WHEN doc_id % 5 = 0 OR (doc_id + 1) % 5 = 0 THEN 'missing file' WHEN n_chars < 1000 THEN 'low score' ELSE 'ok' END AS reason FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)) GROUP BY reason")
def g4(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    pairs = docs.select(F.col("key").alias("key_a"), (F.col("key") + 1).alias("key_b"), F.col("n_chars").cast("double").alias("score"))
    pairs = pairs.join(docs.select(F.col("key").alias("key_b")), "key_b", "left_semi")
    return curate.pair_gate(pairs, docs.filter("key % 9 <> 0"), docs.filter("key % 5 <> 0"), 1000.0).groupBy("reason").agg(F.count("*").alias("n"))


@query("G5_asset_health", "SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'video stream' END, CASE WHEN doc_id % 29 = 0 THEN 'unreadable' END, CASE WHEN n_chars < 300 THEN 'too short' END, CASE WHEN doc_id % 31 = 0 THEN 'partial' END], lambda x: x IS NOT NULL)) AS problem FROM documents")
def g5(spark, d):
    checks = {"video stream": F.expr("doc_id % 13 = 0"), "unreadable": F.expr("doc_id % 29 = 0"), "too short": F.col("n_chars") < 300, "partial": F.expr("doc_id % 31 = 0")}
    return curate.problems(table(spark, d, "documents"), "doc_id", checks)


@query("G6_complete_songs", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) = 14")
def g6(spark, d):
    return curate.complete_units(table(spark, d, "events"), ["event_type", "user_id"], 14).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("G7_all_or_nothing", "SELECT event_type, count(*) FILTER (ok) AS kept, count(*) AS songs FROM (SELECT event_type, user_id, bool_and(value < 150) AS ok FROM events GROUP BY 1, 2) GROUP BY 1")
def g7(spark, d):
    e = table(spark, d, "events")
    kept = curate.all_or_nothing(e, ["event_type", "user_id"], F.col("value") < 150).select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("kept"))
    return e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("songs")).join(kept, "event_type", "left").fillna(0, ["kept"])


@query("G8_only_in_one", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a' ELSE 'b' END AS side FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id AS k FROM documents WHERE doc_id % 4 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def g8(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    return curate.only_in_one(docs.filter("k % 3 <> 0"), docs.filter("k % 4 <> 0"), "k")


@query("G9_validator_guard", "SELECT user_id, count(*) AS tries, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'error') = count(*) OR (count(*) >= 20 AND count(*) FILTER (event_type = 'error') > 0.2 * count(*)) AS suspect FROM events GROUP BY user_id")
def g9(spark, d):
    bad, tries = F.count_if(F.col("event_type") == "error"), F.count("*")
    return table(spark, d, "events").groupBy("user_id").agg(tries.alias("tries"), bad.alias("bad"), ((bad == tries) | ((tries >= 20) & (bad > 0.2 * tries))).alias("suspect"))


@query("G10_compatible_caches", "SELECT 64 AS dims, count(*) AS vectors FROM embeddings")
def g10(spark, d):
    e = table(spark, d, "embeddings")
    identity = e.agg(F.max(F.size("embedding")).alias("dims"), F.count("*").alias("vectors"))
    return curate.require_equal(identity, e.agg(F.min(F.size("embedding")).alias("dims"), F.count("*").alias("vectors")), "caches")


@query("G11_no_overlap", "SELECT count(*) AS n FROM documents WHERE doc_id % 5 = 0")
def g11(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return curate.require_disjoint(docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 5 = 1"), "doc_id").agg(F.count("*").alias("n"))


@query("G12_dead_columns", "SELECT pos - 1 AS pos FROM (SELECT unnest(range(1, 66)) AS pos, unnest(list_append(embedding::DOUBLE[], 1.0)) AS x FROM embeddings) GROUP BY pos HAVING stddev_pop(x) <= 1e-8")
def g12(spark, d):
    e = table(spark, d, "embeddings").select(F.array_append("embedding", F.lit(1.0).cast("float")).alias("v"))
    return moments.dead_dimensions(e, "v").select(F.col("pos").cast("bigint").alias("pos"))


@query("G13_trimmed", "SELECT user_id, count(*) AS n FROM (SELECT *, exp(avg(ln(value + 1)) OVER (PARTITION BY user_id)) AS g FROM events) WHERE g <= 40 AND value <= 100 GROUP BY user_id")
def g13(spark, d):
    from cohortia.operators import variance

    e = variance.with_geometric_mean(table(spark, d, "events").withColumn("x", F.col("value") + 1), "user_id", "x", "g")
    return e.filter("g <= 40 AND value <= 100").groupBy("user_id").agg(F.count("*").alias("n"))
