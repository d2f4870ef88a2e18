"""Rankings, windows, samples, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions import arrays as A
from cohortia.operators import curate, metrics, pairs, ranges, retrieval, sampling, trajectory
from cohortia.plans.aggregates import SONGS, songs
from cohortia.plans.joins import EMB, emb
from cohortia.plans.registry import query, table


def u(*parts: str) -> str:
    return f"(('0x' || substring(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT::DOUBLE / power(2, 52))"


@query("W1_retrieval_metrics", f"WITH e AS ({EMB}), p AS (SELECT q.id AS q, q.grp = c.grp AS rel, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.id) AS r FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 20 = 0), h AS (SELECT *, sum(rel::INTEGER) OVER (PARTITION BY q ORDER BY r) AS hits FROM p) SELECT q, max(CASE WHEN r = 1 THEN rel::INTEGER::DOUBLE END) AS hit1, round(sum(rel::INTEGER * hits / r) / greatest(sum(rel::INTEGER), 1), 6) AS ap FROM h GROUP BY q")
def w1(spark, d):
    # Vectors are shuffled as they are stored, in single precision, and compared in double.
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return retrieval.retrieval_metrics(e.filter("id % 20 = 0"), e, 64).select("q", "hit1", F.round("ap", 6).alias("ap"))


@query("W2_latest_outcome", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) IN ('error', 'signup')")
def w2(spark, d):
    return curate.latest_per_key(table(spark, d, "events"), "user_id", "event_id", "event_type").filter("event_type IN ('error', 'signup')")


@query("W3_percent_ranks", "SELECT o_orderkey, round(100.0 * (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / (count(*) OVER () - 1), 6) AS pct FROM orders")
def w3(spark, d):
    return trajectory.percent_ranks(table(spark, d, "orders"), "o_orderkey", "o_totalprice").select("o_orderkey", F.round("pct", 6).alias("pct"))


@query("W4_extreme_groups", "WITH m AS (SELECT o_orderkey, o_totalprice, abs(o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) AS far FROM orders) SELECT o_orderkey, 'high' AS \"group\" FROM (SELECT * FROM m ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL SELECT o_orderkey, 'low' FROM (SELECT * FROM m ORDER BY o_totalprice, o_orderkey LIMIT 20) UNION ALL SELECT o_orderkey, 'middle' FROM (SELECT * FROM m ORDER BY far, o_orderkey LIMIT 20)")
def w4(spark, d):
    return trajectory.extreme_groups(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 20)


@query("W5_slots", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations")
def w5(spark, d):
    return ranges.ordinal(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "slot").withColumn("slot", F.col("slot").cast("bigint"))


WORKS = "SELECT c_custkey AS work, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def works(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("work")).join(o, "work", "left").fillna(0, ["n"])


@query("W6_nested_subsets", f"WITH w AS ({WORKS}), b AS (SELECT *, (row_number() OVER (ORDER BY n, work) - 1) // 20 AS b FROM w), x AS (SELECT work, (row_number() OVER (PARTITION BY b ORDER BY md5('w6:' || work), work) - 1 + {u(chr(39) + 'w6:jitter' + chr(39), 'work')}) / count(*) OVER (PARTITION BY b) AS u FROM b) SELECT work, u < 0.25 AS w25, u < 0.5 AS w50 FROM x")
def w6(spark, d):
    return sampling.nested_fractions(works(spark, d), "work", ["n", "work"], 20, "w6").select("work", (F.col("u") < 0.25).alias("w25"), (F.col("u") < 0.5).alias("w50"))


@query("W7_size_stratified", f"WITH w AS ({WORKS}), p AS (SELECT *, row_number() OVER (ORDER BY n, work) - 1 AS p, count(*) OVER () AS c FROM w) SELECT ((p + 1) * 12 - 1) // c AS bin, arg_min(work, (md5('w7:' || work), work)) AS work FROM p GROUP BY 1")
def w7(spark, d):
    return sampling.size_stratified(works(spark, d), "work", ["n", "work"], 12, "w7")


@query("W8_matched_halves", f"WITH w AS ({WORKS}), p AS (SELECT *, row_number() OVER (ORDER BY n, work) - 1 AS r FROM w) SELECT work, CASE WHEN ({u(chr(39) + 'w8' + chr(39), '(r // 2)')} < 0.5) = (r % 2 = 0) THEN 'a' ELSE 'b' END AS half FROM p")
def w8(spark, d):
    return sampling.matched_halves(works(spark, d), "work", ["n", "work"], "w8").select("work", "half")


@query("W9_best_source", "SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) WHERE n >= 5) WHERE r = 1")
def w9(spark, d):
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sampling.best_source(counts, "lang", "source", "n", "source", 5)


@query("W10_capped_works", "SELECT doc_id FROM (SELECT doc_id, quality IS NOT NULL AS f, row_number() OVER (PARTITION BY source ORDER BY quality IS NOT NULL DESC, md5('w10:' || doc_id), doc_id) AS r FROM documents LEFT JOIN labels USING (doc_id)) WHERE f OR r <= 25")
def w10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sampling.capped(rows, "source", "doc_id", F.col("quality").isNotNull(), 25, "w10").select("doc_id")


@query("W11_first_passing", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), k AS (SELECT *, sum((value > 20)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM t WHERE a <= 40) SELECT user_id, event_id FROM k WHERE value > 20 AND k <= 10")
def w11(spark, d):
    return pairs.first_passing(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 20, 10, 40).select("user_id", "event_id")


@query("W11_shortfalls", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), g AS (SELECT user_id, count(*) FILTER (value > 40 AND a <= 50) AS ok, count(*) AS n FROM t GROUP BY 1) SELECT user_id, least(ok, 15) AS kept, CASE WHEN n > 50 THEN 'budget' ELSE 'exhausted' END AS reason FROM g WHERE ok < 15")
def w11b(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), "value")
    return pairs.shortfalls(e, "user_id", F.col("value") > 40, 15, 50)


@query("W12_adaptive_rounds", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events), k AS (SELECT *, sum((value > 20)::INTEGER) OVER (PARTITION BY user_id ORDER BY ord) AS k FROM t WHERE ord < 60) SELECT user_id, event_id FROM k WHERE value > 20 AND k <= 10")
def w12(spark, d):
    e = ranges.ordinal(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "ord")
    found = pairs.adaptive_rounds(e, "user_id", lambda df: df.withColumn("passed", F.col("value") > 20), 10, budget=60)
    return found.select("user_id", "event_id")


@query("W13_extendable_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('w13:' || source || ':' || doc_id), doc_id) AS r FROM documents) WHERE r > 5 AND r <= 15")
def w13(spark, d):
    return sampling.extendable(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 10, "w13", skip=5)


@query("W14_interleaved", "SELECT doc_id, row_number() OVER (ORDER BY r, source) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def w14(spark, d):
    return sampling.interleaved(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", F.col("turn").cast("bigint").alias("turn"))


@query("W15_even_picks", "WITH n AS (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT user_id, unnest(list_distinct(list_transform(range(5), lambda i: l[round_even((len(l) - 1) * i / 4, 0)::INTEGER + 1]))) AS event_id FROM n WHERE len(l) > 5")
def w15(spark, d):
    e = ranges.ordinal(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "i")
    sizes = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n")).filter("n > 5")
    at = sizes.select("user_id", F.explode(A.even_positions(F.col("n"), 5)).alias("i"))
    return e.join(at, ["user_id", "i"]).select("user_id", "event_id")


@query("W16_chunks_and_shards", "SELECT event_id, chunk, shard FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS chunk FROM events) JOIN (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 4 AS shard FROM (SELECT DISTINCT user_id FROM events)) USING (user_id)")
def w16(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return sampling.chunked(e, "user_id", "event_id", 8).join(sampling.sharded(e, "user_id", 4), "user_id").select("event_id", "chunk", F.col("shard").cast("bigint").alias("shard"))


@query("W17_held_out_groups", "WITH g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('w17:' || event_type || ':' || user_id), user_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)) SELECT event_type, count(*) FILTER (r <= greatest(1, least(n - 1, round_even(n * 0.2, 0)::BIGINT))) AS val, count(*) AS windows FROM events JOIN g USING (event_type, user_id) GROUP BY 1")
def w17(spark, d):
    return sampling.held_out_groups(table(spark, d, "events"), "event_type", "user_id", 0.2, "w17").groupBy("event_type").agg(F.count_if("val").alias("val"), F.count("*").alias("windows"))


@query("W18_one_per_work", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('w18:' || source || ':' || doc_id), doc_id) AS r FROM documents) WHERE r = 1 ORDER BY md5('w18:groups:' || source), source LIMIT 8")
def w18(spark, d):
    return sampling.one_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 8, "w18")


@query("W19_peak_and_final", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS peak_step, max(value) AS peak, max(event_id) AS final_step, arg_max(value, event_id) AS final FROM events GROUP BY 1")
def w19(spark, d):
    return trajectory.peak_best_final(table(spark, d, "events"), "user_id", "event_id", "value")


RUN = "SELECT user_id AS run, (row_number() OVER w)::INTEGER AS step, " + ", ".join(f"(sum((floor(value)::BIGINT % 4 = {k})::INTEGER) OVER w)::DOUBLE / row_number() OVER w AS w{k}" for k in range(4)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
#: Each user's events as a run: its weights after a step are the shares so far of values by their floor modulo 4.
CONVERGENCE = (
    f"r AS ({RUN}), l AS (SELECT *, " + ", ".join(f"lag(w{k}, 4) OVER w AS b{k}" for k in range(4)) + " FROM r WINDOW w AS (PARTITION BY run ORDER BY step)), "
    "p AS (SELECT *, coalesce(sqrt(" + " + ".join(f"(w{k} - b{k})^2" for k in range(4)) + ") / nullif(sqrt(" + " + ".join(f"(w{k} - 0.25)^2" for k in range(4)) + "), 0) < 0.02, false) AS passed FROM l), "
    "g AS (SELECT *, sum((NOT passed)::INTEGER) OVER (PARTITION BY run ORDER BY step) AS gap FROM p), s AS (SELECT run, step, passed, sum(passed::INTEGER) OVER (PARTITION BY run, gap ORDER BY step) AS streak FROM g)"
)


def runs_of_users(spark, d):
    """(run, step, w, value): see CONVERGENCE."""
    e = ranges.ordinal(table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", "value"), ["run"], ["event_id"], "step").withColumn("step", F.col("step") + 1)
    by = W.partitionBy("run").orderBy("step")
    shares = [F.sum((F.pmod(F.floor("value"), F.lit(4)) == k).cast("int")).over(by).cast("double") / F.col("step") for k in range(4)]
    return e.select("run", "step", F.array(*shares).alias("w"), "value")


@query("W20_convergence", f"WITH {CONVERGENCE} SELECT run, step, passed, max((streak >= 3)::INTEGER) OVER (PARTITION BY run ORDER BY step) = 1 AS converged FROM s")
def w20(spark, d):
    return trajectory.convergence(runs_of_users(spark, d), "run", "step", "w").select("run", "step", "passed", "converged")


@query("W21_collapse_alarm", "SELECT event_id, value < 0.5 * first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS alarm FROM events")
def w21(spark, d):
    return trajectory.collapse_alarm(table(spark, d, "events"), "user_id", "event_id", "value", 0.5).select("event_id", "alarm")


@query("W22_operating_grid", f"WITH s AS ({SONGS}), t AS (SELECT k / 100 AS fpr, (SELECT list(min ORDER BY min) FROM s WHERE event_type = 'view') AS l FROM range(1, 21) t(k)), c AS (SELECT fpr, l[floor(fpr * (len(l) - 1))::INTEGER + 1] + (fpr * (len(l) - 1) - floor(fpr * (len(l) - 1))) * (l[least(floor(fpr * (len(l) - 1))::INTEGER + 2, len(l))] - l[floor(fpr * (len(l) - 1))::INTEGER + 1]) AS t FROM t), p AS (SELECT fpr, avg((min < t)::INTEGER) AS tpr FROM s, c WHERE event_type <> 'view' GROUP BY 1) SELECT fpr, round(tpr, 6) AS tpr FROM p ORDER BY round(tpr - fpr, 12) DESC, fpr LIMIT 1")
def w22(spark, d):
    return metrics.operating_grid(songs(spark, d), "min", "event_type", "view").select("fpr", F.round("tpr", 6).alias("tpr"))


@query("W23_cross_fitted", "WITH s AS (SELECT user_id, sum(value) FILTER (event_id % 2 = 0) AS a, sum(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1), r AS (SELECT row_number() OVER w AS k, sum(b) OVER w / sum(b) OVER () AS share FROM s WINDOW w AS (ORDER BY a DESC, user_id)) SELECT level, min(k)::INTEGER AS k FROM r, (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS level) WHERE share >= level - 1e-12 GROUP BY 1")
def w23(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return metrics.cross_fitted(s, "user_id", "a", "b", [0.5, 0.9])


@query("W24_cumulative_bands", "WITH p AS (SELECT user_id, sum(value) AS x FROM events GROUP BY 1) SELECT user_id, round(sum(x) OVER (ORDER BY user_id), 4) AS upto, round(sum(x) OVER () - sum(x) OVER (ORDER BY user_id), 4) AS rest, floor((row_number() OVER (ORDER BY user_id) - 1) * 4 / count(*) OVER ())::BIGINT AS band FROM p")
def w24(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("x"))
    return trajectory.cumulative_bands(p, "user_id", "x", 4).select("user_id", F.round("upto", 4).alias("upto"), F.round("rest", 4).alias("rest"), "band")


@query("W25_margins", "SELECT p_brand, round(x, 6) AS x, row_number() OVER (ORDER BY x DESC, p_brand)::INTEGER AS place, round(x - lead(x) OVER (ORDER BY x DESC, p_brand), 6) AS margin FROM (SELECT p_brand, avg(p_retailprice) AS x FROM part GROUP BY 1)")
def w25(spark, d):
    m = trajectory.with_margin(table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("x")), "p_brand", "x")
    return m.select("p_brand", F.round("x", 6).alias("x"), "place", F.round("margin", 6).alias("margin"))


@query("W26_ordered_listing", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 350000 ORDER BY o_totalprice DESC, o_orderkey")
def w26(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice > 350000").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("U1_union_of_sources", "SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark")
def u1(spark, d):
    part = lambda t, c, k: table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    return part("documents", "doc_id", "doc").unionByName(part("pages", "page_id", "page")).unionByName(part("benchmark", "item_id", "item"))


@query("U2_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unused', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def u2(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "unused")).unionByName(count(a.union(b).distinct(), "any"))


@query("U3_first_n", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def u3(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(25)


@query("U4_shared_windows", "SELECT l_orderkey, l_partkey, count(*) AS refs FROM lineitem GROUP BY 1, 2")
def u4(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return rows.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("refs"))


