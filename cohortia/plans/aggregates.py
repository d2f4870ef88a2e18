"""Aggregations: profiles, detection metrics, bootstraps, variance components, vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.functions import arrays as A
from cohortia.operators import metrics, moments, resample, runs, scoring, spectra, variance
from cohortia.plans.joins import EMB, emb
from cohortia.plans.registry import query, table


def songs(spark, d):
    return scoring.unit_scores(table(spark, d, "events"), ["event_type", "user_id"], "value")


SONGS = "SELECT event_type, user_id, min(value) AS min, avg(value) AS mean, quantile_cont(value, 0.1) AS p10 FROM events GROUP BY 1, 2"


@query("A1_clique_sizes", "SELECT lang, count(*) AS works, round(avg(n), 6) AS mean, max(n) AS largest FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def a1(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("works"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("largest"))


@query("A2_pairs_per_work", "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1) SELECT min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, max(n) AS most, count(*) FILTER (n < 3) AS below FROM n")
def a2(spark, d):
    pairs = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("work"))
    return runs.pairs_profile(pairs, table(spark, d, "customer").select(F.col("c_custkey").alias("work")), "work", 3)


@query("A3_paired_tracks", "SELECT count(DISTINCT t) AS tracks FROM (SELECT unnest([l_partkey, l_suppkey]) AS t FROM lineitem)")
def a3(spark, d):
    return table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("t")).agg(F.count_distinct("t").alias("tracks"))


@query("A4_top_values", "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM c) SELECT p_brand, max(p_size) FILTER (r = 1) AS top, round(max(share) FILTER (r = 1), 6) AS top_share, round(sum(share) FILTER (r <= 3), 6) AS top3 FROM r GROUP BY 1")
def a4(spark, d):
    return runs.top_values(table(spark, d, "part"), "p_brand", "p_size").select("p_brand", "top", F.round("top_share", 6).alias("top_share"), F.round("top3", 6).alias("top3"))


@query("A5_bitrates", "SELECT source, low, round(median, 6) AS median, high, list_last(list_filter([48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], lambda b: b <= low / 2))::INTEGER AS suggested FROM (SELECT source, min(n_chars) AS low, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS high FROM documents WHERE n_chars > 90 GROUP BY 1)")
def a5(spark, d):
    return runs.bitrate_profile(table(spark, d, "documents").filter("n_chars > 90"), "source", "n_chars").withColumn("median", F.round("median", 6))


@query("A6_song_scores", "SELECT event_type, user_id, round(min, 6) AS min, round(mean, 6) AS mean, round(p10, 6) AS p10 FROM (" + SONGS + ")")
def a6(spark, d):
    return songs(spark, d).select("event_type", "user_id", *[F.round(c, 6).alias(c) for c in ("min", "mean", "p10")])


@query("A7_unit_moments", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY 1")
def a7(spark, d):
    return variance.unit_moments(table(spark, d, "events"), ["user_id"], "value").select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("A8_geometric_means", "SELECT event_id, round(exp(avg(ln(value + 1)) OVER (PARTITION BY user_id)), 6) AS g FROM events")
def a8(spark, d):
    return variance.with_geometric_mean(table(spark, d, "events").withColumn("x", F.col("value") + 1), "user_id", "x", "g").select("event_id", F.round("g", 6).alias("g"))


@query("A9_auroc", f"WITH s AS ({SONGS}) SELECT o.event_type, round(avg(CASE WHEN v.min > o.min THEN 1.0 WHEN v.min = o.min THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS auroc FROM s o JOIN s v ON v.event_type = 'view' AND o.event_type <> 'view' GROUP BY 1")
def a9(spark, d):
    return metrics.auroc_against(songs(spark, d), "min", "event_type", "view").select("event_type", F.round("auroc", 6).alias("auroc"))


@query("A9_auroc_labels", "SELECT round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS auroc FROM (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) p, (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0) n")
def a9b(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, d, "labels"), "doc_id")
    return metrics.auroc(rows, "n_chars", F.col("quality") == 1).select(F.round("auroc", 6).alias("auroc"))


@query("A10_clipped_quantiles", "SELECT event_type, round(quantile_cont(greatest(least(x, 1e300), -1e300), 0.5), 6) AS p50, round(quantile_cont(greatest(least(x, 1e300), -1e300), 0.9), 6) AS p90 FROM (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN '-infinity'::DOUBLE ELSE value END AS x FROM events) GROUP BY 1")
def a10(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 50 == 0, F.lit(float("-inf"))).otherwise(F.col("value")).alias("x"))
    return metrics.quantiles(e, "x", {"p50": 0.5, "p90": 0.9}, ("event_type",)).select("event_type", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@query("A11_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events GROUP BY 1")
def a11(spark, d):
    s = metrics.summary(table(spark, d, "events"), "value", ("event_type",))
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


POINTS = f"WITH s AS ({SONGS}), t AS (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS fpr, unnest([quantile_cont(min, 0.05), quantile_cont(min, 0.1)]) AS threshold FROM s WHERE event_type = 'view')"


@query("A12_operating_points", POINTS + " SELECT event_type, fpr, round(threshold, 6) AS threshold, round(avg((min < threshold)::INTEGER), 6) AS flagged FROM s, t GROUP BY ALL")
def a12(spark, d):
    return metrics.operating_points(songs(spark, d), "min", "event_type", "view", [0.05, 0.1]).select("event_type", "fpr", F.round("threshold", 6).alias("threshold"), F.round("flagged", 6).alias("flagged"))


@query("A13_source_report", f"WITH s AS ({SONGS}), q AS (SELECT quantile_cont(min, 0.05) AS t FROM s WHERE event_type = 'view'), a AS (SELECT o.event_type, avg(CASE WHEN v.min > o.min THEN 1.0 WHEN v.min = o.min THEN 0.5 ELSE 0.0 END)::DOUBLE AS auroc FROM s o JOIN s v ON v.event_type = 'view' AND o.event_type <> 'view' GROUP BY 1) SELECT s.event_type, count(*) AS songs, round(quantile_cont(min, 0.25), 6) AS q1, round(quantile_cont(min, 0.5), 6) AS median, round(quantile_cont(min, 0.75), 6) AS q3, round(any_value(a.auroc), 6) AS auroc, round(avg((min < t)::INTEGER), 6) AS below, 0::BIGINT AS failed FROM s LEFT JOIN a ON a.event_type = s.event_type, q GROUP BY s.event_type")
def a13(spark, d):
    r = metrics.source_report(songs(spark, d), "min", "event_type", "view")
    return r.select("event_type", "songs", "failed", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "auroc", "below")])


POOLS = {"all": ["click", "purchase", "error", "signup"], "dev": ["click", "purchase"], "click": ["click"]}


@query("A14_pools", f"WITH s AS ({SONGS}), p AS (SELECT *, unnest(CASE event_type WHEN 'click' THEN ['all', 'dev', 'click'] WHEN 'purchase' THEN ['all', 'dev'] WHEN 'view' THEN [] ELSE ['all'] END) AS pool FROM s) SELECT pool, count(*) AS songs, round(avg(mean), 6) AS mean FROM p GROUP BY 1")
def a14(spark, d):
    return metrics.pooled(songs(spark, d), "event_type", POOLS).groupBy("pool").agg(F.count("*").alias("songs"), F.round(F.avg("mean"), 6).alias("mean"))


def draws(units: str, key: str, reps: int, seed: str, within: str | None = None) -> str:
    """SQL of `resample.multiplicities`, as CTEs p and m."""
    g, cast = (f"{within}, ", f" || ':' || {within}::VARCHAR") if within else ("", "")
    part = f"PARTITION BY {within} " if within else ""
    on = f"AND x.{within} = p.{within}" if within else ""
    return (
        f"p AS (SELECT *, row_number() OVER ({part}ORDER BY {key}) - 1 AS i, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {g}{key} FROM {units})), "
        f"x AS (SELECT rep, {g}floor(('0x' || substring(md5('{seed}:' || rep{cast} || ':' || i), 1, 13))::BIGINT::DOUBLE / power(2, 52) * n)::BIGINT AS i, count(*) AS times FROM p, range({reps}) t(rep) GROUP BY ALL), "
        f"m AS (SELECT x.rep, p.* EXCLUDE (i, n), x.times FROM x JOIN p ON x.i = p.i {on})"
    )


@query("A15_clustered_bootstrap", f"WITH c AS (SELECT user_id, sum(value) AS s, count(*) AS c FROM events GROUP BY 1), {draws('c', 'user_id', 40, 'a15')}, r AS (SELECT rep, sum(times * s) / sum(times * c) AS v FROM m JOIN c USING (user_id) GROUP BY 1) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r")
def a15(spark, d):
    return resample.interval(resample.clustered_mean(table(spark, d, "events"), "user_id", "value", 40, "a15"), "value").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


SIDES = f"SELECT user_id, event_type <> 'view' AS syn, mean AS x, mean + user_id % 2 AS y FROM ({SONGS}) WHERE event_type IN ('view', 'click')"


def sides(spark, d):
    return songs(spark, d).filter("event_type IN ('view', 'click')").select("user_id", (F.col("event_type") != "view").alias("syn"), F.col("mean").alias("x"), (F.col("mean") + F.col("user_id") % 2).alias("y"))


def boot(x: str) -> str:
    return f"SELECT a.rep, sum(CASE WHEN a.{x} > b.{x} THEN 1.0 WHEN a.{x} = b.{x} THEN 0.5 ELSE 0.0 END::DOUBLE * a.times * b.times) / sum(a.times * b.times)::DOUBLE AS v FROM w a JOIN w b ON a.rep = b.rep AND a.syn AND NOT b.syn GROUP BY 1"


@query("A16_auroc_bootstrap", f"WITH s AS ({SIDES}), {draws('s', 'user_id', 20, 'a16', 'syn')}, w AS (SELECT * FROM m JOIN s USING (syn, user_id)), r AS ({boot('x')}) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r")
def a16(spark, d):
    return resample.interval(resample.auroc_replicates(sides(spark, d), "user_id", "x", "syn", 20, "a16"), "auroc").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("A17_paired_auroc_bootstrap", f"WITH s AS ({SIDES}), {draws('s', 'user_id', 20, 'a17', 'syn')}, w AS (SELECT * FROM m JOIN s USING (syn, user_id)), r AS ({boot('x')}), q AS ({boot('y')}) SELECT r.rep::INTEGER AS rep, round(q.v - r.v, 6) AS delta FROM r JOIN q USING (rep)")
def a17(spark, d):
    s = sides(spark, d)
    return resample.paired_auroc_replicates(s.drop("y"), s.select("user_id", "syn", F.col("y").alias("x")), "user_id", "x", "syn", 20, "a17").select("rep", F.round("delta", 6).alias("delta"))


@query("A18_share_bootstrap", f"WITH f AS (SELECT event_type, user_id, (min < 3)::INTEGER AS x FROM ({SONGS})), c AS (SELECT event_type, user_id, sum(x) AS s, count(*) AS c FROM f GROUP BY 1, 2), {draws('c', 'user_id', 20, 'a18', 'event_type')}, r AS (SELECT rep, event_type, sum(times * s) / sum(times * c) AS v FROM m JOIN c USING (event_type, user_id) GROUP BY 1, 2) SELECT event_type, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r GROUP BY 1")
def a18(spark, d):
    f = songs(spark, d).select("event_type", "user_id", (F.col("min") < 3).cast("int").alias("x"))
    return resample.interval(resample.clustered_mean(f, "user_id", "x", 20, "a18", "event_type"), "value", ("event_type",)).select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("A19_early_late", f"WITH e AS (SELECT event_id, event_id >= (SELECT max(event_id) // 2 FROM events) AS late, value FROM events), {draws('e', 'event_id', 20, 'a19', 'late')}, r AS (SELECT rep, late, sum(times * value) / sum(times) AS v FROM m JOIN e USING (late, event_id) GROUP BY 1, 2), q AS (SELECT b.v - a.v AS v FROM r a JOIN r b ON a.rep = b.rep AND NOT a.late AND b.late) SELECT round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM q")
def a19(spark, d):
    e = table(spark, d, "events")
    half = F.broadcast(e.agg(F.expr("max(event_id) div 2").alias("half")))  # one row
    e = e.crossJoin(half).select("event_id", (F.col("event_id") >= F.col("half")).alias("late"), "value")
    r = resample.clustered_mean(e, "event_id", "value", 20, "a19", "late")
    q = r.groupBy("rep").agg((F.max(F.when(F.col("late"), F.col("value"))) - F.max(F.when(~F.col("late"), F.col("value")))).alias("delta"))
    return resample.interval(q, "delta").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("A20_block_means", "SELECT block, round(avg(value), 6) AS mean FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 250 AS block FROM events) GROUP BY 1")
def a20(spark, d):
    return runs.block_means(table(spark, d, "events"), "event_id", "value", 250).select("block", F.round("mean", 6).alias("mean"))


@query("A21_baseline_context", "SELECT round(avg(value), 6) AS mean, round(ln(8 * 4), 6) AS chance, round(avg((value < ln(32))::INTEGER), 6) AS below, round(-0.1 * ln((exp(min(value)) - 1) / 28), 6) AS margin FROM events WHERE event_type = 'view'")
def a21(spark, d):
    return runs.baseline(table(spark, d, "events").filter("event_type = 'view'"), "value", 8, 4, 0.1)


@query("A22_spearman", "SELECT round(corr(a, b), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders)")
def a22(spark, d):
    return metrics.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey").select(F.round("rho", 6).alias("rho"))


@query("A23_squared_correlation", "SELECT event_type, round(corr(value, user_id)^2, 6) AS r2 FROM events GROUP BY 1")
def a23(spark, d):
    return metrics.squared_correlation(table(spark, d, "events"), "value", "user_id", ("event_type",)).select("event_type", F.round("r2", 6).alias("r2"))


@query("A24_leave_one_out", "SELECT round(corr(value, loo)^2, 6) AS r2 FROM (SELECT value, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS loo FROM events WINDOW w AS (PARTITION BY user_id))")
def a24(spark, d):
    loo = metrics.leave_one_out_means(table(spark, d, "events"), "user_id", "value")
    return metrics.squared_correlation(loo, "value", "loo").select(F.round("r2", 6).alias("r2"))


@query("A25_calibration", "SELECT event_type, round(regr_intercept(value, user_id), 6) AS a, round(regr_slope(value, user_id), 6) AS b FROM events GROUP BY 1")
def a25(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.regr_intercept("value", "user_id"), 6).alias("a"), F.round(F.regr_slope("value", "user_id"), 6).alias("b"))


LINES = "SELECT c_custkey AS work, o_orderkey AS rec, l_extendedprice / 1000 AS x FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def nested(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("rec"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec"), (F.col("l_extendedprice") / 1000).alias("x")).join(o, "rec")


DISP = "(sum({k} * {v} * (t - {k})) + sum({k} * {m} * {m} * (t - {k})) - (sum({k} * {m})^2 - sum(({k} * {m})^2))) / (max(t)^2 - sum({k}^2))"


@query("A26_pair_dispersion", f"WITH u AS (SELECT work, count(*)::DOUBLE AS k, avg(x) AS m, var_pop(x) AS v FROM ({LINES}) GROUP BY 1), t AS (SELECT *, sum(k) OVER () AS t FROM u) SELECT round({DISP.format(k='k', m='m', v='v')}, 4) AS dispersion FROM t")
def a26(spark, d):
    return variance.pair_dispersion(variance.unit_moments(nested(spark, d), ["work"], "x")).select(F.round("dispersion", 4).alias("dispersion"))


#: Per-work pieces of the nested components, as CTEs l, r and p; and the components of CTE `q` with weights k by `{by}`.
PIECES = (
    f"l AS ({LINES}), r AS (SELECT work, rec, count(*)::DOUBLE AS k, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2), "
    "p0 AS (SELECT work, coalesce(sum(v * k / (k - 1)) FILTER (k > 1), 0) AS ws, count(*) FILTER (k > 1) AS wc, CASE WHEN count(*) > 1 THEN ((count(*) - 1) * (sum(v) + sum(m * m)) - (sum(m)^2 - sum(m * m))) / (count(*)^2 - count(*)) END AS rd FROM r GROUP BY 1), "
    "pieces AS (SELECT p0.*, avg(x) AS m, var_pop(x) AS v FROM p0 JOIN l USING (work) GROUP BY ALL)"
)
COMPONENTS = (
    "SELECT {by}sum(k * ws) / sum(k * wc) AS windows, sum(k * rd) / sum(k) FILTER (rd IS NOT NULL) AS d_rec, "
    "(sum(k * v * (t - k)) + sum(k * m * m * (t - k)) - (sum(k * m)^2 - sum((k * m)^2))) / (max(t)^2 - sum(k^2)) AS total FROM q"
)


@query("A27_variance_components", f"WITH {PIECES}, q AS (SELECT *, 1.0::DOUBLE AS k, count(*) OVER () AS t FROM pieces), c AS ({COMPONENTS.format(by='')}) SELECT round(total - d_rec, 4) AS works, round(d_rec - windows, 4) AS recordings, round(windows, 4) AS windows, round(total, 4) AS total FROM c")
def a27(spark, d):
    c = variance.components(nested(spark, d), "work", "rec", "x")
    return c.select(*[F.round(x, 4).alias(x) for x in c.columns])


@query(
    "A28_component_intervals",
    f"WITH {PIECES}, {draws('pieces', 'work', 40, 'a28')}, q AS (SELECT rep, pieces.*, times::DOUBLE AS k, sum(times) OVER (PARTITION BY rep)::DOUBLE AS t FROM m JOIN pieces USING (work) UNION ALL SELECT -1, *, 1.0::DOUBLE, count(*) OVER ()::DOUBLE FROM pieces), "
    f"c AS ({COMPONENTS.format(by='rep, ')} GROUP BY rep), s AS (SELECT rep, unnest(['works', 'recordings', 'windows']) AS level, unnest([total - d_rec, d_rec - windows, windows]) AS variance, total FROM c) "
    "SELECT level, round(max(variance) FILTER (rep = -1), 4) AS variance, round(max(variance / total) FILTER (rep = -1), 6) AS share, round(quantile_cont(variance / total, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(variance / total, 0.975) FILTER (rep >= 0), 6) AS high FROM s GROUP BY level",
)
def a28(spark, d):
    c = variance.component_intervals(nested(spark, d), "work", "rec", "x", 40, "a28")
    return c.select("level", F.round("variance", 4).alias("variance"), *[F.round(x, 6).alias(x) for x in ("share", "low", "high")])


@query("A29_squared_mean", f"WITH e AS ({EMB}), x AS (SELECT grp, id % 5 AS rec, unnest(range(64)) AS pos, unnest(v) AS x FROM e), u AS (SELECT grp, rec, pos, avg(x) AS a, count(*)::DOUBLE AS k FROM x GROUP BY 1, 2, 3), s AS (SELECT grp, pos, (sum(k * a)^2 - sum(k * k * a * a)) / (sum(k)^2 - sum(k * k)) AS u FROM u GROUP BY 1, 2) SELECT grp, round(sum(u), 6) AS delta2 FROM s GROUP BY 1")
def a29(spark, d):
    units = moments.per_dimension(emb(spark, d).withColumn("rec", F.col("id") % 5), "v", "grp", "rec")
    return variance.squared_mean(units, ["grp"], "pos", "mean", "n").select("grp", F.round("delta2", 6).alias("delta2"))


@query("A30_covariance", f"WITH x AS (SELECT id, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})) SELECT a.p::INTEGER AS i, b.p::INTEGER AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b USING (id) WHERE a.p <= b.p GROUP BY 1, 2")
def a30(spark, d):
    return moments.covariance_table(emb(spark, d), "v").select("i", "j", F.round("cov", 6).alias("cov"))


@query("A30_covariance_gram", f"WITH x AS (SELECT id, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})) SELECT a.p AS i, b.p AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b USING (id) WHERE a.p <= b.p GROUP BY 1, 2")
def a30b(spark, d):
    _, _, cov = moments.mean_and_covariance(emb(spark, d), "v")
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 6)) for i in range(64) for j in range(i, 64)], "i bigint, j bigint, cov double")


@query("A31_layer_moments", f"WITH x AS (SELECT id, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})) SELECT p // 16 AS layer, p % 16 AS pos, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM x GROUP BY 1, 2")
def a31(spark, d):
    m = moments.per_dimension(emb(spark, d), "v")
    return m.select(F.expr("bigint(pos div 16)").alias("layer"), F.expr("bigint(pos % 16)").alias("pos"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("A32_group_means", f"WITH x AS (SELECT grp, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})) SELECT grp, round(avg(x) FILTER (p = 0), 6) AS m1, round(avg(x) FILTER (p = 63), 6) AS m64, count(*) FILTER (p = 0) AS n FROM x GROUP BY 1")
def a32(spark, d):
    g = moments.group_means(emb(spark, d), "v", "grp")
    return g.select("grp", F.round(F.col("mean")[0], 6).alias("m1"), F.round(F.col("mean")[63], 6).alias("m64"), "n")


@query("A33_between_share", f"WITH x AS (SELECT grp, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})), m AS (SELECT p, avg(x) AS m, sum(x * x) - count(*) * avg(x)^2 AS ss FROM x GROUP BY 1), g AS (SELECT grp, p, avg(x) AS a, count(*) AS n FROM x GROUP BY 1, 2) SELECT round(sum(n * (a - m)^2) / (SELECT sum(ss) FROM m), 6) AS share FROM g JOIN m USING (p)")
def a33(spark, d):
    return spectra.between_share(emb(spark, d), "v", "grp").select(F.round("share", 6).alias("share"))


WEIGHTS = "SELECT id, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS w FROM (" + EMB + ")"


@query("A34_weight_stats", f"WITH w AS ({WEIGHTS}) SELECT id, round(-list_sum(list_transform(w, lambda x: x * ln(x))), 6) AS entropy, round(ln(64) + list_sum(list_transform(w, lambda x: x * ln(x))), 6) AS kl, round(list_max(w) / list_min(w), 4) AS ratio, (list_position(w, list_max(w)) - 1)::INTEGER AS top, round(list_sum(list_reverse_sort(w)[1:3]), 6) AS top3 FROM w")
def a34(spark, d):
    w = emb(spark, d).select("id", A.softmax(F.col("v")).alias("w"))
    return w.select("id", *spectra.weight_stats(F.col("w"))).select("id", F.round("entropy", 6).alias("entropy"), F.round("kl", 6).alias("kl"), F.round("ratio", 4).alias("ratio"), "top", F.round("top3", 6).alias("top3"))


@query("A35_spectrum_stats", f"WITH x AS (SELECT unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})), l AS (SELECT p, var_samp(x) AS l FROM x GROUP BY 1), s AS (SELECT l / sum(l) OVER () AS s, row_number() OVER (ORDER BY l DESC, p) AS r FROM l), c AS (SELECT *, sum(s) OVER (ORDER BY r) AS c FROM s) SELECT round(exp(-sum(s * ln(s))), 6) AS effective_rank, round(1 / sum(s * s), 6) AS participation, round(max(s) / min(s), 6) AS condition, round(sum(s) FILTER (r <= 5), 6) AS top5, min(r) FILTER (c >= 0.5) AS half FROM c")
def a35(spark, d):
    lam = moments.per_dimension(emb(spark, d), "v").select("pos", F.col("var").alias("lam"))
    s = spectra.spectrum_stats(lam, "lam", "pos")
    return s.select(*[F.round(c, 6).alias(c) for c in ("effective_rank", "participation", "condition", "top5")], F.col("half").cast("bigint").alias("half"))


@query("A36_slot_effects", "WITH f AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), s AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) - 1 AS slot, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey) AS dev FROM f WHERE n = 4), g AS (SELECT slot, avg(dev) AS effect, count(*) AS n, sum(dev * dev) AS ss FROM s GROUP BY 1) SELECT slot, round(effect, 4) AS effect, n, round(sum(n * effect * effect) OVER () / sum(ss) OVER (), 6) AS explained FROM g")
def a36(spark, d):
    s = variance.slot_effects(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_extendedprice", 4)
    return s.select(F.col("slot").cast("bigint").alias("slot"), F.round("effect", 4).alias("effect"), "n", F.round("explained", 6).alias("explained"))


@query("A37_outcome_counts", "SELECT event_type AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / (epoch(max(max(ts)) OVER ()) - epoch(min(min(ts)) OVER ())) * 3600, 4) AS per_hour FROM events GROUP BY 1")
def a37(spark, d):
    return runs.outcome_counts(table(spark, d, "events"), "event_type", "ts").select(F.col("event_type").alias("status"), "n", F.round("share", 6).alias("share"), F.round("per_hour", 4).alias("per_hour"))


@query(
    "A37_run_progress",
    "WITH a AS (SELECT count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS final, epoch(max(ts)) - epoch(min(ts)) AS s FROM events), "
    "k AS (SELECT DISTINCT event_id FROM events WHERE event_type IN ('purchase', 'error')), p AS (SELECT count(*) AS planned, count(*) FILTER (k.event_id IS NULL) AS remaining FROM (SELECT DISTINCT o_orderkey AS key FROM orders) o LEFT JOIN k ON k.event_id = o.key) "
    "SELECT planned, attempted, ok, final, round(ok / attempted, 6) AS yield, round(attempted / s * 3600, 4) AS per_hour, remaining, round(remaining / (attempted / s * 3600) / 24, 6) AS days FROM a, p",
)
def a37_progress(spark, d):
    """Orders are what is planned, events the attempts at them: purchases succeed, errors are final."""
    log = table(spark, d, "events").withColumn("class", F.expr("CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'final' ELSE 'again' END"))
    r = runs.progress(log, table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), "event_id", "class", "ts")
    return r.select("planned", "attempted", "ok", "final", F.round("yield", 6).alias("yield"), F.round("per_hour", 4).alias("per_hour"), "remaining", F.round("days", 6).alias("days"))


@query("A38_recording_deviation", f"WITH r AS (SELECT work, rec, avg(x) AS m FROM ({LINES}) GROUP BY 1, 2), w AS (SELECT *, avg(m) OVER (PARTITION BY work) AS a, count(*) OVER (PARTITION BY work) AS c FROM r) SELECT work, rec, round(m - a, 8) AS deviation FROM w WHERE c > 1")
def a38(spark, d):
    return variance.recording_deviation(nested(spark, d), "work", "rec", "x").withColumn("deviation", F.round("deviation", 8))


@query("A39_cross_correlation", f"WITH x AS (SELECT id, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})) SELECT round(avg(c * c), 6) AS stat FROM (SELECT corr(a.x, b.x) AS c FROM x a JOIN x b USING (id) WHERE a.p < 32 AND b.p >= 32 GROUP BY a.p, b.p)")
def a39(spark, d):
    halves = emb(spark, d).select(F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return spectra.cross_correlation(halves, "a", "b", 32).select(F.round("stat", 6).alias("stat"))


@query(
    "A40_hsic",
    f"WITH e AS (SELECT id, v[1:32] AS a, v[33:64] AS b FROM ({EMB})), p AS (SELECT x.id AS i, y.id AS j, list_distance(x.a, y.a)^2 AS da, list_distance(x.b, y.b)^2 AS db FROM e x JOIN e y ON x.id % 20 = 0), "
    "m AS (SELECT quantile_cont(da, 0.5) AS ma, quantile_cont(db, 0.5) AS mb FROM p WHERE i <> j), k AS (SELECT i, j, exp(-da / (2 * ma)) AS ka, exp(-db / (2 * mb)) AS kb FROM p, m), "
    "c AS (SELECT i, j, ka - avg(ka) OVER (PARTITION BY i) - avg(ka) OVER (PARTITION BY j) + avg(ka) OVER () AS ca, kb FROM k) SELECT round(sum(ca * kb) / ((count(DISTINCT i) - 1) * (count(DISTINCT j) - 1)), 8) AS hsic FROM c",
)
def a40(spark, d):
    """The two halves of every vector; a stated set of rows against all rows."""
    e = emb(spark, d).select("id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return spectra.hsic(e.filter("id % 20 = 0"), e, (32, 32)).select(F.round("hsic", 8).alias("hsic"))


@query(
    "A41_contrastive",
    f"WITH e AS ({EMB}), p AS (SELECT q.id, q.id // 2 = c.id // 2 AS pos, list_cosine_similarity(q.v, c.v) / 0.1 AS s FROM e q JOIN e c ON q.id % 20 = 0 AND q.id <> c.id AND (q.id // 2 = c.id // 2 OR q.grp <> c.grp)) "
    "SELECT id, round(ln(sum(exp(s))) - ln(sum(exp(s)) FILTER (pos)), 6) AS loss FROM p GROUP BY 1",
)
def a41(spark, d):
    e = emb(spark, d).withColumn("pair", F.expr("id div 2"))
    return spectra.contrastive(e.filter("id % 20 = 0"), e, 64, 0.1).select("id", F.round("loss", 6).alias("loss"))


@query(
    "A42_standardised_error",
    f"WITH x AS (SELECT id, unnest(range(64)) AS p, unnest(v) AS x FROM ({EMB})), z AS (SELECT id, p, (x - avg(x) OVER (PARTITION BY p)) / stddev_samp(x) OVER (PARTITION BY p) AS z FROM x), w AS (SELECT *, avg(z) OVER (PARTITION BY id) AS m FROM z) SELECT round(avg(z * z), 6) AS global_mse, round(avg((z - m)^2), 6) AS window_mse, round(1 - avg((z - m)^2) / avg(z * z), 6) AS between FROM w",
)
def a42(spark, d):
    s = spectra.trivial_errors(emb(spark, d), "id", "v")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("A43_seen_transfer", f"WITH s AS ({SONGS}), a AS (SELECT o.event_type AS gen, k AS probe, avg(CASE WHEN v.mean + v.user_id % k > o.mean + o.user_id % k THEN 1.0 WHEN v.mean + v.user_id % k = o.mean + o.user_id % k THEN 0.5 ELSE 0.0 END)::DOUBLE AS auroc FROM s o JOIN s v ON v.event_type = 'view' AND o.event_type <> 'view', range(1, 4) t(k) GROUP BY 1, 2) SELECT probe::INTEGER AS probe, round(avg(auroc) FILTER (gen = 'click'), 6) AS seen, round(avg(auroc) FILTER (gen <> 'click'), 6) AS transfer FROM a GROUP BY 1")
def a43(spark, d):
    s = songs(spark, d).withColumn("probe", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("x", F.col("mean") + F.col("user_id") % F.col("probe"))
    return runs.seen_and_transfer(runs.probe_matrix(s, "probe", "event_type", "x", "view"), "probe", "event_type", ["click"])


@query("A44_agreement", "WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: [x[1]::DOUBLE, x[2]::DOUBLE]) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id // 2) * 2), x AS (SELECT vec_id, unnest(z) AS q FROM p), c AS (SELECT vec_id, corr(q[1], q[2]) AS r FROM x GROUP BY 1) SELECT round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6) AS p05, round(avg((r > 0.999)::INTEGER), 6) AS same FROM c")
def a44(spark, d):
    e = emb(spark, d)
    both = e.select("id", "v", F.expr("id div 2 * 2").alias("o")).join(e.select(F.col("id").alias("o"), F.col("v").alias("w")), "o")
    s = spectra.agreement(both, "id", "v", "w")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


