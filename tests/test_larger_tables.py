"""What small tables do not show: values past the usual range, ties, and the ends of logs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import text as T
from cohortia.operators import align, metrics, pairs, resample, runs, scoring, spectra
from cohortia.plans.registry import QUERIES


def test_baseline_margin_of_a_loss_of_nothing_and_of_a_bad_one(spark):
    margin = lambda *x: runs.baseline(spark.createDataFrame([(v,) for v in x], "x double"), "x", 8, 4, 0.1).first().margin
    assert margin(0.0, 2.0) == math.inf
    assert margin(5.0, 6.0) == round(-0.1 * math.log((math.exp(5) - 1) / 28), 6) < 0
    assert math.isnan(margin(-1.0, 2.0)) and margin() is None


def test_quantiles_between_equal_values_are_that_value(spark):
    # 0.97 * x + 0.03 * x is not x for about one in five x.
    values = [math.sqrt(k) for k in range(2, 60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values) for _ in range(4)], "i int, x double")
    for q in (0.01, 0.11, 0.23):
        got = {r.i: r.value for r in metrics.quantile_table(df, "x", [q], ("i",)).collect()}
        assert got == dict(enumerate(values))
    report = {r.i: (r.q1, r.median, r.q3) for r in metrics.source_report(df, "x", "i", 0).collect()}
    assert report == {i: (x, x, x) for i, x in enumerate(values)}


def test_human_bytes_up_to_a_largest_unit(spark):
    n = spark.createDataFrame([(512.0,), (1536.0,), (2.0**40 * 6,)], "n double")
    show = lambda *a: [r[0] for r in n.select(T.human_bytes(F.col("n"), *a)).collect()]
    assert show() == ["512 B", "1.5 KiB", "6.0 TiB"]
    assert show("GiB") == ["512 B", "1.5 KiB", "6144.0 GiB"]


def test_human_units_query_beyond_a_tebibyte(spark, tmp_path):
    row = spark.createDataFrame([(1_000_000, 100_000, 61.5)], "o_orderkey long, o_custkey long, o_totalprice double")
    row.write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["P7_human_units"](spark, str(tmp_path)).first()["size"] == "5960.5 GiB"


def test_request_rates_count_every_event_in_five_windows(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["T3_request_rates"](spark, d)
    events = spark.read.parquet(f"{d}/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == 5 * events.count()
    # The last window is that of the last event, which no later one closes.
    assert got.agg(F.max("start")).first()[0] == events.agg(F.date_trunc("minute", F.max("ts")).cast("string")).first()[0]


def test_bootstrap_draws_are_shuffled_once_by_one_number(spark):
    rows = spark.createDataFrame([(i % 30 if i % 7 else None, i % 2 == 0, float(i)) for i in range(300)], "c long, late boolean, x double")
    got = {(r.rep, r.late): r.value for r in resample.clustered_mean(rows, "c", "x", 5, "s", "late").collect()}
    pieces = rows.groupBy("late", "c").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    m = resample.multiplicities(pieces, "c", 5, "s", "late", ("s", "n")).groupBy("rep", "late").agg((F.sum(F.expr("times * s")) / F.sum(F.expr("times * n"))).alias("v"))
    assert got == {(r.rep, r.late): pytest.approx(r.v) for r in m.collect()} and len(got) == 10
    plan = resample.clustered_mean(rows, "c", "x", 5, "s", "late")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS times" not in plan


def test_square_distances_by_one_product(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(3, 1, (40, 6))
    b = np.concatenate([a[:10], a[10:20] + 1e-7, rng.normal(3, 1, (30, 6))])
    far = spectra._square_distances(a, b)
    assert np.allclose(far, np.square(a[:, None] - b[None]).sum(-1), rtol=1e-8, atol=0)
    assert (far[np.arange(10), np.arange(10)] == 0).all()


def test_clique_profile_counts_pairs_without_listing_them(spark):
    rows = [("a", k) for k in (5, 1, 1, 9, 1, 7)] + [("b", 4), ("c", None), (None, 1), (None, 2), ("d", 3), ("d", 3), ("e", 2), ("e", 8)]
    items = spark.createDataFrame(rows, "g string, k long")
    listed = pairs.clique_pairs(items, "g", "k").groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("key_b") - F.col("key_a")).alias("span"))
    found = {tuple(r) for r in pairs.clique_profile(items, "g", "k").select("g", "n", "span").collect()}
    assert found == {tuple(r) for r in listed.collect()} and len(found) == 2
    # A hundred thousand of a group have five thousand million pairs.
    many = spark.range(100_000).select(F.lit("x").alias("g"), F.col("id").alias("k"))
    r = pairs.clique_profile(many, "g", "k").first()
    assert (r.n, r.span) == (100_000 * 99_999 // 2, (100_000**3 - 100_000) // 6)


def test_unit_scores_deal_windows_before_they_keep_values(spark):
    windows = spark.range(1000).select((F.col("id") % 7).alias("u"), F.col("id").cast("double").alias("x"))
    scores = scoring.unit_scores(windows, ["u"], "x")
    assert scores.filter("u = 3").first()["p10"] == pytest.approx(3 + 7 * 0.1 * 142)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("ObjectHashAggregate") < plan.index("Exchange")


def test_preservation_aligns_each_pair_once_where_it_lies(spark):
    plan = QUERIES["M26_preservation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "FlatMapGroups" not in plan


def test_alignments_of_many_pairs_at_a_time_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    cells = [np.where(rng.random(shape) < 0.3, 1.0, -1.0) for shape in ((23, 31), (31, 23), (40, 7), (1, 9), (9, 1), (1, 1), (12, 12))] + [-np.ones((3, 4))]
    for gap in (0.5, 0.0):
        together = [(best, [tuple(at) for at in path.tolist()]) for best, path in align.local_alignments(cells, gap)]
        assert together == [align.local_alignment(c, gap) for c in cells]
    for q in (0.0, 0.3, 0.8, 1.0):
        x = rng.integers(0, 5, 37) / 3
        assert align._quantile(x, q) == np.quantile(x, q) and math.isnan(align._quantile(np.append(x, np.nan), q))
    seqs = {str(k): rng.random((n, 12)) for k, n in enumerate((30, 25, 90, 5))} | {"none": None}
    rows = [(k, None if v is None else v.tolist()) for k, v in seqs.items()]
    s = spark.createDataFrame(rows, "key string, frames array<array<double>>").unionByName(spark.createDataFrame([("ragged", [[1.0] * 12] * 30 + [[1.0] * 11])], "key string, frames array<array<double>>"))
    both = s.select(F.col("key").alias("key_a"), F.col("frames").alias("frames_a")).crossJoin(s.select(F.col("key").alias("key_b"), F.col("frames").alias("frames_b")))
    got = {(r.key_a, r.key_b): r for r in align.align_met(both).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        if {a, b} <= {"0", "1", "2"}:
            score, oti, path = align.align_pair(seqs[a], seqs[b])
            assert (r.score, r.oti, [(at.i, at.j) for at in r.path], r.error) == (score, oti, path, None)
        else:
            assert r.error and r.score is None and r.oti is None and r.path == []


def test_draws_of_all_replicates_in_one_row_a_unit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = [float(v) for v in rng.integers(0, 9, 400) / 2] + [math.inf, -math.inf, math.nan, 0.0, -0.0]
    rows = [(("ref", "a", "b", None)[i % 4], (i % 57) or None, "pq"[i // 7 % 2], v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "s string, u long, g string, x double").repartition(5)
    monkeypatch.setattr(resample, "DEALT", 60)  # lots of ten units
    times = resample.drawn_times(df, "u", 6, "t", "s")
    listed = {(r.s, r.u): list(r.times) for r in times.collect()}
    assert len(listed) == times.count()
    apart = resample.multiplicities(df, "u", 6, "t", "s")
    want = {(r.rep, r.s, r.u): r.times for r in apart.collect()}
    assert {(k, *key): n for key, v in listed.items() for k, n in enumerate(v) if n} == want
    met = lambda m: df.withColumnsRenamed({"s": "_s", "u": "_u"}).join(m, F.col("_s").eqNullSafe(F.col("s")) & F.col("_u").eqNullSafe(F.col("u")))
    plain = lambda t: {tuple(r[c] for c in sorted(t.columns) if c != "auroc"): r.auroc for r in t.collect()}
    for by, reference, n in ((("g",), "ref", 36), ((), "gone", 24)):
        got = plain(resample.drawn_auroc(met(times), "x", "s", reference, by))
        assert got == plain(metrics.auroc_against(met(apart), "x", "s", reference, by=("rep", *by), weight=F.col("times"))) and len(got) == n
    finite = df.filter("x > -9 AND x < 9")
    mean = {(r.rep, r.s): r.value for r in resample.drawn_mean(finite, resample.drawn_times(finite, "u", 6, "t", "s"), "u", "x", "s").collect()}
    assert mean == {(r.rep, r.s): pytest.approx(r.value) for r in resample.clustered_mean(finite, "u", "x", 6, "t", "s").collect()} and len(mean) == 24
    assert resample.drawn_auroc(met(times).limit(0), "x", "s", "ref").count() == 0
