"""Ranks, quantiles, reports and bootstraps against numpy: null groups, infinities, ties, several rounds of bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import text
from cohortia.operators import metrics, protocol, ranks, resample, runs, variance


@pytest.fixture(scope="module")
def scores(spark):
    """Sources a, b and null; scores with ties, infinities, NaN and nulls."""
    rng = np.random.default_rng(3)
    rows = []
    for source, n, shift in (("a", 700, 0.0), ("b", 500, 0.7), (None, 300, -0.4)):
        x = np.round(rng.normal(shift, 1, n), 1)
        values = [float(v) for v in x] + [math.inf, -math.inf, math.nan, None]
        rows += [(source, v) for v in values]
    return spark.createDataFrame(rows, "source string, score double")


def usable(rows, source):
    return np.array([r.score for r in rows if r.source == source and r.score is not None and not math.isnan(r.score)])


def auroc(high, low):
    return float(((high[:, None] > low).mean() + 0.5 * (high[:, None] == low).mean()))


def test_quantiles_of_null_groups_and_infinities(spark, scores):
    rows = scores.collect()
    got = {r.source: r for r in metrics.summary(scores, "score", ("source",)).collect()}
    assert set(got) == {"a", "b", None}
    for source, r in got.items():
        x = np.clip(usable(rows, source), -1e300, 1e300)
        assert r.n == len(x)
        assert [r.p5, r.p25, r.p50, r.p75, r.p95] == pytest.approx(list(np.quantile(x, [0.05, 0.25, 0.5, 0.75, 0.95])))


def test_quantiles_by_bounds_are_exact(spark, monkeypatch):
    """Large groups: two bounds from a sketch, narrowed more than once, ties and a crowded value included."""
    x = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.col("id") * 7919, F.lit(100_003)).cast("double"))
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), x.alias("x"))
    pdf, qs = rows.toPandas(), [0.0, 0.001, 0.25, 0.3334, 0.5, 0.9, 1.0]
    calls = []
    narrowed = metrics._narrowed
    monkeypatch.setattr(metrics, "_narrowed", lambda *a: calls.append(1) or narrowed(*a))
    for ordered in (1 << 20, 30, 1):
        monkeypatch.setattr(metrics, "ORDERED", ordered)
        got = {(r.g, r.p): r.value for r in metrics.quantile_table(rows, "x", qs, ("g",)).collect()}
        for g in (0, 1):
            assert [got[g, q] for q in qs] == pytest.approx(list(np.quantile(pdf[pdf.g == g].x, qs)))
    assert len(calls) >= 2
    whole = {r.p: r.value for r in metrics.quantile_table(rows, "x", qs).collect()}
    assert [whole[q] for q in qs] == pytest.approx(list(np.quantile(pdf.x, qs)))
    assert metrics.quantile_table(rows.limit(0), "x", qs).count() == 0


def test_report_of_all_sources_from_one_ranking(spark, scores):
    rows = scores.collect()
    got = {r.source: r for r in metrics.source_report(scores, "score", "source", "a").collect()}
    ref = usable(rows, "a")
    cut = np.quantile(np.clip(ref, -1e300, 1e300), 0.05)
    assert set(got) == {"a", "b", None}
    for source, r in got.items():
        x = usable(rows, source)
        assert (r.songs, r.failed) == (len(x) + 2, 2)
        assert [r.q1, r["median"], r.q3] == pytest.approx(list(np.quantile(np.clip(x, -1e300, 1e300), [0.25, 0.5, 0.75])))
        assert r.below == pytest.approx((x < cut).mean())
        assert r.auroc is None if source == "a" else r.auroc == pytest.approx(auroc(ref, x))
    lone = metrics.source_report(scores, "score", "source", "absent").collect()
    assert len(lone) == 3 and all(r.auroc is None for r in lone)


def test_auroc_keeps_null_groups_and_does_not_repeat_the_reference(spark, scores):
    rows = scores.withColumn("g", F.when(F.col("score") > 0, "up")).unionByName(scores.withColumn("g", F.lit("all")))
    got = {(r.g, r.source): r.auroc for r in metrics.auroc_against(rows, "score", "source", "a", by=("g",)).collect()}
    seen = rows.collect()
    for g in ("up", "all", None):
        part = [r for r in seen if r.g == g]
        for source in ("b", None):
            assert got[g, source] == pytest.approx(auroc(usable(part, "a"), usable(part, source)))
    plain = {r.source: r.auroc for r in metrics.auroc(scores.withColumn("pos", F.col("score") > 0.5), "score", F.col("pos"), ("source",)).collect()}
    assert plain == {"a": 1.0, "b": 1.0, None: 1.0}
    few = metrics.auroc_against(rows.filter("source <> 'a'"), "score", "source", "a", by=("g",)).collect()
    assert few and all(r.auroc is None for r in few)


def test_standings_in_many_ranges(spark, scores):
    counts = scores.filter(metrics.usable("score")).groupBy("source", "score").agg(F.count("*").alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = ranks.standings(counts, (), "source", "score", "k", "b").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = scores.collect()
    ref = usable(rows, "b")
    for r in got:
        assert (r._own, r._ref, r._tie) == ((usable(rows, r.source) < r.score).sum(), (ref < r.score).sum(), (ref == r.score).sum())


def test_null_clusters_and_empty_clusters_are_drawn(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (None, 100.0), (None, 100.0), (3, None)], "c long, x double")
    got = [r.value for r in resample.clustered_mean(rows, "c", "x", 200, "s").collect()]
    assert len(got) == 200 and max(v for v in got if v is not None) == 100.0 and 1.0 in got
    two = resample.clustered_mean(rows.filter("c IN (1, 3)"), "c", "x", 50, "s").collect()
    assert {r.value for r in two} == {1.0, None}  # null where only the cluster without values was drawn
    by = rows.withColumn("g", F.when(F.col("c") == 1, "one"))
    assert {r.g for r in resample.clustered_mean(by, "c", "x", 20, "s", "g").collect()} == {"one", None}


def test_component_intervals_are_those_of_physical_resampling(spark):
    """Weighted pieces give what copies of the drawn works' windows give, less pairs of a work with itself."""
    rng = np.random.default_rng(5)
    rows = [(w, f"{w}_{r}", float(m + rng.normal(0, 1) + 0.5 * i)) for w in range(12) for m in [rng.normal(0, 2)] for r in range(1 + w % 4) for i in range(1 + (w + r) % 3)]
    df = spark.createDataFrame(rows, "w int, r string, x double")

    def direct(works):
        """Components by listing pairs, of works that may repeat."""
        of = {w: {} for w in works}
        for w, r, x in rows:
            if w in of:
                of[w].setdefault(r, []).append(x)
        var = [np.var(v, ddof=1) for w in works for v in of[w].values() if len(v) > 1]

        def half(a, b):
            return 0.5 * np.mean(np.square(np.subtract.outer(a, b)))

        rec = [np.mean([half(a, b) for i, a in enumerate(v) for j, b in enumerate(v) if i != j]) for w in works for v in [list(of[w].values())] if len(v) > 1]
        alls = [np.concatenate(list(of[w].values())) for w in works]
        total = np.mean([half(a, b) for a, i in zip(alls, works) for b, j in zip(alls, works) if i != j])
        return {"works": total - np.mean(rec), "recordings": np.mean(rec) - np.mean(var), "windows": np.mean(var)}, total

    want, total = direct(list(range(12)))
    got = {r.level: r for r in variance.component_intervals(df, "w", "r", "x", 25, "s").collect()}
    drawn = resample.multiplicities(df, "w", 25, "s").toPandas()
    shares = {k: [] for k in want}
    for _, part in drawn.groupby("rep"):
        c, t = direct([w for w, k in zip(part.w, part.times) for _ in range(k)])
        for k in want:
            shares[k].append(c[k] / t)
    for k in want:
        assert got[k].variance == pytest.approx(want[k]) and got[k].share == pytest.approx(want[k] / total)
        assert (got[k].low, got[k].high) == pytest.approx(tuple(np.quantile(shares[k], [0.025, 0.975])))


def test_slots_explain_their_share(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (40, 3)) + np.array([0.0, 1.0, -0.5])
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(3)] + [(99, 0, 5.0)], "r int, at int, x double")
    got = {r.slot: r for r in variance.slot_effects(df, "r", "at", "x", 3).collect()}
    dev = x - x.mean(1, keepdims=True)
    assert [got[j].effect for j in range(3)] == pytest.approx(list(dev.mean(0)))
    assert got[0].explained == pytest.approx(40 * np.square(dev.mean(0)).sum() / np.square(dev).sum())


def test_progress_of_a_run(spark):
    log = spark.createDataFrame([(1, "ok", 0), (2, "again", 1800), (2, "final", 3600), (9, "ok", 7200)], "k int, o string, s long").withColumn("at", F.timestamp_seconds("s"))
    planned = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "k int")
    r = runs.progress(log, planned, "k", "o", "at").first()
    assert (r.planned, r.attempted, r.ok, r.final, r["yield"], r.per_hour, r.remaining) == (5, 4, 2, 1, 0.5, 2.0, 3)
    assert r.days == pytest.approx(3 / 2 / 24)
    none = runs.progress(log.limit(0), planned, "k", "o", "at").first()
    assert (none.attempted, none["yield"], none.per_hour, none.remaining, none.days) == (0, None, None, 5, None)


def test_threshold_moves_with_the_log_density(spark):
    """Two fits of one density in other units flag the same songs, whichever way their deviations differ."""
    rng = np.random.default_rng(3)
    logp = rng.normal(0, 1, 400)
    rows = [(i, "human" if i < 200 else "gen", float(v - (i >= 200))) for i, v in enumerate(logp)]
    one = spark.createDataFrame(rows, "k int, source string, x double")
    # log p of features = x + log_det, so a fit whose log_det is 2 lower has scores 2 higher.
    two = one.withColumn("x", F.col("x") + 2.0)
    rates, changes = protocol.fixed_threshold(one, two, "k", "source", "x", "human", {"all": ["gen"]}, 0.1, log_det_before=1.0, log_det_after=-1.0)
    r = rates.first()
    gen, human = np.array([v for i, _, v in rows if i >= 200]), np.array([v for i, _, v in rows if i < 200])
    assert r.threshold == pytest.approx(np.quantile(human, 0.1) + 2) and r.fpr == pytest.approx(0.1) and changes.count() == 0
    assert r.tpr == pytest.approx((gen < np.quantile(human, 0.1)).mean()) and r.before_tpr == pytest.approx((gen < np.quantile(human, r.fpr)).mean())
    nan = two.withColumn("x", F.when(F.col("k") == int(np.argmin(human)), float("nan")).otherwise(F.col("x")))
    assert [tuple(c) for c in protocol.fixed_threshold(one, nan, "k", "source", "x", "human", {"all": ["gen"]}, 0.1, 1.0, -1.0)[1].collect()] == [(int(np.argmin(human)), "no longer")]


def test_codec_chains_by_the_book(spark):
    specs = ["mp3:64k", "mp3:64k:22050", "mp3:64k:44100:1", "opus:96k:24000", "opus:96k:22050", "vorbis:64k", "mp3", "mp3:64k:x", "mp3:64k:44100:2:1", "", " None ", None, "aac:1k+ opus:2k", "mp3:64k+", "mp3:64k:"]
    got = spark.createDataFrame([(s,) for s in specs], "s string").select(text.codec_chain(F.col("s")).alias("c")).select(F.size("c").alias("n"), text.codec_chain_ok(F.col("c")).alias("ok"), text.codec_name(F.col("c")).alias("name"), text.codec_slug(F.col("c")).alias("slug")).collect()
    assert [r.ok for r in got] == [True, True, True, True, False, False, False, False, False, True, True, True, True, False, False]
    assert got[9].n == got[10].n == got[11].n == 0 and got[11].name is None and got[11].slug == ""
    assert got[12].name == "aac:1k:44100:2+opus:2k:48000:2" and got[12].slug == "aac-1k-44100-2_opus-2k-48000-2"
    assert len({r.slug for r in got[:4]}) == 4
