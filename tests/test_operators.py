"""Brute force for what has no SQL, and the invariants of samples, schedules and statistics."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import align, curate, density, descriptors, gaussians, metrics, moments, pairs, protocol, ranks, resample, sampling, trajectory, variance
from cohortia.functions import arrays as A
from cohortia.functions import text as T
from cohortia.sources import catalogue, stores
from cohortia.sources.scratch import new_folder


def vectors(spark, n=120, dims=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + 3
    rows = [(i, i % 4, i % 12, [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, grp int, rec int, v array<double>")


def test_round_robin_covers_every_pair_once(spark):
    items = spark.createDataFrame([(g, f"{g}-{i:02d}") for g, n in (("a", 7), ("b", 8), ("c", 2), ("d", 1)) for i in range(n)], "g string, k string")
    rows = pairs.round_robin(items, "g", "k").collect()
    for g, n in (("a", 7), ("b", 8), ("c", 2), ("d", 1)):
        mine = [r for r in rows if r.g == g]
        assert {(r.key_a, r.key_b) for r in mine} == set(itertools.combinations([f"{g}-{i:02d}" for i in range(n)], 2)) and len(mine) == n * (n - 1) // 2
        for _, turn in itertools.groupby(sorted(mine, key=lambda r: r.round), key=lambda r: r.round):
            used = [k for r in turn for k in (r.key_a, r.key_b)]
            assert len(used) == len(set(used))


def test_capped_pairs_have_no_repeats(spark):
    items = spark.range(300).select(F.when(F.col("id") < 280, "big").otherwise("small").alias("g"), F.col("id").alias("k"))
    rows = [(r.g, r.key_a, r.key_b) for r in pairs.capped_pairs(items, "g", "k", 500).collect()]
    assert len(rows) == len(set(rows)) and all(a < b for _, a, b in rows)
    assert sum(g == "big" for g, *_ in rows) == 500 and sum(g == "small" for g, *_ in rows) == 190


def test_cross_group_pairs(spark):
    items = spark.range(500).select((F.col("id") % 9).alias("g"), F.col("id").alias("k"))
    rows = pairs.cross_group_pairs(items, "g", "k", 60).collect()
    assert len(rows) == 60 and all(r.group_a != r.group_b for r in rows)


def test_nested_subsets_and_extension(spark):
    works = spark.range(200).select(F.col("id").alias("w"), (F.col("id") % 13).alias("n"))
    u = {r.w: r.u for r in sampling.nested_fractions(works, "w", ["n", "w"], 20, "s").collect()}
    assert len(u) == 200 and all(0 <= x < 1 for x in u.values())
    assert sum(x < 0.25 for x in u.values()) == 50 and sum(x < 0.5 for x in u.values()) == 100
    ten = {r.w for r in sampling.extendable(works.withColumn("s", F.lit(1)), "s", "w", 10, "x").collect()}
    assert ten < {r.w for r in sampling.extendable(works.withColumn("s", F.lit(1)), "s", "w", 25, "x").collect()}


def test_halves_are_matched_and_holdouts_leave_both(spark):
    works = spark.range(40).select(F.col("id").alias("w"))
    half = {r.w: r.half for r in sampling.matched_halves(works, "w", ["w"], "s").collect()}
    assert all(half[i] != half[i + 1] for i in range(0, 40, 2))
    rows = spark.range(60).select((F.col("id") % 3).alias("s"), F.expr("id div 6").alias("g"))
    got = sampling.held_out_groups(rows, "s", "g", 0.01, "h").groupBy("s").agg(F.count_if("val").alias("v"), F.count_if(~F.col("val")).alias("t")).collect()
    assert all(r.v > 0 and r.t > 0 for r in got)


def test_cap_never_drops_paired(spark):
    rows = spark.range(50).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") < 12).alias("paired"))
    kept = sampling.capped(rows, "g", "k", F.col("paired"), 5, "c").collect()
    assert {r.k for r in kept} == set(range(12))


def test_auroc_brute_force_and_symmetry(spark):
    rng = np.random.default_rng(1)
    rows = [(float(np.round(rng.normal(), 1)), bool(rng.random() < 0.4)) for _ in range(300)] + [(float("nan"), True), (float("-inf"), False), (float("inf"), True)]
    df = spark.createDataFrame(rows, "x double, p boolean")
    a = metrics.auroc(df, "x", F.col("p")).first()[0]
    ok = [r for r in rows if not math.isnan(r[0])]
    pos, neg = [x for x, p in ok if p], [x for x, p in ok if not p]
    assert a == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    assert a + metrics.auroc(df, "x", ~F.col("p")).first()[0] == pytest.approx(1)
    assert metrics.auroc(df.filter("p"), "x", F.col("p")).first()[0] is None


def test_weighted_auroc_is_resampling(spark):
    rows = [(i % 7 + 0.1 * (i % 3), i % 2 == 0, i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, p boolean, w int")
    copies = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "x double, p boolean")
    assert metrics.auroc(df, "x", F.col("p"), weight=F.col("w")).first()[0] == pytest.approx(metrics.auroc(copies, "x", F.col("p")).first()[0])


def test_bootstrap_of_a_constant_has_no_width(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("c"), F.lit(4.5).alias("x"))
    r = resample.interval(resample.clustered_mean(df, "c", "x", 30, "s"), "value").first()
    assert (r.low, r.high) == (4.5, 4.5)
    m = resample.multiplicities(df, "c", 30, "s").groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert {x.n for x in m} == {6}


def test_dispersion_by_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(w), float(rng.normal(w))) for w in rng.integers(0, 5, 60)]
    d = variance.pair_dispersion(variance.unit_moments(spark.createDataFrame(rows, "w int, x double"), ["w"], "x")).first()[0]
    far = [(a - b) ** 2 / 2 for (u, a), (v, b) in itertools.product(rows, rows) if u != v]
    assert d == pytest.approx(np.mean(far))


def test_components_sum_to_total(spark):
    rng = np.random.default_rng(5)
    rows = [(w, w * 10 + r, float(w + 0.5 * r + rng.normal())) for w in range(6) for r in range(3) for _ in range(4)]
    c = variance.components(spark.createDataFrame(rows, "w int, r int, x double"), "w", "r", "x").first()
    assert c.works + c.recordings + c.windows == pytest.approx(c.total)


def test_numbered_and_running(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("x"))
    got = {r.id: r.n for r in ranks.numbered(df.repartition(7), ["x", "id"], "n").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((i * 7919 % 101, i) for i in range(500)))}
    assert got == want
    sums = df.groupBy("x").agg(F.count("*").cast("double").alias("c"))
    run = {r.x: r.b for r in ranks.running_before(sums, (), "x", "c", "b", 8).collect()}
    counts = sorted((r.x, r.c) for r in sums.collect())
    assert run == {x: sum(c for y, c in counts if y < x) for x, _ in counts}


def test_moments_and_covariance(spark):
    x, df = vectors(spark)
    n, mu, cov = moments.mean_and_covariance(df, "v")
    assert n == 120 and np.allclose(mu, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    t = {(r.i, r.j): r.cov for r in moments.covariance_table(df, "v").collect()}
    assert all(t[i, j] == pytest.approx(cov[i, j]) for i in range(5) for j in range(i, 5))
    assert moments.mean_and_covariance(df.limit(0), "v")[0] == 0


def test_shrunk_gaussian(spark):
    x, df = vectors(spark)
    for shrink in (0.01, 1.0):
        model = gaussians.fit_shrunk(df, "v", shrink)
        got = {r.id: (r.logp, r.q) for r in gaussians.score_shrunk(df, ["id"], "v", model).collect()}
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        r = (1 - shrink) * np.corrcoef(x.T) + shrink * np.eye(5)
        q = np.einsum("ij,jk,ik->i", z, np.linalg.inv(r), z)
        logp = -0.5 * (5 * math.log(2 * math.pi) + np.linalg.slogdet(r)[1] + q)
        assert np.allclose([got[i] for i in range(120)], np.stack([logp, q], 1))


def test_pca_and_mix_moments(spark):
    x, df = vectors(spark, dims=6)
    out, share = gaussians.pca_2d(df, ["id"], "v")
    pts = np.array([(r.x, r.y) for r in out.orderBy("id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(pts.var(0, ddof=1), values[:2]) and np.allclose(share, values[:2] / values.sum())
    _, mu, cov = moments.mean_and_covariance(df, "v")
    w = np.array([0.25, 0.75])
    m, c = gaussians.mix_moments(mu, cov, w)
    mixed = 0.25 * x[:, :3] + 0.75 * x[:, 3:]
    assert np.allclose(m, mixed.mean(0)) and np.allclose(c, np.cov(mixed.T))


def test_lda_finds_the_direction_between_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=4) + np.array([4.0 * (i % 3), 0, 0, 0])]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, grp int, v array<double>")
    model = gaussians.fit_shrunk(df, "v")
    eta, directions = gaussians.fit_lda(df, "v", "grp", model, 2)
    assert eta[0] > 0.85 > 0.3 > eta[1]
    content = gaussians.project_content(df, ["id"], "v", model, directions).first().content
    assert len(content) == 2


def test_conditional_gaussian_and_ridge(spark):
    rng = np.random.default_rng(9)
    c = rng.normal(size=(400, 2))
    z = c @ np.array([[1.0, 0.5, 0.0], [0.0, 1.0, 2.0]]) + 0.1 * rng.normal(size=(400, 3))
    y = z @ np.array([1.0, -2.0, 0.5]) + 4
    df = spark.createDataFrame([(i, list(map(float, z[i])), list(map(float, c[i])), float(y[i])) for i in range(400)], "id long, z array<double>, c array<double>, y double")
    model = gaussians.fit_conditional(df, "z", "c", 3)
    assert model.explained > 0.95
    got = gaussians.score_conditional(df, ["id"], "z", "c", model).agg(F.avg("pmi").alias("m")).first().m
    assert got > 1
    w, b = gaussians.ridge(df, "z", "y", 1e-6)
    assert np.allclose(w, [1, -2, 0.5], atol=1e-3) and b == pytest.approx(4, abs=1e-3)


def brute_alignment(cell, gap):
    """(best, visited cells) by a table filled cell by cell, walked back from its first largest."""
    n, m = cell.shape
    t = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = max(0, t[i - 1, j - 1] + cell[i - 1, j - 1], t[i - 1, j] - gap, t[i, j - 1] - gap)
    i, j = map(int, np.unravel_index(t.argmax(), t.shape))
    best, seen = t[i, j], []
    while t[i, j] > 0:
        seen.insert(0, (i - 1, j - 1))
        i, j = next((a, b) for a, b, v in ((i - 1, j - 1, t[i - 1, j - 1] + cell[i - 1, j - 1]), (i - 1, j, t[i - 1, j] - gap), (i, j - 1, t[i, j - 1] - gap)) if v == t[i, j])
    return best, seen


def test_local_alignment(spark):
    rng = np.random.default_rng(2)
    for shape in ((23, 31), (31, 23), (40, 7), (1, 9), (12, 12)):
        for share in (0.1, 0.3, 0.6):
            cell = np.where(rng.random(shape) < share, 1.0, -1.0)
            assert align.local_alignment(cell, 0.5) == brute_alignment(cell, 0.5)
    assert align.local_alignment(-np.ones((3, 4)), 0.5) == (0.0, [])
    gaps = [len(p) > len({i for i, _ in p}) for _, p in (align.local_alignment(np.where(rng.random((30, 30)) < 0.3, 1.0, -1.0), 0.5) for _ in range(9))]
    assert any(gaps)  # gap steps are part of a path
    a = rng.random((40, 12))
    b = np.roll(a, 5, axis=1)
    score, oti, path = align.align_pair(a, b)
    assert oti == 7 and path == [(i, i) for i in range(40)]
    assert align.align_pair(a, np.roll(b, 3, axis=1))[0] == score


def test_alignment_control_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(w, i, list(map(float, v)), list(map(float, v + 0.1 * rng.normal(size=6)))) for w, n in (("x", 5), ("y", 3), ("z", 1)) for i, v in enumerate(rng.normal(size=(n, 6)))]
    got = align.alignment_control(spark.createDataFrame(rows, "w string, t int, a array<double>, b array<double>"), "w", "t", "a", "b", 2).first()
    cos = lambda u, v: float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
    by = {(w, i): (a, b) for w, i, a, b in rows}
    size, after = {"x": 5, "y": 3, "z": 1}, {"x": "y", "y": "z", "z": "x"}
    assert got.n == 9 and got.ok and got.aligned == pytest.approx(np.mean([cos(a, b) for _, _, a, b in rows]))
    assert got.shifted == pytest.approx(np.mean([cos(a, by[w, (i + 2) % size[w]][1]) for w, i, a, _ in rows if size[w] > 2]))
    assert got.crossed == pytest.approx(np.mean([cos(a, by[after[w], i % size[after[w]]][1]) for w, i, a, _ in rows]))


def test_alignment_job_reports_errors(spark):
    rng = np.random.default_rng(4)
    seq = {"a": rng.random((30, 12)), "b": rng.random((25, 12)), "short": rng.random((5, 12))}
    s = spark.createDataFrame([(k, v.tolist()) for k, v in seq.items()], "key string, frames array<array<double>>")
    p = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "short"), ("a", "gone")], "key_a string, key_b string")
    got = {(r.key_a, r.key_b): r for r in align.align(p, s).collect()}
    assert got["a", "a"].error is None and got["a", "a"].oti == 0 and got["a", "b"].score == pytest.approx(align.align_pair(seq["a"], seq["b"])[0])
    assert got["a", "short"].error.startswith("under") and got["a", "gone"].error == "no sequence"


def test_adaptive_rounds_equal_all_at_once(spark):
    c = spark.range(900).select((F.col("id") % 9).alias("g"), F.expr("id div 9").alias("ord"))
    passed = (F.col("ord") * 31 + F.col("g")) % 4 == 0
    want = pairs.first_passing(c, "g", "ord", passed, 6, 50)
    got = pairs.adaptive_rounds(c, "g", lambda df: df.withColumn("passed", passed), 6, budget=50)
    assert {(r.g, r.ord) for r in got.collect()} == {(r.g, r.ord) for r in want.collect()}


def test_convergence_of_a_run_that_never_left(spark):
    rows = [(1, s, [0.25, 0.25, 0.25, 0.25]) for s in range(12)] + [(2, s, [0.25 + 0.2, 0.05, 0.25, 0.25]) for s in range(12)]
    got = trajectory.convergence(spark.createDataFrame(rows, "run int, step int, w array<double>"), "run", "step", "w").filter("step = 11").collect()
    assert {r.run: (r.converged, r.never_left) for r in got} == {1: (False, True), 2: (True, False)}


def test_leaks_and_gates(spark):
    train = spark.createDataFrame([(1, "w1", "v1"), (2, "w2", "v2"), (3, "w3", "v3"), (4, "w4", "v1")], "id int, work string, video string")
    held = spark.createDataFrame([("w1", "x"), ("y", "v2")], "work string, video string")
    assert {r.id for r in curate.leak_free(train, held, "work", "video").collect()} == {3, 4}
    assert {r.id: r.leak for r in curate.leak_reasons(train, held, "work", "video").collect()} == {1: "work", 2: "item", 3: None, 4: None}
    with pytest.raises(ValueError):
        curate.require_disjoint(train, train.limit(1), "id")
    with pytest.raises(ValueError):
        curate.require_equal(train.filter("id = 1"), train.filter("id = 2"), "rows")


def test_protocol_is_tested_once_and_unchanged(spark):
    rng = np.random.default_rng(0)
    rows = [(s, u, f"{s}{u}", float(rng.normal(2 if s == "human" else 0)), float(rng.normal())) for s in ("human", "g1", "g2") for u in range(60)]
    songs = spark.createDataFrame(rows, "source string, u int, song string, a double, b double")
    dev, rest = songs.filter("u < 30"), songs.filter("u >= 30")
    made = protocol.select(dev, "source", "human", ["g1"], ["a", "b"])
    assert made["score"] == "a"
    record = new_folder(spark, "protocol")
    got = {(r.row, r.source): r for r in protocol.test(rest, dev, "song", "u", "source", made, record, ("b",), reps=30).collect()}
    best, other = got["a", "g2"], got["b", "g2"]
    assert len(got) == 6 and best.auroc > 0.8 and got["a", "human"].auroc is None and not best.repeat
    assert best.auroc_low <= best.auroc <= best.auroc_high and best.flagged_low <= best.flagged <= best.flagged_high
    assert other.delta_low > 0 and best.delta_low is None and other.auroc < 0.7
    human, g2 = ([r[3] for r in rows if r[0] == s and r[1] >= 30] for s in ("human", "g2"))
    assert best.auroc == pytest.approx(np.mean([x > y for x in human for y in g2])) and best.flagged == pytest.approx(np.mean(np.array(g2) < made["threshold"]))
    ask = lambda songs, p, **how: protocol.test(songs, dev, "song", "u", "source", p, reps=5, **how)
    fresh = lambda: new_folder(spark, "protocol")
    for bad in (lambda: ask(rest, made, record=record), lambda: ask(rest, made | {"threshold": 9.0}, record=fresh()), lambda: ask(dev, made, record=fresh())):
        with pytest.raises(ValueError):
            bad()
    assert {r.repeat for r in ask(rest, made, record=record, again=True).collect()} == {True}


def test_quantile_table_is_numpys(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400) / 4)] + [(4, 1.5), (5, float("inf")), (5, 2.0), (5, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = {(r.g, r.p): r.value for r in metrics.quantile_table(df, "x", [0.0, 0.1, 0.33, 0.5, 1.0], ("g",)).collect()}
    for (g, p), v in got.items():
        x = np.clip([x for h, x in rows if h == g and x == x], -1e300, 1e300)
        assert v == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert len(got) == 25
    assert metrics.quantile_table(df.limit(0), "x", [0.5]).count() == 0


def test_nearest_by_blocks_is_brute_force(spark):
    from cohortia.operators import retrieval

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 4)) + 0.5  # many ties
    df = spark.createDataFrame([(i, i % 4, list(map(float, v))) for i, v in enumerate(x)], "id long, grp int, v array<double>")
    for cosine in (False, True):
        for own_group in (False, True):
            got = retrieval.nearest(df.filter("id % 9 = 0"), df, 6, 4, cosine, own_group, block_bytes=600).collect()
            for q in range(0, 90, 9):
                far = -(x @ x[q]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q]) if cosine else np.linalg.norm(x - x[q], axis=1)
                want = sorted((round(f, 9), i) for i, f in enumerate(far) if i != q and (own_group or i % 4 != q % 4))[:6]
                mine = sorted((r for r in got if r.id == q), key=lambda r: r.r)
                assert [round(-r.score if cosine else r.score, 9) for r in mine] == [f for f, _ in want]
                assert [r.c_id for r in mine] == [i for _, i in want] or cosine  # cosines that tie may differ in the last bit


def test_normal_distribution_and_bisection(spark):
    xs = [-9.0, -3.0, -0.5, 0.0, 1e-9, 0.7, 2.5, 5.0, 7.9, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(A.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-13)
    marks = [1.0, 2.0, 2.0, 5.0, 9.0]
    m = F.array(*map(F.lit, marks))
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 9.0, 10.0)], "x double").select(A.below(m, 5, F.col("x"))).collect()]
    assert got == [sum(v < x for v in marks) for x in (0.0, 1.0, 2.0, 3.0, 9.0, 10.0)]
    assert [r[0] for r in spark.createDataFrame([(2.0,), (9.0,)], "x double").select(A.below(m, 5, F.col("x"), True)).collect()] == [3, 5]


def test_short_and_failed_songs_end_as_they_should(spark):
    from cohortia.streaming import jobs

    songs, path = new_folder(spark, "songs"), new_folder(spark, "scored")
    table = spark.createDataFrame([(i, [float(i)] * (i % 4 + 1)) for i in range(12)], "song int, windows array<double>")
    table.write.parquet(songs)
    score = lambda fails: lambda df: df.select("song", F.array_min("windows").alias("low"), F.when(fails, F.lit("no answer")).alias("error"))
    short = F.size("windows") < 2
    jobs.score_as_they_come(jobs.read_files(spark, songs), ["song"], score(F.col("song") % 3 == 1), path, short)
    first = {r.song: (r.low, r.skipped) for r in spark.read.parquet(path).collect()}
    assert set(first) == {i for i in range(12) if i % 3 != 1 or i % 4 == 0} and first[4] == (None, "too short")
    for _ in range(2):  # the failed are tried again, once they succeed nothing is left to do
        jobs.score_as_they_come(jobs.read_files(spark, songs), ["song"], score(F.lit(False)), path, short)
    got = [(r.song, r.low) for r in spark.read.parquet(path).collect()]
    assert sorted(s for s, _ in got) == list(range(12)) and all(v is None or v == s for s, v in got)


def test_assets_leave_out_hidden_and_partial_files(spark, tmp_path):
    for name in ("b.mp3", ".c.mp3", "d.mp3.part", "e.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.mp3").write_text("x")
    got = {(r.key, r.folder) for r in catalogue.list_assets(spark, str(tmp_path), (".mp3",)).collect()}
    assert got == {("b", tmp_path.name), ("f", "sub")}


def test_windows_of_a_table_function(spark):
    df = spark.createDataFrame([("a", 2500.0), ("b", 999.0), ("c", 1000.0), ("d", None)], "k string, d double")
    got = sorted(map(tuple, descriptors.window_table(df, "d", 1000.0, 500.0).select("k", "slot", "start").collect()))
    assert got == [("a", 0, 0.0), ("a", 1, 500.0), ("a", 2, 1000.0), ("a", 3, 1500.0), ("c", 0, 0.0)]
    with pytest.raises(Exception, match="hop must be above 0"):
        descriptors.window_table(df, "d", 1000.0, 0.0).collect()
    with pytest.raises(Exception, match="duration is string"):
        descriptors.window_table(df, "k", 1000.0, 1.0).collect()


def test_described_windows_against_numpy(spark):
    rng = np.random.default_rng(9)
    x, t = rng.random((60, 12)), np.sort(rng.uniform(0, 100, 60))
    tracks = [("good", t.tolist(), x.tolist(), [0.0, 40.0, 95.0], 5, True), ("bad", [1.0, 2.0], x[:3].tolist(), [0.0], 0, False), ("none", None, None, [0.0], 0, False)]
    df = spark.createDataFrame(tracks, "key string, times array<double>, frames array<array<double>>, starts array<double>, tonic int, minor boolean")
    got = descriptors.described_windows(df, 30.0, patch=8, least=3).select("key", "start", "ok", "n", "absolute", "relative", "spectrum", "error").collect()
    assert {r.key for r in got if r.error} == {"bad", "none"} and len(got) == 5
    for r in (r for r in got if r.key == "good"):
        w = x[(t >= r.start) & (t < r.start + 30)]
        assert (r.ok, r.n) == (len(w) >= 3, len(w))
        if not r.ok:
            assert r.absolute is None and r.spectrum is None
            continue
        rolled = w[:, [(k + 5) % 12 for k in range(12)]]
        for values, frames in ((r.absolute, w), (r.relative, rolled)):
            assert np.allclose(values[:12], frames.mean(0))
            assert np.allclose(values[12:90], [np.mean(frames[:, i] * frames[:, j]) for i in range(12) for j in range(i, 12)])
        assert len(r.relative) == 91 and r.relative[90] == 1.0
        y = w if len(w) >= 8 else np.concatenate([w] * 8)[:8]
        want = np.median([np.abs(np.fft.fft2(y[i : i + 8].T)) for i in range(len(y) - 7)], axis=0)[:, :5]
        assert np.allclose(r.spectrum, want.ravel())


def test_moments_of_pitch_classes(spark):
    x = np.random.default_rng(2).random((50, 12))
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "k int, pc array<double>")
    for r in descriptors.pitch_class_moments(df, "k", "pc").collect():
        assert np.allclose(r.moments, descriptors.window_moments(x[r.k :: 2]))


def test_catalogue_rows(spark, tmp_path):
    lines = ['10,1,"A, b","C ""d"" e",vid1', "11,1,T,A,vid2", "12,1,T,A", "x,1,T,A,vid3", '13,2,T,A,""', " 14 , 2 , T , A , vid4 "]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    rows = catalogue.read_catalogue(spark, str(tmp_path / "c.csv")).collect()
    ok = [(r.work_id, r.version_id, r.title, r.artist, r.video_id) for r in rows if r.ok]
    assert ok == [(1, 10, "A, b", 'C "d" e', "vid1"), (1, 11, "T", "A", "vid2"), (2, 14, "T", "A", "vid4")] and len(rows) == 6


def test_scores_refuse_another_identity(spark):
    path = new_folder(spark, "scores")
    df = spark.createDataFrame([("a", 1)], "source string, song int")
    stores.resume_scores(spark, path, df, ["source", "song"], "one")
    with pytest.raises(ValueError):
        stores.resume_scores(spark, path, df, ["source", "song"], "two")


def test_messages_go_to_the_first_list(spark):
    rows = [("Sign in to confirm you're not a bot", [], "throttled"), ("Please sign in", [], "blocked"), ("Please sign in", ["HTTP Error 429"], "throttled"), ("odd", [], "failed"), ("Private video. Sign in", [], "gone")]
    df = spark.createDataFrame(rows, "e string, w array<string>, want string")
    assert df.select((T.outcome_of(F.col("e"), F.array_join("w", " ")) == F.col("want")).alias("ok")).filter("NOT ok").isEmpty()


def test_keys_rolls_and_patches(spark):
    rows = [(list(np.roll(descriptors.MAJOR, 4)), 4, False), (list(np.roll(descriptors.MINOR, 9)), 9, True), ([1.0] * 12, 0, False)]
    df = spark.createDataFrame([(list(map(float, v)), t, m) for v, t, m in rows], "v array<double>, t int, m boolean")
    assert df.select(((descriptors.key_of(F.col("v"))["tonic"] == F.col("t")) & (descriptors.key_of(F.col("v"))["minor"] == F.col("m"))).alias("ok")).filter("NOT ok").isEmpty()
    r = df.select(A.roll(F.col("v"), F.lit(3)).alias("r")).first().r
    assert np.allclose(r, np.roll(rows[0][0], 3))
    x = np.random.default_rng(0).random((20, 12))
    want = np.median([np.abs(np.fft.fft2(x[i : i + 16].T)) for i in range(5)], axis=0)
    assert np.allclose(descriptors.patch_magnitudes(x), want) and descriptors.patch_magnitudes(x[:3]).shape == (12, 16)


def test_density_is_a_density(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    g = spark.range(1600).select(F.col("id"), (F.col("id") % 40 * 0.25 - 5).alias("x"), (F.expr("id div 40") * 0.25 - 5).alias("y"))
    assert density.density_at(g, df, "id").agg(F.sum("density") * 0.0625).first()[0] == pytest.approx(1, abs=0.02)


def test_scale_check_against_numpy(spark):
    rng = np.random.default_rng(6)
    tau = rng.lognormal(0, 0.3, 500)
    v = np.array([1.0, 0.5, 2.0, 0.7, 0.2, 1.5])
    w = (v * rng.normal(size=(500, 6)) ** 2) * tau[:, None]
    b = w.reshape(500, 3, 2).sum(2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in b], "x double, y double, z double")
    got = gaussians.scale_check(df, ["x", "y", "z"], [float((v[2 * i : 2 * i + 2] ** 2).sum()) for i in range(3)], float(v.sum())).orderBy("band").collect()
    norm = np.cov(b.T) / np.outer(b.mean(0), b.mean(0))
    off = ~np.eye(3, dtype=bool)
    assert got[0].c2_off == pytest.approx(norm[off].mean()) and got[1].coupling == pytest.approx(norm[1][off[1]].mean())
    logs = np.log(b)
    assert got[2].cancelled == pytest.approx(1 - (logs - logs.mean(1, keepdims=True)).var(0)[2] / logs.var(0)[2])
    total = b.sum(1)
    assert got[0].c2_total == pytest.approx((total.var(ddof=1) - 2 * (v**2).sum()) / (v.sum() ** 2 + 2 * (v**2).sum()))
    c2, q = norm[off].mean(), (v**2).reshape(3, 2).sum(1)
    model = c2 * b.mean(0) ** 2 + (1 + c2) * 2 * q
    corr = np.corrcoef(b.T)
    assert got[0].c2_low == pytest.approx(norm[off].min()) and got[0].c2_high == pytest.approx(norm[off].max()) and got[0].corr_high == pytest.approx(corr[off].max())
    assert got[1].corr_model_off == pytest.approx((c2 * np.outer(b.mean(0), b.mean(0)) / np.sqrt(np.outer(model, model)))[off].mean())
    assert got[1].excess == pytest.approx((b.var(0, ddof=1)[1] - model[1]) / b.mean(0)[1] ** 2) and sum(r.share for r in got) == pytest.approx(1)
    at = {r.p: r for r in gaussians.scale_quantiles(df, ["x", "y", "z"], list(map(float, q)), float(v.sum())).collect()}
    assert len(at) == 7 and at[0.95].observed == pytest.approx(np.quantile(total / total.mean(), 0.95)) and at[0.5].no_factor == pytest.approx(1) and at[0.5].lognormal == pytest.approx(math.exp(-np.log(total).var() / 2))


def test_five_scores_agree_with_their_parts(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(300, 2))
    z = c @ rng.normal(size=(2, 3)) + rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, list(map(float, z[i])), list(map(float, c[i]))) for i in range(300)], "id long, z array<double>, c array<double>")
    got = {r.id: r for r in gaussians.five_scores(df, df, ["id"], "z", "c", 3, shrink=1e-6).collect()}
    model = gaussians.fit_conditional(df, "z", "c", 3, 1e-6)
    cond, none = model.log_densities(z, c)
    assert np.allclose([got[i].mean for i in range(300)], cond) and np.allclose([got[i].pmi for i in range(300)], cond - none)
    assert all(got[i].joint == pytest.approx(got[i].mean + got[i].content) for i in range(300))
    d = z - z.mean(0)
    q = np.einsum("ij,jk,ik->i", d, np.linalg.inv(model.prior), d)
    x = c - c.mean(0)
    y = np.log(q / q.mean())
    b = np.linalg.solve(x.T @ x / 300 + 1e-6 * np.eye(2), x.T @ (y - y.mean()) / 300)
    h = x @ b + y.mean()
    assert np.allclose([got[i].scale for i in range(300)], none - 0.5 * q * (np.exp(-h) - 1) - 1.5 * h)


def test_hsic_and_contrastive_by_numpy(spark):
    from cohortia.operators import spectra

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(30, 2))
    df = spark.createDataFrame([(i, list(map(float, a[i])), list(map(float, b[i]))) for i in range(30)], "id long, a array<double>, b array<double>")

    def kernel(x):
        d = np.square(x[:, None] - x[None]).sum(2)
        return np.exp(-d / (2 * np.median(d[~np.eye(len(x), dtype=bool)])))

    h = np.eye(30) - 1 / 30
    assert spectra.hsic(df, df, (3, 2)).first()[0] == pytest.approx(np.trace(kernel(a) @ h @ kernel(b) @ h) / 29**2)
    anchors = df.select("id", F.col("id").alias("pair"), (F.col("id") % 3).alias("grp"), F.col("a").alias("v"))
    others = df.select((F.col("id") + 1000).alias("id"), F.col("id").alias("pair"), (F.col("id") % 3).alias("grp"), F.reverse("a").alias("v"))
    got = {r.id: r.loss for r in spectra.contrastive(anchors, others, 3, 0.1).collect()}
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u(a) @ u(a[:, ::-1]).T / 0.1
    for i in range(30):
        kept = [j for j in range(30) if j == i or j % 3 != i % 3]
        assert got[i] == pytest.approx(np.log(np.exp(s[i, kept]).sum()) - s[i, i])
