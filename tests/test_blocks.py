"""What is compared block by block, or laid on a grid, against the direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import density, retrieval, spectra


@pytest.fixture(scope="module")
def vectors(spark):
    """300 vectors of 6: groups of very different size, a null group, repeated vectors that tie."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 6))
    x[200:260] = x[100:160]
    groups = ["big" if i % 3 == 0 else None if i % 50 == 7 else f"g{i % 9}" for i in range(300)]
    return spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(zip(groups, x))], "id long, grp string, v array<double>"), x, groups


def test_retrieval_metrics_by_counting_ranks(spark, vectors):
    df, x, groups = vectors
    for block in (1000, 1 << 20):
        got = {r.q: r for r in retrieval.retrieval_metrics(df.filter("id % 5 < 2"), df, 6, block).collect()}
        assert len(got) == 120
        for q, r in got.items():
            sims = retrieval._cosines(x, x[q])
            order = sorted((i for i in range(300) if i != q), key=lambda i: (-sims[i], i))
            rel = [groups[q] is not None and groups[i] == groups[q] for i in order]
            hits = np.cumsum(rel)
            ap = float((hits / np.arange(1, 300))[rel].mean()) if any(rel) else 0.0
            assert (r.hit1, r.ap) == (float(rel[0]), pytest.approx(ap, abs=1e-9)), q
    plan = retrieval.retrieval_metrics(df.filter("id = 1"), df, 6)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan


def test_retrieval_metrics_in_chunks_and_tiles_without_rows_of_pairs(spark, vectors):
    df, _, _ = vectors
    found = lambda *a: sorted(map(tuple, retrieval.retrieval_metrics(df.filter("id % 5 < 2"), df, 6, *a).collect()))
    whole = found()
    # Groups of more rows than a task keeps are dealt in chunks; a pair or two for each task.
    for got in (found(40, 1), found(400, 1), found(1 << 20, 500)):
        assert [r[:2] for r in got] == [r[:2] for r in whole] and [r[2] for r in got] == pytest.approx([r[2] for r in whole], abs=1e-12)
    assert found()[0][0] == 0 and retrieval.retrieval_metrics(df.limit(0), df, 6).count() == 0
    # What is shuffled has vectors only: no lists of a query's relevant rows, as grew with the square of the table.
    plan = retrieval.retrieval_metrics(df.filter("id % 5 < 2"), df, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_ids" not in plan and "sims" not in plan


def test_ranks_above_with_ties():
    sims, ids = np.array([0.5, 0.9, 0.5, 0.1, 0.5]), np.array([1, 2, 3, 4, 5])
    above, rel = retrieval._ranked_above(sims, ids, np.array([True, False, True, True, False]), np.array([0.5, 0.1, 0.5]), np.array([3, 4, 6]))
    assert above.tolist() == [2, 4, 4] and rel.tolist() == [1, 2, 2]


def _hsic(x, y, dims, q):
    def kernel(a, b):
        far = np.square(a[:, None] - b[None]).sum(-1)
        return np.exp(-far / (2 * np.median(far[q[:, None] != np.arange(len(b))[None]])))

    ka, kb = kernel(x[q], x), kernel(y[q], y)
    c = ka - ka.mean(1, keepdims=True) - ka.mean(0) + ka.mean()
    return (c * kb).sum() / ((len(q) - 1) * (len(x) - 1))


def test_hsic_of_all_rows_and_of_stated_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (230, 5))
    y = np.round(x[:, :2] ** 2 + rng.normal(0, 0.3, (230, 2)), 1)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, a array<double>, b array<double>")
    calls, plain = [], spectra.by_blocks
    monkeypatch.setattr(spectra, "by_blocks", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert spectra.hsic(df, df, (5, 2)).first().hsic == pytest.approx(_hsic(x, y, (5, 2), np.arange(230)), rel=1e-9)
    some = spectra.hsic(df.filter("id % 10 = 0"), df, (5, 2), block_bytes=3000).first().hsic
    assert some == pytest.approx(_hsic(x, y, (5, 2), np.arange(0, 230, 10)), rel=1e-9)
    # Bins are refined more than once, and a distance that fills a bin ends it.
    medians = spectra._pair_medians
    monkeypatch.setattr(spectra, "_pair_medians", lambda sides, dims, block: medians(sides, dims, block, bins=4, few=40))
    calls.clear()
    assert spectra.hsic(df, df, (5, 2)).first().hsic == pytest.approx(_hsic(x, y, (5, 2), np.arange(230)), rel=1e-9)
    assert len(calls) > 8
    same = df.withColumn("a", F.array(*[F.lit(1.0)] * 5))
    assert spectra.hsic(same, same, (5, 2)).first().hsic == pytest.approx(0.0, abs=1e-9)
    assert spectra.hsic(df.limit(0), df, (5, 2)).first().hsic is None


def test_contrastive_against_all_rows(spark, vectors):
    df, x, groups = vectors
    rows = df.withColumn("pair", F.expr("id div 3"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.id: r.loss for r in spectra.contrastive(rows.filter("id % 11 = 0"), rows, 6, 0.2, block_bytes=2000).collect()}
    for i, loss in got.items():
        e = np.exp(u @ u[i] / 0.2)
        own = np.array([j // 3 == i // 3 and j != i for j in range(300)])
        other = np.array([(groups[j] or "") != (groups[i] or "") and j != i for j in range(300)])
        assert loss == pytest.approx(float(np.log(e[own | other].sum()) - np.log(e[own].sum())), abs=1e-9)
    alone = rows.withColumn("pair", F.col("id"))
    assert {r.loss for r in spectra.contrastive(alone.filter("id < 3"), alone, 6, 0.2).collect()} == {None}


def _direct(points, sample, h):
    d = (points[:, None] - sample[None]) / h
    return np.exp(-0.5 * np.square(d).sum(-1)).mean(1) / (2 * np.pi * h.prod())


def test_density_on_a_grid_keeps_its_error_bound(spark):
    rng = np.random.default_rng(4)
    sample = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(4, 0.2, (90, 2)), [[60.0, -40.0]]])
    points = np.concatenate([sample[::7], rng.uniform(-3, 5, (60, 2)), [[1e4, 0.0]]])
    df = lambda x: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {r.id: r.density for r in density.density_at(df(points), df(sample), "id").collect()}
    iqr = np.subtract(*np.percentile(sample, [75, 25], axis=0)) / 1.349
    h = np.minimum(sample.std(axis=0), iqr) * len(sample) ** (-1 / 6)
    want = _direct(points, sample, h)
    off = np.abs(np.array([got[i] for i in range(len(points))]) - want)
    # A lone point is off by 0.8 % of its own kernel's peak at most; the whole by far less than that of all.
    assert off.max() <= 0.008 * want.max() and got[len(points) - 1] == 0.0
    lone = [i for i, p in enumerate(points) if abs(p[0] - 60) < 1]
    assert all(off[i] <= 0.008 / (2 * np.pi * h.prod() * len(sample)) for i in lone)


def test_density_without_spread(spark):
    """Equal quartiles fall back to the deviation; no spread at all to a bandwidth of 1; nulls are left out."""
    rows = [(i, 5.0 if i < 60 else float(i), 2.0) for i in range(70)] + [(70, None, 2.0), (71, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.density for r in density.density_at(df, df, "id").collect()}
    x = np.array([r[1] for r in rows[:70]])
    h = np.array([x.std() * 70 ** (-1 / 6), 1.0])
    want = _direct(np.stack([x, np.full(70, 2.0)], 1), np.stack([x, np.full(70, 2.0)], 1), h)
    assert set(got) == set(range(70)) and [got[i] for i in range(70)] == pytest.approx(list(want), abs=0.008 * want.max())
    assert density.density_at(df, df.limit(0), "id").filter("density > 0").count() == 0


def test_frame_pins_what_lies_outside(spark):
    df = spark.range(1001).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = density.framed(df, df, share=0.8, pad=0.1).toPandas()
    assert got.x.min() == pytest.approx(20) and got.x.max() == pytest.approx(980) and got.outside.sum() in (39, 40)
