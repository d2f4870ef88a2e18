"""One group that holds nearly all rows: its places, pairs and samples are made in many tasks."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import align, moments, pairs, probe, ranks, sampling, spectra


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows, all but a few of group `big`; the null group is one, too."""
    g = F.when(F.col("id") % 100 == 3, "small").when(F.col("id") % 100 == 4, F.lit(None)).otherwise("big")
    return spark.range(2000).select(g.alias("g"), F.col("id").alias("k"), F.pmod(F.col("id") * 7919, F.lit(2003)).alias("o")).repartition(7)


def test_places_of_a_hot_group_lie_in_many_tasks(spark, hot):
    # As with a large table: ranges are not merged, and each of their files is a task.
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = ranks.places(hot, ["g"], ["o"], "i", "n")
        rows = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("big", "small", None):
        part = sorted((r for r in rows if r.g == g), key=lambda r: r.o)
        assert [r.i for r in part] == list(range(len(part))) and {r.n for r in part} == {len(part)}
    assert len({r.task for r in rows if r.g == "big"}) > 1
    assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranks.places(hot.limit(0), ["g"], ["o"], "i").count() == 0


def test_pairs_of_a_hot_group_in_blocks(spark, hot):
    items = hot.filter("k < 120")
    got = pairs.clique_pairs(items, "g", "k", block=16)
    want = Counter()
    for g in ("big", "small"):
        keys = sorted(r.k for r in items.collect() if r.g == g)
        want.update((g, a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
    assert Counter(map(tuple, got.collect())) == want


def test_capped_interleaved_and_held_out(spark, hot):
    got = sampling.capped(hot, "g", "k", F.col("k") < 30, 40, "s").collect()
    by = Counter(r.g for r in got)
    assert by == {"big": 40, "small": 20, None: 20} and {r.k for r in got} >= set(range(30)) and len({r.k for r in got}) == len(got)
    over = sampling.capped(hot, "g", "k", F.col("k") < 300, 40, "s").filter("g = 'big'").count()
    assert over == sum(1 for k in range(300) if k % 100 not in (3, 4))
    turns = sorted((r.turn, r.g or "", r.k) for r in sampling.interleaved(hot, "g", "o").collect())
    assert [t for t, _, _ in turns] == list(range(1, 2001)) and {g for _, g, _ in turns[:6]} == {"", "big", "small"}
    held = sampling.held_out_groups(hot, "g", "k", 0.25, "s").collect()
    assert Counter((r.g, r.val) for r in held) == {("big", True): 490, ("big", False): 1470, ("small", True): 5, ("small", False): 15, (None, True): 5, (None, False): 15}


def test_alignment_control_of_one_large_work(spark):
    rng = np.random.default_rng(1)
    rows = [("w" if i < 90 else f"v{i}", i, (v := rng.normal(0, 1, 4)).tolist(), (v + rng.normal(0, 0.1, 4)).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "w string, o int, a array<double>, b array<double>")
    r = align.alignment_control(df, "w", "o", "a", "b").first()
    u = lambda x: np.array(x) / np.linalg.norm(x)
    assert r.n == 100 and r.ok and r.aligned == pytest.approx(np.mean([u(a) @ u(b) for _, _, a, b in rows]))
    assert r.shifted == pytest.approx(np.mean([u(rows[i][2]) @ u(rows[(i + 1) % 90][3]) for i in range(90)]))


def test_covariance_blocks_of_many_dimensions(spark):
    """Stripes of a few rows, a last block that is shorter, null vectors; no task holds the matrix."""
    rng = np.random.default_rng(3)
    x = rng.normal(5, 1, (40, 150)) @ np.diag(np.linspace(0.1, 3, 150))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(3)
    for stripe in (64 << 20, 150 * 8 * 40):
        got = np.zeros((150, 150))
        for r in moments.covariance_blocks(df, "v", stripe_bytes=stripe).collect():
            got[r.i, r.b * 64 : r.b * 64 + len(r["values"])] = r["values"]
        assert np.allclose(got, np.cov(x.T))
    weights = [0.5, 0.2, 0.3]
    mixed = np.einsum("l,nld->nd", weights, x.reshape(40, 3, 50))
    cov = {(r.i, r.j): r["cov"] for r in moments.mixed_covariance(moments.covariance_blocks(df, "v"), weights, 50).collect()}
    assert len(cov) == 2500 and np.allclose([[cov[i, j] for j in range(50)] for i in range(50)], np.cov(mixed.T))
    assert moments.covariance_blocks(df.limit(0), "v").count() == 0
    a, b = x[:, :3], x[:, 3:8]
    c = np.corrcoef(np.concatenate([a, b], 1).T)[:3, 3:]
    halves = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in zip(a, b)], "a array<double>, b array<double>")
    assert spectra.cross_correlation(halves, "a", "b", 3).first().stat == pytest.approx(np.square(c).mean())


def _train(x, y, layers, epochs, lr, mix_lr, decay):
    """The same training on one matrix."""
    n, dims = len(x), x.shape[1] // layers
    mean, sd = x.mean(0).reshape(layers, dims), x.std(0, ddof=1).reshape(layers, dims)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    mix, head, bias = np.zeros(layers), np.zeros(dims), 0.0
    m = v = np.zeros(layers + dims + 1)
    path = [(mix, head, bias)]
    z = (x.reshape(n, layers, dims) - mean) / sd
    for t in range(1, epochs + 1):
        w = np.exp(mix) / np.exp(mix).sum()
        p = 1 / (1 + np.exp(-(np.einsum("nld,l,d->n", z, w, head) + bias)))
        off = weight * (p - y)
        gw = np.einsum("n,nld,d->l", off, z, head)
        g = np.concatenate([w * (gw - w @ gw), np.einsum("n,nld,l->d", off, z, w), [off.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        mix, head, bias = mix - mix_lr * step[:layers], head * (1 - lr * decay) - lr * step[layers:-1], bias - lr * step[-1]
        path.append((mix, head, bias))
    return path, mean, sd


def test_probe_trains_as_on_one_matrix(spark):
    rng = np.random.default_rng(7)
    y = (np.arange(240) % 3 == 0).astype(int)
    x = rng.normal(0, 1, (240, 12))
    x[:, 4:8] += 1.2 * y[:, None]  # the second of three layers tells the classes apart
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)] + [(None, x[0].tolist()), (1, None)], "y int, v array<double>")
    train, val = df.limit(160), spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x[160:], y[160:])], df.schema)
    train = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x[:160], y[:160])] + [(None, x[0].tolist()), (1, None)], df.schema).repartition(3)
    history, best = probe.train(train, val, "v", "y", 3, epochs=6)
    rows = sorted(history.collect(), key=lambda r: r.epoch)
    path, mean, sd = _train(x[:160], y[:160], 3, 6, 0.1, 0.1, 1e-3)
    assert len(rows) == 7 and sum(r.best for r in rows) == 1
    for r, (mix, head, bias) in zip(rows, path):
        assert r.weights == pytest.approx(list(np.exp(mix) / np.exp(mix).sum()), abs=1e-9)
        logit = np.einsum("nld,l,d->n", (x.reshape(240, 3, 4) - mean) / sd, r.weights, head) + bias
        for side, at in (("train", slice(0, 160)), ("val", slice(160, 240))):
            one, zero = logit[at][y[at] == 1], logit[at][y[at] == 0]
            assert r[f"{side}_auroc"] == pytest.approx((one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean())
            assert r[f"{side}_bce"] == pytest.approx((np.log1p(np.exp(-one)).mean() + np.log1p(np.exp(zero)).mean()) / 2)
    assert rows[-1].weights[1] == max(rows[-1].weights) and rows[-1].val_auroc > 0.9
    top = max(rows, key=lambda r: (r.val_auroc, -r.epoch))
    assert top.best and np.allclose(best.head, path[top.epoch][1])
    with pytest.raises(ValueError, match="both classes"):
        probe.train(train.filter("y = 1"), val, "v", "y", 3)


def test_probe_gradient_by_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (9, 6)), np.array([0, 1, 1, 0, 1, 0, 0, 1, 1])
    w = rng.random(9)
    p = probe.Probe(rng.normal(0, 1, (2, 3)), rng.random((2, 3)) + 0.5, rng.normal(0, 1, 2), rng.normal(0, 1, 3), 0.3)
    flat = np.concatenate([p.mix, p.head, [p.bias]])
    at = lambda v: float(w @ probe.losses(probe.Probe(p.mean, p.sd, v[:2], v[2:5], float(v[5])).logits(x), y))
    want = [(at(flat + d) - at(flat - d)) / 2e-6 for d in np.eye(6) * 1e-6]
    assert np.allclose(probe.gradient_sums(p, x, y, w)[1:], want, atol=1e-6)
