"""Fits and reports that have no SQL, against numpy; listings that are kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import arrays
from cohortia.operators import gaussians, runs
from cohortia.plans.registry import QUERIES
from cohortia.sources import stores

SF = "/root/testdata/sf0.001"


def test_trimmed_refit_drops_rows_and_scores_all(spark):
    """M13: the refit's scores of all rows are those of a fit on the rows under the threshold, and no other."""
    from cohortia.plans.joins import emb

    got = {r.id: r for r in QUERIES["M13_trimmed_refit"](spark, SF).collect()}
    e = emb(spark, SF)
    first = gaussians.with_tau2(gaussians.score_shrunk(e, ["id"], "v", gaussians.fit_shrunk(e, "v"))).toPandas().set_index("id").tau2
    rows = e.toPandas().set_index("id")
    kept = first.index[first <= np.quantile(first, 0.9)]
    assert 0 < len(kept) < len(rows) and len(got) == len(rows)
    x = np.array(rows.loc[kept, "v"].tolist())
    again = gaussians.score_shrunk(e, ["id", "grp"], "v", gaussians.fit_shrunk(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v"))
    names = [c for c in again.columns if c not in ("id", "grp")]
    for r in again.collect():
        assert [got[r.id][c] for c in names] == pytest.approx([r[c] for c in names], rel=1e-6)


def test_preservation_of_variants(spark):
    """M26: a clean copy keeps all; rolling pitch classes costs nothing, but is found; silence adds nothing."""
    got = {r.variant: r for r in QUERIES["M26_preservation"](spark, SF).collect()}
    assert got["clean"].kept == pytest.approx(1.0) and got["clean"].transposed == 0
    assert got["rolled"].kept == pytest.approx(1.0) and got["rolled"].transposed > 0
    assert 0 < got["silent"].kept <= 1.0 + 1e-9


def test_listing_is_kept_while_it_covers(spark, tmp_path):
    made = []

    def make(groups):
        made.append(sorted(groups))
        return spark.createDataFrame([(g, f"{g}{k}") for g in groups if g != "none" for k in range(2)], "group string, path string")

    path = str(tmp_path / "l")
    ask = lambda *groups: sorted(r.path for r in stores.listing_of(spark, path, list(groups), make).collect())
    assert ask("a", "b", "none") == ["a0", "a1", "b0", "b1"] and ask("a") == ["a0", "a1"] and ask("none") == [] and len(made) == 1
    assert ask("a", "c") == ["a0", "a1", "c0", "c1"] and len(made) == 2 and ask("c", "a") == ["a0", "a1", "c0", "c1"] and len(made) == 2
    for f in (tmp_path / "l" / "rows" / "versions").glob("*/*.parquet"):
        f.write_bytes(b"cut")
    assert ask("a") == ["a0", "a1"] and len(made) == 3


def test_probe_report_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(p, s, u, float(np.round(rng.normal(m, 1), 2))) for p, m in ((1, 0.0), (2, 1.0)) for s in ("ref", "a") for u in range(40)]
    df = spark.createDataFrame(rows, "p int, s string, u int, x double")
    got = {(r.p, r.s): r for r in runs.probe_report(df, "p", "s", "x", "ref", "u", 0.1, 30, "t").collect()}
    assert set(got) == {(1, "a"), (2, "a")}
    for (p, s), r in got.items():
        ref, own = (np.array([x for q, t, _, x in rows if (q, t) == (p, name)]) for name in ("ref", s))
        assert r.auroc == pytest.approx((ref[:, None] > own).mean() + 0.5 * (ref[:, None] == own).mean())
        assert r.threshold == pytest.approx(np.quantile(ref, 0.1)) and r.tpr == pytest.approx((own < r.threshold).mean())
        assert r.low <= r.auroc <= r.high


def test_runs_are_compared_on_the_same_draws(spark):
    """A run that is better by the same in every cluster gains exactly that; a run without test has its trajectory only."""
    test = spark.createDataFrame([(r, c, float(c % 5) + (0.25 if r == "new" else 0.0)) for r in ("old", "new") for c in range(30)], "run string, c int, x double")
    steps = spark.createDataFrame([("old", 1, 0.5), ("old", 2, 0.9), ("old", 3, 0.9), ("idle", 1, None), ("idle", 2, 0.1)], "run string, step long, m double")
    got = {r.run: r for r in runs.compare_runs(steps, test, "run", "step", "m", "c", "x", "old", 25, "t").collect()}
    assert set(got) == {"old", "new", "idle"}
    assert (got["old"].best_step, got["old"].best, got["old"].final_step, got["old"].points) == (2, 0.9, 3, 3) and got["old"].gain is None
    assert got["new"].gain == pytest.approx(0.25) and (got["new"].gain_low, got["new"].gain_high) == pytest.approx((0.25, 0.25)) and got["new"].verdict == "real gain"
    assert got["new"].best_step is None and got["idle"].test is None and got["idle"].points == 1


def test_jittered_centres_stay_near(spark):
    got = spark.range(50).select(arrays.jittered(F.col("id").cast("double"), 4, 2.0, F.lit("s"), F.col("id")).alias("c"), arrays.jittered(F.lit(1.0), 1, 2.0, F.lit("s")).alias("one")).collect()
    assert all(len(r.c) == 4 and r.c[0] == i and all(abs(x - i) <= 2 for x in r.c) and len(set(r.c)) == 4 and r.one == [1.0] for i, r in enumerate(got))
