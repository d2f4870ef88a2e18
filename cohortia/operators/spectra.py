"""Statistics of vectors, weights and spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.arrays import dot, doubles, entropy, total
from cohortia.operators.metrics import quantiles
from cohortia.operators.moments import BLOCK, covariance_blocks, per_dimension
from cohortia.operators.retrieval import by_blocks, matrix
from cohortia.sources.scratch import stash


def between_share(vectors: DataFrame, vector: str, group: str) -> DataFrame:
    """(share): the part of all dimensions' sum of squares that lies between groups."""
    all_ = per_dimension(vectors, vector).select("pos", F.col("mean").alias("_m"), (F.col("var") * (F.col("n") - 1)).alias("_ss"))
    by = per_dimension(vectors, vector, group).join(all_, "pos")
    between = by.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_m"), 2)).alias("_b"))
    return between.crossJoin(all_.agg(F.sum("_ss").alias("_t"))).select((F.col("_b") / F.col("_t")).alias("share"))


def weight_stats(w: Column) -> list[Column]:
    """entropy, kl to uniform, ratio of the largest to the least, top (place of the largest), top3 (sum)."""
    h = entropy(w)
    return [
        h.alias("entropy"),
        (F.ln(F.size(w).cast("double")) - h).alias("kl"),
        (F.array_max(w) / F.array_min(w)).alias("ratio"),
        (F.array_position(w, F.array_max(w)) - 1).cast("int").alias("top"),
        total(F.slice(F.sort_array(w, asc=False), 1, 3)).alias("top3"),
    ]


def spectrum_stats(values: DataFrame, lam: str, tie: str) -> DataFrame:
    """(effective_rank, participation, condition, top5, half): of eigenvalues or variances, largest first."""
    w = W.orderBy(F.desc("s"), tie)
    s = values.select(tie, (F.col(lam) / F.sum(lam).over(W.partitionBy())).alias("s"))
    s = s.withColumn("r", F.row_number().over(w)).withColumn("c", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.agg(
        F.exp(-F.sum(F.when(F.col("s") > 0, F.col("s") * F.ln("s")).otherwise(0.0))).alias("effective_rank"),
        (1 / F.sum(F.col("s") * F.col("s"))).alias("participation"),
        (F.max("s") / F.min("s")).alias("condition"),
        F.sum(F.when(F.col("r") <= 5, F.col("s"))).alias("top5"),
        F.min(F.when(F.col("c") >= 0.5, F.col("r"))).alias("half"),
    )


def cross_correlation(pairs: DataFrame, a: str, b: str, dims: int) -> DataFrame:
    """(stat): mean squared entry of the correlation matrix between two vectors, the first of `dims`; dimensions without variance give none."""
    blocks = covariance_blocks(pairs, F.concat(doubles(F.col(a)), doubles(F.col(b))))
    entries = blocks.select("i", "b", F.posexplode("values").alias("k", "c")).select("i", (F.col("b") * BLOCK + F.col("k")).alias("j"), "c")
    entries = stash(entries.filter((F.col("i") == F.col("j")) | ((F.col("i") < dims) & (F.col("j") >= dims))), "cross-covariance")
    own = entries.filter("i = j AND c > 0")
    met = entries.filter("i <> j").join(own.select("i", F.col("c").alias("vi")), "i").join(own.select("j", F.col("c").alias("vj")), "j")
    return met.agg(F.avg(F.col("c") * F.col("c") / (F.col("vi") * F.col("vj"))).alias("stat"))


def _squares(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a vector, each from its own row alone, so that they are the same in every block."""
    return np.square(x - v).sum(1)


def _lots(q: pa.Table, c: pa.Table, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors) of some queries beside those of all candidates, both by id, so that every pass makes the same numbers."""
    (i, v), (ids, x) = ((t["id"].to_numpy(), matrix(t["v"])) for t in (q.sort_by("id"), c.sort_by("id")))
    step = max(1, cells // len(ids))
    for n in range(0, len(i), step):
        yield i[n : n + step], v[n : n + step], ids, x


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b by one product; near pairs, which that would blur, by their differences."""
    size = np.square(a).sum(1)[:, None] + np.square(b).sum(1)
    far = size - 2 * (a @ b.T)
    i, j = np.nonzero(far < 1e-7 * size)
    for n in range(0, len(i), 1 << 16):
        part = slice(n, n + (1 << 16))
        far[i[part], j[part]] = np.square(a[i[part]] - b[j[part]]).sum(1)
    return far


def _pair_medians(sides: tuple[DataFrame, DataFrame], dims: list[int], block_bytes: int, bins: int = 4096, few: int = 1 << 16) -> list[float]:
    """The median squared distance, over pairs of different ids, of each of the vectors that v joins.

    Pairs are counted in bins, block by block; the bins that hold the median are counted in finer ones, until they
    hold so few pairs that their distances are gathered. Only bins and these distances leave a block.
    """
    ends = np.cumsum(dims)

    def distances(q: pa.Table, c: pa.Table, k: int) -> Iterator[np.ndarray]:
        part = slice(ends[k] - dims[k], ends[k])
        for i, v, ids, x in _lots(q, c):
            yield _square_distances(v[:, part], x[:, part])[i[:, None] != ids]

    def binned(lo: float, hi: float, k: int):
        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            counts, edges = np.zeros(bins + 2, np.int64), np.linspace(lo, hi, bins + 1)
            if len(q) and len(c):
                for far in distances(q, c, k):
                    # Bin 0 is below lo, the last from hi on.
                    below, beyond = far < lo, far >= hi
                    counts[0] += below.sum()
                    counts[-1] += beyond.sum()
                    far = far[~(below | beyond)]
                    if hi - lo > 8 * bins * np.spacing(hi):
                        at = np.minimum(((far - lo) / (hi - lo) * bins).astype(np.int64), bins - 1)
                        # Rounding may be a bin off.
                        at += (far >= edges[at + 1]).astype(np.int64) - (far < edges[at])
                    else:
                        at = np.searchsorted(edges, far, side="right") - 1
                    counts += np.bincount(at + 1, minlength=bins + 2)
            at = np.flatnonzero(counts)
            return pa.table([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bin", "n"])

        return run

    def within(lo: float, hi: float, k: int):
        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            parts = [far[(far >= lo) & (far < hi)] for far in distances(q, c, k)] if len(q) and len(c) else []
            return pa.table([pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())], names=["far"])

        return run

    def top(q: pa.Table, c: pa.Table) -> pa.Table:
        most = [max((far.max(initial=0.0) for far in distances(q, c, k)), default=0.0) if len(q) and len(c) else 0.0 for k in range(len(dims))]
        return pa.table([pa.array([m], pa.float64()) for m in most], names=[f"m{k}" for k in range(len(dims))])

    every = sum(dims)
    tops = by_blocks(*sides, every, block_bytes, top, ", ".join(f"m{k} double" for k in range(len(dims)))).agg(*[F.max(f"m{k}") for k in range(len(dims))]).first()
    out = []
    for k in range(len(dims)):
        lo, hi = 0.0, float(np.nextafter(tops[k] or 0.0, np.inf))
        while True:
            found = by_blocks(*sides, every, block_bytes, binned(lo, hi, k), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
            number, upto = np.array([r.bin for r in found]), np.cumsum([r.n for r in found])
            if not len(upto):
                return [0.0] * len(dims)
            places = (int(upto[-1] - 1) // 2, int(upto[-1]) // 2)
            low, high = (int(number[np.searchsorted(upto, p, side="right")]) for p in places)
            edges = np.linspace(lo, hi, bins + 1)
            start, stop = float(edges[low - 1]), float(edges[high])
            held = int(upto[np.flatnonzero(number == high)[0]] - (upto[np.flatnonzero(number == low)[0] - 1] if number[0] != low else 0))
            if held <= few or start <= lo and stop >= hi or stop <= np.nextafter(start, np.inf):
                break
            lo, hi = start, stop
        before = int(upto[np.flatnonzero(number == low)[0] - 1]) if number[0] != low else 0
        if held <= few:
            values = np.sort([r.far for r in by_blocks(*sides, every, block_bytes, within(start, stop, k), "far double").collect()])
            out.append(float(np.mean([values[min(p - before, len(values) - 1)] for p in places])))
        else:
            out.append(start)  # one distance fills the bin
    return out


def hsic(queries: DataFrame, rows: DataFrame, dims: tuple[int, int], block_bytes: int = 4 << 20) -> DataFrame:
    """(hsic): dependence of two vectors by RBF kernels, twice whose squared width is twice the median squared distance.

    Both tables have id, a and b, and `dims` their lengths; every query meets every row, the queries being all rows
    or a stated set of them. One kernel is centred by its row, column and grand means. Blocks hand on sums for
    each row and column only; the centred product comes of these sums.
    """
    both = lambda df: df.select("id", F.lit("").alias("grp"), F.concat(doubles(F.col("a")), doubles(F.col("b"))).alias("v"))
    sides = (stash(both(queries), "hsic-queries"), stash(both(rows), "hsic-rows"))
    ma, mb = _pair_medians(sides, list(dims), block_bytes)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(q) and len(c):
            kernel = lambda far, m: np.exp(far / (-2 * m)) if m > 0 else np.ones(far.shape)
            a, b, product = np.zeros(len(c)), np.zeros(len(c)), 0.0
            for queried, v, ids, x in _lots(q, c):
                ka = kernel(_square_distances(v[:, : dims[0]], x[:, : dims[0]]), ma)
                kb = kernel(_square_distances(v[:, dims[0] :], x[:, dims[0] :]), mb)
                a, b, product = a + ka.sum(0), b + kb.sum(0), product + float(np.vdot(ka, kb))
                out += [("q", i, s, t, 0.0) for i, s, t in zip(queried, ka.sum(1), kb.sum(1))]
            out += [("c", i, s, t, 0.0) for i, s, t in zip(ids, a, b)]
            out.append(("all", 0, a.sum(), b.sum(), product))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["side", "id", "ka", "kb", "product"])

    sums = by_blocks(*sides, sum(dims), block_bytes, run, "side string, id long, ka double, kb double, product double")
    sums = sums.groupBy("side", "id").agg(F.sum("ka").alias("ka"), F.sum("kb").alias("kb"), F.sum("product").alias("product"))
    s = sums.groupBy("side").agg(F.count("*").alias("n"), F.sum(F.col("ka") * F.col("kb")).alias("cross"), F.sum("ka").alias("ka"), F.sum("kb").alias("kb"), F.sum("product").alias("product"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    m, n = of("q", "n"), of("c", "n")
    value = of("all", "product") - of("q", "cross") / n - of("c", "cross") / m + of("all", "ka") * of("all", "kb") / (m * n)
    return s.agg(F.when((m > 1) & (n > 1), value / ((m - 1) * (n - 1))).alias("hsic"))


def contrastive(anchors: DataFrame, candidates: DataFrame, dims: int, temperature: float, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, loss): log-sum-exp over an anchor's candidates less that over its positives; null without positives.

    Both have id, pair, grp and v. An anchor is no candidate of its own; candidates of its pair are its positives;
    others of its group are the same work and are left out; all else is negative. Cosines are shifted by their
    largest possible value before exponents. Blocks hand on two sums for each anchor.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if len(q) and len(c):
            of = [t.split("|", 1) for t in c["grp"].to_pylist()]
            pairs, groups, ids, x = np.array([p for p, _ in of]), np.array([g for _, g in of]), c["id"].to_numpy(), matrix(c["v"])
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for i, key, v in zip(q["id"].to_numpy(), q["grp"].to_pylist(), matrix(q["v"])):
                pair, group = key.split("|", 1)
                own = (pairs == pair) & (ids != i)
                e = np.exp((x @ (v / max(np.linalg.norm(v), 1e-12)) - 1) / temperature)
                out.append((i, float(e[own | ((groups != group) & (ids != i))].sum()), float(e[own].sum())))
        kinds = (pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["id", "every", "own"])

    keyed = lambda df: df.select("id", F.concat(F.coalesce(F.col("pair").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("grp").cast("string"), F.lit(""))).alias("grp"), "v")
    sums = by_blocks(keyed(anchors), keyed(candidates), dims, block_bytes, run, "id long, every double, own double")
    return sums.groupBy("id").agg(F.when(F.sum("own") > 0, F.ln(F.sum("every")) - F.ln(F.sum("own"))).alias("loss"))


def trivial_errors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(global_mse, window_mse, between): standardised squares about the global and each row's own mean."""
    m = per_dimension(vectors, vector).select("pos", "mean", "sd")
    z = vectors.select(key, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).join(F.broadcast(m), "pos").select(key, ((F.col("x") - F.col("mean")) / F.col("sd")).alias("z"))
    each = z.groupBy(key).agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    g, w = F.sum("q") / F.sum("n"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")
    return each.agg(g.alias("global_mse"), w.alias("window_mse"), (1 - w / g).alias("between"))


def agreement(pairs: DataFrame, key: str, a: str, b: str, same: float = 0.999) -> DataFrame:
    """(median, p05, same): correlation of two vectors of each row, and the share above `same`."""
    n = F.size(a).cast("double")
    cov = lambda x, y: dot(F.col(x), F.col(y)) / n - total(F.col(x)) / n * (total(F.col(y)) / n)
    r = stash(pairs.select((cov(a, b) / F.sqrt(cov(a, a) * cov(b, b))).alias("r")), "agreement")
    return quantiles(r, "r", {"median": 0.5, "p05": 0.05}).crossJoin(F.broadcast(r.agg(F.avg((F.col("r") > same).cast("int")).alias("same"))))  # one row each

