"""Nearest neighbours and retrieval metrics by exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.arrays import doubles
from cohortia.operators.ranks import beside
from cohortia.sources.scratch import stash


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def by_blocks(queries: DataFrame, candidates: DataFrame, dims: int, block_bytes: int, run, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """`run`, a function of two Arrow tables of id, grp and v, over every block of queries beside every block of candidates.

    Columns in `carry` come along with the queries.
    """
    blocks = lambda df: max(1, -(-df.count() * (8 * dims + 16) // block_bytes))
    n_q, n_c = blocks(queries), blocks(candidates)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(int(n))).cast("int")
    side = lambda df, *more: df.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), doubles(F.col("v")).alias("v"), *more)
    left = side(queries, *carry).withColumn("bq", own(n_q)).withColumn("bc", every(n_c)).groupBy("bq", "bc")
    right = side(candidates).withColumn("bc", own(n_c)).withColumn("bq", every(n_q)).groupBy("bq", "bc")
    return left.cogroup(right).applyInArrow(run, schema)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, dims: int, cosine: bool = False, own_group: bool = True, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, c_id, score, r): the k nearest candidates of each query, by Euclidean distance or falling cosine.

    Both have id, grp, v. A query's own id is no candidate, nor is its group unless `own_group`; ties go to
    the smaller id. Both sides are dealt in blocks of about `block_bytes`; each pair of blocks is compared
    at once in Arrow and hands on k rows for each query, so pairs never become rows.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            ids, groups, x = c["id"].to_numpy(), c["grp"].to_numpy(), matrix(c["v"])
            if cosine:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for i, g, v in zip(q["id"].to_numpy(), q["grp"].to_numpy(), matrix(q["v"])):
                far = -(x @ (v / max(np.linalg.norm(v), 1e-12))) if cosine else np.sqrt(np.square(x - v).sum(1))
                far = np.where((ids == i) | ((groups == g) & (not own_group)), np.inf, far)
                # All that tie with the k-th stay in, for the smaller ids.
                at = np.flatnonzero((far <= (np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf)) & np.isfinite(far))
                at = at[np.lexsort((ids[at], far[at]))][:k]
                found += [(i, ids[j], far[j]) for j in at]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[n] for r in found], t) for n, t in enumerate(kinds)], names=["id", "c_id", "score"])

    out = by_blocks(queries, candidates, dims, block_bytes, run, "id long, c_id long, score double")
    out = out.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("score", "c_id"))).filter(F.col("r") <= k)
    return out.withColumn("score", -F.col("score")) if cosine else out


def within_and_between(queries: DataFrame, candidates: DataFrame, dims: int, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, within, between, nearest): mean distance of each query to others of its group and of other groups, and the
    id of the nearest of all. Blocks hand on a sum, a count and a nearest for each query."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        rows = []
        if len(q) and len(c):
            ids, groups, x = c["id"].to_numpy(), c["grp"].to_numpy(), matrix(c["v"])
            for i, g, v in zip(q["id"].to_numpy(), q["grp"].to_numpy(), matrix(q["v"])):
                far, same, other = np.sqrt(np.square(x - v).sum(1)), groups == g, ids != i
                if other.any():
                    at = np.flatnonzero(other & (far == far[other].min()))
                    rows.append((i, far[same & other].sum(), int((same & other).sum()), far[~same & other].sum(), int((~same & other).sum()), far[at[0]], ids[at].min()))
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        names = ["id", "s", "n", "t", "m", "far", "c_id"]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    parts = by_blocks(queries, candidates, dims, block_bytes, run, "id long, s double, n long, t double, m long, far double, c_id long")
    mean = lambda s, n: F.when(F.sum(n) > 0, F.sum(s) / F.sum(n))
    return parts.groupBy("id").agg(mean("s", "n").alias("within"), mean("t", "m").alias("between"), F.min_by("c_id", F.struct("far", "c_id")).alias("nearest"))


def knn_mean(queries: DataFrame, candidates: DataFrame, k: int, dims: int) -> DataFrame:
    """(id, predicted): the mean target of each query's k nearest candidates of other groups.

    `queries` has id, grp, v; `candidates` has id, grp, v, target. Ties go to the smaller candidate id.
    """
    near = nearest(queries, candidates, k, dims, own_group=False)
    return near.join(candidates.select(F.col("id").alias("c_id"), "target"), "c_id").groupBy("id").agg(F.avg("target").alias("predicted"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _cosines(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows with a vector, each from its own row alone, so that they are the same in every batch."""
    return (_unit(x) * _unit(v[None])[0]).sum(1)


def _ranked_above(sims: np.ndarray, ids: np.ndarray, same: np.ndarray, rel_sims: np.ndarray, rel_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the relevant (similarity, id): how many rows lie above it, and how many of them are relevant too."""
    n = len(rel_ids)
    # A probe comes before the row that it is of.
    probe = np.concatenate([np.zeros(n, np.int8), np.ones(len(ids), np.int8)])
    order = np.lexsort((probe, np.concatenate([rel_ids, ids]), -np.concatenate([rel_sims, sims])))
    above = np.cumsum(probe[order])
    rel = np.cumsum(np.concatenate([np.zeros(n, np.int64), same.astype(np.int64)])[order])
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return above[at[:n]], rel[at[:n]]


class _Ranking:
    """How many candidates lie above each relevant row of one query, and how many of them are relevant, batch by batch.

    Relevant rows lie by falling cosine, equal ones by id; a candidate is counted where it would stand among them.
    """

    def __init__(self, query: int, v: np.ndarray, keys: np.ndarray, ids: np.ndarray, count_own: bool):
        order = np.argsort(keys, kind="stable")  # ids rise
        order = order[ids[order] != query]
        self.query, self.v, self.keys = query, v, keys[order]
        first = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if len(order) else np.empty(0, bool)
        # Where the row's run of equal cosines begins, then the place of its id among all relevant ids.
        self.places = (np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) << 32) + order
        self.counts = np.zeros(len(order) + 1, np.int32)
        self.own = np.zeros(len(order) + 1, np.int32) if count_own else None

    def add(self, x: np.ndarray, ids: np.ndarray, upto: np.ndarray, same: np.ndarray | None) -> None:
        """Candidates' unit vectors and ids, how many relevant ids are not above each, and which are of the group."""
        if not len(self.keys):
            return
        keys = _keys(x, self.v)
        at = np.searchsorted(self.keys, keys)
        tied = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        at[tied] = np.searchsorted(self.places, (at[tied] << 32) + upto[tied] - 1, side="right")
        other = ids != self.query
        if not other.all():
            at, same = at[other], None if same is None else same[other]
        self.counts += np.bincount(at, minlength=len(self.counts)).astype(np.int32)
        if self.own is not None:
            self.own += np.bincount(at[same], minlength=len(self.own)).astype(np.int32)

    def result(self) -> tuple[int, int, float, float]:
        """(id, relevant rows, sum of precisions at them, whether one of them is first)."""
        above = np.cumsum(self.counts[:-1], dtype=np.int64)
        rel = np.arange(len(above)) if self.own is None else np.cumsum(self.own[:-1], dtype=np.int64)
        return self.query, len(above), float(((rel + 1) / (above + 1)).sum()), float(len(above) > 0 and above[0] == 0)


def _keys(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of unit vectors: what rises as `_cosines` fall."""
    keys = -(x * v).sum(1)
    keys[np.isnan(keys)] = np.inf
    return keys


def _ranked(batches: Iterator[pa.RecordBatch], count_own: bool) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by tile and kind: queries (0), relevant rows (1), then all candidates (2), which are only passed through."""
    tile, kind, queries, relevant, made = None, 0, {}, {}, None

    def rankings() -> list[tuple[str, np.ndarray, list[_Ranking]]]:
        out = []
        for g, found in queries.items():
            ids = np.concatenate([i for i, _ in relevant.get(g, [])] or [np.empty(0, np.int64)])
            by_id = np.argsort(ids, kind="stable")
            keys = [np.concatenate([k[n] for _, k in relevant.get(g, [])] or [np.empty(0)])[by_id] for n in range(len(found))]
            relevant.pop(g, None)
            out.append((g, ids[by_id], [_Ranking(i, v, k, ids[by_id], count_own) for (i, v), k in zip(found, keys)]))
        return out

    def results() -> Iterator[pa.RecordBatch]:
        rows = [r.result() for _, _, found in (rankings() if made is None else made) for r in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["id", "n", "s", "hit1"])

    for batch in batches:
        marks = np.stack([batch["tile"].to_numpy(), batch["kind"].to_numpy()], 1)
        starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for a, b in zip(starts[:-1], starts[1:]):
            if a == b:
                continue
            if tile != marks[a, 0]:
                if tile is not None:
                    yield from results()
                tile, queries, relevant, made = marks[a, 0], {}, {}, None
            kind, part = marks[a, 1], pa.Table.from_batches([batch.slice(int(a), int(b - a))])
            ids, groups, x = part["id"].to_numpy(), part["grp"].to_numpy(), _unit(matrix(part["v"]))
            if kind == 0:
                for i, g, v in zip(ids, groups, x):
                    queries.setdefault(g, []).append((i, v))
            elif kind == 1:
                for g in set(groups) & set(queries):
                    at = np.flatnonzero(groups == g)
                    relevant.setdefault(g, []).append((ids[at], [_keys(x[at], v) for _, v in queries[g]]))
            else:
                made = rankings() if made is None else made
                for g, own, found in made:
                    upto, same = np.searchsorted(own, ids, side="right"), groups == g if count_own else None
                    for ranking in found:
                        ranking.add(x, ids, upto, same)
    if tile is not None:
        yield from results()


#: Relevant rows, of all queries of a task together, that it keeps the cosines and counts of (20 bytes each), and pairs that are worth a task.
CELLS, PAIRS = 1 << 25, 20_000_000


def retrieval_metrics(queries: DataFrame, candidates: DataFrame, dims: int, cells: int = CELLS, pairs: int = PAIRS) -> DataFrame:
    """(q, hit1, ap): whether the nearest candidate by cosine is of the query's group, and average precision (0 if none is there).

    Both have id, grp, v; a query's own id is no candidate, ties go to the smaller id, a null group is
    nobody's. Queries are dealt into tiles of at most about `cells` relevant rows; a tile's task reads the relevant rows, then
    all candidates in batches, and counts where each stands among the relevant ones. Only vectors are shuffled, once for
    each tile, and a row of sums for each query; pairs never become rows. A group of over `cells` rows is dealt in chunks.
    """
    spark = queries.sparkSession
    side = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), "v")
    q, c = side(queries), side(candidates)
    sizes = stash(q.groupBy("grp").agg(F.count("*").alias("_m")).join(c.groupBy("grp").agg(F.count("*").alias("_n")), "grp"), "group-sizes")
    of = sizes.agg(F.sum(F.col("_m") * F.col("_n")).alias("cells"), F.max("_n").alias("largest"), F.sum("_m").alias("queries")).first()
    total = of["cells"] or 0
    worth = -(-(of["queries"] or 0) * candidates.count() // pairs)
    tasks = max(1, -(-total // cells), min(2 * spark.sparkContext.defaultParallelism, worth))
    limit = max(1, -(-total // tasks))
    own = F.col("_m") * F.col("_n")
    small = sizes.filter(4 * own <= limit).agg(F.sum(own).alias("n")).first()["n"] or 0
    # Groups of a quarter of a tile or more have their own tiles, the others share some.
    g = sizes.withColumn("_big", 4 * own > limit).withColumn("_own", F.when(F.col("_big"), F.col("grp")))
    g = g.withColumn("_lot", F.when(F.col("_big"), F.lit(0)).otherwise(F.pmod(F.xxhash64("grp"), F.lit(max(1, -(-small // limit))))).cast("long"))
    g = g.withColumn("_chunks", F.ceil(F.col("_n") / cells)).withColumn("_pieces", F.ceil(own / (F.col("_chunks") * limit))).drop("_m", "_n", "_big")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = g.withColumn("_piece", every("_pieces")).withColumn("_chunk", every("_chunks")).select("_own", "_lot", "_piece", "_chunk").distinct()
    # Some dozens or hundreds of rows.
    tiles = stash(tiles.withColumn("tile", F.row_number().over(W.orderBy("_own", "_lot", "_piece", "_chunk"))), "tiles")
    n_tiles = tiles.count()
    drawn = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    row = lambda df, kind: df.select("tile", F.lit(kind).alias("kind"), "id", "grp", "v")
    asked = row(beside(q.join(g, "grp").withColumn("_piece", drawn("_pieces")), tiles, ["_own", "_lot", "_piece"]), 0)
    relevant = row(beside(c.join(g, "grp").withColumn("_chunk", drawn("_chunks")), tiles, ["_own", "_lot", "_chunk"]), 1)
    rows = asked.unionByName(relevant).unionByName(row(c.withColumn("tile", F.explode(F.sequence(F.lit(1), F.lit(n_tiles)) if n_tiles else F.array().cast("array<int>"))), 2))
    count_own = (of["largest"] or 0) > cells
    ranked = rows.repartition(4 * max(1, n_tiles), "tile").sortWithinPartitions("tile", "kind").mapInArrow(lambda b: _ranked(b, count_own), "id long, n long, s double, hit1 double")
    found = ranked.groupBy("id").agg(F.max("hit1").alias("hit1"), F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")).alias("ap"))
    return q.select("id").join(found, "id", "left").select(F.col("id").alias("q"), F.coalesce("hit1", F.lit(0.0)).alias("hit1"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
