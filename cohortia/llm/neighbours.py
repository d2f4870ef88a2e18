"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and its leaves hold all vectors; a leaf that turns out crowded is
split again from a sample of its own, so leaves multiply with the table. A query visits leaves in the order
of a priority queue; how many is calibrated: visits widen until the true neighbours of a sample of
queries, found by comparing those with all vectors, are reached as often as asked. Leaves that cannot hold
a neighbour, by their radius and what the leaves seen before hold, are passed over.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.llm.common import bounded_sample, stash


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes, each node's children, and the leaf number of a node without any.

    A sample of s vectors gives fewer than 2 s nodes (about s / 20 of spread vectors by default), and so does each
    leaf that is split again; `search` stops splitting at a stated number of nodes, whatever the number of vectors indexed.
    """

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    def order(self, query: np.ndarray) -> Iterator[tuple[int, float]]:
        """(leaf, squared distance of its centre) for a query, best bin first: of all nodes seen the nearest is opened next."""
        queue = [(float(np.square(self.centres[0] - query).sum()), 0)]
        while queue:
            far, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield self.leaf[node], far
            for d, c in zip(np.square(self.centres[below] - query).sum(1), below):
                heapq.heappush(queue, (float(d), c))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance from its centre) of each vector: down the nearest centres."""
        out, far, todo = np.zeros(len(x), np.int64), np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            below = self.children[node]
            if not below:
                out[own], far[own] = self.leaf[node], np.sqrt(np.square(x[own] - self.centres[node]).sum(1))
                continue
            c = self.centres[below]
            nearest = (np.square(c).sum(1)[None, :] - 2 * x[own] @ c.T).argmin(1)
            todo += [(k, own[nearest == i]) for i, k in enumerate(below) if (nearest == i).any()]
        return out, far

    def with_subtrees(self, parts: dict[int, Tree]) -> Tree:
        """This tree with a tree in place of some of its leaves, and leaves numbered anew."""
        centres, children, leaf = list(self.centres), [list(c) for c in self.children], list(self.leaf)
        for node in [n for n, c in enumerate(self.children) if not c and self.leaf[n] in parts]:
            part, shift = parts[self.leaf[node]], len(centres) - 1
            # The part's root is the node itself, the others follow at the end.
            children[node] = [c + shift for c in part.children[0]]
            centres += list(part.centres[1:])
            children += [[c + shift for c in below] for below in part.children[1:]]
            leaf += [-1] * (len(part.children) - 1)
        ends = [n for n, c in enumerate(children) if not c]
        leaf = [-1] * len(children)
        for k, n in enumerate(ends):
            leaf[n] = k
        return Tree(np.array(centres), children, leaf)


def grow(x: np.ndarray, branches: int = 8, leaf: int = 64, rounds: int = 8, seed: int = 11) -> Tree:
    """k-means in each node, until a node has `leaf` vectors of the sample or they are all alike."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, x.shape[1])), [], [])
    centres, todo, n_leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [(0, np.arange(len(x)))], 0
    tree.children.append([])
    tree.leaf.append(-1)
    while todo:
        node, own = todo.pop()
        y = x[own]
        if len(own) > leaf:
            c = y[rng.choice(len(y), min(branches, len(y)), replace=False)]
            for _ in range(rounds):
                mine = (np.square(c).sum(1)[None, :] - 2 * y @ c.T).argmin(1)
                c = np.stack([y[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))])
            mine = (np.square(c).sum(1)[None, :] - 2 * y @ c.T).argmin(1)
            parts = [(c[j], own[mine == j]) for j in range(len(c)) if (mine == j).any()]
            if len(parts) > 1:
                for centre, part in parts:
                    tree.children[node].append(len(centres))
                    todo.append((len(centres), part))
                    centres.append(centre)
                    tree.children.append([])
                    tree.leaf.append(-1)
                continue
        tree.leaf[node], n_leaves = n_leaves, n_leaves + 1
    return Tree(np.array(centres), tree.children, tree.leaf)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", length: int | None = None) -> DataFrame:
    """(id, v): rows with an id whose vector is not null, not zero and holds finite numbers only.

    Those of `length` take part; without it, those of the most frequent length (of two, the longer).
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(~bad & F.exists("v", lambda x: x != 0))
    if length is None:
        found = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        length = found["n"] if found else 0
    return rows.filter(F.size("v") == length)


def _fetched(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a few rows of (id, v), as matrices; no lists of Python numbers on the way."""
    got = df.select("id", "v").toArrow().combine_chunks()
    if not len(got):
        return np.empty(0, np.int64), np.empty((0, 0))
    return got["id"].combine_chunks().to_numpy(), _matrix(got["v"].combine_chunks())


def _split(indexed: DataFrame, tree: Tree, crowded: int, sample: int, seed: int, nodes: int, at_once: int = 64) -> Tree | None:
    """The tree with leaves of over `crowded` vectors split again, each from at most `sample` of its own; None if there are none.

    The `at_once` largest are split, as long as the tree keeps to `nodes` nodes. A leaf's sample is drawn at random,
    seeded, at a rate set by its count, so repeated rows are no more than others, and its part of the tree is
    grown in a task of its own. Only centres come to the driver.
    """
    full = indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("r")).filter((F.col("n") > crowded) & (F.col("r") > 0))
    full = full.orderBy(F.desc("n"), "leaf").limit(at_once).select("leaf", "n")
    drawn = indexed.withColumn("u", F.rand(seed)).join(F.broadcast(full), "leaf").filter(F.col("u") * F.col("n") < 1.2 * sample + 30)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(["u", "id"]).head(sample)["v"].tolist(), np.float64)
        part = grow(x, seed=seed)
        rows = [(pdf["leaf"].iloc[0], k, c.tolist(), below) for k, (c, below) in enumerate(zip(part.centres, part.children))]
        return pd.DataFrame(rows, columns=["leaf", "node", "centre", "children"])

    rows = drawn.groupBy("leaf").applyInPandas(run, "leaf long, node int, centre array<double>, children array<int>").collect()
    parts: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["leaf"], r["node"])):
        parts.setdefault(r["leaf"], []).append(r)
    room, grown = nodes - len(tree.children), {}
    for k, p in parts.items():
        if 1 < len(p) <= room:
            grown[k] = Tree(np.array([r["centre"] for r in p]), [list(r["children"]) for r in p], [])
            room -= len(p) - 1
    return tree.with_subtrees(grown) if grown else None


def _nearest(spark: SparkSession, queries: np.ndarray, own: np.ndarray, tree, indexed: DataFrame, k: int) -> dict[int, list[tuple[float, int, int]]]:
    """(distance, id, leaf) of the k nearest of each of a few queries, against all vectors, in blocks."""
    shared = spark.sparkContext.broadcast((queries, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mine = shared.value
        best: dict[int, list] = {i: [] for i in range(len(q))}
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for i in range(len(q)):
                d = np.sqrt(np.square(x - q[i]).sum(1))
                d[ids == mine[i]] = np.inf
                near = np.argsort(d, kind="stable")[:k]
                best[i] = heapq.nsmallest(k, best[i] + [(float(d[j]), int(ids[j]), int(leaf[j])) for j in near if np.isfinite(d[j])])
        rows = [(i, *r) for i, found in best.items() for r in found]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["q", "d", "id", "leaf"])

    found = indexed.select("id", "v", "leaf").mapInArrow(run, "q long, d double, id long, leaf long")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).filter(F.col("r") <= k)
    out: dict[int, list] = {}
    for r in found.collect():
        out.setdefault(r["q"], []).append((r["d"], r["id"], r["leaf"]))
    return out


def calibrated(tree: Tree, queries: np.ndarray, truth: dict[int, list[tuple[float, int, int]]], recall: float) -> int:
    """The fewest leaves after which `recall` of the true neighbours have been reached, at least 2."""
    ranks = []
    for i, found in truth.items():
        place = {leaf: n for n, (leaf, _) in enumerate(tree.order(queries[i]))}
        ranks += [place[leaf] for _, _, leaf in found]
    if not ranks:
        return 2
    return max(2, int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1)


def route(tree: Tree, query: np.ndarray, visits: int, k: int, held: dict[int, int], radius: dict[int, float]) -> list[int]:
    """The leaves a query visits: the first `visits` in order, more until those hold k others.

    Of leaves that hold k others among them, all of whose vectors lie within some distance, none further
    off than that, by the triangle inequality, can hold a neighbour: such leaves are left out.
    """
    out, seen, reach = [], 0, []
    for n, (leaf, far) in enumerate(tree.order(query)):
        if n >= visits and seen > k:
            break
        if not held.get(leaf):
            continue
        d, r = math.sqrt(far), radius[leaf]
        # The distance within which k others are known to lie.
        within, most = 0, math.inf
        for edge, count in reach:
            within += count
            if within > k:
                most = edge
                break
        if d - r > most * (1 + 1e-9):
            continue
        out.append(leaf)
        insort(reach, (d + r, held[leaf]))
        seen += held[leaf]
    return out


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, sample: int = 20_000, calibration: int = 128, block: int = 2048, crowded: int = 1 << 16, nodes: int = 1 << 16, id: str = "vec_id", vector: str = "embedding", seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other vectors, by Euclidean distance.

    Vectors that `usable` refuses take no part, on either side, nor do queries of another length than the
    index; of query rows that share an id the least vector is searched. Ties go to the smaller id. A query's own id is
    no candidate; of rows that repeat an id the nearest counts; a query visits leaves until they hold k others, so it gets fewer only where there are
    fewer, then all. An empty side gives no rows.

    The tree is fitted on at most `sample` vectors (fewer if those are over 128 MB) and on at most 4096 of
    each leaf of over `crowded`, round by round until none is crowded or the tree has `nodes` nodes (fewer if those are
    over 64 MB), which every task holds; leaves crowded even then are searched in parts. Visits are calibrated on at most `calibration` queries. Leaves are dealt in
    lots of about `block` vectors and `block` queries, a crowded leaf in parts; each lot hands on k rows for
    each query.
    """
    spark = vectors.sparkSession
    points = usable(vectors, id, vector)
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    some = points.select(F.size("v").alias("n")).first()
    if some is None:
        return empty
    length = some["n"]
    wanted = usable(queries, id, vector, length)
    _, drawn = _fetched(bounded_sample(points, "id", min(sample, max(1000, (128 << 20) // (8 * length)))))
    tree = grow(drawn, seed=seed)

    def index(tree: Tree) -> DataFrame:
        shared = spark.sparkContext.broadcast(tree)

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, far = shared.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(far, pa.float64())], names=["id", "v", "leaf", "far"])

        return stash(points.mapInArrow(leaves, "id long, v array<double>, leaf long, far double"), "ann-index")

    indexed = index(tree)
    most = min(nodes, (64 << 20) // (8 * length))
    while deeper := _split(indexed, tree, crowded, 4096, seed, most):
        tree, indexed = deeper, index(deeper)
    shared = spark.sparkContext.broadcast(tree)
    wanted = stash(wanted.groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    own, trial = _fetched(bounded_sample(wanted, "id", calibration))
    if not len(own):
        return empty
    visits = calibrated(tree, trial, _nearest(spark, trial, own, tree, indexed, k), recall)
    # One row for each leaf, of which there are at most as many as the tree has nodes.
    stats = indexed.groupBy("leaf").agg(F.countDistinct("id").alias("ids"), F.max("far").alias("radius"), F.count("*").alias("rows")).orderBy("leaf").collect()
    held, radius = {r["leaf"]: r["ids"] for r in stats}, {r["leaf"]: r["radius"] for r in stats}
    lots, before = {}, 0
    for r in stats:  # leaves beside each other share a lot; a crowded one is dealt in parts
        lots[r["leaf"]] = (before // block, -(-r["rows"] // block))
        before += r["rows"]

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, list[int]]] = []
            for i, q in enumerate(_matrix(batch.column(1))):
                visited: dict[tuple[int, int], list[int]] = {}
                for leaf in route(shared.value, q, visits, k, held, radius):
                    lot, parts = lots[leaf]
                    for part in range(parts):
                        visited.setdefault((lot, part), []).append(leaf)
                rows += [(i, lot, part, leaves) for (lot, part), leaves in visited.items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array([r[n + 1] for r in rows], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cols], names=["id", "v", "lot", "p", "leaves"])

    # Few rows of much work each: dealt out over all cores.
    spread = wanted.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "id")
    routed = stash(spread.mapInArrow(routes, "id long, v array<double>, lot long, p long, leaves array<long>"), "ann-routes")
    # A row for each leaf; lots and their parts grow with the table, so those are joined as they are.
    of = F.broadcast(spark.createDataFrame([(leaf, lot, parts) for leaf, (lot, parts) in lots.items()], "leaf long, lot long, parts long"))
    blocks = routed.groupBy("lot", "p").agg(F.ceil(F.count("*") / block).alias("blocks"))
    left = indexed.select("id", "v", "leaf").join(of, "leaf").withColumn("p", F.pmod(F.xxhash64("id", "v"), "parts")).join(blocks, ["lot", "p"])
    left = left.select("id", "v", "leaf", "lot", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("r"))
    right = routed.join(blocks, ["lot", "p"]).select("id", "v", "leaves", "lot", "p", F.pmod(F.xxhash64("id"), "blocks").alias("r"))

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(x) and len(q):
            leaf = x["leaf"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            ids, m, leaf = x["id"].to_numpy()[order], _matrix(x["v"].combine_chunks())[order], leaf[order]
            repeats = len(np.unique(ids)) < len(ids)
            for qid, v, leaves in zip(q["id"].to_numpy(), _matrix(q["v"].combine_chunks()), q["leaves"].to_pylist()):
                at = np.concatenate([np.arange(*np.searchsorted(leaf, [w, w + 1])) for w in leaves])
                near = ids[at]
                d = np.sqrt(np.square(m[at] - v).sum(1))
                d[near == qid] = np.inf
                # All that tie with the k-th stay in, for the smaller ids; an id that repeats counts once.
                edge = np.partition(d, k - 1)[k - 1] if len(d) > k and not repeats else np.inf
                some = np.flatnonzero((d <= edge) & np.isfinite(d))
                some = some[np.lexsort((near[some], d[some]))]
                if repeats:
                    some = some[np.sort(np.unique(near[some], return_index=True)[1])]
                out += [(qid, near[j], d[j]) for j in some[:k]]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    keys = ["lot", "p", "r"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
