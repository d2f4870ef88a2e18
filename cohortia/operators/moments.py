"""Moments of vectors: per dimension by exploding, covariances by partial Gram matrices.

Sums are of doubles. A covariance of F dimensions brings one F x F matrix for each partition to a
reducer tree, never the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.arrays import doubles


def per_dimension(vectors: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., pos, n, mean, sd, var): moments of each dimension; sd and var have n - 1 below, 0 for one row."""
    long = vectors.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("var"))


def group_means(vectors: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., n, mean): the mean vector of each group."""
    means = per_dimension(vectors, vector, *by)
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(*by, "n", F.col("m.mean").alias("mean"))


def dead_dimensions(vectors: DataFrame, vector: str, eps: float = 1e-8) -> DataFrame:
    """(pos) of dimensions that hardly vary."""
    long = vectors.select(F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    return long.groupBy("pos").agg(F.stddev_pop("x").alias("sd")).filter(F.col("sd") <= eps).select("pos")


def gram(vectors: DataFrame, vector: Column | str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) in doubles, about the first vector's values to keep digits.

    Each task adds its batches up; its one row of F + F^2 doubles goes on to be summed pairwise.
    """
    v = vector if isinstance(vector, Column) else F.col(vector)
    rows = vectors.select(doubles(v).alias("v")).filter("v IS NOT NULL")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            flat = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "x"])

    parts = rows.mapInArrow(partial, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
    if not len(parts):
        return 0, np.zeros(0), np.zeros((0, 0))
    dims = int(round((-1 + np.sqrt(1 + 4 * (len(parts) - 1))) / 2))
    return int(parts[0]), parts[1 : dims + 1], parts[dims + 1 :].reshape(dims, dims)


def mean_and_covariance(vectors: DataFrame, vector: Column | str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with n - 1): two passes, the second about the mean."""
    n, s, _ = gram(vectors, vector)
    if n < 2:
        return n, s / max(n, 1), np.zeros((len(s), len(s)))
    mu = s / n
    v = vector if isinstance(vector, Column) else F.col(vector)
    at = F.array(*[F.lit(float(m)) for m in mu])
    _, _, g = gram(vectors, F.zip_with(doubles(v), at, lambda x, m: x - m))
    return n, mu, g / (n - 1)


#: Columns of a block of a matrix, and bytes of a matrix's rows that one task adds up at a time.
BLOCK, STRIPE_BYTES = 64, 64 << 20


def vector_sums(vectors: DataFrame, vector: Column | str) -> tuple[int, np.ndarray]:
    """(n, sum) of vectors that are not null: F doubles for each task and on the driver."""
    v = vector if isinstance(vector, Column) else F.col(vector)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, s = n + len(x), x.sum(0) if s is None else s + x.sum(0)
        if n:
            flat = np.concatenate([[n], s])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "x"])

    rows = vectors.select(doubles(v).alias("v")).filter("v IS NOT NULL")
    sums = rows.mapInArrow(partial, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
    return (int(sums[0]), sums[1:]) if len(sums) else (0, np.zeros(0))


def covariance_blocks(vectors: DataFrame, vector: Column | str, block: int = BLOCK, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """(i, b, values): row i of the covariance with n - 1, columns b * block on, `block` of them (the last may be shorter).

    The matrix stays a table. A task adds up a stripe of its rows, of at most `stripe_bytes` (one row at least), and
    reads its vectors once for each stripe; what the tasks hand on is summed by row and block. Vectors are taken
    about their mean, F doubles. Null vectors are left out; fewer than two give no rows.
    """
    v = vector if isinstance(vector, Column) else F.col(vector)
    n, total = vector_sums(vectors, v)
    dims = len(total)
    spark = vectors.sparkSession
    if n < 2:
        return spark.createDataFrame([], "i int, b int, values array<double>")
    mean, high = total / n, max(1, stripe_bytes // (8 * dims))
    rows = vectors.select(doubles(v).alias("v")).filter("v IS NOT NULL")
    width = -(-dims // block) * block

    def stripe(low: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
                    part = x[:, low : low + high].T @ x
                    g = part if g is None else np.add(g, part, out=g)
            for i in range(0 if g is None else len(g)):
                padded = np.zeros(width)
                padded[:dims] = g[i]
                values = pa.FixedSizeListArray.from_arrays(pa.array(padded), block).cast(pa.list_(pa.float64()))
                k = width // block
                yield pa.RecordBatch.from_arrays([pa.array([low + i] * k, pa.int32()), pa.array(np.arange(k), pa.int32()), values], names=["i", "b", "values"])

        return run

    parts = [rows.mapInArrow(stripe(low), "i int, b int, values array<double>") for low in range(0, dims, high)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("i", "b").agg(F.array(*[F.sum(F.col("values")[k]) for k in range(block)]).alias("values"))
    return sums.select("i", "b", F.transform(F.slice("values", F.lit(1), F.least(F.lit(block), dims - F.col("b") * block)), lambda x: x / (n - 1)).alias("values"))


def covariance_table(vectors: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) for i <= j, from `covariance_blocks`."""
    entries = covariance_blocks(vectors, vector).select("i", "b", F.posexplode("values").alias("k", "cov"))
    return entries.select("i", (F.col("b") * BLOCK + F.col("k")).alias("j"), "cov").filter("i <= j")


def mixed_covariance(blocks: DataFrame, weights: list[float], dims: int, block: int = BLOCK) -> DataFrame:
    """(i, j, cov): the covariance of a weighted sum of layers, from that of the layers side by side, `dims` each.

    An entry is the sum over pairs of layers of both weights times the entry at the same places in them.
    """
    entries = blocks.select("i", "b", F.posexplode("values").alias("k", "c")).select("i", (F.col("b") * block + F.col("k")).alias("j"), "c")
    w = F.array(*[F.lit(float(x)) for x in weights])
    weight = lambda at: F.element_at(w, F.floor(F.col(at) / dims).cast("int") + 1)
    return entries.groupBy((F.col("i") % dims).alias("i"), (F.col("j") % dims).alias("j")).agg(F.sum(weight("i") * weight("j") * F.col("c")).alias("cov"))


def running_standardiser(batches: DataFrame, by: str, order: str, mean: str, var: str, momentum: float = 0.99) -> DataFrame:
    """(by, mean, var): moments of ordered batches, each moved towards the next; the first batch begins."""
    lists = batches.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(mean).alias("m"), F.col(var).alias("v")))).alias("l"))
    start = F.struct(F.col("l")[0]["m"].alias("m"), F.col("l")[0]["v"].alias("v"))
    move = lambda a, x: momentum * a + (1 - momentum) * x
    fold = F.aggregate(F.slice("l", F.lit(2), F.size("l") - 1), start, lambda a, x: F.struct(move(a["m"], x["m"]).alias("m"), move(a["v"], x["v"]).alias("v")))
    return lists.select(by, fold.alias("f")).select(by, F.col("f.m").alias("mean"), F.col("f.v").alias("var"))
