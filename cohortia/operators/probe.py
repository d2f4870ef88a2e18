"""A linear probe on a learned mix of layers, trained by sums that tasks make of their rows.

A row is the layers of a window side by side. Its layers are standardised, mixed with softmax weights and scored by
one linear head. Only sums of gradients, a number for each parameter, come to the driver; never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.arrays import doubles
from cohortia.operators.metrics import auroc
from cohortia.operators.moments import per_dimension
from cohortia.sources.scratch import stash


@dataclass(frozen=True)
class Probe:
    """Standardisation of the layers (layers x dims), logits of their mix, head and bias; a positive score means label 1."""

    mean: np.ndarray
    sd: np.ndarray
    mix: np.ndarray
    head: np.ndarray
    bias: float

    def weights(self) -> np.ndarray:
        e = np.exp(self.mix - self.mix.max())
        return e / e.sum()

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (x.reshape(len(x), *self.mean.shape) - self.mean) / self.sd

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nld,l,d->n", self.standardised(x), self.weights(), self.head) + self.bias


def losses(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Binary cross-entropy of each row, stable for large logits."""
    return np.logaddexp(0.0, np.where(y == 1, -logit, logit))


def gradient_sums(probe: Probe, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums over rows: loss, then its derivatives by mix logits, head and bias."""
    z, w = probe.standardised(x), probe.weights()
    scores = np.einsum("nld,d->nl", z, probe.head)
    logit = scores @ w + probe.bias
    off = weight * (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - (y == 1))
    by_weight = off @ scores
    return np.concatenate([[weight @ losses(logit, y)], w * (by_weight - w @ by_weight), np.einsum("n,nld,l->d", off, z, w), [off.sum()]])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _sums(rows: DataFrame, probe: Probe, share: dict[int, float]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy()
                part = gradient_sums(probe, _matrix(batch.column(0), batch.num_rows), y, np.where(y == 1, share[1], share[0]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["at", "x"])

    return rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()


def scores(rows: DataFrame, keys: list[str], x: Column | str, probes: list[Probe]) -> DataFrame:
    """(keys..., epoch, logit): what each of the probes, one for each epoch, says of each row."""
    x = F.col(x) if isinstance(x, str) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(probes)
            flat = _matrix(batch.column(batch.num_columns - 1), batch.num_rows) if batch.num_rows else np.zeros((0, probes[0].mean.size))
            logit = np.stack([p.logits(flat) for p in probes], 1).ravel() if batch.num_rows else np.zeros(0)
            at = pa.array(np.repeat(np.arange(batch.num_rows), k))
            kept = [c.take(at) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.tile(np.arange(k), batch.num_rows), pa.int32()), pa.array(logit)], names=[*keys, "epoch", "logit"])

    given = rows.select(*keys, doubles(x).alias("_x")).filter("_x IS NOT NULL")
    kinds = ", ".join(f"`{n}` {t}" for n, t in given.dtypes[:-1])
    return given.mapInArrow(run, f"{kinds}, epoch int, logit double")


def train(train_rows: DataFrame, val_rows: DataFrame, x: str, y: str, layers: int, epochs: int = 10, lr: float = 0.1, mix_lr: float = 0.1, decay: float = 1e-3) -> tuple[DataFrame, Probe]:
    """(history, probe): a row for each epoch and the probe of the best one.

    Both classes weigh the same. An epoch is one step of Adam on the whole training table, one job that sums
    gradients where the rows lie; weight decay holds for the head. history has epoch (0 is the start), train_bce, val_bce,
    train_auroc, val_auroc, weights (of the mix) and best: the epoch of the largest validation AUROC, the first of equals.
    Rows whose label is not 0 or 1 or whose vector is null are left out; a class without training rows is an error.
    """
    of = lambda df: df.select(doubles(F.col(x)).alias("x"), F.col(y).cast("int").alias("y")).filter("x IS NOT NULL AND y IN (0, 1)")
    rows, val = stash(of(train_rows), "probe-train"), stash(of(val_rows), "probe-val")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("training rows of both classes are needed")
    share = {k: 0.5 / n for k, n in counts.items()}
    m = per_dimension(rows, "x").orderBy("pos").toPandas()
    shape = (layers, len(m) // layers)
    sd = m["sd"].to_numpy()
    probe = Probe(m["mean"].to_numpy().reshape(shape), np.where(sd > 0, sd, 1.0).reshape(shape), np.zeros(layers), np.zeros(shape[1]), 0.0)
    path = [probe]
    first = second = np.zeros(layers + shape[1] + 1)
    rate = np.concatenate([np.full(layers, mix_lr), np.full(shape[1] + 1, lr)])
    for step in range(1, epochs + 1):
        g = _sums(rows, probe, share)[1:]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        head = probe.head * (1 - lr * decay) - move[layers:-1]
        probe = replace(probe, mix=probe.mix - move[:layers], head=head, bias=float(probe.bias - move[-1]))
        path.append(probe)

    both = rows.withColumn("side", F.lit("train")).unionByName(val.withColumn("side", F.lit("val")))
    scored = stash(scores(both, ["side", "y"], "x", path), "probe-scores")
    logit = F.col("logit")
    bce = F.greatest(F.when(F.col("y") == 1, -logit).otherwise(logit), F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    of_class = lambda k: F.avg(F.when(F.col("y") == k, bce))
    loss = scored.groupBy("epoch", "side").agg(((of_class(0) + of_class(1)) / 2).alias("bce"))
    found = loss.join(auroc(scored, "logit", F.col("y") == 1, ("epoch", "side")), ["epoch", "side"], "left")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    history = stash(found.groupBy("epoch").agg(pick("train", "bce"), pick("val", "bce"), pick("train", "auroc"), pick("val", "auroc")), "probe-history")
    top = history.orderBy(F.desc_nulls_last("val_auroc"), "epoch").first()
    weights = F.element_at(F.array(*[F.array(*[F.lit(float(w)) for w in p.weights()]) for p in path]), F.col("epoch") + 1)
    return history.withColumn("weights", weights).withColumn("best", F.col("epoch") == top.epoch), path[top.epoch]
