"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each weight has its own rate, from the gradients it has seen, and the L1 term holds most at zero, so the
model that is broadcast is the few coordinates that are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import stash
from cohortia.llm.quality import labelled

BITS, STEM = 20, 4
_WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str | None) -> np.ndarray:
    """Hashes, of BITS bits, of a text's lower-cased words and their stems, pairs of neighbours and pairs
    with one word between. A stem is the first STEM bytes of a longer word: languages that build words
    have many forms of one. Repeats are kept; a null text has none.
    """
    words = _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    stems = [w[:STEM] for w in words if len(w) > STEM + 1]
    stem = np.fromiter(map(crc32, stems), np.uint64, len(stems)) + np.uint64(1)
    one = h * _MIX[0]
    parts = [one, stem * _MIX[3], one[:-1] * _MIX[1] + one[1:], one[:-2] * _MIX[2] + one[2:]]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Weights:
    """The coordinates with a weight, in order, their weights, and the bias.

    At most 2^BITS coordinates; in practice, as L1 is for, a few hundred.
    """

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(rows: list[np.ndarray], y: np.ndarray, passes: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.5, seed: int = 5) -> Weights:
    """FTRL-proximal over the rows' distinct coordinates, in `passes` seeded orders; the bias has no L1."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = bias = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = _sigmoid(w.sum() + bias) - y[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Weights(at, w[at].astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = 12_000, sample_bytes: int = 256 << 20, **how) -> Weights:
    """Learn from a sample of at most `sample` labelled texts and `sample_bytes` bytes of their features.

    Features, four bytes for each coordinate of a text, are written in parallel; those of the first texts by a hash of
    them, as many as fit, come to the driver. A text that alone is over the bound is not learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.unique(features(t)).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    table = stash(labelled(docs, labels, label, learn, sample).select("y", "text").mapInArrow(run, "y int, x binary"), "toxicity-sample")
    hashed = table.withColumn("h", F.xxhash64("x"))
    held, most = 0, None
    # One row of 20 bytes for each text of the sample.
    for r in hashed.select("h", F.length("x").alias("size")).filter(F.length("x") <= sample_bytes).orderBy("h").collect():
        held += r["size"]
        if held > sample_bytes:
            break
        most = r["h"]
    fits = hashed.filter((F.length("x") <= sample_bytes) & (F.col("h") <= F.lit(most))) if most is not None else hashed.limit(0)
    keyed = sorted(((bytes(r["x"]), r["y"]) for r in fits.select("x", "y").toLocalIterator()), key=lambda r: (crc32(r[0]), r[1]))
    return train([np.frombuffer(x, "<i4") for x, _ in keyed], np.array([y for _, y in keyed], float), **how)


def score(docs: DataFrame, weights: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from the whole text; null, empty and blank texts get the bias alone.

    Repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value.dense(), shared.value.bias
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                at = features(text)
                at = np.unique(at[w[at] != 0])
                out.append(float(_sigmoid(float(w[at].sum()) + bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
