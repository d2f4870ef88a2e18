"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams of its letters, weighted by inverse document frequency and
normalised. Each language has several centroids, from spherical k-means on a bounded sample of its texts;
document frequencies cover all texts to learn from. A text gets the language of the centroid with the
largest cosine, and is rejected if it is further from it than nearly all texts it was learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMS = 8192
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are no letters in ASCII count as blanks.
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a sign of Unicode category L is in the text; fractions and other number signs are none."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of a text's byte trigrams, lower-cased, runs of other signs being one blank."""
    clean = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(clean, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """The normalised vectors of texts given by their trigrams and counts."""
    out = np.zeros((len(counts), DIMS), np.float32)
    for i, (at, n) in enumerate(counts):
        out[i, at] = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-12)[:, None]


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    return weighted([trigrams(t or "") for t in texts], idf)


@dataclass(frozen=True)
class Model:
    """Centroids by row, the language of each, the least cosine that is not rejected, and idf.

    It has `clusters` rows of DIMS floats for each language: its size does not grow with the corpus.
    """

    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of each text: the best guess, its cosine, and whether it is near enough."""
        lang, score, ok = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not len(self.langs):
            return lang, score, ok
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            cos = vectors([texts[i] for i in part], self.idf) @ self.centroids.T
            best = cos.argmax(1)
            for i, b, c in zip(part, best, cos[np.arange(len(part)), best]):
                lang[i], score[i], ok[i] = self.langs[b], min(1.0, max(0.0, float(c))), c >= self.least[b]
        return lang, score, ok


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[trigrams(text)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array(np.concatenate([[n], df]))], names=["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1)
    for r in rows:
        out[r["at"] + 1] = r["n"]
    return out[1:], int(out[0])


def _k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, each first centroid being the text furthest from those before."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[[(x @ c.T).max(1).argmin()]]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", clusters: int = 4, sample: int = 1200, reject: float = 0.005) -> Model:
    """Learn from the rows where `learn` holds and neither text nor lang is null.

    `sample` bounds the texts of each language that are clustered: the first by a hash of the text, from a
    hash range sized by the count of the language's distinct texts. `reject` is the share of them that a threshold leaves out.
    Languages of no usable text are not learned; without any, all texts are unknown.
    """
    rows = docs.filter(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    df, n = _document_frequency(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    counts = rows.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    picked = rows.join(F.broadcast(counts), "lang").withColumn("u", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30))
    # Copies count once, or a text with a third of all rows could fill one task.
    picked = picked.filter(F.col("u") * F.col("n") < 1.5 * sample + 30).dropDuplicates(["lang", "text"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            parts = [trigrams(t) if has_letter(t) else (np.empty(0, np.int64), np.empty(0, np.int64)) for t in texts]
            at, n = (pa.array([p[k].astype(np.int32) for p in parts], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], at, n], names=["lang", "u", "tie", "at", "n"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values(["u", "tie"]).head(sample)
        x = weighted([(at, n) for at, n in zip(part["at"], part["n"]) if len(at)], idf)
        if not len(x):
            return pd.DataFrame({"lang": [], "least": [], "centroid": []})
        c, own = _k_means(x, clusters)
        cos = (x * c[own]).sum(1)
        least = [float(np.quantile(cos[own == j], reject)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "least": least, "centroid": [v.astype(float).tolist() for v in c]})

    # A text is at most DIMS counts, however long, before those of a language meet in one task.
    counts_of = picked.select("lang", "u", F.md5("text").alias("tie"), "text").mapInArrow(counted, "lang string, u double, tie string, at array<int>, n array<int>")
    found = counts_of.groupBy("lang").applyInPandas(cluster, "lang string, least double, centroid array<double>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMS)
    return Model([r["lang"] for r in found], centroids, np.array([r["least"] for r in found]), idf)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, score, guess for every row: lang is `und` for a text that is rejected, guess is not.

    Both are `und`, with score 0, for texts that are null or have no letter; whole texts are read; rows
    that repeat get equal rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess, score, ok = shared.value.predict(batch.column(1).to_pylist())
            lang = [g if a else UNKNOWN for g, a in zip(guess, ok)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(guess, pa.string())], names=["doc_id", "lang", "score", "guess"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, guess string")
