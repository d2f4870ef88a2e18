"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown from histograms of binned statistics of a bounded sample of labelled texts and laid
out in flat arrays, which whole batches walk down at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import bounded_sample

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "blank", "stop", "comma", "shout", "symbol", "bar", "bracket", "quote", "dash", "slash", "high",
    "word_mean", "word_sd", "word_max", "short_words", "long_words", "distinct_words", "distinct_lines", "line_mean", "line_max", "ended_lines", "words_with_sign",
)
_SIGNS = {"digit": b"0123456789", "stop": b".", "comma": b",;:", "shout": b"!?", "symbol": b"#$%&*+=^~@", "bar": b"|", "bracket": b"()[]{}<>", "quote": b"\"'`", "dash": b"-_", "slash": b"/\\"}
_CLASS = np.zeros((256, 14), np.float64)
for _i in range(256):
    _CLASS[_i, 0] = 97 <= _i <= 122
    _CLASS[_i, 1] = 65 <= _i <= 90
    _CLASS[_i, 3] = _i in b" \t\n\r\x0b\x0c"
    _CLASS[_i, 13] = _i >= 128
    for _k, _v in zip((2, *range(4, 13)), _SIGNS.values()):
        _CLASS[_i, _k] = _i in _v
_TAIL = b".!?,;:#$%&*+=|"


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; a null text counts as empty, and an empty one has zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words, lines = b.split(), b.split(b"\n")
    n = max(1, len(b))
    share = (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _CLASS / n).tolist()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    w, widths = max(1, len(words)), list(map(len, lines))
    ended = sum(x[-1:] == b"." for x in lines) / len(lines)
    signed = sum(x[-1] in _TAIL for x in words) / w
    return [
        np.log1p(len(b)), np.log1p(len(words)), np.log1p(len(lines)), *share,
        sizes.mean(), sizes.std(), np.log1p(sizes.max()), np.count_nonzero(sizes <= 3) / w, np.count_nonzero(sizes >= 12) / w,
        len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(sum(widths) / len(lines)), np.log1p(max(widths)), ended, signed,
    ]


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child. `base` is the log-odds without statistics."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            down = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(down, self.left[node], self.right[node])
        z = self.base + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss of 0/1 labels `y`; constant if there is one label only."""
    if not len(y):
        return Trees(*(np.zeros(0, np.int64),) * 6, 0, 0.0)
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1]) * bins
    z = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for col, v in zip((feature, threshold, left, right, value), (0, 0.0, k, k, 0.0)):
            col.append(v)
        return k

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            after = []
            for k, own in level:
                sum_g, sum_h = g[own].sum(), h[own].sum()
                value[k] = rate * sum_g / (sum_h + ridge)
                split = None
                if d < depth and len(own) >= 2 * least:
                    f = flat[own].ravel()
                    size = x.shape[1] * bins
                    hist = [np.bincount(f, np.repeat(v[own], x.shape[1]), size).reshape(-1, bins).cumsum(1) for v in (g, h, np.ones(len(y)))]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(nl < least) | (len(own) - nl < least)] = -1
                    best = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[best] > 1e-6 and best[1] < len(edges[best[0]]):
                        split = best
                if split is None:
                    z[own] += value[k]
                    continue
                feature[k], threshold[k] = split[0], edges[split[0]][split[1]]
                left[k], right[k] = node(), node()
                down = binned[own, split[0]] <= split[1]
                after += [(left[k], own[down]), (right[k], own[~down])]
            level = after
    ints = [np.array(c, np.int64) for c in (feature, left, right, roots)]
    return Trees(ints[0], np.array(threshold), ints[1], ints[2], np.array(value), ints[3], depth, base)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int) -> DataFrame:
    """(text, y) of at most `sample` labelled documents: the first by a hash of doc_id among those where
    `learn`, an expression of doc_id, holds. Labels that are null or of no document are left out; of two, the larger counts.
    Of rows that share an id one is learned, that of the least text hash."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = bounded_sample(rows.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", sample)
    # At most `sample` rows of 12 bytes.
    met = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    first = F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("of")
    return met.groupBy("doc_id").agg(first).select("of.text", "of.y")


def _statistics_table(df: DataFrame, keep: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    return df.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = 20_000, **how) -> Trees:
    """Grow the trees from a sample of at most `sample` labelled texts; their statistics come to the driver."""
    table = _statistics_table(labelled(docs, labels, label, learn, sample), "y", "int").toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort([*x.T, table["y"].to_numpy()])  # the same trees however the rows arrive
    return grow(x[order], table["y"].to_numpy()[order].astype(float), **how)


def score(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from the whole text; null and empty texts are scored alike.

    Repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            parts = [shared.value.score(x[i : i + 1024]) for i in range(0, len(x), 1024)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, trees: Trees, least: float) -> DataFrame:
    """The rows of `docs` whose whole text scores `least` or more, all their columns untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
            parts = [shared.value.score(x[i : i + 1024]) for i in range(0, len(x), 1024)]
            yield batch.filter(pa.array(np.concatenate(parts) >= least)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
