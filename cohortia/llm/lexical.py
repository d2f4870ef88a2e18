"""Ranked lexical search: the best documents for each item, by buckets of documents of like vector length.

A document is a vector of term impacts over the items' terms. Documents are ordered by the length of
their vectors and searched bucket by bucket. Where a bucket's longest vector times the item's cannot
reach the item's tenth best score so far (Cauchy-Schwarz), the item is done. Else the item's heaviest
terms are summed until the rest, by lengths, cannot reach that score alone: documents without any of them
are passed over, and the others must reach it with what is left of their length. What survives is scored
exactly in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.llm.common import stash

#: Items are searched in blocks of so many bytes of text, or one item: a block's terms are held by every task.
ITEM_BYTES = 4 << 20
#: Documents of a bucket; so many of the longest give each item's first bound.
BUCKET, WARM = 4096, 8192
#: Letters A-Z lower, what parts terms to blanks, digits, a-z and non-ASCII bytes as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bounds in doubles are taken so much higher, which is more than they can be off.
_SLACK = 1 + 1e-9

VECTORS = "row long, doc_id long, n long, terms array<int>, tfs array<long>"
IMPACTS = "row long, doc_id long, norm double, terms array<int>, impacts array<long>"
HITS = "item int, row long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of digits, letters and non-ASCII signs, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """For each row its number of terms and how often it holds each of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for t in batch.column(2):
                words = terms_of(t.as_py())
                counts = Counter(words)
                here = counts.keys() & known.keys()
                sizes.append(len(words))
                terms.append([known[w] for w in here])
                tfs.append([counts[w] for w in here])
            out = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, VECTORS).filter("n > 0")


def _impacts(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """What each term of a document adds to a score but its weight, and the length of the vector that sqrt(weight) times it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column(3), batch.column(4)
            ends = terms.offsets.to_numpy()
            at, tf = terms.values.to_numpy()[ends[0] : ends[-1]], tfs.values.to_numpy()[ends[0] : ends[-1]]
            # In Python's integers, which do not overflow.
            m = np.array([100 - 75 + 75 * n * n_docs // n_terms for n in batch.column(2).to_pylist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            # No list is empty.
            norm = np.sqrt(np.add.reduceat(weights[at] * impact.astype(float) ** 2, ends[:-1] - ends[0])) if len(at) else np.empty(0)
            out = [batch.column(0), batch.column(1), pa.array(norm), terms, pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(impact))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "norm", "terms", "impacts"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, IMPACTS)


class _Best:
    """The best so far of one item: scores, ids and rows, the highest score first, ties by id (null last) and row."""

    def __init__(self, counts: Counter, weights: np.ndarray, most: int, bound: int):
        self.terms = np.array(sorted(counts, key=lambda t: (-weights[t] * counts[t] ** 2, t)), np.int64)
        self.times = np.array([counts[t] for t in self.terms.tolist()], np.int64)
        self.weight = self.times * weights[self.terms]
        # Lengths of the item's vector, times * sqrt(weight), from each term on.
        self.rest = np.sqrt(np.append(np.cumsum((self.times * self.weight).astype(float)[::-1])[::-1], 0.0)) * _SLACK
        self.most, self.bound = most, bound
        self.hits: list[tuple[int, int, int, int | None]] = []

    def add(self, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        new = [(-s, math.inf if d is None else d, r, d) for s, r, d in zip(scores.tolist(), rows.tolist(), ids)]
        self.hits = sorted(self.hits + new, key=lambda x: x[:3])[: self.most]
        if len(self.hits) == self.most:
            self.bound = max(self.bound, -self.hits[-1][0])


class _Bucket:
    """Documents of like length: vectors by document and by term."""

    def __init__(self, batch: pa.RecordBatch):
        self.rows, self.ids, self.norms = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
        ends = batch.column(3).offsets.to_numpy().astype(np.int64)
        self.terms = batch.column(3).values.to_numpy()[ends[0] : ends[-1]]
        self.impacts = batch.column(4).values.to_numpy()[batch.column(4).offsets[0].as_py() :][: len(self.terms)]
        self.ends = ends - ends[0]
        self.order = np.argsort(self.terms, kind="stable")
        self.sorted_terms = self.terms[self.order]
        self.doc_of = np.repeat(np.arange(len(self.rows)), np.diff(ends))[self.order]
        self.by_term = self.impacts[self.order]

    def search(self, best: _Best, dense: np.ndarray, weights: np.ndarray) -> bool:
        """Adds the bucket's documents that can be among the item's best; false where no shorter document can."""
        if best.bound and best.rest[0] * self.norms[0] * _SLACK < best.bound:
            return False
        # With the first `heavy` terms' sums known, the rest of the item's vector is too short to matter alone.
        heavy = int(np.argmax(best.rest * self.norms[0] * _SLACK < best.bound)) if best.bound else len(best.terms)
        low = np.searchsorted(self.sorted_terms, best.terms[:heavy])
        high = np.searchsorted(self.sorted_terms, best.terms[:heavy], side="right")
        met = np.concatenate([np.empty(0, np.int64), *[np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())]])
        if not len(met):
            return True
        docs, impact = self.doc_of[met], self.by_term[met]
        sums = np.bincount(docs, np.repeat(best.weight[:heavy], high - low) * impact.astype(float), len(self.rows))
        used = np.bincount(docs, weights[best.terms[:heavy]].repeat(high - low) * impact.astype(float) ** 2, len(self.rows))
        left = np.sqrt(np.maximum(self.norms**2 * _SLACK - used, 0) + self.norms**2 * 1e-9)
        there = np.flatnonzero((sums > 0) & ((sums + best.rest[heavy] * left) * _SLACK >= best.bound))
        if not len(there):
            return True
        dense[best.terms] = best.weight
        sizes = self.ends[there + 1] - self.ends[there]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.ends[there] - first, sizes) + np.arange(sizes.sum())
        scores = np.add.reduceat(dense[self.terms[at]] * self.impacts[at], first)
        dense[best.terms] = 0
        good = np.flatnonzero((scores > 0) & (scores >= best.bound))
        if len(good) > best.most:
            # All that tie with the last of the best by score stay for the ids to decide.
            good = good[scores[good] >= -np.partition(-scores[good], best.most - 1)[best.most - 1]]
        best.add(scores[good], self.rows[there[good]], self.ids.take(pa.array(there[good])).to_pylist())
        return True


def _search(items: list[Counter], weights: np.ndarray, bounds: list[int], most: int, bucket: int):
    """A task's work: documents come longest first, buckets of them meet every item that is not done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(c, weights, most, b) for c, b in zip(items, bounds)]
        open_, dense = [i for i, c in enumerate(items) if c], np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                docs = _Bucket(batch.slice(at, bucket))
                open_ = [i for i in open_ if docs.search(best[i], dense, weights)]
        hits = [(i, r, d, -s) for i, b in enumerate(best) for s, _, r, d in b.hits]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], kind) for k, kind in enumerate(kinds)], names=["item", "row", "doc_id", "score"])

    return run


def _rank_block(docs: DataFrame, items: list[tuple[int | None, str | None]], most: int, bucket: int, warm: int) -> DataFrame:
    texts = [Counter(terms_of(t)) for _, t in items]
    known = {w: k for k, w in enumerate(sorted({w for c in texts for w in c}))}
    vectors = stash(_vectors(docs, known), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    # One row for each term of the block.
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
    impacts = stash(_impacts(vectors, weights, n_docs, max(n_terms, 1)), "impacts")
    counts = [Counter({known[w]: k for w, k in c.items()}) for c in texts]

    none = [0] * len(items)
    # About `warm` of the longest vectors, more where many are of one length, searched where they lie.
    cut = impacts.agg(F.percentile_approx("norm", max(0.0, 1 - warm / max(n_docs, 1)), 10_000)).first()[0]
    longest = impacts.filter(F.col("norm") >= F.lit(cut)).sortWithinPartitions(F.desc("norm"))
    best = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    tenth = longest.mapInArrow(_search(counts, weights, none, most, bucket), HITS).withColumn("nth", best).filter(F.col("nth") == most)
    # One number for each item of the block.
    low = {r.item: r.score for r in tenth.select("item", "score").collect()}
    bounds = [low.get(i, 0) for i in range(len(items))]

    # Equal lengths are parted by row, so copies do not fill one task.
    order = [F.desc("norm"), F.col("row")]
    found = impacts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_search(counts, weights, bounds, most, bucket), HITS)
    # Each task hands on `most` rows of an item at most.
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= most)
    ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, most: int = 10, bucket: int = BUCKET, warm: int = WARM, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """For each row of `items` (item_id, text) its `most` highest-scoring documents: item_id, rank, doc_id, score.

    Scores are those of the impact formula in README, above 0; equal scores go by ascending doc_id, null ids last,
    rows of one id one after another, each a document of its own. Null and empty texts have no terms: such
    documents are not counted, such items get no rows; rows of one item_id are ranked apart. Whole texts
    are read. Items are taken in blocks of at most `item_bytes` bytes (a longer one is a block of its own),
    each of which reads all documents; the driver holds one block and as many counts as it has terms.
    """
    blocks: list[DataFrame] = []
    block: list[tuple[int | None, str | None]] = []
    size = 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        more = len((text or "").encode())
        if block and size + more > item_bytes:
            blocks.append(_rank_block(docs, block, most, bucket, warm))
            block, size = [], 0
        block.append((item_id, text))
        size += more
    if block:
        blocks.append(_rank_block(docs, block, most, bucket, warm))
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, blocks)
