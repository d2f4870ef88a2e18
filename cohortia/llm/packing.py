"""Best-fit packing of token sequences, certified by lower bounds.

Pieces are dealt into groups of a bounded number, each packed by best-fit decreasing. Dual feasible
functions give a lower bound for each group's bins; a group that meets it is done. Groups with a gap pool
the pieces of their bins that are not full, deal them anew and pack again; the round counts if the pool
then needs fewer bins. The pool's bounds tell when nothing is left to gain.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import stash

#: Texts of these characters are parted alike by both tokenizer libraries (a test holds that); others,
#: and texts that hold a special token, go to `tokenizers` itself.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|endoftext\|>")

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_GROUP = "group long, row long, doc_id long, piece int, start long, length long, ids_crc32 long, key long"


@lru_cache(1)
def _encoders(path: str):
    """The vocabulary in `tokenizers`, and the same as ranks in `tiktoken`, which is four times as fast."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in signs]
    byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if all(c in byte_of for c in word) and not word.startswith("<|endoftext|>")}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return whole, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """The ids of a text, without special tokens added."""
    whole, fast = _encoders(path)
    if _PLAIN.search(text):
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` tokens: row, doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids and the id `end`; one that is longer than `capacity` is cut into pieces
    of just that, the first being what is left over. A null text is empty. `row` tells rows of `docs` apart,
    whatever their ids; it holds for one evaluation, so whoever reads the pieces twice stashes them first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for r, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.append(encode(t or "", tokenizer), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for col, v in zip(cols, (r, d, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b])):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays, names = [pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.concatenate(cols[6]) if cols[6] else np.empty(0, "<u4")
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[6]])]).astype("i4")
                arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype("i4")))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the fullest bin that it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - left
        if left > size:
            insort(room, (left - size, b))
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions ask for: no packing has fewer bins.

    Tried are the sizes themselves, rounding to k-ths of a bin, and, for each cut, counting sizes over
    bin less cut as whole bins and dropping those under the cut.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    most = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        most = max(most, -(-int((value * counts).sum()) // (k * capacity)))
    below = np.concatenate([[0], np.cumsum(sizes * counts)])
    ahead = np.concatenate([[0], np.cumsum(counts)])
    for cut in sizes[2 * sizes <= capacity]:
        low, high = np.searchsorted(sizes, cut), np.searchsorted(sizes, capacity - cut, side="right")
        most = max(most, int(ahead[-1] - ahead[high]) + -(-int(below[high] - below[low]) // capacity))
    return most


def pack(pieces: DataFrame, capacity: int = 2048, group: int = 8192, rounds: int = 3) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces of (row, doc_id, piece, start, length, ids_crc32).

    certified is true where the group's bin count met its lower bound. Repeated rows are pieces of their
    own; null ids are kept; no pieces give no rows. At most `rounds` rounds exchange pieces.
    """

    def packed(round_: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            lengths = pdf["length"].to_numpy()
            bins, offsets = best_fit(lengths, capacity)
            n = int(bins.max()) + 1
            fill = np.bincount(bins, weights=lengths, minlength=n)
            out = pdf.assign(sequence_id=(round_ << 58) + pdf["group"].to_numpy() * (1 << 20) + bins, offset=offsets)
            return out.assign(full=fill[bins] == capacity, gap=n - lower_bound(lengths, capacity), first=offsets == 0)

        return run

    schema = _GROUP + ", sequence_id long, offset long, full boolean, gap long, first boolean"
    spark = pieces.sparkSession
    table = stash(pieces.withColumn("key", F.monotonically_increasing_id()), "pack-pieces")

    def dealt(df: DataFrame, round_: int) -> DataFrame:
        n = df.count()
        groups = max(1, -(-n // group))
        df = df.withColumn("group", F.pmod(F.xxhash64(F.lit(round_), "key"), F.lit(groups)))
        columns = [c.split()[0] for c in _GROUP.split(", ")]
        return stash(df.select(*columns).groupBy("group").applyInPandas(packed(round_), schema), f"packed-{round_}")

    done, now = [], dealt(table, 0)
    for round_ in range(1, rounds + 1):
        open_ = (F.col("gap") > 0) & ~F.col("full")
        pool = now.filter(open_)
        done.append(now.filter(~open_))
        before, gap = pool.agg(F.count_if("first"), F.countDistinct(F.struct("group", "gap"))).first()
        if gap < 2:  # nobody to exchange with
            now = pool
            break
        again = dealt(pool, round_)
        after = again.agg(F.count_if("first")).first()[0]
        if after >= before:
            now = pool
            break
        now = again
    for part in done:
        now = now.unionByName(part)
    return now.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("gap") == 0).alias("certified"), "row")


def sequences(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id and the ids of its pieces in order of offset.

    `ids` has row, piece and ids: the stashed pieces that were placed, so that rows have the same numbers.
    """
    whole = placed.join(ids.select("row", "piece", "ids"), ["row", "piece"])
    return whole.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, row for every piece of every row.

    `row` numbers the rows of `docs`, so that the pieces of repeated or null ids are told apart. Null and
    empty texts are one piece with the id `end`; very long texts are cut; repeated rows are packed each;
    other columns are ignored; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end, with_ids=False), capacity, **how)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """(placed, sequences): where `pack_documents` puts each piece, and the token sequences that come of it."""
    pieces = stash(token_pieces(docs, tokenizer, capacity, end), "token-pieces")
    placed = stash(pack(pieces.drop("ids"), capacity, **how), "packed")
    return placed, sequences(pieces, placed)
