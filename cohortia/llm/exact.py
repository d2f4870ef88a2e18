"""Exact dedup by content-defined chunk recipes.

A text is cut into chunks where a hash of the last bytes says so, so texts that share passages share
chunks. A chunk's identifier is its 64-bit hash and a number that tells different chunks of one hash
apart: it is verified by the chunks themselves, each distinct chunk of a map task moving once. A text's
recipe is the list of its chunks' identifiers; equal recipes are equal texts, and only recipes, about a
hundredth of the texts, are grouped and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.llm.common import stash

#: Bytes of a chunk, at least and at most; between, a cut falls after one byte in 2^CUT_BITS.
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: The copies of one text are joined in so many parts, as one text may hold a third of the rows.
SALTS = 64
#: A random number for each byte, and bytes that decide on a cut.
_BYTES = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)
_BACK = 16

RECIPES = "row long, doc_id long, text_sha256 string, hashes array<long>, chunks array<binary>"


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with each run of ASCII blanks made one space; null is empty."""
    raw = (text or "").encode()
    words = b" ".join(raw.split())  # of bytes, so by ASCII blanks only
    if not words:
        return b" " if raw else b""
    blank = b" \t\n\v\f\r"
    return (b" " if raw[0] in blank else b"") + words + (b" " if raw[-1] in blank else b"")


def cut(data: bytes) -> list[bytes]:
    """The chunks of some bytes, in order; cuts depend on the bytes shortly before them and the last cut only."""
    if len(data) <= LEAST:
        return [data] if data else []
    # The sum of the last bytes' numbers, each shifted by its distance, by doubling.
    h = _BYTES[np.frombuffer(data, np.uint8)]
    back = 1
    while back < _BACK:
        h[back:] += h[:-back] << np.uint32(back)
        back *= 2
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    cuts = [0]
    for end in [*ends, len(data)]:
        while end - cuts[-1] > MOST:
            cuts.append(cuts[-1] + MOST)
        if end - cuts[-1] >= LEAST or end == len(data):
            cuts.append(end)
    return [data[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256 (of the normalised text), hashes and chunks, for each row of `docs`; hashes keep `hash_bits` bits.

    `row` tells rows apart; it holds for one evaluation, so whoever reads this twice stashes it first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, hashes, chunks = [], [], []
            for t in batch.column(2):
                data = normalised(t.as_py())
                sha.append(hashlib.sha256(data).hexdigest())
                chunks.append(cut(data))
                hashes.append([(xxhash.xxh64_intdigest(c) >> (64 - hash_bits)) - (1 << (hash_bits - 1)) for c in chunks[-1]])
            out = [batch.column(0), batch.column(1), pa.array(sha, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "text_sha256", "hashes", "chunks"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RECIPES)


def _told_apart(made: DataFrame) -> DataFrame:
    """(row, apart): for rows that hold a chunk whose hash another chunk has too, the places and numbers of these chunks.

    The first of such chunks has number 0 and is left out.
    """
    parts = made.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("place", "c")).select("row", "place", F.col("c.hashes").alias("h"), F.col("c.chunks").alias("chunk"))
    # Of each hash, the least and the greatest chunk say whether there are two; equal chunks merge before they move.
    shared = parts.groupBy("h").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low <> high")
    shared = stash(shared.select("h"), "shared-hashes")
    several = parts.join(shared, "h")
    # One row for each of the different chunks of a hash.
    ranked = several.select("h", "chunk").distinct().withColumn("nth", F.row_number().over(W.partitionBy("h").orderBy("chunk")) - 1)
    told = several.join(ranked.filter("nth > 0"), ["h", "chunk"])
    return told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "nth"))).alias("apart"))


def duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per row of `docs` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII blanks is made one space; null counts
    as empty. Of equal texts the row with the smallest doc_id stays; null ids come last, and of rows equal
    in id one stays. keep_id is null where all ids of a group are. Whole texts of any length are compared;
    a text lies in one task once, its chunks apart from then on. An empty table gives an empty result,
    other columns are left out.
    """
    made = stash(recipes(docs, hash_bits), "recipes")
    apart = _told_apart(made)
    lists = made.select("row", "doc_id", "text_sha256", "hashes").join(apart, "row", "left")
    lists = lists.withColumn("apart", F.coalesce("apart", F.array().cast("array<struct<place:int,nth:int>>"))).withColumn("salt", F.col("row") % SALTS)
    recipe = ["hashes", "apart"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    parts = lists.groupBy(*recipe, "salt").agg(first.alias("first"), F.count("*").alias("n"))
    groups = parts.groupBy(*recipe).agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    # A recipe meets its group in SALTS rows at most, and each of these one part of its copies.
    found = lists.join(parts.select(*recipe, "salt").join(groups, recipe), [*recipe, "salt"])
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
