"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks.

All of it is DataFrame expressions. The points are van der Corput's, in exact integers: slot i lies where
the reversed bits of i say, and the sources' needs, laid end to end, are the cumulative weights that the
points fall into. The k-th slot of a source takes the k-th block of its shuffled stream, which starts again
when it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.llm.common import BLANKS, stash

#: Slots of a source are listed and ranked in chunks of so many points.
CHUNK = 1 << 16
#: So many sources are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Of the hash that shuffles a source's documents.
_HASH_BITS = 60


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest `bits` bits of a number in reverse order: its place among 2^bits van der Corput points."""
    for shift in (1, 2, 4, 8, 16, 32):
        mask = F.lit(((1 << 64) - 1) // ((1 << shift) + 1))
        x = F.shiftrightunsigned(x, shift).bitwiseAND(mask).bitwiseOR(F.shiftleft(x.bitwiseAND(mask), shift))
    return F.shiftrightunsigned(x, 64 - bits)


def shuffle_hash(doc_id: Column, seed: int) -> Column:
    """A number of 60 bits from the md5 of seed and id, which other engines repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, _HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of words, parted by ASCII blanks; 0 for null."""
    bare = F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target
    stops at `cap` times its source, and what is over goes to the others by weight until none is above.
    In order of the size per weight, the sources that are capped come first, so one pass of running sums
    finds the level at which the rest share.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    src = src.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by = W.orderBy("ratio", "sid")
    before = F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(W.partitionBy())["level"]
    src = src.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return src.select("sid", "source", "source_size", "target")


def _ranked(df: DataFrame, key: str, chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of `value` before each row of a key: within chunks, then over chunk sums.

    No task holds a whole key, only one chunk of it.
    """
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(key, chunk, before.alias("_ahead"))
    own = F.coalesce(F.sum(value).over(W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Listed rows look smaller to the planner than they are, so that it would broadcast them.
    return df.withColumn("_own", own).join(ahead.hint("merge"), [key, chunk]).withColumn(name, (F.col("_own") + F.col("_ahead")).cast("long")).drop("_own", "_ahead")


def _schedule(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3, block: int = 256, seed: int = 7, buckets: int = 4096) -> tuple[DataFrame, DataFrame, int]:
    """(placed, taken, bits): the documents in their shuffled streams, what each slot takes of each, and the slots' bits.

    `sizes` has doc_id, source and size (words); a null size counts as 0. placed: sid, start (place in
    the source's stream), doc_id, size, source_size, target. taken: slot, sid, start, first (word of the
    document), words. Repeated rows are documents of their own.

    All sources together need so many blocks; of the next power of two of points those that fall beyond
    that number are no slots. So each source has just as many slots as it needs, whatever its share, and
    meets its target to the word. As reversing bits twice gives a number back, the slots of a source are
    listed from its own stretch of the cumulative weights, in chunks, and no join by range is needed.
    A slot is below 2^bits, and read in order the slots hold the sources by their shares from the start.
    """
    spark = sizes.sparkSession
    sizes = stash(sizes.select(F.col("doc_id"), F.col("source"), F.coalesce("size", F.lit(0)).cast("long").alias("size")), "mix-sizes")
    src = targets(sizes, weights, cap)
    src = src.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long")))
    src = src.withColumn("tail", F.floor("target") - F.col("passes") * F.col("source_size"))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("tail") / block))
    src = src.withColumn("low", F.coalesce(F.sum("need").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    src = stash(src, "mix-sources")
    n_sources, points = src.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)

    chunks = src.filter("need > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(need - 1) div {CHUNK}")))).repartition("sid", "part")
    place = F.explode(F.sequence(F.col("low") + F.col("part") * CHUNK, F.col("low") + F.least(F.col("need"), (F.col("part") + 1) * CHUNK) - 1))
    slots = chunks.select("sid", "passes", "tail", "blocks", place.alias("place"))
    bits = max(1, (points - 1).bit_length())
    slots = slots.withColumn("id", reversed_bits(F.col("place"), bits)).withColumn("chunk", F.expr(f"id div {CHUNK}"))
    slots = _ranked(slots, "sid", "chunk", ["id"], F.lit(1), "rank")
    # The last pass ends at `tail`, the others at the end of the stream.
    slots = slots.select(F.col("id").alias("slot"), "sid", F.expr("rank % blocks").alias("block"), F.when(F.expr("rank div blocks") == F.col("passes"), F.col("tail")).otherwise(F.lit((1 << 63) - 1)).alias("until"))

    # Repeated rows are one in the shuffle, as long as all of them, or an id with a third of the rows could fill one bucket.
    placed = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    placed = placed.join(small(src.select("sid", F.col("source").alias("of"), "source_size", "target")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("h", shuffle_hash(F.col("doc_id"), seed)).withColumn("bucket", F.expr(f"h div {(1 << _HASH_BITS) // buckets}"))
    placed = _ranked(placed, "sid", "bucket", ["h", "doc_id", "size"], F.col("size") * F.col("times"), "start").drop("h", "bucket")
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("start", F.col("start") + F.col("nth") * F.col("size")).drop("times", "nth")
    pieces = placed.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("block") * block)).withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    met = pieces.join(slots.hint("merge"), ["sid", "block"]).withColumn("to", F.least("to", "until")).filter("to > from")
    taken = met.select("slot", "sid", "start", (F.col("from") - F.col("start")).alias("first"), (F.col("to") - F.col("from")).alias("words"))
    return placed, taken, bits


def mix_plan(sizes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(placed, taken): the documents in their shuffled streams, and what each slot takes of each (see `_schedule`)."""
    return _schedule(sizes, **how)[:2]


def _by_document(placed: DataFrame, taken: DataFrame) -> DataFrame:
    """`placed` with what the mix takes of each document, and by which slots."""
    # Slots are ranked in order, so a document's passes follow one another, each with the slot of its first word first.
    copies = F.sort_array(F.collect_list(F.when(F.col("first") == 0, F.col("slot"))))
    found = taken.groupBy("sid", "start").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"), F.sum("slot").alias("slot_sum"), copies.alias("copies"))
    # Of the documents at one place only the last has words; the others get keys that meet nothing, or a source of empty texts would be one key.
    placed = placed.withColumn("start", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.monotonically_increasing_id()))
    out = placed.join(found, ["sid", "start"], "left").drop("sid", "start")
    return out.withColumn("taken", F.coalesce("words", F.lit(0)).cast("long")).fillna({"first_slot": -1, "slots": 0, "slot_sum": 0})


def mix(sizes: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, slots, slot_sum for every row of `sizes` (see `_schedule`).

    taken counts the words that the mix takes of a document, repeats counted: `cap` times its size at
    most. slots says how many slots take them, first_slot which is the first (-1: none), slot_sum what
    their numbers add up to. Documents of no words take none; null
    sources are one source; an empty table gives an empty result; reruns agree.
    """
    placed, taken, _ = _schedule(sizes, **how)
    return _by_document(placed, taken).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "slots", "slot_sum")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, ...), each as often as the mix takes it, in the order of the schedule.

    A copy stands at the slot of its first word: rows are dealt to partitions by ranges of slots and sorted
    there, so the sources' shares hold in every stretch of the output. A document whose last copy is taken
    in part keeps its first words in that copy. Documents not taken are absent; n_chars, where there is
    one, is counted anew; rows that are equal in doc_id, source and text share what they take.
    """
    columns = docs.columns
    # The rows' own columns stay in a struct, so that no name clashes.
    # `id` and `none` tell null ids apart, so that one shuffle by plain equality does for both steps below.
    row = F.xxhash64(F.lit("row"), "doc_id", "source", "text")
    keyed = docs.select(F.struct(*columns).alias("doc"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), row.alias("row"))
    sizes = keyed.select(F.struct("id", "none", "row").alias("doc_id"), F.col("doc.source").alias("source"), word_count(F.col("doc.text")).alias("size"))
    placed, met, bits = _schedule(sizes, **how)
    taken = _by_document(placed, met).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.sort_array(F.flatten(F.collect_list("copies"))).alias("copies")).filter("taken > 0")
    rows = keyed.dropDuplicates(["id", "none", "row"]).join(taken.select("doc_id.*", "taken", "size", "copies"), ["id", "none", "row"])
    # One slot for each full copy, and for the part that is left.
    rows = rows.withColumn("part", F.col("taken") % F.col("size")).select("*", F.posexplode("copies").alias("copy", "slot"))
    cut = (F.col("copy") == F.size("copies") - 1) & (F.col("part") > 0)
    start = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    rows = rows.withColumn("new", F.when(cut, start).otherwise(F.col("doc.text")))
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.col("slot") / float(1 << bits) * parts).cast("int")
    rows = rows.select(*[made.get(c, F.col("doc").getField(c)).alias(f"{k}") for k, c in enumerate(columns)], "slot", at.alias("at"))
    return rows.repartitionById(parts, "at").sortWithinPartitions("slot").select(*[F.col(f"{k}").alias(c) for k, c in enumerate(columns)])
