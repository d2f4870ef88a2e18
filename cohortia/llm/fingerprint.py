"""Document fingerprints: a homomorphic multiset hash of paragraphs, all in DataFrame expressions.

A paragraph (a line that is not blank) hashes to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane, modulo powers of two. So the order of paragraphs does not matter,
and paragraphs are added to or taken from a fingerprint without its document.

The vector has two parts. EXACT lanes modulo 2^62 hold hashes of the whole paragraph, for equality. LANES
lanes modulo 2^24 hold its phrases, for likeness: the hash of a phrase picks the lane and the sign of the
one that it adds. The angle between two documents' lanes tells how many phrases they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortia.functions.arrays import below

EXACT, LANES = 4, 128
_EXACT_MASK, _LANE_MASK = (1 << 62) - 1, (1 << 24) - 1
_MASKS = [_EXACT_MASK] * EXACT + [_LANE_MASK] * LANES
#: Java regexes of what parts the phrases of a line: blanks and punctuation, but after a Latin letter other than
#: e, n, s and t; in lines of mostly wide signs also the place after a sign of scripts without blanks (of Han,
#: those of every other 256). So a cut depends on what stands beside it and on the line only, and phrases are
#: one to a few words.
CUTS = "(?<![abcdfghijklmopqruvwxyz])[\\x20\\x09-\\x0D.!?,;:|]+"
_HAN = "".join(f"\\u{k:04X}-\\u{k + 255:04X}" for k in range(0x4E00, 0xA000, 512))
WIDE_CUTS = f"(?<![abcdfghijklmopqruvwxyz])[\\x20\\x09-\\x0D.!?,;:|\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F]+|(?<![\\x00-\\x7F])(?<=[{_HAN}\\p{{IsHiragana}}\\p{{IsKatakana}}\\p{{IsThai}}\\p{{IsLao}}\\p{{IsKhmer}}\\p{{IsMyanmar}}])"
#: Java regex of what holds more than ASCII blanks.
_FULL = "[^\\x20\\x09-\\x0D]"
#: Blocks of documents for each shuffle partition, so that partitions come out even, and code points that weigh as one document more.
BLOCKS, HEAVY = 4, 4096


def zero() -> Column:
    """The fingerprint of a text without paragraphs."""
    return F.array_repeat(F.lit(0).cast("long"), EXACT + LANES)


def _masks() -> Column:
    return F.array(*[F.lit(m).cast("long") for m in _MASKS])


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two documents' paragraphs together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _masks(), lambda x, m: x.bitwiseAND(m))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint `a` without the paragraphs of `b`."""
    return added(a, F.zip_with(b, _masks(), lambda x, m: (-x).bitwiseAND(m)))


def _phrases(line: Column) -> Column:
    """The phrases of a line, and empty texts between some."""
    return F.when(F.octet_length(line) * 2 > F.length(line) * 3, F.split(line, WIDE_CUTS)).otherwise(F.split(line, CUTS))


def _lane(phrase: Column) -> tuple[Column, Column]:
    """(lane, sign) of a phrase."""
    h = F.xxhash64(phrase)
    return h.bitwiseAND(F.lit(LANES - 1)).cast("int"), (1 - 2 * F.shiftright(h, 7).bitwiseAND(F.lit(1))).cast("long")


def _exact(text: Column) -> Column:
    """The EXACT lanes of a text, as a struct."""
    paragraphs = F.filter(F.split(text, "\\x0A"), lambda p: p.rlike(_FULL))

    def add(acc: Column, p: Column) -> Column:
        return F.struct(*[(acc[f"e{k}"] + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(_EXACT_MASK))).bitwiseAND(F.lit(_EXACT_MASK)).alias(f"e{k}") for k in range(EXACT)])

    return F.aggregate(paragraphs, F.struct(*[F.lit(0).cast("long").alias(f"e{k}") for k in range(EXACT)]), add)


def fingerprint(text: Column) -> Column:
    """The wide vector of a text, as an array of longs; null counts as empty.

    An expression for single paragraphs that come or go; `fingerprints` gives the same for whole tables at
    a fraction of the cost.
    """
    text = F.coalesce(text, F.lit(""))
    phrases = F.filter(F.flatten(F.transform(F.split(text, "\\x0A"), _phrases)), lambda t: t != "")
    cells = F.transform(phrases, lambda t: F.struct(_lane(t)[0].alias("lane"), _lane(t)[1].alias("sign")))
    total = lambda j: F.aggregate(F.filter(cells, lambda c: c["lane"] == j), F.lit(0).cast("long"), lambda s, c: s + c["sign"])
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: total(j).bitwiseAND(F.lit(_LANE_MASK)))
    return F.concat(F.transform(F.array(_exact(text)), lambda e: F.array(*[e[f"e{k}"] for k in range(EXACT)]))[0], lanes)


def fingerprints(rows: DataFrame, keys: list[str], text: str, numbers: dict[str, Column] | None = None) -> DataFrame:
    """(keys, fp, names of `numbers`): the fingerprint of each row's text, null counting as empty.

    `keys` are integers and tell rows apart. Phrases become rows, are hashed in generated code and summed
    by (keys, lane) where they lie, so a long text is never held as a list of all its phrases; `numbers`
    are long expressions of a row that travel in lanes of their own. Rows that are already dealt out by
    some of the keys are not shuffled.
    """
    extra = list((numbers or {}).items())
    rows = rows.select(*keys, F.coalesce(text, F.lit("")).alias("_x"), *[c.alias(f"_v{i}") for i, (_, c) in enumerate(extra)]).withColumn("_e", _exact(F.col("_x")))
    # No line of the text starts with a line end, so such lines carry numbers: a lane of three digits, then the value.
    carried = [F.col(f"_e.e{k}") for k in range(EXACT)] + [F.col(f"_v{i}") for i in range(len(extra))]
    carried = F.array_compact(F.array(*[F.concat(F.lit(f"\n{LANES + k:03d}"), v.cast("string")) for k, v in enumerate(carried)]))
    lines = rows.select(*keys, F.explode(F.concat(carried, F.split("_x", "\\x0A"))).alias("_l"))
    parts = lines.select(*keys, F.explode(F.when(F.col("_l").startswith("\n"), F.array("_l")).otherwise(_phrases(F.col("_l")))).alias("_t")).filter("_t <> ''")
    lane, sign = _lane(F.col("_t"))
    number = F.col("_t").startswith("\n")
    cells = parts.select(*keys, F.when(number, F.substring("_t", 2, 3).cast("int")).otherwise(lane).alias("_lane"), F.when(number, F.expr("cast(substring(_t, 5) AS bigint)")).otherwise(sign).alias("_v"))
    summed = cells.groupBy(*keys, "_lane").agg(F.sum("_v").alias("_v"))
    whole = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_lane", "_v"))).alias("_m"))
    at = lambda k: F.try_element_at("_m", F.lit(k))
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0)).bitwiseAND(F.lit(_LANE_MASK)))
    fp = F.concat(F.array(*[at(LANES + k) for k in range(EXACT)]), lanes)
    return whole.select(*keys, fp.alias("fp"), *[at(LANES + EXACT + i).alias(name) for i, (name, _) in enumerate(extra)])


def text_of(vector: Column) -> Column:
    """The fingerprint as lowercase hexadecimal digits: 16 for each exact lane, 6 for each other."""
    digits = lambda part, n: F.array_join(F.transform(part, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(F.slice(vector, 1, EXACT), 16), digits(F.slice(vector, EXACT + 1, LANES), 6)))


def _signed(vector: Column) -> Column:
    """The likeness lanes as numbers around 0."""
    half = 1 << 23
    return F.transform(F.slice(vector, EXACT + 1, LANES), lambda x: ((x + half).bitwiseAND(F.lit(_LANE_MASK)) - half).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 if the fingerprints are equal, else the cosine of the likeness lanes, not below 0.

    It estimates the cosine of the documents' phrase counts, to about 0.09 where they share none. A phrase
    that a document repeats some eight million times or more wraps its lane, so that it tells nothing.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    near = F.transform(
        F.array(F.struct(_signed(a).alias("x"), _signed(b).alias("y"))),
        lambda s: F.struct(dot(s["x"], s["y"]).alias("xy"), dot(s["x"], s["x"]).alias("xx"), dot(s["y"], s["y"]).alias("yy")),
    )[0]
    cos = F.transform(F.array(near), lambda v: F.when((v["xx"] > 0) & (v["yy"] > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["xy"] / F.sqrt(v["xx"] * v["yy"])))).otherwise(F.lit(0.0)))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(cos)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: see the columns below.

    The edit replaces the last third of a text's code points by as many from the start of the next
    document, in descending order of doc_id (after the last: the first). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A null text is empty; a
    null id comes last; rows of one id go by their text's hash; a single row is its own next; an empty
    table gives an empty result; other columns are ignored.

    Rows are dealt once, into blocks of doc_id of like weight in rows and code points; an id that fills
    several blocks is parted by its texts' hashes. The first row of a block comes to the block before it,
    too, so the next document always lies beside each, and all sums are made where the blocks lie. There
    are `ranges` blocks, or BLOCKS for each shuffle partition.
    """
    spark = docs.sparkSession
    n = ranges or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # Ascending `a` is descending doc_id; null ids come after all others.
    rows = rows.withColumn("a", -1 - F.coalesce("doc_id", F.lit(-(1 << 63))))
    weights = rows.select("a", F.explode(F.sequence(F.lit(0), F.expr(f"length(text) div {HEAVY}"))))
    marks = weights.agg(F.percentile_approx("a", [i / n for i in range(1, n)] or [0.5], max(10_000, 2 * n))).first()[0] or []
    rows = rows.withColumn("h", F.xxhash64("text"))
    if marks:
        cuts = F.split(F.lit(",".join(map(str, sorted(marks)))), ",").cast("array<bigint>")
        rows = rows.withColumn("low", below(cuts, len(marks), F.col("a"))).withColumn("times", below(cuts, len(marks), F.col("a"), True) - F.col("low"))
        share = F.shiftright((F.shiftright("h", 32) + (1 << 31)) * (F.col("times") + 1), 32)
        rows = rows.withColumn("block", F.col("low") + F.when(F.col("times") > 0, share).otherwise(F.lit(0))).drop("low", "times")
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    # The first row of each block, a row each, and the block before it, round the end.
    ends = rows.groupBy("block").agg(F.min(F.struct("a", "h")).alias("first")).withColumn("one", F.lit(1))
    ends = ends.withColumn("for", F.coalesce(F.lag("block").over(W.partitionBy("one").orderBy("block")), F.last("block").over(W.partitionBy("one").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    ends = F.broadcast(ends.select("block", "for", F.col("first.a").alias("a"), F.col("first.h").alias("h")))
    after = rows.join(ends, ["block", "a", "h"]).dropDuplicates(["for"]).select("doc_id", "text", "a", "h", F.col("for").alias("block"), F.lit(1).alias("after"))
    all_ = rows.select("doc_id", "text", "a", "h", "block", F.lit(0).alias("after")).unionByName(after)
    # By range, as hashes of so few blocks would fill some tasks with twice as many as others.
    all_ = all_.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")

    by = W.partitionBy("block").orderBy("after", "a", "h")
    all_ = all_.withColumn("place", F.row_number().over(by)).withColumn("next", F.lead("text").over(by))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.col("next"), F.lit(1), third))
    all_ = all_.select("block", "place", "after", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), third.alias("third"), edited.alias("edited"))
    # Up to the last line end before the edit both texts are the same: they share the sum of those lines.
    rest = F.length(F.substring_index(F.substring("text", F.lit(1), F.length("text") - F.col("third")), "\n", -1))
    all_ = all_.withColumn("cut", F.length("text") - F.col("third") - rest).withColumn("sha", F.sha2("edited", 256))
    part = lambda k, x: F.struct(F.lit(k).alias("kind"), x.alias("x"))
    head, tail = part(0, F.substring("text", F.lit(1), F.col("cut"))), part(1, F.substring("text", F.col("cut") + 1, F.length("text")))
    new = part(2, F.substring("edited", F.col("cut") + 1, F.length("edited")))
    both = all_.select("block", "place", "after", "doc_id", "n_chars", "sha", F.explode(F.when(F.col("after") == 0, F.array(head, tail, new)).otherwise(F.array(head, tail))).alias("s"))
    both = both.select("block", "place", "after", "doc_id", "n_chars", "sha", "s.kind", "s.x")
    mine = (F.col("kind") == 0) & (F.col("after") == 0)
    numbers = {"n_chars": F.when(mine, F.col("n_chars")), "doc_id": F.when(mine, F.col("doc_id"))}
    numbers |= {f"sha_{i}": F.when(mine, F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)}
    found = fingerprints(both, ["block", "place", "kind"], "x", numbers)
    # A row's head, its tail and its new tail, then the next row's head and tail.
    by = W.partitionBy("block").orderBy("place", "kind")
    found = found.select("*", *[F.lead("fp", k).over(by).alias(f"fp_{k}") for k in range(1, 5)]).filter("n_chars IS NOT NULL")
    found = found.select("*", added(F.col("fp"), F.col("fp_1")).alias("own_fp"), added(F.col("fp"), F.col("fp_2")).alias("edited_fp"), added(F.col("fp_3"), F.col("fp_4")).alias("next_fp"))
    return found.select(
        "doc_id",
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"sha_{i}"), 8, "0") for i in range(8)])).alias("edited_sha256"),
        text_of(F.col("own_fp")).alias("fingerprint"),
        text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
    )
