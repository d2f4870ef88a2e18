"""Line dedup: repeated windows of three lines, wherever in the corpus, keep their first occurrence only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import stash

#: A window with over one of so many of all windows is broadcast: there are fewer such windows than this.
HOT = 1000


def _full_lines(text: Column) -> Column:
    """Positions of the lines that hold more than blanks."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(lines, lambda s: s["line"].rlike("[^ \\t\\r]"))


def _picked(values: Column, at: Column) -> Column:
    """The elements of `values` at the places `at`; both are worked out once for a row, not for each place."""
    return F.transform(F.array(F.struct(values.alias("v"), at.alias("at"))), lambda s: F.transform(s["at"], lambda i: F.get(s["v"], i)))[0]


def covered(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row, starts): the windows of a document that occurred before, by place among its full lines.

    `row` is a hash of the id and the text. The first occurrence is the one with the least (doc_id, row,
    place). Windows are compared by two 64-bit hashes of their lines.
    """
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _full_lines(F.col("text")).alias("full")).filter(F.size("full") >= width)

    def window(i: Column) -> Column:
        # The full lines of a window have no line end, so joining them with one is unambiguous.
        text = F.concat_ws("\n", *[F.get(F.col("full"), i + k)["line"] for k in range(width)])
        return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), i.alias("place"))

    windows = lines.select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0), F.size("full") - width), window)).alias("w"))
    windows = stash(windows.select("doc_id", "row", "w.h1", "w.h2", "w.place"), "line-windows")
    here = F.struct("doc_id", "row", "place")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(here).alias("first")).filter("n > 1")
    repeated = stash(repeated, "line-repeats")
    total = windows.count()
    hot = F.broadcast(repeated.filter(F.col("n") * HOT > total).select("h1", "h2", "first"))
    common = windows.join(hot, ["h1", "h2"])
    rest = windows.join(hot, ["h1", "h2"], "left_anti").join(repeated.filter(F.col("n") * HOT <= total).select("h1", "h2", "first"), ["h1", "h2"])
    later = common.unionByName(rest).filter(~F.col("first").eqNullSafe(here))
    return later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("place")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, width: int = 3, counts: bool = True) -> DataFrame:
    """`docs` with the lines of repeated windows removed from `text`; with `counts`, n_lines and removed_lines are added.

    A line goes if any window of `width` lines over it occurred before, in an earlier document by doc_id
    or earlier in its own; overlapping windows merge into one run. Blank lines take no part and stay.
    Each window that goes was in the corpus before it; the first window of a kind goes only where another
    window over its lines does. Null texts stay null with no lines; texts of fewer lines than `width` stay
    as they are; rows equal in id and text are one document and stay as they are twice; null ids come
    first; other columns are kept, but with `counts` columns of `docs` by those two names are replaced.
    """
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "removed_lines")]
    found = covered(docs.select("doc_id", "text"), width).select(F.col("doc_id").alias("id"), "row", "starts")
    # The rows' own columns stay in a struct, so that no name clashes.
    rows = docs.select(F.struct(*columns).alias("doc")).withColumn("key", F.xxhash64("doc.doc_id", "doc.text"))
    rows = rows.join(found, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("row")), "left")
    rows = rows.withColumn("lines", F.split(F.coalesce("doc.text", F.lit("")), "\n"))
    # The merged windows' places among the full lines, then among all; both steps hash, so long texts cost no more a line.
    places = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1)))))
    gone = _picked(F.col("full.at"), places)
    rows = rows.withColumn("full", F.when(F.col("starts").isNotNull(), _full_lines(F.col("doc.text"))))
    rows = rows.withColumn("gone", F.when(F.col("starts").isNotNull(), gone))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(_picked(F.col("lines"), stay), "\n")
    text = F.when(F.col("starts").isNull(), F.col("doc.text")).otherwise(left)
    added = [
        F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("removed_lines"),
    ]
    return rows.select(*[(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in columns], *(added if counts else []))
