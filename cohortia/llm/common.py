"""What the operators of this subpackage share: scratch tables, hash splits, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.sources.scratch import settled, stash  # noqa: F401  (where the operators write what they read again)

#: Java regex for the blanks that part words: space and \x09-\x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Java regex for a word.
WORD = "[^\\x20\\x09-\\x0D]+"


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the first by a hash of `key`: the same rows in every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit("sample")), F.col(key)).limit(most)
