"""A corpus pipeline over documents: each stage applies one operator of cohortia.llm to all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but
the last return the columns of documents. `run` applies them to documents, each stage written as Parquet
in the shared scratch folder and read again; what a stage wrote on the way is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import lines, mixing, packing, quality, simhash
from cohortia.llm.common import remainder, settled
from cohortia.llm.queries import table, tokenizer_path

#: A document with a lower quality score is rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores under LEAST_QUALITY.

    It learns from labels outside the held-out fifth, as op6 does. Rows equal in id and text have equal
    scores and stay or go together.
    """
    columns = docs.columns
    trees = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.keep(docs, trees, LEAST_QUALITY).select(*columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows but their first occurrence; n_chars is counted anew."""
    out = lines.drop_repeated_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of texts of five-word similarity 0.8 or more the document with the smallest id, once if it is repeated."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, copies included, into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
