"""The corpus pipeline: quality, near copies, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets all that the one before kept.  All but the last return the
columns of ``documents``, whatever others there are; labels come from the folder, and only those outside the
quality query's held-out fold are learned from.  Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm.common import discard, materialize, written
from quarrylens.llm.mixing import mix
from quarrylens.llm.packing import pack
from quarrylens.llm.pii import redact
from quarrylens.llm.quality import keep_good
from quarrylens.llm.setjoin import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier rejects go; rows are otherwise unchanged.

    Null and wordless texts are judged as one empty passage; repeated rows stay or go together.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles stays: the one with the smallest key.

    Of equal rows one stays; rows without words link with nothing and all stay; a null key counts as the largest.
    """
    return keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets, and n_chars follows.

    No row goes; null and empty texts stay as they are; repeated rows change alike.
    """
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole.

    Null and wordless texts add nothing to a mix and go; a null source is a source of its own.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, one row each; a null text is one token, the end."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents.  What a stage needed only itself is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, begin, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
