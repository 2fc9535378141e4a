"""Helpers that the corpus operators share: scratch storage, column handling, text normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Where the rows of frequent keys are looked up apart: at most so many keys are broadcast, and a key of so few rows isn't frequent.
HEAVY, LIGHT = 4096, 10_000
_WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A local one is set only where none is configured and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/quarrylens"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/quarrylens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialize`` holds; see ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote since there were ``since``, but the last ``keep``.  What still reads them must be done."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; no task gets all rows of a frequent key.

    ``table`` has one row for each key, with ``n`` rows of ``rows`` at least, which are ``total`` in all; it is read
    twice, so it should be written.  Keys with more than ``total`` / HEAVY rows are HEAVY at most, whatever the
    size: these are broadcast.  The others are shuffled, and none has more rows than that.
    """
    limit = max(LIGHT, total // HEAVY)
    own = table.drop(n)
    if not total or not table.where(F.col(n) > limit).limit(1).count():
        return rows.join(own, key, how)
    heavy, light = table.where(F.col(n) > limit), table.where(F.col(n) <= limit)
    often = rows.join(F.broadcast(heavy.drop(n)), key)
    seldom = rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(light.drop(n), key, how)
    return often.unionByName(seldom)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; a null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fold(df: DataFrame, modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True for held-out rows: crc32 of the key as text, modulo ``modulus``, is ``remainder``.  A null key counts as the empty text."""
    return (F.crc32(F.coalesce(df[key].cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
