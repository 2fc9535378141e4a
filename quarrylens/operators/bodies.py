"""External scripts: which of a page's script URLs may be read, and their bodies out of a large table.

The scope is settled before the join, as a capture settles it before it asks: a URL outside of the page's site is never
looked up.  The URLs that are left prune the table of bodies by a Bloom filter where it is scanned, so that other
bodies never reach the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import scratch
from .sourcemaps import join_url

ASKED, NO_BODY = "asked", "no body"


def pruning(spark: SparkSession) -> SparkSession:
    """A session of the same application in which joins prune their larger side by a Bloom filter, whatever its size."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    return own


def gated(linked: DataFrame, pages: DataFrame) -> DataFrame:
    """``linked`` (page_id, pos, src) with url and outcome: unresolvable, out of scope, or asked.  Only http(s) URLs resolve; the scope is the page's host and its relatives."""
    own = pages.select("page_id", F.col("url").alias("page_url"))
    rows = linked.where("src is not null").select("page_id", "pos", "src").join(own, "page_id").withColumn("url", join_url(F.col("page_url"), F.col("src")))
    # a fragment is no part of what is asked for
    rows = rows.withColumn("url", F.regexp_replace("url", "#[\\s\\S]*$", ""))
    outcome = F.when(F.col("url").isNull(), "unresolvable").when(~urls.related(F.col("url"), urls.host(F.col("page_url"))), "out of scope").otherwise(ASKED)
    return rows.withColumn("outcome", outcome).drop("page_url")


def external(linked: DataFrame, pages: DataFrame, bodies: str, session: SparkSession | None = None) -> DataFrame:
    """(page_id, pos, src, url, outcome, body) of every script with a source; outcome is read, no body, out of scope or unresolvable.

    ``bodies``: path of a Parquet table (url, body), with one row a URL.  The gated rows are written once: the filter on them is what
    the Bloom filter over ``bodies`` is made of.  The result belongs to ``session``, by default one of ``pruning``.
    """
    spark = linked.sparkSession
    path = scratch.fresh(spark, "asked")
    made = gated(linked, pages)
    made.write.parquet(path)
    own = session or pruning(spark)
    rows = own.read.schema(made.schema).parquet(path)
    found = rows.where(F.col("outcome") == ASKED).join(own.read.parquet(bodies).select("url", "body"), "url", "left")
    read = found.select("page_id", "pos", "src", "url", F.when(F.col("body").isNull(), NO_BODY).otherwise("read").alias("outcome"), "body")
    rest = rows.where(F.col("outcome") != ASKED).select("page_id", "pos", "src", "url", "outcome", F.lit(None).cast("string").alias("body"))
    return read.unionByName(rest)
