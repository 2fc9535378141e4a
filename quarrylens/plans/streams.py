"""Queries that run as streams over files of shuffled rows, to the end, and give what their batch forms give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import secrets
from ..sources import scratch
from ..streaming import network
from . import samples as S
from .catalog import _PICKED, ORACLES, query
from .samples import sample

#: Micro-batches that rows are dealt to.
BATCHES = 3


def at_once(spark: SparkSession) -> int:
    """Files of a micro-batch: a file of one row group is read by one task, so there are some for each core."""
    return S.DEAL * spark.sparkContext.defaultParallelism


def shuffled(rows: DataFrame, key: str, last: DataFrame | None = None) -> str:
    """A folder with the rows dealt to files at random, and ``last`` in a file after all others."""
    path = scratch.fresh(rows.sparkSession, "stream")
    rows.repartition(BATCHES * at_once(rows.sparkSession), F.xxhash64(F.lit(5), key)).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return path


@query(ORACLES["network_merge"])
def network_merge_stream(spark, d):
    """All events in shuffled micro-batches; the delay covers the shuffling, and an end of capture gives out the last calls."""
    stamped = sample(spark, d, f"select e.*, t.ts from ({S.EVENTS}) e join events t on e.seq = t.event_id").withColumn("headers", F.create_map().cast("map<string,string>"))
    delay = "60 days"
    path = shuffled(stamped, "seq", network.end_of_capture(stamped, delay))
    own, out = network.session(spark), scratch.fresh(spark, "calls")
    events = own.readStream.schema(stamped.schema).option("maxFilesPerTrigger", at_once(spark)).parquet(path)
    flow = network.merge_stream(events, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    flow.awaitTermination()
    return spark.read.parquet(out).select("page_id", "request_id", "seq", "url", "method", "status", "request_body", "response_body", "response_size")


@query(ORACLES["secret_dedupe"])
def secret_dedupe_stream(spark, d):
    """All artifacts in shuffled micro-batches: least sources as state, and their table kept by idempotent upserts."""
    art = sample(spark, d, S.ARTIFACTS, True)
    path = shuffled(art, "seq")
    own, out = network.session(spark), scratch.fresh(spark, "firsts")
    table = network.Upserts(out, ["page_id", "pattern", "value"], "at", fold=2)
    found = secrets.scan(own.readStream.schema(art.schema).option("maxFilesPerTrigger", at_once(spark)).parquet(path), _PICKED, secrets.PER_ARTIFACT)
    flow = network.first_sources_stream(found).writeStream.foreachBatch(table.put).option("checkpointLocation", f"{out}-state").outputMode("update").trigger(availableNow=True).start()
    flow.awaitTermination()
    return table.table(spark).select("page_id", "pattern", "value", "at.seq", "at.label")
