"""Merging a browser's network events into calls: in batch as an aggregation, on a stream with keyed state and event-time timers.

Events: page_id, request_id, kind (request, response, finished), seq, url, method, status, headers, body,
size.  A request that isn't http(s) is dropped; a later request under an id overwrites an earlier one (redirects);
a response fills url and headers only where no request did; a body counts only if the call exists by then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import scratch


def _typed(events: DataFrame, *more: str) -> DataFrame:
    return events.select(*more, F.col("page_id").cast("long"), F.col("request_id").cast("string"), "kind", F.col("seq").cast("long"), "url", "method", F.col("status").cast("int"), "headers", "body", F.col("size").cast("long"))


def merge(events: DataFrame) -> DataFrame:
    """One row for each call.  A single aggregation by key, combined before the shuffle."""
    e = _typed(events)
    kind, seq = F.col("kind"), F.col("seq")
    asked = (kind == "request") & F.rlike("url", F.lit("^https?:"))
    answered = kind == "response"
    request = F.max_by(F.when(asked, F.struct("url", "method", "headers", "body")), F.when(asked, seq)).alias("q")
    response = F.max_by(F.when(answered, F.struct("url", "status", "headers")), F.when(answered, seq)).alias("p")
    first = F.min(F.when(asked | answered, seq)).alias("seq")
    final = F.max_by(F.when((kind == "finished") & F.col("body").isNotNull(), F.struct("body", "size", "seq")), F.when((kind == "finished") & F.col("body").isNotNull(), seq)).alias("f")
    rows = e.groupBy("page_id", "request_id").agg(request, response, first, final).where("seq is not null")
    status = F.when(F.col("p.status").between(0, 65535), F.col("p.status")).otherwise(0)
    headers = F.col("p.headers")
    kind_ = F.get(F.filter(F.map_entries(headers), lambda x: F.lower(x["key"]) == "content-type"), F.lit(0))["value"]
    there = F.col("f.seq") > F.col("seq")
    return rows.select(
        "page_id", "request_id", "seq", F.coalesce("q.url", "p.url").alias("url"), F.coalesce("q.method", F.lit("")).alias("method"), F.when(F.col("p").isNotNull(), status).otherwise(0).cast("int").alias("status"),
        F.coalesce("q.headers", F.create_map().cast("map<string,string>")).alias("request_headers"), F.coalesce(headers, F.create_map().cast("map<string,string>")).alias("response_headers"), kind_.alias("response_content_type"),
        F.nullif("q.body", F.lit("")).alias("request_body"), F.when(there, F.col("f.body")).alias("response_body"), F.when(there, F.col("f.size")).alias("response_size"),
    )


_STATE = "q_seq long, url string, method string, request_headers string, request_body string, p_seq long, p_url string, status int, response_headers string, first long, f_seq long, body string, size long, until long"
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]
#: Milliseconds of event time that a call waits for more.
WAIT = 60_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def absorb(now: dict, row) -> None:
    """One event into a call's state.  The order of events doesn't matter: ``seq`` decides, as in ``merge``."""
    seq = row["seq"]
    if row["kind"] == "request" and (row["url"] or "").startswith(("http:", "https:")):
        if now["q_seq"] is None or seq > now["q_seq"]:
            now |= {"q_seq": seq, "url": row["url"], "method": row["method"], "request_headers": row["headers"], "request_body": row["body"]}
    elif row["kind"] == "response":
        if now["p_seq"] is None or seq > now["p_seq"]:
            code = row["status"]
            now |= {"p_seq": seq, "p_url": row["url"], "status": code if code is not None and 0 <= code <= 65535 else 0, "response_headers": row["headers"]}
    else:
        if row["kind"] == "finished" and row["body"] is not None and (now["f_seq"] is None or seq > now["f_seq"]):
            now |= {"f_seq": seq, "body": row["body"], "size": row["size"]}
        return
    now["first"] = seq if now["first"] is None else min(seq, now["first"])


class Calls(StatefulProcessor):
    """A value for each call, in event time: its one timer gives it out when ``wait`` has passed after its latest event, or is set anew if that came meanwhile.

    A row's ``event`` has its fields as JSON: each column of a row costs as much to be brought to Python.
    """

    def __init__(self, wait: int = WAIT) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.call.get()
        now = dict.fromkeys(_FIELDS) if known is None else dict(zip(_FIELDS, known))
        last = 0
        for row in rows:
            event = json.loads(row["event"])
            absorb(now, event)
            last = max(last, event["at"])
        now["until"] = max(last + self.wait, now["until"] or 0)
        if known is None:
            self.handle.registerTimer(now["until"])
        self.call.update(tuple(now[n] for n in _FIELDS))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.call.get()
        if known is None:
            return
        now = dict(zip(_FIELDS, known))
        if now["until"] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(now["until"])
            return
        self.call.clear()
        if now["first"] is None:
            return
        there = now["f_seq"] is not None and now["f_seq"] > now["first"]
        yield Row(
            page_id=key[0], request_id=key[1], seq=now["first"], url=now["url"] if now["q_seq"] is not None and now["url"] is not None else now["p_url"], method=now["method"] or "", status=now["status"] or 0,
            request_headers=now["request_headers"], response_headers=now["response_headers"], request_body=now["request_body"] or None, response_body=now["body"] if there else None, response_size=now["size"] if there else None,
        )

    def close(self) -> None:
        pass


_GIVEN = "page_id long, request_id string, seq long, url string, method string, status int, request_headers string, response_headers string, request_body string, response_body string, response_size long"


def merge_stream(events: DataFrame, delay: str = "10 minutes", wait: int = WAIT) -> DataFrame:
    """The same merge on a stream with an event time ``ts``: a call is given out once, when the watermark has passed ``wait`` milliseconds after its latest event.

    An end doesn't give a call out at once: a redirect's next request under the same id belongs to it.  Micro-batches may come in any
    order, because ``seq`` decides what overwrites.  An event later than the watermark, ``delay`` behind the latest, is left out and counted
    (see ``LateRows``).  State is one value and one timer a call, in RocksDB: start the query in a ``session`` of this module's.
    """
    slim = _typed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts").withColumn("at", F.unix_millis("ts")).withColumn("headers", F.to_json("headers")).withWatermark("ts", delay)
    event = F.to_json(F.struct("kind", "seq", "url", "method", "status", "headers", "body", "size", "at"), {"ignoreNullFields": "false"})
    given = slim.select("ts", "page_id", "request_id", event.alias("event")).groupBy("page_id", "request_id").transformWithState(Calls(wait), _GIVEN, "append", "eventTime")
    maps = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(c)
    out = given.select("page_id", "request_id", "seq", "url", "method", "status", maps("request_headers"), maps("response_headers"), "request_body", "response_body", "response_size")
    kind = F.get(F.filter(F.map_entries("response_headers"), lambda x: F.lower(x["key"]) == "content-type"), F.lit(0))["value"]
    return out.select("page_id", "request_id", "seq", "url", "method", "status", "request_headers", "response_headers", kind.alias("response_content_type"), "request_body", "response_body", "response_size")


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


class LateRows(StreamingQueryListener):
    """The side output of late events: (query, batch, rows) of each micro-batch in which the watermark left events out."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if late:
            self.rows.append((str(p.id), p.batchId, late))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def end_of_capture(events: DataFrame, delay: str, wait: int = WAIT) -> DataFrame:
    """One event after all others, which moves the watermark past every call; it is no part of any."""
    last = events.agg((F.max("ts") + F.expr(f"interval {delay}") + F.expr(f"interval {wait + 1000} milliseconds")).alias("ts"))
    return last.select(*[F.lit("end").alias(c) if c == "kind" else F.col("ts") if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])


def first_sources_stream(found: DataFrame) -> DataFrame:
    """Every (page, pattern, value) of a stream of matches (``secrets.scan``) with the first artifact so far that has it; for update mode.

    The state is one least (seq, label) a value.  Its output is given to ``Upserts``, whose table is that of ``secrets.first_sources``.
    """
    each = found.select("page_id", "pattern", F.explode("matches").alias("value"), F.struct("seq", "label").alias("at"))
    return each.groupBy("page_id", "pattern", "value").agg(F.min("at").alias("at"))


class Upserts:
    """A keyed table that micro-batches are put into: of a key the least ``value`` stays, so that order and replays change nothing.

    A batch is one folder, written anew if it is replayed.  After ``fold`` batches all are folded into a base table, which
    counts once it is complete; only then what it holds is deleted.
    """

    def __init__(self, path: str, keys: list[str], value: str, fold: int = 16) -> None:
        self.path, self.keys, self.value, self.fold = path.rstrip("/"), keys, value, fold

    def _parts(self, spark: SparkSession) -> tuple[int | None, list[int]]:
        """The newest complete base, by its last batch, and the batches after it."""
        there = scratch.names(spark, self.path)
        bases = [int(n[5:]) for n in there if n.startswith("base=") and "_SUCCESS" in scratch.names(spark, f"{self.path}/{n}")]
        base = max(bases, default=None)
        batches = [int(n[6:]) for n in there if n.startswith("batch=") and "_SUCCESS" in scratch.names(spark, f"{self.path}/{n}")]
        return base, sorted(b for b in batches if base is None or b > base)

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        base, batches = self._parts(spark)
        if base is not None and batch_id <= base:
            return  # folded already
        batch.select(*self.keys, self.value).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        before = [b for b in batches if b < batch_id]
        if len(before) >= self.fold:  # the last one may be replayed, so it stays apart
            self._rows(spark, base, before, batch.schema).write.mode("overwrite").parquet(f"{self.path}/base={before[-1]}")
            for b in before:
                scratch.delete(spark, f"{self.path}/batch={b}")
            if base is not None:
                scratch.delete(spark, f"{self.path}/base={base}")

    def _rows(self, spark: SparkSession, base: int | None, batches: list[int], schema=None) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in batches] + ([f"{self.path}/base={base}"] if base is not None else [])
        return spark.read.parquet(*paths).groupBy(*self.keys).agg(F.min(self.value).alias(self.value))

    def table(self, spark: SparkSession) -> DataFrame:
        """The table as it is now."""
        base, batches = self._parts(spark)
        if base is None and not batches:
            raise ValueError(f"no batch in {self.path}")
        return self._rows(spark, base, batches)
