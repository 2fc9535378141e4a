"""The streams give what the batch operators give, in whatever order micro-batches come."""

import itertools
import json
import random
import time

from pyspark.sql import functions as F

from quarrylens.operators import secrets
from quarrylens.sources import scratch
from quarrylens.streaming import network

SCHEMA = "page_id long, request_id string, kind string, seq long, url string, method string, status int, headers map<string,string>, body string, size long, ts timestamp"


def _events(rng):
    """Calls with redirects after an end, responses without request, requests that aren't http, ends without call, repeated events."""
    out, seq = [], 0
    for k in range(60):
        base = 1_700_000_000 + 40 * k
        key = (k % 7, f"r{k // 2}" if k % 2 else f"s{k}")
        for kind in rng.choice([["request", "response", "finished"], ["request", "response", "finished", "request", "response", "finished"], ["response", "finished"], ["finished"], ["request"], ["finished", "request", "response"]]):
            seq += 1
            url = rng.choice(["http://x/", "https://y/", "data:z", None]) if kind == "request" else f"http://answer/{seq}"
            out.append((*key, kind, seq, url, rng.choice(["GET", "POST", None]), rng.choice([None, 200, 70_000, -1]), rng.choice([None, {"Content-Type": "a/b"}, {"x": "1", "content-type": "t"}]), rng.choice([None, "", f"b{seq}"]), seq, base + rng.randint(0, 5)))
    return out


def _shown(df, columns):
    return sorted(map(str, df.select(*[F.to_json(F.array_sort(F.map_entries(c))) if c.endswith("_headers") else F.col(c) for c in columns]).collect()))


def _frame(spark, rows):
    return spark.createDataFrame([(*r[:-1], float(r[-1])) for r in rows], SCHEMA.replace("ts timestamp", "t double")).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def _started(own, folder, state, delay, **more):
    events = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return network.merge_stream(events, delay, **more).writeStream.format("parquet").option("path", f"{state}-out").option("checkpointLocation", state).outputMode("append")


def test_merging_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = _events(rng)
    rng.shuffle(rows)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(4):
        _frame(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(folder)
    whole = _frame(spark, rows)
    network.end_of_capture(whole, "2 hours").coalesce(1).write.mode("append").parquet(folder)
    flow = _started(network.session(spark), folder, state, "2 hours").trigger(availableNow=True).start()
    flow.awaitTermination()
    want = network.merge(whole)
    assert _shown(spark.read.parquet(f"{state}-out"), want.columns) == _shown(want, want.columns)
    assert want.count() > 30


def test_late_events_are_counted_and_a_restart_goes_on(spark, tmp_path):
    at = 1_700_000_000
    call = lambda seq, key, kind, t: (1, key, kind, seq, f"http://{seq}/", "GET", 200, None, "b", 1, at + t)
    first = [call(1, "a", "request", 0), call(2, "a", "response", 1)]
    second = [call(3, "b", "request", 1000)]
    late = [call(4, "a", "request", 2), call(5, "c", "request", 3), call(6, "b", "finished", 1001)]
    folder, state, own, side = str(tmp_path / "in"), str(tmp_path / "state"), network.session(spark), network.LateRows()
    own.streams.addListener(side)
    try:
        for rows in (first, second, [call(7, "d", "request", 1002)], late, [call(8, "e", "request", 9000)]):
            _frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
            flow = _started(own, folder, state, "1 minute").trigger(availableNow=True).start()  # each time from the state that the last one left
            flow.awaitTermination()
        until = time.time() + 30
        while sum(n for _, _, n in side.rows) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        own.streams.removeListener(side)
    assert sum(n for _, _, n in side.rows) == 2
    got = {r["request_id"]: (r["seq"], r["response_body"]) for r in spark.read.parquet(f"{state}-out").collect()}
    assert got == {"a": (1, None), "b": (3, "b"), "d": (7, None)}  # a without its late redirect, c not at all, e still open


def test_events_are_absorbed_in_any_order():
    rows = [dict(zip(("kind", "seq", "url", "method", "status", "headers", "body", "size"), r)) for r in (("request", 1, "http://a", "GET", None, "{}", None, None), ("response", 2, "http://a", None, 302, "{}", None, None), ("finished", 3, None, None, None, None, "old", 3), ("request", 4, "http://b", "POST", None, "{}", "x", None), ("finished", 5, None, None, None, None, "new", 4), ("end", 9, None, None, None, None, None, None))]
    ends = set()
    for order in itertools.permutations(rows):
        now = dict.fromkeys(network._FIELDS)
        for r in order:
            network.absorb(now, r)
        ends.add(json.dumps(now))
    assert len(ends) == 1


def test_first_sources_of_a_stream_in_any_order(spark, tmp_path):
    art = spark.createDataFrame([(k % 5, k, f"label{k}", f"x AKIA{'ABCDEFGH'[k % 8] * 16} y AKIA{'XYZ'[k % 3] * 16} ") for k in range(120)], "page_id long, seq long, label string, text string")
    rows = art.collect()
    random.Random(1).shuffle(rows)
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(7):
        spark.createDataFrame(rows[k::7], art.schema).coalesce(1).write.mode("append").parquet(folder)
    table, seen = network.Upserts(out, ["page_id", "pattern", "value"], "at", fold=2), []

    def put(batch, n):
        held = spark.createDataFrame(batch.collect(), batch.schema)
        table.put(held, n)
        table.put(held, n)  # a batch that is replayed changes nothing
        seen.append(n)

    found = secrets.scan(network.session(spark).readStream.schema(art.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    flow = network.first_sources_stream(found).writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    flow.awaitTermination()
    assert len(seen) == 7 and any(n.startswith("base=") for n in scratch.names(spark, out))
    table.put(spark.createDataFrame([(0, "p", "v", (1, "l"))], table.table(spark).schema), 0)  # folded long ago
    want = secrets.first_sources(secrets.scan(art))
    got = table.table(spark).select("page_id", "pattern", "value", "at.seq", "at.label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_micro_batch_is_read_by_all_cores(spark):
    from quarrylens.plans import streams

    rows = spark.range(40_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    files = spark.read.parquet(streams.shuffled(rows, "id")).groupBy(F.input_file_name()).count().collect()
    n = streams.BATCHES * streams.at_once(spark)
    assert len(files) == n and streams.at_once(spark) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in files) == 40_000 and max(r["count"] for r in files) < 2 * 40_000 / n


def test_a_timer_moves_only_when_it_expires():
    from types import SimpleNamespace

    class State:
        held = None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    timers, calls = [], network.Calls(10)
    calls.handle, calls.call = SimpleNamespace(registerTimer=timers.append), State()
    event = lambda seq, at: {"event": json.dumps(dict.fromkeys(("url", "method", "status", "headers", "body", "size")) | {"kind": "request", "seq": seq, "url": f"https://h/{seq}", "at": at})}
    at = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    for batch in ([event(1, 100), event(2, 105)], [event(4, 300), event(3, 200)], [event(5, 250)]):
        assert list(calls.handleInputRows((1, "a"), iter(batch), at(0))) == []
    assert timers == [115]
    assert list(calls.handleExpiredTimer((1, "a"), at(309), None)) == [] and timers == [115, 310]
    (row,) = calls.handleExpiredTimer((1, "a"), at(310), None)
    assert (row["seq"], row["url"]) == (1, "https://h/5") and calls.call.get() is None
    assert list(calls.handleExpiredTimer((1, "a"), at(400), None)) == [] and timers == [115, 310]
