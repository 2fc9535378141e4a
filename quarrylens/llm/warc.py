"""WARC captures: reading and writing records, and resolving "not modified" revisits.

A revisit record of a server's 304 answer has no payload.  It is resolved by an as-of join on the
canonical URL to the latest full response before it, if a validator agrees: the entity tag, or else the
date of the last modification.  The answer's permitted headers replace the response's.

The join is a window over captures in order, in two levels so that no task holds a URL's whole history:
first inside (URL, hour), then over one row for each hour, which carries the last response of
earlier hours forward.  Captures without URL or time take no part in it.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The headers that a 304 answer may update (RFC 9111, section 3.2, leaves out those that
#: describe the payload).
PERMITTED = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Seconds in a stretch of time.
STRETCH = 3_600
RECORD = "record_id string, type string, url string, ts timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.``, no scheme, no fragment or tracking parameters, no port that is the scheme's own; the rest of the query sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(r"(?i)^(?:utm_[a-z]+|gclid|fbclid|ref|sessionid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def _unpacked(data: bytes) -> bytes:
    """The members of a gzip file, one after the other; a damaged one is left out."""
    parts = []
    while data:
        d = zlib.decompressobj(31)
        try:
            parts.append(d.decompress(data))
            data = d.unused_data
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", 1)
            data = data[at:] if at > 0 else b""
    return b"".join(parts)


def _headers(lines: list[str]) -> dict[str, str]:
    """Names in lower case; the values of a repeated one are joined with commas."""
    out: dict[str, str] = {}
    for name, colon, value in (x.partition(":") for x in lines):
        if colon:
            k, v = name.strip().lower(), value.strip()
            out[k] = f"{out[k]}, {v}" if k in out else v
    return out


def parse_records(data: bytes) -> list[dict]:
    """The records of a WARC file, gzipped by record or plain.  A damaged record is left out, what follows it is read."""
    data = _unpacked(data) if data[:2] == b"\x1f\x8b" else data
    out, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            break
        head = _headers(data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:])
        size = head.get("content-length", "0")
        n = int(size) if size.isascii() and size.isdigit() else -1
        body = data[head_end + 4 : head_end + 4 + max(n, 0)]
        if n < 0 or len(body) < n:
            at = head_end + 4
            continue
        status, headers, payload = None, {}, body
        if head.get("warc-type") in ("response", "revisit") and body.startswith(b"HTTP/"):
            top, _, payload = body.partition(b"\r\n\r\n")
            first, *lines = top.decode("utf-8", "replace").split("\r\n")
            code = first.split(" ")[1:2]
            status = int(code[0]) if code and code[0].isdigit() else None
            headers = _headers(lines)
        out.append({"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": status, "headers": headers, "payload": payload})
        at = head_end + 4 + n
    return out


def format_record(kind: str, record_id: str, url: str, date: str, status: int, headers: dict[str, str], payload: bytes = b"", pack: bool = False) -> bytes:
    """A record's bytes."""
    body = f"HTTP/1.1 {status} \r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    out = head + body + b"\r\n\r\n"
    return gzip.compress(out, 1, mtime=0) if pack else out


def records(files: DataFrame, content: str = "content") -> DataFrame:
    """The records in a column of WARC files, as ``binaryFile`` reads them."""

    def run(batches):
        for b in batches:
            rows = [r for c in b.column(0).to_pylist() for r in parse_records(c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in (("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()))] + [pa.array([list(r["headers"].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r["payload"] for r in rows], pa.binary())], ["record_id", "type", "url", "date", "status", "headers", "payload"])

    made = files.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, "record_id string, type string, url string, date string, status int, headers map<string,string>, payload binary")
    return made.select("record_id", "type", "url", F.try_to_timestamp("date").alias("ts"), "status", "headers", "payload")


def _tag(headers: Column, name: str) -> Column:
    value = F.try_element_at(headers, F.lit(name))
    return F.regexp_replace(F.trim(value), r"^W/", "") if name == "etag" else F.trim(value)


def resolve_revisits(captures: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``captures`` of type response and revisit, with what each revisit resolves to.

    Needs record_id, type, url, ts, status, headers (keys lower-case); a column ``digest`` stands for the
    payload, which needn't travel.  Result: record_id, type, url_key, ts, status, headers (merged), digest,
    refers_to (the response's record), resolution: "full" for a response, "etag" or "last-modified" for the
    validator that agreed, "mismatch" if one disagrees or none is there, "orphan" without an earlier full response.
    A full response has status 200; other responses are passed through and never referred to.
    Captures at one time go full responses first, then by record_id and digest.  Rows without url or ts can't be
    ordered: they are orphans or full.  Repeated rows each get a row; other columns are ignored.
    """
    kind = F.lower(F.col("type"))
    rows = captures.where(kind.isin("response", "revisit")).select(
        "record_id", kind.alias("type"), canonical_url(F.col("url")).alias("url_key"), "ts", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
        F.floor(F.unix_timestamp("ts") / stretch).alias("stretch"),
    )
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("type") == "response") & (F.col("status") == 200) & placed
    rows = rows.withColumn("own", F.when(full, F.struct("record_id", "headers", "digest", "status")))
    ordered = rows.where(placed)
    place = Window.partitionBy("url_key", "stretch").orderBy("ts", F.col("own").isNull(), "record_id", "digest")
    inside = ordered.withColumn("near", F.last("own", True).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    order = F.struct("ts", "record_id", "digest")
    ends = ordered.where(full).groupBy("url_key", "stretch").agg(F.max_by("own", order).alias("last"))
    every = ordered.where("type = 'revisit'").select("url_key", "stretch").distinct().join(ends, ["url_key", "stretch"], "full")
    past = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = every.withColumn("before", F.last("last", True).over(past)).where("before is not null").select(F.col("url_key").alias("k"), F.col("stretch").alias("s"), "before")
    both = inside.join(before, (F.col("url_key") == F.col("k")) & (F.col("stretch") == F.col("s")), "left").drop("k", "s")
    both = both.unionByName(rows.where(~placed), allowMissingColumns=True)
    base = F.coalesce("near", "before")
    both = both.withColumn("base", F.when((F.col("type") == "revisit") & F.col("ts").isNotNull() & F.col("url_key").isNotNull(), base))
    mine, theirs = F.col("headers"), F.col("base.headers")
    tag, tag0, date, date0 = _tag(mine, "etag"), _tag(theirs, "etag"), _tag(mine, "last-modified"), _tag(theirs, "last-modified")
    verdict = F.when(F.col("type") == "response", "full").when(F.col("base").isNull(), "orphan")
    verdict = verdict.when(tag.isNotNull() & tag0.isNotNull(), F.when(tag == tag0, "etag").otherwise("mismatch"))
    verdict = verdict.when(date.isNotNull() & date0.isNotNull(), F.when(date == date0, "last-modified").otherwise("mismatch")).otherwise("mismatch")
    both = both.withColumn("resolution", verdict)
    good = F.col("resolution").isin("etag", "last-modified")
    allowed = F.map_filter("headers", lambda k, v: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.when(good, F.map_concat(kept, allowed)).otherwise(F.col("headers"))
    return both.select(
        "record_id", "type", "url_key", "ts", F.when(good, F.col("base.status")).otherwise(F.col("status")).alias("status"), merged.alias("headers"),
        F.when(good, F.col("base.digest")).when(F.col("type") == "response", F.col("digest")).alias("digest"), F.when(good, F.col("base.record_id")).alias("refers_to"), "resolution",
    )


def captures_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A capture log of ``pages``; page n is first captured in minute n.

    r: that response.  s: of every second page a changed response ten days later, its URL with a tracking
    parameter and a fragment.  h: of every fourth page a response of its host's root, which pages of one host share.
    w: of every third page a revisit after five days, to the first response.  v: a revisit of every page after thirty
    days, to the last; a third have only a date, and a seventh an outdated tag.  g: every fourth page's revisit
    of its host's root, by date.  x: of every tenth page a revisit before any response.
    A null key counts as 0, a null page as empty, and a null URL stays null.
    """
    n = F.coalesce(pages[key].cast("long"), F.lit(0))
    digest = F.sha2(F.coalesce(pages[page], F.lit("")).cast("binary"), 256)
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + n * 60_000_000
    base = pages.select(n.alias("n"), pages[url].alias("url"), digest.alias("digest"), start.alias("start"), F.length(F.coalesce(pages[page], F.lit(""))).alias("size"))
    at = lambda days: F.timestamp_micros(F.col("start") + F.lit(days * 86_400_000_000))
    day = F.date_format(at(-1), "yyyy-MM-dd")
    tag = lambda d: F.concat(F.lit('"'), F.substring(d, 1, 16), F.lit('"'))
    second = F.sha2(F.concat("digest", F.lit("2")).cast("binary"), 256)
    marked = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=feed#top"))
    root = F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))
    last = F.when(F.col("n") % 2 == 0, second).otherwise(F.col("digest"))

    def capture(some: Column, name: str, address: Column, days: int, digest_: Column | None, etag: Column, modified: Column) -> Column:
        fixed = {"content-type": F.lit("text/html"), "content-length": F.col("size").cast("string"), "cache-control": F.lit("max-age=60")} if digest_ is not None else {"content-length": F.lit("0"), "cache-control": F.lit("max-age=600")}
        heads = F.create_map(*[x for k, v in {**fixed, "etag": etag, "last-modified": modified}.items() for x in (F.lit(k), v)])
        made = F.struct(
            F.concat(F.lit(name), "n").alias("record_id"), F.lit("revisit" if digest_ is None else "response").alias("type"), address.alias("url"), at(days).alias("ts"), F.lit(304 if digest_ is None else 200).alias("status"),
            F.map_filter(heads, lambda _, v: v.isNotNull()).alias("headers"), (F.lit(None) if digest_ is None else digest_).cast("string").alias("digest"),
        )
        return F.when(some, made)

    nth = F.col("n")
    none, always = F.lit(None).cast("string"), F.lit("2023-06-01")
    stale = F.when(nth % 3 == 1, none).when(nth % 7 == 3, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), tag(last)))
    made = F.array(
        capture(F.lit(True), "r", F.col("url"), 0, F.col("digest"), tag(F.col("digest")), day),
        capture(nth % 2 == 0, "s", marked, 10, second, tag(second), day),
        capture(nth % 4 == 0, "h", root, 0, second, none, always),
        capture(nth % 3 == 0, "w", F.col("url"), 5, None, tag(F.col("digest")), none),
        capture(F.lit(True), "v", F.col("url"), 30, None, stale, day),
        capture(nth % 4 == 2, "g", root, 1, None, none, always),
        capture(nth % 10 == 0, "x", F.col("url"), -400, None, tag(F.col("digest")), none),
    )
    return base.select(F.inline(F.array_compact(made)))


def page_revisits(pages: DataFrame) -> DataFrame:
    """The resolved capture log of ``pages``, headers as text; see ``captures_of_pages`` and ``resolve_revisits``.

    A null page_id counts as 0; pages without URL have full responses and orphans; repeated pages each get their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    found = resolve_revisits(captures_of_pages(pages))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(F.expr("cast(substring(record_id, 2) as bigint)").alias("page_id"), "record_id", "type", "url_key", F.col("ts").cast("string").alias("captured"), "status", F.array_join(entries, ";").alias("headers"), "digest", "refers_to", "resolution")


def _sql() -> str:
    """Captures as columns, each revisit's base by a join on the canonical URL, the latest one picked by row."""
    quote = lambda d: f"'\"' || substr({d}, 1, 16) || '\"'"
    when = lambda days: f"tm + interval ({days}) day"
    last = "case when n % 2 = 0 then second else digest end"
    kinds = [
        ("r", "true", "url", 0, "digest", quote("digest"), "day"),
        ("s", "n % 2 = 0", "url || case when contains(url, '?') then '&' else '?' end || 'utm_source=feed#top'", 10, "second", quote("second"), "day"),
        ("h", "n % 4 = 0", "root", 0, "second", "null", "'2023-06-01'"),
        ("w", "n % 3 = 0", "url", 5, None, quote("digest"), "null"),
        ("v", "true", "url", 30, None, f"case when n % 3 = 1 then null when n % 7 = 3 then '\"outdated\"' else 'W/' || {quote(f'({last})')} end", "day"),
        ("g", "n % 4 = 2", "root", 1, None, "null", "'2023-06-01'"),
        ("x", "n % 10 = 0", "url", -400, None, quote("digest"), "null"),
    ]
    each = " union all ".join(
        f"select n, '{k}' || n as record_id, '{'revisit' if d is None else 'response'}' as type, {u} as url, {when(t)} as ts, {'null::varchar' if d is None else d} as digest, {e}::varchar as etag, {m}::varchar as modified, "
        f"{chr(39) + '0' + chr(39) if d is None else 'size::varchar'} as size from p where {some}"
        for k, some, u, t, d, e, m in kinds
    )
    shown = "'cache-control=max-age={0}' || ';content-length=' || {1} || {2} || coalesce(';etag=' || {3}, '') || coalesce(';last-modified=' || {4}, '')"
    html = "';content-type=text/html'"
    return rf"""
with o as (select coalesce(page_id, 0) as n, url, sha256(coalesce(html, '')) as digest, length(coalesce(html, '')) as size from pages),
p as (select *, sha256(digest || '2') as second, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' as root, timestamp '2024-01-01 00:00:00' + to_minutes(n) as tm,
  strftime(timestamp '2024-01-01 00:00:00' + to_minutes(n) - interval 1 day, '%Y-%m-%d') as day from o),
c as ({each}),
u as (select *, row_number() over () as id, regexp_replace(trim(url), '#.*$', '') as u from c),
v as (select *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)) as h, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as rest from u),
w as (select *, regexp_replace(case scheme when 'http' then regexp_replace(h, ':80$', '') when 'https' then regexp_replace(h, ':443$', '') else h end, '^www[0-9]*\.', '') as host, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:utm_[a-z]+|gclid|fbclid|ref|sessionid)='))) as q from v),
k as (select *, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url_key from w),
f as (select * from k where type = 'response'),
j as (select s.*, f.record_id as base, f.digest as base_digest, f.size as base_size, f.etag as base_tag, f.modified as base_modified from (select * from k where type = 'revisit') s
  left join f on s.url_key = f.url_key and f.ts <= s.ts qualify row_number() over (partition by s.id order by f.ts desc, f.record_id desc, f.digest desc) = 1),
x as (select *, case when base is null then 'orphan' when etag is not null and base_tag is not null then case when regexp_replace(etag, '^W/', '') = base_tag then 'etag' else 'mismatch' end
  when modified is not null and base_modified is not null then case when modified = base_modified then 'last-modified' else 'mismatch' end else 'mismatch' end as resolution from j),
y as (select *, resolution in ('etag', 'last-modified') as good from x)
select n as page_id, record_id, type, url_key, strftime(ts, '%Y-%m-%d %H:%M:%S') as captured, (case when good then 200 else 304 end)::int as status,
  case when good then {shown.format("600", "base_size", html, "coalesce(etag, base_tag)", "coalesce(modified, base_modified)")} else {shown.format("600", "size", "''", "etag", "modified")} end as headers,
  case when good then base_digest end as digest, case when good then base end as refers_to, resolution from y
union all select n, record_id, type, url_key, strftime(ts, '%Y-%m-%d %H:%M:%S'), 200::int, {shown.format("60", "size", html, "etag", "modified")}, digest, null, 'full' from f
"""


#: DuckDB's SQL for ``page_revisits`` over ``pages``.
SQL = _sql()
