"""A page's network calls: headers, declared source maps, parties, domains, the rows that a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls, values
from .sourcemaps import references

#: Request headers that tell of credentials.
AUTH = ("authorization", "cookie", "x-api-key", "x-auth-token", "x-client-id")
#: Response headers that name a source map.
MAP_HEADERS = ("sourcemap", "x-sourcemap")
SHOWN = 10


def value_text(v: Column) -> Column:
    """A header's JSON value as text: lists joined by commas, null as the word."""
    kind = F.schema_of_variant(v)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")))
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(items, ", ")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")))


def header_map(json: Column) -> Column:
    """A JSON object of headers as a map; anything else is an empty map."""
    parsed = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(parsed, lambda _, v: value_text(v)), F.create_map().cast("map<string,string>"))


def post_data(entries: Column) -> Column:
    """The pieces of a request's body together; null if there is nothing in them."""
    return F.nullif(F.array_join(entries, ""), F.lit(""))


def map_headers(calls: DataFrame) -> DataFrame:
    """(page_id, seq, referrer, ref): source maps that response headers declare, whatever their case."""
    named = F.filter(F.map_entries("response_headers"), lambda e: F.lower(e["key"]).isin(*MAP_HEADERS))
    return calls.select("page_id", "seq", F.col("url").alias("referrer"), F.explode(F.transform(named, lambda e: e["value"])).alias("ref"))


def map_references(scripts: DataFrame, calls: DataFrame) -> DataFrame:
    """(page_id, seq, referrer, ref) of all source maps, by scripts(page_id, seq, url, text) first, then by headers; none is deduped."""
    said = scripts.select("page_id", "seq", F.col("url").alias("referrer"), F.explode(references(F.col("text"))).alias("ref"))
    return said.union(map_headers(calls).withColumn("seq", F.col("seq") + F.lit(10**9)))


def third_party(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls whose URL doesn't contain the page's whole URL: the text counts, not the host."""
    own = calls.join(targets.select("page_id", F.col("url").alias("target")), "page_id")
    return own.where(~F.contains("url", F.col("target"))).drop("target")


def content_type(calls: DataFrame) -> Column:
    """The recorded type, else the response's header, else the request's."""
    return F.coalesce("response_content_type", urls.header(F.col("response_headers"), "content-type"), urls.header(F.col("request_headers"), "content-type"))


def auth_hints(headers: Column) -> Column:
    """Which credential headers a request has, in upper case, or a dash."""
    there = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    hits = F.filter(F.array(*[F.lit(a) for a in AUTH]), lambda a: F.array_contains(there, a))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda a: F.upper(F.replace(a, F.lit("-"), F.lit(" ")))), ", ")).otherwise("-")


def parties(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, domain, first_party, n): calls by host; a host is the first party's if it equals the page's.  Calls without host are left out."""
    host = targets.select("page_id", urls.host(F.col("url")).alias("target"))
    own = calls.select("page_id", urls.host(F.col("url")).alias("domain")).where("domain is not null").groupBy("page_id", "domain").agg(F.count("*").alias("n"))
    return own.join(host, "page_id").select("page_id", "domain", F.coalesce(F.col("domain") == F.col("target"), F.lit(False)).alias("first_party"), "n")


def totals(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, requests, api, first_party, third_party, domains): a page's calls in numbers; domains are the third parties'."""
    by = parties(calls, targets).groupBy("page_id").agg(F.coalesce(F.sum(F.when(F.col("first_party"), F.col("n"))), F.lit(0)).alias("first_party"), F.coalesce(F.sum(F.when(~F.col("first_party"), F.col("n"))), F.lit(0)).alias("third_party"), F.count_if(~F.col("first_party")).alias("domains"))
    own = calls.groupBy("page_id").agg(F.count("*").alias("requests"), F.count_if(urls.is_api(F.col("url"))).alias("api"))
    return own.join(by, "page_id", "left").select("page_id", "requests", "api", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("first_party", "third_party", "domains")])


def key_calls(calls: DataFrame, n: int | None = SHOWN) -> DataFrame:
    """(page_id, place, method, status, content_type, url, hints): each page's first ``n`` calls to APIs, or simply its first if it has none; without ``n`` all."""
    shown = calls.withColumn("like", urls.is_api_like(F.col("url"))).withColumn("kind", content_type(calls)).withColumn("hints", auth_hints(F.col("request_headers")))
    some = F.max("like").over(Window.partitionBy("page_id"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("seq", "url"))
    rows = shown.withColumn("some", some).where("like or not some").withColumn("place", place)
    rows = rows if n is None else rows.where(F.col("place") <= n)
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    method, status = F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")), F.when(F.coalesce("status", F.lit(0)) == 0, "-").otherwise(F.col("status").cast("string"))
    return rows.select("page_id", "place", method.alias("method"), status.alias("status"), values.clip_middle(cell(F.coalesce("kind", F.lit("-"))), 40).alias("content_type"), cell(values.clip_middle(F.col("url"), 120)).alias("url"), "hints")
