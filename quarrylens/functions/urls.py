"""URL predicates as column expressions.  Hosts are compared in lower case; null where a URL has none.

The engine keeps five notions of "first party" apart, as the detectors that use them differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a static or framework resource.
STATIC_EXTENSIONS = (".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map", ".webp", ".avif", ".mp4", ".webm", ".mp3", ".ogg", ".wav")
FRAMEWORK_PARTS = ("/_next/", "/_nuxt/", "/_vercel/", "/_gatsby/", "/cdn-cgi/", "?_rsc=", "&_rsc=", "/favicon")
CDN_HOSTS = ("cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "fonts.googleapis.com", "fonts.gstatic.com", "api.iconify.design", "cdn.amplitude.com", "cdn.segment.com", "cdn.mxpnl.com")
MIME_STARTS = ("font/", "image/", "video/", "audio/")
MIME_PARTS = ("application/font", "text/css", "application/javascript", "text/javascript")
API_PARTS = ("/api/", "/graphql", "/v1/", "/v2/", "/v3/")
WORDPRESS_PARTS = ("/wp-content/", "/wp-includes/", "/wp-json/", "rest_route=/")


def any_of(column: Column, parts: tuple[str, ...]) -> Column:
    """Whether the column contains any of the literals."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(column, F.lit(p))
    return found


def host(url: Column) -> Column:
    """The host in lower case; of a URL that Spark's strict parser refuses (a bar in its path, say) what stands in its place."""
    placed = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), placed)), F.lit(""))


def _below(inner: Column, outer: Column) -> Column:
    return F.endswith(inner, F.concat(F.lit("."), outer))


def related(url: Column, target: Column) -> Column:
    """Host equal to the target's, or a subdomain of it either way; unknown host or target counts as related."""
    h = host(url)
    return F.coalesce((h == target) | _below(h, target) | _below(target, h), F.lit(True))


def same_host(url: Column, target: Column) -> Column:
    """Host exactly the target's; unknown counts as the same."""
    return F.coalesce(host(url) == target, F.lit(True))


def under(url: Column, target: Column) -> Column:
    """Host equal to the target's, or a subdomain of it; unknown counts as under."""
    h = host(url)
    return F.coalesce((h == target) | _below(h, target), F.lit(True))


def in_scope(url: Column, target: Column) -> Column:
    """Like ``related``, but a URL without host is out of scope; without target all is in scope."""
    h = host(url)
    return F.when(target.isNull(), True).when(h.isNull(), False).otherwise((h == target) | _below(h, target) | _below(target, h))


def origin(url: Column, target: Column) -> Column:
    """first, third or unknown: unknown without target, first without host."""
    h = host(url)
    return F.when(target.isNull(), "unknown").when(h.isNull(), "first").when((h == target) | _below(h, target) | _below(target, h), "first").otherwise("third")


def is_map(url: Column) -> Column:
    return F.endswith(F.lower(F.element_at(F.split(url, "[?#]"), 1)), F.lit(".map"))


def is_static(url: Column, content_type: Column) -> Column:
    """Where a wildcard CORS header is expected: static files, framework internals, public CDNs, media types."""
    low, kind = F.lower(url), F.lower(F.coalesce(content_type, F.lit("")))
    path = F.element_at(F.split(low, r"\?"), 1)
    found = any_of(low, FRAMEWORK_PARTS) | any_of(low, CDN_HOSTS) | any_of(kind, MIME_PARTS)
    for e in STATIC_EXTENSIONS:
        found = found | F.endswith(path, F.lit(e))
    for m in MIME_STARTS:
        found = found | F.startswith(kind, F.lit(m))
    return found


def is_api(url: Column) -> Column:
    return any_of(url, (*API_PARTS, ".json"))


def is_api_like(url: Column) -> Column:
    return any_of(url, API_PARTS) | F.endswith(url, F.lit(".json"))


def query_pairs(url: Column) -> Column:
    """The query's (key, value) pairs in order, decoded; undecodable ones stay as they are."""
    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.element_at(F.split(p, "="), 1)).alias("key"), decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))


def header(headers: Column, name: str) -> Column:
    """The first value whose key equals ``name`` whatever the case."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]


#: A reference's scheme, authority with its slashes, path, query and fragment with their marks, as RFC 3986 parts them; empty where absent.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def parts_of(url: Column) -> Column:
    """struct(scheme, authority, path, query, fragment); authority, query and fragment keep their marks, so that empty and absent differ."""
    piece = lambda k: F.regexp_extract(url, _PARTS, k)
    return F.struct(piece(1).alias("scheme"), piece(2).alias("authority"), piece(3).alias("path"), piece(4).alias("query"), piece(5).alias("fragment"))


def without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments worked off, as a fold over its segments."""
    rooted = F.startswith(path, F.lit("/"))
    each = F.split(F.when(rooted, F.substring(path, F.lit(2), F.length(path))).otherwise(path), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(each, none, lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    ended = F.when(F.element_at(each, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.concat(kept, ended), "/"))


def resolved(base: Column, ref: Column) -> Column:
    """``ref`` against ``base`` as RFC 3986 resolves references; surrounding ASCII white space goes, a null gives a null."""
    bare = lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    both = F.array(F.struct(parts_of(bare(base)).alias("b"), parts_of(bare(ref)).alias("r")))

    def joined(x: Column) -> Column:
        b, r = x["b"], x["r"]
        own = (r["scheme"] != "") | (r["authority"] != "")
        above = F.regexp_extract(b["path"], r"^([\s\S]*/)?", 1)
        merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(above, r["path"]))
        path = F.when(own | F.startswith(r["path"], F.lit("/")), without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(without_dots(merged))
        query = F.when(~own & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        scheme = F.lower(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]))
        authority = F.when(own, r["authority"]).otherwise(b["authority"])
        return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), authority, path, query, r["fragment"])

    return F.when(base.isNotNull() & ref.isNotNull(), F.get(F.transform(both, joined), F.lit(0)))
