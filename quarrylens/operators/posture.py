"""Security posture of a page: cookies, cross-origin headers, missing headers, mixed content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Headers that an HTML response should have.
REQUIRED = ("Content-Security-Policy", "Strict-Transport-Security", "X-Frame-Options", "X-Content-Type-Options")


def missing_headers(headers: Column) -> Column:
    """Of the required headers those that are absent, whatever the case of the keys."""
    there = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return F.filter(F.array(*[F.lit(r) for r in REQUIRED]), lambda r: ~F.array_contains(there, F.lower(r)))


def missing_on_document(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, header) that the first HTML response under the page's own URL lacks."""
    own = calls.join(targets.select("page_id", F.col("url").alias("target")), "page_id").where(F.startswith("url", "target") & F.contains("response_content_type", F.lit("text/html")))
    first = own.groupBy("page_id").agg(F.min_by("response_headers", "seq").alias("headers"))
    return first.select("page_id", F.explode(missing_headers(F.col("headers"))).alias("header"))


def open_cors(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, url) of first-party calls to nothing static that any origin may read."""
    host = targets.select("page_id", urls.host(F.col("url")).alias("target_host"))
    own = calls.join(host, "page_id")
    wide = F.coalesce(F.try_element_at("response_headers", F.lit("access-control-allow-origin")), F.try_element_at("response_headers", F.lit("Access-Control-Allow-Origin"))) == "*"
    return own.where(wide & urls.under(F.col("url"), F.col("target_host")) & ~urls.is_static(F.col("url"), F.col("response_content_type"))).select("page_id", "url")


def mixed_content(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, url) of plain http calls on an https page."""
    own = calls.join(targets.select("page_id", F.col("url").alias("target")).where(F.startswith("target", F.lit("https://"))), "page_id")
    return own.where(F.startswith("url", F.lit("http://"))).select("page_id", "url")


def weak_cookies(cookies: DataFrame) -> DataFrame:
    """(page_id, name, issues) of cookies without Secure or HttpOnly."""
    issues = F.array_compact(F.array(F.when(~F.col("secure"), "missing Secure"), F.when(~F.col("http_only"), "missing HttpOnly")))
    return cookies.select("page_id", "name", issues.alias("issues")).where(F.size("issues") > 0)


def validation_leads(**lists: DataFrame) -> DataFrame:
    """One lead for each page and kind of issue: page_id, vuln_type, n, evidence (sorted).  Each list has page_id and item."""
    out = None
    for kind, rows in lists.items():
        one = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item")).alias("evidence")).select("page_id", F.lit(kind).alias("vuln_type"), "n", "evidence")
        out = one if out is None else out.unionByName(one)
    return out


def csp_policies(header: Column) -> Column:
    """A header's policies: for each whether it restrains scripts, and with which sources."""
    policies = F.filter(F.transform(F.split(header, "[\n,]"), lambda p: F.trim(p)), lambda p: p != "")

    def directive(policy: Column, name: str) -> Column:
        parts = F.filter(F.transform(F.split(policy, ";"), lambda d: F.filter(F.split(F.trim(d), r"\s+"), lambda t: t != "")), lambda t: F.lower(F.get(t, F.lit(0))) == name)
        return F.get(parts, F.lit(0))

    def one(policy: Column) -> Column:
        tokens = F.coalesce(directive(policy, "script-src"), directive(policy, "default-src"))
        return F.struct(tokens.isNotNull().alias("present"), F.coalesce(F.slice(tokens, 2, 10_000), F.array().cast("array<string>")).alias("sources"))

    return F.transform(policies, one)


def csp_flags(header: Column) -> Column:
    """unsafe_inline, unsafe_eval and broad: what all restraining policies together still allow."""
    policies = F.filter(csp_policies(header), lambda p: p["present"])

    def keyword(p: Column, word: str) -> Column:
        return F.exists(p["sources"], lambda s: F.lower(s).isin(word, f"'{word}'"))

    def neutral(p: Column) -> Column:
        return F.exists(p["sources"], lambda s: F.rlike(F.lower(s), F.lit("^'(?:nonce-|sha256-|sha384-|sha512-|strict-dynamic'$)")))

    some = F.size(policies) > 0
    inline = some & F.forall(policies, lambda p: keyword(p, "unsafe-inline") & ~neutral(p))
    evals = some & F.forall(policies, lambda p: keyword(p, "unsafe-eval"))
    broad = ~some | F.forall(policies, lambda p: F.exists(p["sources"], lambda s: F.lower(s).isin("*", "https:", "http:", "data:")))
    return F.struct(inline.alias("unsafe_inline"), evals.alias("unsafe_eval"), broad.alias("broad"))
