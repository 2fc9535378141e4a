"""Secrets in text artifacts: scan, first-source dedupe, roles of signed tokens, scores and dispositions.

An artifact is (page_id, seq, label, text); ``seq`` is the capture order.  The scan shuffles nothing:
patterns are literals, so each regex is compiled once, and only texts with a pattern's needle
try it.  Deduping is an aggregation by value with map-side combining, never a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, urls, values
from ..functions.needles import ODD, Index
from ..functions.patterns import BUILT_IN, DERIVED, Pattern

#: Matches of a pattern in an artifact, where a query's contract cuts them.
PER_ARTIFACT = 10


def matches_of(text: Column, pattern: Pattern, limit: int | None = None, unicode: bool = True) -> Column:
    """All distinct whole matches, or the first ``limit``, in order of value."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(("(?dU)" if unicode else "(?d)") + pattern.regex), F.lit(0))))
    return found if limit is None else F.slice(found, 1, limit)


def scan(artifacts: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILT_IN, limit: int | None = None, unicode: bool = True) -> DataFrame:
    """(page_id, seq, label, pattern, matches) of every artifact and pattern that match; of each all matches, or the first ``limit``.

    A text is probed once for the needles of all patterns; a row goes on for each pattern that it may match, and tries that one's regex.
    """
    index = Index([p.regex for p in patterns], [p.needles for p in patterns])
    rows = artifacts.select("page_id", "seq", "label", "text", F.lower("text").alias("low"), urls.any_of(F.col("text"), ODD).alias("odd"))
    rows = rows.select("page_id", "seq", "label", "text", F.explode(index.hits(F.col("text"), F.col("low"), F.col("odd"))).alias("k"))
    found, name = None, F.element_at(F.array(*[F.lit(p.name) for p in patterns]), F.col("k") + 1)
    for k, p in enumerate(patterns):
        own = matches_of(F.col("text"), p, limit, unicode)
        found = F.when(F.col("k") == k, own) if found is None else found.when(F.col("k") == k, own)
    # exploded, not filtered: a filter would be pushed below, and would run the regex a second time
    one = F.filter(F.array(F.struct(name.alias("pattern"), found.alias("matches"))), lambda x: F.size(x["matches"]) > 0)
    return rows.select("page_id", "seq", "label", F.explode(one).alias("m")).select("page_id", "seq", "label", "m.pattern", "m.matches")


def first_sources(found: DataFrame) -> DataFrame:
    """Every (page, pattern, value) at the first artifact that has it: page_id, pattern, value, seq, label."""
    each = found.select("page_id", "pattern", F.explode("matches").alias("value"), F.struct("seq", "label").alias("at"))
    first = each.groupBy("page_id", "pattern", "value").agg(F.min("at").alias("at"))
    return first.select("page_id", "pattern", "value", "at.seq", "at.label")


def grouped(first: DataFrame) -> DataFrame:
    """Values back in lists by artifact: page_id, pattern, seq, label, matches."""
    return first.groupBy("page_id", "pattern", "seq", "label").agg(F.array_sort(F.collect_list("value")).alias("matches"))


def with_token_roles(first: DataFrame) -> DataFrame:
    """Signed tokens become service-role or anonymous tokens by the role in their payload (perhaps both), else stay."""
    service, anon = values.jwt_role(F.col("value"), "service_role"), values.jwt_role(F.col("value"), "anon")
    names = F.array_compact(F.array(F.when(service, "supabase_service_role"), F.when(anon, "supabase_anon_jwt"), F.when(~service & ~anon, "jwt")))
    kinds = F.when(F.col("pattern") == "jwt", names).otherwise(F.array("pattern"))
    return first.withColumn("pattern", F.explode(kinds))


def severity_of(pattern: Column, catalog: list[Pattern] | tuple[Pattern, ...] = BUILT_IN) -> Column:
    """The pattern's severity; custom ones are MEDIUM."""
    table = {p.name: p.severity for p in (*catalog, *DERIVED) if p.category != "custom" and p.severity != "MEDIUM"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[pattern], F.lit("MEDIUM"))


def exploitability_of(pattern: Column, catalog: list[Pattern] | tuple[Pattern, ...] = BUILT_IN) -> Column:
    table = {p.name: p.exploitability for p in (*catalog, *DERIVED) if p.exploitability != "none"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[pattern], F.lit("none"))


def label_origin(label: Column, target: Column) -> Column:
    """Of a script's label the origin of its URL; everything else belongs to the page."""
    return F.when(F.startswith(label, F.lit("Script: ")), urls.origin(F.expr("substring(label, 9)"), target)).otherwise("first")


def scored(findings: DataFrame, target: Column) -> DataFrame:
    """``findings`` (page_id, pattern, seq, label, matches) with severity, confidence and disposition."""
    value = F.coalesce(F.get("matches", F.lit(0)), F.lit(""))
    source = values.label_source(F.col("label"))
    note = F.when(values.placeholder(value), "placeholder or test value")
    score = scoring.confidence(F.lit(1), F.array(source), label_origin(F.col("label"), target), exploitability_of(F.col("pattern")), values.entropy_signal(value), source == "runtime", None, note)
    out = findings.withColumn("severity", severity_of(F.col("pattern"))).withColumn("confidence", score)
    return out.withColumn("disposition", disposition(F.col("severity"), F.col("confidence.level")))


def disposition(severity: Column, level: Column) -> Column:
    return F.when(severity.isin("LOW", "INFO"), "inventory").when(level == "low", "lead").otherwise("finding")


def comments(scripts: DataFrame) -> DataFrame:
    """(page_id, seq, label, comment_type, content) of line and block comments with over 5 bytes, clipped to 200 and 500 characters."""
    def of(kind: str, regex: str, n: int) -> DataFrame:
        each = scripts.where(F.octet_length("text") >= 10).select("page_id", "seq", "label", F.explode(F.regexp_extract_all("text", F.lit(regex), F.lit(1))).alias("c"))
        each = each.withColumn("c", F.trim(F.regexp_replace("c", r"^\s+|\s+$", "")))
        return each.where(F.octet_length("c") > 5).select("page_id", "seq", "label", F.lit(kind).alias("comment_type"), F.left("c", F.lit(n)).alias("content"))

    return of("single", r"(?d)//(.+)", 200).union(of("multi", r"/\*([\s\S]*?)\*/", 500))
