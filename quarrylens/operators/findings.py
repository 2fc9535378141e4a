"""Findings of all kinds in one shape: union, suppression, ranking, summaries, calls, storage risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, urls, values

COLUMNS = ("page_id", "kind", "title", "severity", "disposition", "source", "level", "score", "seq")


def uncovered(secrets: DataFrame, storage: DataFrame) -> DataFrame:
    """Secrets without those all of whose matches are values in the page's storage."""
    each = secrets.select("page_id", "pattern", "seq", F.explode("matches").alias("value"))
    kept = storage.select("page_id", "value", F.lit(1).alias("hit")).distinct()
    hidden = each.join(kept, ["page_id", "value"], "left").groupBy("page_id", "pattern", "seq").agg(F.count("*").alias("n"), F.count("hit").alias("m")).where("n = m")
    return secrets.join(hidden, ["page_id", "pattern", "seq"], "left_anti").select(*secrets.columns)


def of_secrets(secrets: DataFrame) -> DataFrame:
    return secrets.select("page_id", F.lit("secret").alias("kind"), values.title(F.col("pattern")).alias("title"), F.upper("severity").alias("severity"), "disposition", F.col("label").alias("source"), F.col("confidence.level").alias("level"), F.col("confidence.score").alias("score"), F.col("seq").cast("long").alias("seq"))


def of_vulnerabilities(rows: DataFrame) -> DataFrame:
    """rows: page_id, seq, vuln_type, severity, disposition, location, confidence."""
    return rows.select("page_id", F.lit("vulnerability").alias("kind"), F.col("vuln_type").alias("title"), F.upper("severity").alias("severity"), "disposition", F.coalesce("location", F.lit("Scan target")).alias("source"), F.col("confidence.level").alias("level"), F.col("confidence.score").alias("score"), F.col("seq").cast("long").alias("seq"))


def of_storage(rows: DataFrame) -> DataFrame:
    """rows: as ``storage.assess`` gives them, with confidence."""
    return rows.select("page_id", F.lit("storage").alias("kind"), values.title(F.col("classification")).alias("title"), F.upper("severity").alias("severity"), "disposition", F.array_join("keys", ", ").alias("source"), F.col("confidence.level").alias("level"), F.col("confidence.score").alias("score"), F.col("seq").cast("long").alias("seq"))


def unify(*tables: DataFrame) -> DataFrame:
    out = tables[0].select(*COLUMNS)
    for t in tables[1:]:
        out = out.unionByName(t.select(*COLUMNS))
    return out


def rank(findings: DataFrame) -> DataFrame:
    """Numbered inside page and severity, most confident first; ties by seq, kind and title."""
    order = (scoring.level_rank(F.col("level")).desc(), F.col("score").desc(), "seq", "kind", "title", "source")
    return findings.withColumn("severity_rank", scoring.severity_rank(F.col("severity"))).withColumn("place", F.row_number().over(Window.partitionBy("page_id", "severity").orderBy(*order)))


def top(findings: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` of each group; Spark keeps no more than n rows of a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return findings.withColumn("place", place).where(F.col("place") <= n)


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity of findings, leads apart, and the headline risk; unknown severities count as medium."""
    sev = F.lower("severity")
    found = F.col("disposition") == "finding"
    known = F.when(sev.isin("critical", "high", "medium", "low", "info"), sev).otherwise("medium")
    out = findings.groupBy("page_id").agg(*[F.count_if(found & (known == s)).alias(s) for s in ("critical", "high", "medium", "low", "info")], F.count_if(F.col("disposition") == "lead").alias("leads"), F.count_if(F.col("disposition") == "inventory").alias("inventory"))
    risk = F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").when(F.col("low") > 0, "low").otherwise("info")
    return out.withColumn("risk", risk)


def totals(findings: DataFrame) -> DataFrame:
    """Findings of each page by kind, with subtotals and the grand total (null page or kind)."""
    return findings.rollup("page_id", "kind").agg(F.count("*").alias("n"))


def vulnerability_confidence(rows: DataFrame, target: Column) -> DataFrame:
    """rows: disposition, description, evidence (source, location), url; adds confidence."""
    inferred = (F.col("disposition") != "finding") | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("inferred:"))
    sources = F.transform("evidence", lambda e: e["source"])
    fallback = F.when(F.col("url").isNull(), "dom").when(urls.is_map(F.col("url")), "source_map").otherwise("network")
    sources = F.when(F.size(sources) > 0, sources).otherwise(F.array(fallback))
    location = F.get(F.filter(F.transform("evidence", lambda e: e["location"]), lambda x: F.try_parse_url(x, F.lit("PROTOCOL")).isNotNull()), F.lit(0))
    place = F.coalesce(location, F.col("url"))
    origin = F.when(place.isNull(), "first").otherwise(urls.origin(place, target))
    score = scoring.confidence(F.greatest(F.lit(1), F.size("evidence")), sources, origin, F.when(inferred, "unmet").otherwise("privileged"), None, F.array_contains(sources, "runtime"))
    return rows.withColumn("confidence", score)


def storage_confidence(rows: DataFrame) -> DataFrame:
    """rows: sources, classification, disposition; adds confidence.  Several kinds of evidence corroborate."""
    strong = F.when(F.col("classification").isin("privileged_jwt", "refresh_token"), "privileged").when(F.col("classification") == "public_configuration", "benign").when(F.col("classification") == "ambiguous_sensitive_name", "unmet").otherwise("none")
    score = scoring.confidence(F.size("sources"), F.col("sources"), F.lit("first"), strong, None, F.array_contains("sources", "runtime"))
    return rows.withColumn("confidence", score)


def route_confidence(routes: DataFrame, target: Column) -> DataFrame:
    kind = F.when(urls.is_map(F.col("source")), "source_map").when(F.startswith("source", F.lit("__")), "runtime").otherwise("ast")
    return routes.withColumn("confidence", scoring.confidence(F.lit(1), F.array(kind), urls.origin(F.col("source"), target), F.lit("none"), None, kind == "runtime"))


def flow_confidence(flows: DataFrame, target: Column) -> DataFrame:
    """flows: source, sink, path, script_url, runtime_observed."""
    low = F.lower("sink")
    exploit = F.when(urls.any_of(low, ("eval", "function", "innerhtml", "outerhtml", "document.write", "insertadjacenthtml")), "privileged").otherwise("unmet")
    clean = F.exists("path", lambda s: urls.any_of(F.lower(s), ("sanitize", "dompurify", "escapehtml", "encodeuri")))
    note = F.when(urls.any_of(low, ("textcontent", "innertext")), "text-only sink").when(clean, "sanitised on the way")
    seen = F.col("runtime_observed")
    score = scoring.confidence(F.when(seen, 2).otherwise(1), F.when(seen, F.array(F.lit("ast"), F.lit("runtime"))).otherwise(F.array(F.lit("ast"))), urls.origin(F.col("script_url"), target), exploit, None, seen, None, note, taint=True)
    return flows.withColumn("confidence", score)


def handler_confidence(handlers: DataFrame, target: Column) -> DataFrame:
    check = F.lower("origin_check")
    exploit = F.when(check == "none", "privileged").when(check == "weak", F.when(F.col("reaches_sink"), "privileged").otherwise("unmet")).when(check == "strict", "benign").otherwise("none")
    return handlers.withColumn("confidence", scoring.confidence(F.lit(1), F.array(F.lit("ast")), urls.origin(F.col("script_url"), target), exploit, taint=True))


def gadget_confidence(gadgets: DataFrame, target: Column) -> DataFrame:
    hint = F.lower("exploitability_hint")
    exploit = F.when(urls.any_of(hint, ("requires", "strict")), "unmet").when(urls.any_of(hint, ("unsafe-inline", "unsafe-eval")), "privileged").otherwise("none")
    return gadgets.withColumn("confidence", scoring.confidence(F.lit(1), F.array(F.lit("ast")), urls.origin(F.col("script_url"), target), exploit, taint=True))
