"""Sections of a page's report as Markdown, each a table (page_id, text).

Every list in them is bounded: a page's rows are numbered, the first so many are kept before they are gathered,
and a last line says how many more there are.  So a page with any number of findings costs a task a few kilobytes.
With ``parts`` a section is a table (page_id, part, text): part 0 as without, and the rows that it leaves out in further parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, values
from ..operators import traffic
from .sinks import HEAD, cell, finding_line

#: Technologies in the summary, leads of a kind, endpoints, routes, rows of other lists.
TECHNOLOGIES, LEADS, ENDPOINTS, ROUTES, ROWS = 10, 10, 15, 20, 50
#: Rows of a list in a further part.
PART = 1000


def listed(rows: DataFrame, line: Column, n: int, *order, head: str = "", parts: bool = False) -> DataFrame:
    """(page_id, text): ``head`` and the first ``n`` lines of each page in order, and how many more there are; with ``parts`` those are in further ones."""
    by, at = Window.partitionBy("page_id"), F.col("at")
    each = rows.withColumn("line", line).withColumn("at", F.row_number().over(by.orderBy(*order))).withColumn("of", F.count("*").over(by))
    each = each.withColumn("part", F.when(at <= n, 0).otherwise(F.floor((at - n - 1) / PART) + 1).cast("int")) if parts else each.where(at <= n).withColumn("part", F.lit(0))
    kept = each.groupBy("page_id", "part", "of").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    more = F.when((F.col("part") == 0) & (F.col("of") > n), F.concat(F.lit("\n- ... and "), (F.col("of") - n).cast("string"), F.lit(" more"))).otherwise("")
    return kept.select("page_id", *["part"] * parts, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), more).alias("text"))


def _gathered(tables: tuple[DataFrame, ...]) -> DataFrame:
    """(page_id, texts), or (page_id, part, texts) if any of the tables has parts; the others are in part 0."""
    key = ["page_id", "part"] if any("part" in t.columns for t in tables) else ["page_id"]
    rows = None
    for k, t in enumerate(tables):
        own = (t if "part" in t.columns else t.withColumn("part", F.lit(0))).select(*key, F.lit(k).alias("k"), "text")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("texts")).withColumn("texts", F.transform("texts", lambda t: t["text"]))


def joined(*tables: DataFrame, title: str) -> DataFrame:
    """The tables' texts that a page has under one title, in order."""
    body = _gathered(tables)
    return body.select(*body.columns[:-1], F.concat(F.lit(f"## {title}\n\n"), F.array_join("texts", "\n\n"), F.lit("\n")).alias("text"))


def technologies(names: DataFrame, parts: bool = False) -> DataFrame:
    """``names``: page_id, name; the first ten, and how many more; with ``parts`` all, because signatures are few."""
    own = names.select("page_id", "name").distinct().groupBy("page_id").agg(F.array_sort(F.collect_set("name")).alias("all"))
    if parts:
        return own.select("page_id", F.concat(F.lit("**Technologies**: "), F.array_join("all", ", ")).alias("text"))
    more = F.when(F.size("all") > TECHNOLOGIES, F.concat(F.lit(" (+"), (F.size("all") - TECHNOLOGIES).cast("string"), F.lit(" more)"))).otherwise("")
    return own.select("page_id", F.concat(F.lit("**Technologies**: "), F.array_join(F.slice("all", 1, TECHNOLOGIES), ", "), more).alias("text"))


def network(calls: DataFrame, targets: DataFrame, parts: bool = False) -> DataFrame:
    """Totals, the other parties' domains, the first calls to APIs."""
    n = traffic.totals(calls, targets)
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    sums = n.select("page_id", F.concat_ws("\n", count("Requests", "requests"), count("API-like", "api"), count("First party", "first_party"), count("Third party", "third_party")).alias("text"))
    domains = traffic.parties(calls, targets).where("not first_party")
    table = listed(domains, F.concat(F.lit("| "), "domain", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")), ROWS, "domain", head="| Domain | Requests |\n| --- | --- |\n", parts=parts)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "method", "status", "content_type", F.concat(F.lit("`"), "url", F.lit("`")), "hints"), F.lit(" |"))
    first = listed(traffic.key_calls(calls, None if parts else traffic.SHOWN), row, traffic.SHOWN, "place", head="| Method | Status | Content type | URL | Credentials |\n| --- | --- | --- | --- | --- |\n", parts=parts)
    return joined(sums, table, first, title="Network")


def inventory(endpoints: DataFrame, routes: DataFrame, storage: DataFrame, parts: bool = False) -> DataFrame:
    """Storage that is no finding, distinct endpoints, routes.

    ``endpoints``: page_id, url; ``routes``: page_id, path, kind; ``storage``: page_id, classification, keys, value, disposition.
    """
    own = storage.where("disposition = 'inventory'")
    kept = listed(own, F.concat(F.lit("| "), values.title(F.col("classification")), F.lit(" | `"), cell(F.array_join("keys", ", ")), F.lit("` | `"), cell(values.redact(F.col("value"))), F.lit("` |")), ROWS, "classification", F.array_join("keys", ", "), "value", head="### Storage\n\n| Classification | Key | Value |\n| --- | --- | --- |\n", parts=parts)
    called = listed(endpoints.select("page_id", "url").distinct(), F.concat(F.lit("- `"), "url", F.lit("`")), ENDPOINTS, "url", head="### Endpoints\n\n", parts=parts)
    found = listed(routes.select("page_id", "path", "kind").distinct(), F.concat(F.lit("- `"), "path", F.lit("` ("), "kind", F.lit(")")), ROUTES, "path", "kind", head="### Routes\n\n", parts=parts)
    return joined(kept, called, found, title="Inventory")


def leads(wordpress: DataFrame, flows: DataFrame, handlers: DataFrame, parts: bool = False) -> DataFrame:
    """What a person should look at: an unsure content system's version, flows that aren't of low confidence, handlers that reach a sink.

    ``wordpress``: page_id, lead; ``flows``: page_id, source, sink, location, confidence; ``handlers``: page_id, location, origin_check, reaches_sink.
    """
    a = listed(wordpress, F.concat(F.lit("- WordPress: "), "lead"), 1, "lead", parts=parts)
    b = listed(flows.where("confidence.level <> 'low'"), F.concat(F.lit("- Flow: `"), "source", F.lit("` to `"), "sink", F.lit("` at `"), "location", F.lit("`")), LEADS, "location", "source", "sink", parts=parts)
    c = listed(handlers.where("reaches_sink"), F.concat(F.lit("- Message handler at `"), "location", F.lit("`, origin check: "), "origin_check"), LEADS, "location", parts=parts)
    return joined(a, b, c, title="Leads")


def _trust() -> tuple[Column, Column]:
    return scoring.level_rank(F.col("confidence.level")).desc(), F.col("confidence.score").desc()


def _told() -> Column:
    return F.concat("confidence.level", F.lit(" ("), F.col("confidence.score").cast("string"), F.lit(")"))


def dataflow(flows: DataFrame, gadgets: DataFrame, handlers: DataFrame, parts: bool = False) -> DataFrame:
    """Flows, gadgets and handlers with confidence, the surest first."""
    a = listed(flows, F.concat(F.lit("| `"), "source", F.lit("` | `"), "sink", F.lit("` | `"), "location", F.lit("` | "), _told(), F.lit(" |")), ROWS, *_trust(), "location", "source", "sink", head="| Source | Sink | Location | Confidence |\n| --- | --- | --- | --- |\n", parts=parts)
    b = listed(gadgets, F.concat(F.lit("| "), "category", F.lit(" | "), cell(F.col("description")), F.lit(" | "), _told(), F.lit(" |")), ROWS, *_trust(), "place", head="| Gadget | Description | Confidence |\n| --- | --- | --- |\n", parts=parts)
    c = listed(handlers, F.concat(F.lit("| `"), "location", F.lit("` | "), "origin_check", F.lit(" | "), F.when(F.col("reaches_sink"), "yes").otherwise("no"), F.lit(" | "), _told(), F.lit(" |")), ROWS, *_trust(), "location", head="| Handler | Origin check | Reaches a sink | Confidence |\n| --- | --- | --- | --- |\n", parts=parts)
    return joined(a, b, c, title="Dataflow")


def surface(manifests: DataFrame, routes: DataFrame, packages: DataFrame, parts: bool = False) -> DataFrame:
    """Manifests with build ids, routes by confidence, versions out of source maps.

    ``manifests``: page_id, framework, manifest_type, build_id; ``routes``: page_id, path, kind, source, confidence; ``packages``: page_id, name, version.
    """
    a = listed(manifests, F.concat(F.lit("| "), F.concat_ws(" | ", "framework", "manifest_type", F.coalesce("build_id", F.lit("-"))), F.lit(" |")), ROWS, "framework", "manifest_type", head="| Framework | Manifest | Build |\n| --- | --- | --- |\n", parts=parts)
    b = listed(routes, F.concat(F.lit("| `"), "path", F.lit("` | "), "kind", F.lit(" | "), "source", F.lit(" | "), _told(), F.lit(" |")), ROWS, *_trust(), "path", "kind", head="| Path | Kind | Source | Confidence |\n| --- | --- | --- | --- |\n", parts=parts)
    c = listed(packages, F.concat(F.lit("- "), "name", F.lit(" "), "version"), ROWS, "name", "version", head="### Versions\n\n", parts=parts)
    return joined(a, b, c, title="Client surface")


def cookies(weak: DataFrame, missing: DataFrame, parts: bool = False) -> DataFrame:
    """Weak cookies (page_id, name, issues) and missing headers (page_id, header)."""
    a = listed(missing, F.concat(F.lit("- missing header "), "header"), ROWS, "header", parts=parts)
    b = listed(weak, F.concat(F.lit("| "), cell(F.col("name")), F.lit(" | "), F.array_join("issues", ", "), F.lit(" |")), ROWS, "name", F.array_join("issues", ", "), head="| Cookie | Issues |\n| --- | --- |\n", parts=parts)
    return joined(a, b, title="Security posture")


def recommendations(summary: DataFrame) -> DataFrame:
    """Numbered advice by what a page's counts (``findings.summary``) hold; the last one always."""
    said = F.array_compact(F.array(
        F.when(F.col("critical") > 0, "Revoke and replace the critical credentials now."),
        F.when(F.col("high") > 0, "Look into the findings of high severity first."),
        F.when(F.col("medium") > 0, "Plan work on the findings of medium severity."),
        F.when(F.col("leads") > 0, "Check the leads by hand; they are no findings yet."),
        F.when(F.col("inventory") > 0, "Review what the inventory shows to everyone."),
        F.lit("Scan again after each release."),
    ))
    numbered = F.transform(said, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return summary.select("page_id", F.concat(F.lit("## Recommendations\n\n"), F.array_join(numbered, "\n"), F.lit("\n")).alias("text"))


def findings(ranked: DataFrame, parts: bool = False) -> DataFrame:
    """Findings, leads and inventory in the order of their rank; ``ranked``: as ``findings.rank`` gives them."""
    tables = []
    for title, kind in (("Findings", "finding"), ("Leads", "lead"), ("Inventory", "inventory")):
        tables.append(listed(ranked.where(F.col("disposition") == kind), finding_line(), ROWS, F.col("severity_rank").desc(), "place", "line", head=f"### {title}\n\n{HEAD}", parts=parts))
    return joined(*tables, title="Findings")


def report(pages: DataFrame, *sections: DataFrame) -> DataFrame:
    """(page_id, text): all sections that a page has, in order, under its URL; (page_id, part, text) if any of them has parts."""
    body = _gathered(sections)
    rows = pages.select("page_id", "url").join(body, "page_id", "left")
    if "part" not in body.columns:
        return rows.select("page_id", F.concat(F.lit("# Report for "), "url", F.lit("\n\n"), F.array_join(F.coalesce("texts", F.array()), "\n")).alias("text"))
    part = F.coalesce("part", F.lit(0))
    more = F.when(part > 0, F.concat(F.lit(", part "), (part + 1).cast("string"))).otherwise("")
    return rows.select("page_id", part.alias("part"), F.concat(F.lit("# Report for "), "url", more, F.lit("\n\n"), F.array_join(F.coalesce("texts", F.array()), "\n")).alias("text"))
