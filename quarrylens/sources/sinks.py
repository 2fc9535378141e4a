"""Sinks: JSON results and Markdown reports, one document a page, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

SCHEMA_VERSION = "0.5"


def folder(url: Column) -> Column:
    """The host with dashes for dots, or ``unknown``."""
    return F.coalesce(F.replace(urls.host(url), F.lit("."), F.lit("-")), F.lit("unknown"))


#: Rows of a page that a document holds of one section at most; the rest is counted there, and is in further parts.
LIMIT = 10_000


def _within(limit: int | None) -> Column:
    return F.lit(True) if limit is None else F.col("at") <= limit


def _placed(rows: DataFrame) -> DataFrame:
    """(page_id, row, at): a section's rows as structs, numbered in the order of their JSON."""
    row = F.struct(*[c for c in rows.columns if c != "page_id"])
    return rows.select("page_id", row.alias("row")).withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy(F.to_json("row"))))


def json_documents(pages: DataFrame, limit: int = LIMIT, **sections: DataFrame) -> DataFrame:
    """(page_id, folder, json): each page's rows of each section as lists; empty sections and nulls are left out.

    Rows are in the order of their JSON.  A section of more than ``limit`` rows is cut there, and ``cut`` has its whole length; see
    ``json_parts`` for what is cut off.  Without limit nothing is.
    """
    out, longer = pages.select("page_id", "url"), []
    for name, rows in sections.items():
        each = _placed(rows).withColumn("of", F.count("*").over(Window.partitionBy("page_id")))
        own = each.where(_within(limit)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"), F.max("of").alias("of"))
        out = out.join(own.select("page_id", F.transform("rows", lambda r: r["row"]).alias(name), F.when(F.lit(False) if limit is None else F.col("of") > limit, F.col("of")).alias(f"{name}_of")), "page_id", "left")
        longer.append(F.col(f"{name}_of").alias(name))
    some = F.when(F.coalesce(*longer).isNotNull(), F.struct(*longer)) if longer else F.lit(None).cast("string")
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "url", *sections, some.alias("cut"))
    return out.select("page_id", folder(F.col("url")).alias("folder"), F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def json_parts(pages: DataFrame, limit: int = LIMIT, **sections: DataFrame) -> DataFrame:
    """(page_id, folder, part, json), parts from 1: the rows that ``json_documents`` with this limit cuts off, ``limit`` of each section in a part."""
    out = None
    for name, rows in sections.items():
        own = _placed(rows).where(F.col("at") > limit).withColumn("part", F.floor((F.col("at") - 1) / limit).cast("int"))
        own = own.groupBy("page_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows")).select("page_id", "part", F.transform("rows", lambda r: r["row"]).alias(name))
        out = own if out is None else out.join(own, ["page_id", "part"], "full")
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "url", "part", *sections)
    return out.join(pages.select("page_id", "url"), "page_id").select("page_id", folder(F.col("url")).alias("folder"), "part", F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def cell(text: Column) -> Column:
    """A table's cell: pipes escaped, line breaks as spaces."""
    return F.replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


HEAD = "| Severity | Title | Confidence | Source |\n| --- | --- | --- | --- |\n"


def finding_line() -> Column:
    """A finding's row of that table."""
    return F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), cell(F.col("title")), F.lit(" | "), F.col("level"), F.lit(" ("), F.col("score"), F.lit(") | "), cell(F.col("source")), F.lit(" |"))


def numbered(ranked: DataFrame) -> DataFrame:
    """``ranked`` with its table's ``line``, ``at``, its number in page and disposition, and ``of``, how many there are; as it is if it has them."""
    if "at" in ranked.columns:
        return ranked
    by = Window.partitionBy("page_id", "disposition")
    return ranked.withColumn("line", finding_line()).withColumn("at", F.row_number().over(by.orderBy(F.col("severity_rank").desc(), "place", "line"))).withColumn("of", F.count("*").over(by))


def markdown(pages: DataFrame, ranked: DataFrame, summary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(page_id, folder, text): a report with headline, counts and the findings in rank order, of each disposition the first ``limit``; see ``markdown_parts`` for the others."""
    body = numbered(ranked).where(_within(limit)).groupBy("page_id", "disposition").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"), F.max("of").alias("of"))
    more = F.lit("") if limit is None else F.when(F.col("of") > limit, F.concat(F.lit("\n\n... and "), (F.col("of") - limit).cast("string"), F.lit(" more"))).otherwise("")
    body = body.select("page_id", "disposition", F.concat(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), more).alias("body"))
    pick = lambda d: F.max(F.when(F.col("disposition") == d, F.col("body")))
    wide = body.groupBy("page_id").agg(pick("finding").alias("text_findings"), pick("lead").alias("text_leads"), pick("inventory").alias("text_stock"))
    rows = pages.select("page_id", "url").join(summary, "page_id", "left").join(wide, "page_id", "left")
    section = lambda t, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n## {t}\n\n{HEAD}"), F.col(c))).otherwise("")
    count = F.concat_ws(", ", *[F.concat(F.coalesce(F.col(s), F.lit(0)).cast("string"), F.lit(f" {s}")) for s in ("critical", "high", "medium", "low", "info", "leads")])
    text = F.concat(F.lit("# Report for "), "url", F.lit("\n\nRisk: "), F.coalesce("risk", F.lit("info")), F.lit("\n\n"), count, section("Findings", "text_findings"), section("Leads", "text_leads"), section("Inventory", "text_stock"), F.lit("\n"))
    return rows.select("page_id", folder(F.col("url")).alias("folder"), text.alias("text"))


def markdown_parts(pages: DataFrame, ranked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(page_id, folder, part, text), parts from 1: the findings that ``markdown`` with this limit leaves out, ``limit`` of each disposition in a part."""
    own = numbered(ranked).where(F.col("at") > limit).withColumn("part", F.floor((F.col("at") - 1) / limit).cast("int"))
    table = own.groupBy("page_id", "part", "disposition").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    title = F.when(F.col("disposition") == "finding", "Findings").when(F.col("disposition") == "lead", "Leads").otherwise("Inventory")
    table = table.withColumn("text", F.concat(F.lit("## "), title, F.lit(f"\n\n{HEAD}"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n")))
    body = table.groupBy("page_id", "part").agg(F.array_sort(F.collect_list(F.struct("disposition", "text"))).alias("s")).join(pages.select("page_id", "url"), "page_id")
    text = F.concat(F.lit("# Report for "), "url", F.lit(", part "), (F.col("part") + 1).cast("string"), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n"))
    return body.select("page_id", folder(F.col("url")).alias("folder"), "part", text.alias("text"))


def documents(decisions: DataFrame | None, evidence: DataFrame | None, decision_parts: DataFrame | None = None, evidence_parts: DataFrame | None = None) -> DataFrame:
    """(folder, name, body) for ``documents.write``: of each page a decision report and the evidence behind it, in its host's folder, and further parts where there are any.

    ``decisions`` as ``markdown`` gives them, ``evidence`` as ``json_documents`` does, parts as their ``_parts``; any may be missing, but not all.
    """
    rows = None
    for docs, column, name, end in ((decisions, "text", "decision", "md"), (evidence, "json", "evidence", "json"), (decision_parts, "text", "decision", "md"), (evidence_parts, "json", "evidence", "json")):
        if docs is not None:
            part = F.concat(F.lit("-"), F.col("part").cast("string")) if "part" in docs.columns else F.lit("")
            own = docs.select("folder", F.concat(F.col("page_id").cast("string"), F.lit(f"-{name}"), part, F.lit(f".{end}")).alias("name"), F.col(column).alias("body"))
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("neither decisions nor evidence")
    return rows


def batch_summary(pages: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(url, secrets, vulnerabilities, status) of each page; a failed page's status is its error, clipped to 60 characters."""
    count = findings.groupBy("page_id").agg(F.count_if(F.col("kind") == "secret").alias("secrets"), F.count_if(F.col("kind") == "vulnerability").alias("vulnerabilities"))
    rows = pages.select("page_id", "url").join(count, "page_id", "left")
    if errors is not None:
        rows = rows.join(errors.select("page_id", "error"), "page_id", "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNull(), "ok").otherwise(F.when(F.length("error") > 60, F.concat(F.left("error", F.lit(60)), F.lit("..."))).otherwise(F.col("error")))
    return rows.select("page_id", "url", F.coalesce("secrets", F.lit(0)).alias("secrets"), F.coalesce("vulnerabilities", F.lit(0)).alias("vulnerabilities"), status.alias("status"))
