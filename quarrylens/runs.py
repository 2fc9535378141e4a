"""A whole run: targets joined with what was captured of them, all operators, findings, documents, and the pages that failed.

Each page is parsed once, into a table that everything else reads; what several operators read is written once.  A page that was not
captured, or that breaks the parser, is a row of the error table and of the summary, and nothing of the others is lost.  The run's totals are
observed while its findings are written, so nothing is read a second time for them.  Texts are read whole, and all of their matches count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import scoring, urls
from .functions.patterns import catalog, compiles
from .operators import advisories, bodies, endpoints, findings, posture, secrets, storage
from .sources import captures, documents, scratch, sinks
from .sources.captures import Config

#: Tables that a capture may hold besides ``pages`` (url, html, and page_id or not), all by page_id.
TABLES = {
    "storage": "page_id long, area string, key string, value string",
    "globals": "page_id long, key string, value string",
    "cookies": "page_id long, name string, value string, secure boolean, http_only boolean",
    "calls": "page_id long, seq long, url string, response_content_type string, response_headers map<string,string>",
}
NOT_CAPTURED = "not captured"


@dataclass
class Run:
    """What a run has made: tables, totals, and where the documents are."""

    pages: DataFrame
    errors: DataFrame
    findings: DataFrame
    endpoints: DataFrame
    summary: DataFrame
    totals: dict[str, int]
    documents: str | None


def wanted(spark: SparkSession, config: Config) -> DataFrame:
    """(url), distinct: the targets of the settings."""
    if config.file is not None:
        return captures.targets(spark, config.file).select("url").distinct()
    return spark.createDataFrame([(config.url,)], "url string")


def _captured(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the columns that operators read; empty ones for those that weren't captured."""
    out = {}
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        out[name] = tables[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]) if name in tables else empty
    return out


def _vulnerabilities(scripts: DataFrame, own: DataFrame) -> DataFrame:
    """Advisories that scripts' versions meet, as findings; once for each page, kind and version, by the first script."""
    rows = advisories.rsc_versions(scripts).groupBy("page_id", "vuln_type", "severity", "version").agg(F.min("seq").alias("seq"))
    rows = rows.select("page_id", "seq", "vuln_type", "severity", F.lit("finding").alias("disposition"), F.concat(F.col("vuln_type"), F.lit(" in version "), F.col("version")).alias("description"), F.lit(None).cast("string").alias("url"), F.array(F.struct(F.lit("ast").alias("source"), F.lit(None).cast("string").alias("location"))).alias("evidence"), F.concat(F.lit("react-server-dom "), "version").alias("location"))
    return findings.of_vulnerabilities(findings.vulnerability_confidence(rows.join(own, "page_id"), F.col("target")))


def _posture(held: dict[str, DataFrame], pages: DataFrame) -> DataFrame:
    """A lead for each page and kind of weakness that its cookies and calls show."""
    cookies = posture.weak_cookies(held["cookies"]).select("page_id", F.lit("Weak cookies").alias("title"))
    headers = posture.missing_on_document(held["calls"], pages).select("page_id", F.lit("Missing headers").alias("title"))
    mixed = posture.mixed_content(held["calls"], pages).select("page_id", F.lit("Mixed content").alias("title"))
    cors = posture.open_cors(held["calls"], pages).select("page_id", F.lit("Open cross-origin access").alias("title"))
    each = cookies.union(headers).union(mixed).union(cors).groupBy("page_id", "title").agg(F.count("*").alias("n"))
    score = scoring.confidence(F.lit(1), F.array(F.lit("network")), F.lit("first"), F.lit("none"), None, F.lit(False))
    own = each.withColumn("confidence", score)
    return own.select("page_id", F.lit("posture").alias("kind"), "title", F.lit("LOW").alias("severity"), F.lit("lead").alias("disposition"), F.concat(F.col("n").cast("string"), F.lit(" observed")).alias("source"), F.col("confidence.level").alias("level"), F.col("confidence.score").alias("score"), F.lit(0).cast("long").alias("seq"))


def run(spark: SparkSession, config: Config, tables: dict[str, DataFrame], script_bodies: str | None = None, output: str | None = None) -> Run:
    """Analyse the targets of ``config`` as far as ``tables`` hold them; ``script_bodies``: path of a table (url, body); ``output``: folder for the documents."""
    targets = wanted(spark, config)
    pages = tables["pages"]
    if "page_id" not in pages.columns:
        pages = pages.withColumn("page_id", F.xxhash64("url"))
    own = targets.join(pages.select("page_id", "url", "html"), "url", "left").withColumn("page_id", F.coalesce("page_id", F.xxhash64("url")))
    parsed = scratch.kept(captures.parsed(own.select("page_id", "url", "html")), "parsed")  # the only parse
    failed = F.when(F.col("html").isNull(), NOT_CAPTURED).otherwise(F.col("error"))
    errors = parsed.select("page_id", "url", failed.alias("error")).where("error is not null")
    whole = parsed.where("html is not null and error is null")
    site = whole.select("page_id", urls.host(F.col("url")).alias("target"))
    held = {k: t.join(whole.select("page_id"), "page_id", "left_semi") for k, t in _captured(spark, tables).items()}

    e = captures.elements(whole)
    linked = captures.scripts(e, None)
    read = None
    if script_bodies is not None:
        got = bodies.external(linked, whole.select("page_id", "url"), script_bodies).where("body is not null")
        path = scratch.fresh(spark, "read-bodies")
        got.select("page_id", "pos", F.col("url").alias("src"), "body").write.parquet(path)  # of another session until it is written
        read = spark.read.parquet(path)
    art = scratch.kept(captures.artifacts(whole, held["storage"], read, held["globals"], inline=None, size=None, manifest_size=None), "artifacts")
    own_patterns = [(c[0], c[1], "") for c in config.custom_patterns if compiles(spark, c[1])]
    patterns = catalog(own_patterns, config.ignore_patterns)
    found = secrets.scored(secrets.grouped(secrets.with_token_roles(secrets.first_sources(secrets.scan(art, patterns)))).join(site, "page_id"), F.col("target"))
    scripts = art.where(F.col("label").startswith("Script: ") | (F.col("label") == "Inline Script"))
    stored = storage.assess(storage.classify(storage.gather(held["storage"], held["cookies"].select("page_id", "name", "value"), held["calls"].select("page_id", "seq", "url"), None), F.unix_timestamp()))
    every = findings.unify(findings.of_secrets(found), _vulnerabilities(scripts, site), findings.of_storage(findings.storage_confidence(stored)), _posture(held, whole.select("page_id", "url")))

    seen = Observation("totals")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("secret", "vulnerability", "storage", "posture")]
    told = scratch.kept(every.observe(seen, F.count("*").alias("findings"), *kinds, F.count_if(F.col("disposition") == "finding").alias("certain")), "findings")
    totals = {k: int(v) for k, v in seen.get.items()}
    counts = parsed.agg(F.count("*").alias("pages"), F.count_if(failed.isNotNull()).alias("failed")).first()
    totals |= {"pages": counts["pages"], "failed": counts["failed"]}

    at = None
    if output is not None:
        ranked, of = findings.rank(told), whole.select("page_id", "url")
        rows = told.select("page_id", "kind", "title", "severity", "disposition", "source", "level", "score")
        decisions = (sinks.markdown(of, ranked, findings.summary(told)), sinks.markdown_parts(of, ranked)) if config.format in ("md", "both") else (None, None)
        evidence = (sinks.json_documents(of, findings=rows), sinks.json_parts(of, findings=rows)) if config.format in ("json", "both") else (None, None)
        documents.write(sinks.documents(decisions[0], evidence[0], decisions[1], evidence[1]), output)
        at = output
    summary = sinks.batch_summary(parsed.select("page_id", "url"), told, errors)
    return Run(whole, errors, told, endpoints.endpoints(scripts), summary, totals, at)
