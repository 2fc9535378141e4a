"""Known flaws by observed versions: closed version ranges, script fingerprints, existence leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values

#: Affected WordPress versions, both ends included.
WORDPRESS = (
    ("6.9.0", "6.9.4", "critical", "WordPress pre-authentication RCE chain (CVE-2026-60137/CVE-2026-63030)"),
    ("7.0.0", "7.0.1", "critical", "WordPress pre-authentication RCE chain (CVE-2026-60137/CVE-2026-63030)"),
    ("6.8.0", "6.8.5", "medium", "WordPress SQL injection (CVE-2026-60137)"),
)
PACKAGE = "react-server-dom-(?:webpack|parcel|turbopack)"
#: Affected versions of the package, as they stand in scripts.
RSC = (
    ("React RSC RCE (CVE-2025-55182)", "critical", r"(19\.0\.0|19\.1\.0|19\.1\.1|19\.2\.0)\b"),
    ("React RSC Source Code Exposure (CVE-2025-55183)", "medium", r"(19\.(?:0\.[0-2]|1\.[0-3]|2\.[0-2]))\b"),
    ("React RSC DoS (CVE-2025-55184/CVE-2025-67779)", "high", r"(19\.(?:0\.[0-2]|1\.[0-3]|2\.[0-2]))\b"),
    ("React RSC DoS (CVE-2026-23864)", "high", r"(19\.(?:0\.[0-3]|1\.[0-4]|2\.[0-3]))\b"),
)
#: Leads for any page where the framework is seen, whatever its version.
NEXT = (
    "Next.js Middleware Bypass Advisory (CVE-2025-29927)",
    "Next.js SSRF Advisory (CVE-2024-34351)",
    "Next.js Cache Poisoning Advisory (CVE-2024-46982)",
    "Next.js Auth Bypass Advisory (CVE-2024-51479)",
    "Next.js Server Actions DoS Advisory (CVE-2024-56332)",
)
AUTHORITATIVE = ("meta generator", "REST generator")
#: Marks of server components in scripts.
FLIGHT, BRIDGE, ACTIONS = r"(?:self\.)?__next_f\s*(?:\.push|\[)", PACKAGE, r"createServerReference|callServerReference|\bcallServer\b|react\.server\.reference"


def wordpress(versions: DataFrame) -> DataFrame:
    """(page_id, version, vuln_type, severity) of each page's first authoritative WordPress version in a range.

    The ranges are a literal array, so the range join is a projection.
    """
    own = versions.where((F.lower("name") == "wordpress") & F.col("detection_method").isin(*AUTHORITATIVE))
    first = own.groupBy("page_id").agg(F.min_by("version", "seq").alias("version"))
    v = values.version_struct(F.col("version"))
    end = lambda x: values.version_struct(F.lit(x))
    hit = F.coalesce(*[F.when(v.between(end(a), end(b)), F.struct(F.lit(t).alias("vuln_type"), F.lit(s).alias("severity"))) for a, b, s, t in WORDPRESS])
    return first.withColumn("hit", hit).where("hit is not null").select("page_id", "version", "hit.vuln_type", "hit.severity")


def rsc_versions(scripts: DataFrame) -> DataFrame:
    """(page_id, seq, vuln_type, severity, version): one row for each match of each advisory in each script."""
    found = [F.transform(F.regexp_extract_all("text", F.lit(PACKAGE + "[^0-9]{0,15}" + v), F.lit(1)), _advised(t, s)) for t, s, v in RSC]
    each = scripts.where(F.contains("text", F.lit("react-server-dom-"))).select("page_id", "seq", F.explode(F.concat(*found)).alias("a"))
    return each.select("page_id", "seq", "a.vuln_type", "a.severity", "a.version")


def _advised(kind: str, severity: str):
    return lambda v: F.struct(F.lit(kind).alias("vuln_type"), F.lit(severity).alias("severity"), v.alias("version"))


def rsc_surface(scripts: DataFrame, window_objects: DataFrame) -> DataFrame:
    """(page_id, flight, bridge, actions, app_router, pages_router): what the page's scripts and globals show."""
    s = scripts.select("page_id", F.rlike("text", F.lit(FLIGHT)).alias("flight"), F.rlike("text", F.lit(BRIDGE)).alias("bridge"), F.rlike("text", F.lit(ACTIONS)).alias("actions"), F.lit(False).alias("pages"))
    w = window_objects.select("page_id", (F.col("key") == "__next_f").alias("flight"), F.lit(False).alias("bridge"), F.lit(False).alias("actions"), (F.col("key") == "__NEXT_DATA__").alias("pages"))
    both = s.unionByName(w).groupBy("page_id").agg(*[F.bool_or(c).alias(c) for c in ("flight", "bridge", "actions", "pages")])
    return both.select("page_id", "flight", "bridge", "actions", F.col("flight").alias("app_router"), F.col("pages").alias("pages_router"))


def rsc(scripts: DataFrame, window_objects: DataFrame) -> DataFrame:
    """Observed advisories, each once a page by its first script; else one inferred lead where the surface is there."""
    seen = rsc_versions(scripts).groupBy("page_id", "vuln_type", "severity", "version").agg(F.min("seq").alias("seq")).withColumn("disposition", F.lit("finding"))
    surface = rsc_surface(scripts, window_objects).where("flight or bridge or actions")
    labels = F.concat_ws(", ", F.when(F.col("flight"), "flight"), F.when(F.col("bridge"), "server-dom"), F.when(F.col("actions"), "server actions"))
    lead = surface.join(seen, "page_id", "left_anti").select("page_id", F.lit("React Server Components surface").alias("vuln_type"), F.lit("info").alias("severity"), labels.alias("version"), F.lit(None).cast("int").alias("seq"), F.lit("lead").alias("disposition"))
    return seen.select("page_id", "vuln_type", "severity", "version", F.col("seq").cast("int").alias("seq"), "disposition").unionByName(lead)


def next_leads(versions: DataFrame) -> DataFrame:
    """Five fixed leads for each page with any version entry of the framework."""
    pages = versions.where(F.startswith("name", F.lit("Next.js"))).select("page_id").distinct()
    return pages.select("page_id", F.explode(F.array(*[F.lit(n) for n in NEXT])).alias("vuln_type")).withColumn("severity", F.lit("info")).withColumn("disposition", F.lit("lead"))


def append_new(known: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` and the rows of ``more`` whose keys it lacks, nulls equal to nulls; of equal keys in ``more`` one stays."""
    a, b = known.alias("a"), more.dropDuplicates(keys).alias("b")
    cond = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = c if cond is None else cond & c
    return known.unionByName(b.join(a, cond, "left_anti").select(*[f"b.{c}" for c in known.columns]))
