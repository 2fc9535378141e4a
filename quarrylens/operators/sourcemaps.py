"""Source maps: references in scripts, the gate before a map is read, recovered sources, routes and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

MAPS, BYTES = 50, 26_214_400
ROUTE_DIRS = ("pages", "app", "routes", "views")
#: A package with its version in a dependency path.
PACKAGE = r"(@?[a-z0-9][a-z0-9._+-]*)@([0-9]+\.[0-9]+\.[0-9]+[A-Za-z0-9.+-]*)"
MAP_SCHEMA = "version int, sourceRoot string, sources array<string>, sourcesContent array<string>, names array<string>, ignoreList array<int>, x_google_ignoreList array<int>"


def references(text: Column) -> Column:
    """All map references of a script."""
    return F.regexp_extract_all(text, F.lit(r"(?://[#@]|/\*[#@])\s*sourceMappingURL\s*=\s*(\S+\.map)\b"), F.lit(1))


def join_url(base: Column, ref: Column) -> Column:
    """The reference resolved against its script's URL; null unless the result is http(s) with a host."""
    url = urls.resolved(F.coalesce(base, F.lit("")), F.coalesce(ref, F.lit("")))
    return F.when(F.rlike(url, F.lit(r"^https?://[^/?#]")), url)


def gate(candidates: DataFrame, targets: DataFrame, limit: int = MAPS) -> DataFrame:
    """``candidates`` (page_id, seq, referrer, ref) with url and skip: data-url, unresolvable, off-origin, repeated, count-cap or null."""
    host = targets.select("page_id", urls.host(F.col("url")).alias("target"))
    rows = candidates.join(host, "page_id", "left").withColumn("url", join_url(F.col("referrer"), F.col("ref")))
    skip = F.when(F.startswith(F.lower("ref"), F.lit("data:")), "data-url").when(F.col("url").isNull(), "unresolvable").when(~urls.in_scope(F.col("url"), F.col("target")), "off-origin")
    rows = rows.withColumn("skip", skip)
    first = F.row_number().over(Window.partitionBy("page_id", "url", F.col("skip").isNull()).orderBy("seq"))
    rows = rows.withColumn("skip", F.when(F.col("skip").isNull() & (first > 1), "repeated").otherwise(F.col("skip")))
    place = F.row_number().over(Window.partitionBy("page_id", F.col("skip").isNull()).orderBy("seq"))
    return rows.withColumn("skip", F.when(F.col("skip").isNull() & (place > limit), "count-cap").otherwise(F.col("skip"))).drop("target")


def parse(maps: DataFrame) -> DataFrame:
    """(columns of ``maps`` but body, idx, path, content, ignored) of every source; bodies that aren't objects, or too large, give none."""
    keep = [c for c in maps.columns if c != "body"]
    m = F.from_json("body", MAP_SCHEMA)
    rows = maps.where(F.startswith(F.ltrim("body"), F.lit("{")) & (F.octet_length("body") <= BYTES)).select(*keep, m.alias("m"))
    each = rows.select(*keep, "m", F.posexplode("m.sources").alias("idx", "raw")).where("raw is not null")
    root = F.coalesce(F.col("m.sourceRoot"), F.lit(""))
    path = F.when((root == "") | F.contains("raw", F.lit("://")) | F.startswith("raw", F.lit("/")), F.col("raw")).when(F.endswith(root, F.lit("/")), F.concat(root, "raw")).otherwise(F.concat(root, F.lit("/"), "raw"))
    ignored = F.coalesce(F.array_contains(F.coalesce("m.ignoreList", "m.x_google_ignoreList"), F.col("idx")), F.lit(False))
    return each.select(*keep, "idx", path.alias("path"), F.nullif(F.get("m.sourcesContent", F.col("idx")), F.lit("")).alias("content"), ignored.alias("ignored"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(path, F.lit("://")), F.regexp_replace(path, r"^.*?:///*", "")).otherwise(path), r"^(?:\./)+", "")


def vendor(path: Column) -> Column:
    return F.rlike(path, F.lit(r"node_modules|/vendor/|^vendor/|/\.pnpm/"))


def routes(paths: DataFrame) -> DataFrame:
    """(page_id, path, kind, dynamic, seq) of ``paths(page_id, seq, path)``: controllers, routes and APIs by the deepest route folder."""
    rows = paths.select("page_id", "seq", normal_path(F.col("path")).alias("p")).where(~vendor(F.col("p")))
    low = F.transform(F.split("p", "/"), lambda s: F.lower(s))
    back = F.array_max(F.transform(low, lambda s, i: F.when(s.isin(*ROUTE_DIRS), i)))
    rest = F.array_join(F.slice(F.split("p", "/"), F.coalesce(back, F.lit(0)) + 2, 10_000), "/")
    stem = F.regexp_replace(rest, r"\.[^.]*$", "")
    stem = F.when(stem == "index", "").otherwise(F.regexp_replace(stem, "/index$", ""))
    route = F.concat(F.lit("/"), F.regexp_replace(stem, "^/+", ""))
    rows = rows.withColumn("back", back).withColumn("rest", rest).withColumn("route", route)
    control = F.contains(F.lower("p"), F.lit("controller"))
    kind = F.when(control, "controller").when(F.col("back").isNull() | (F.col("rest") == ""), None).when(F.rlike("route", F.lit("^/api(?:/|$)")), "api").otherwise("route")
    rows = rows.select("page_id", "seq", kind.alias("kind"), F.when(control, F.col("p")).otherwise(F.col("route")).alias("path"), F.when(control, False).otherwise(F.rlike("route", F.lit(r"[\[:]"))).alias("dynamic")).where("kind is not null")
    return first_of(rows, ["page_id", "kind", "path", "dynamic"])


def first_of(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row for each combination of ``keys``, with its first place."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def package_versions(paths: DataFrame) -> DataFrame:
    """(page_id, name, version, seq) of packages in dependency paths."""
    rows = paths.select("page_id", "seq", normal_path(F.col("path")).alias("p")).where(F.rlike("p", F.lit(r"node_modules|/\.pnpm/")))
    zipped = F.arrays_zip(F.regexp_extract_all("p", F.lit(PACKAGE), F.lit(1)).alias("name"), F.regexp_extract_all("p", F.lit(PACKAGE), F.lit(2)).alias("version"))
    each = rows.select("page_id", "seq", F.explode(zipped).alias("v"))
    named = each.select("page_id", "seq", F.replace(F.regexp_replace("v.name", "^@+", ""), F.lit("+"), F.lit("/")).alias("name"), "v.version").where("name <> ''")
    return first_of(named, ["page_id", "name", "version"])


def intel(referenced: DataFrame, bodies: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """The whole chain: the gate's log, the maps' sources, their routes and package versions."""
    log = gate(referenced, targets)
    sources = parse(log.where("skip is null").join(bodies, "url").select("page_id", "seq", "url", "body"))
    paths = sources.select("page_id", (F.col("seq") * 1_000_000 + F.col("idx")).alias("seq"), "path")
    return {"log": log, "sources": sources, "routes": routes(paths), "versions": package_versions(paths)}
