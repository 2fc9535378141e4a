"""Versions of frameworks and content systems: from meta tags, observed responses, asset URLs and captured globals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .technologies import asset_versions, generator_version

#: How a version was found, in order of trust.
META, REST, ASSETS = "meta generator", "REST generator", "asset consensus"
#: A React build on a public delivery network, with its version.
CDN = r"(?:unpkg\.com|cdn\.jsdelivr\.net|cdnjs\.cloudflare\.com)/(?:npm/)?react(?:-dom)?@([0-9]+\.[0-9]+\.[0-9]+)"
#: Folders of the two routers' chunks.
APP_CHUNKS, PAGE_CHUNKS = "/_next/static/chunks/app/", "/_next/static/chunks/pages/"


def marked(url: Column) -> Column:
    return urls.any_of(F.lower(url), (*urls.WORDPRESS_PARTS, "rest_route=/"))


def wordpress(calls: DataFrame, meta: DataFrame, scripts: DataFrame) -> DataFrame:
    """(page_id, version, detection_method) of pages with signs of WordPress; both null where only a sign is there.

    ``calls``: page_id, seq, url, response_body; ``meta``: page_id, pos, name, content; ``scripts``: page_id, src.
    The generator's meta tag beats a REST answer's ``generator``, and that a version which two assets or more agree on.
    """
    generator = meta.where(F.lower("name") == "generator")
    told = generator.withColumn("version", generator_version(F.col("content"))).where("version is not null")
    said = F.get_json_object("response_body", "$.generator")
    asked = calls.where(urls.any_of(F.lower("url"), ("/wp-json/", "rest_route=/"))).withColumn("version", generator_version(said)).where("version is not null")
    addresses = calls.select("page_id", "url").union(scripts.where("src is not null").select("page_id", F.col("src").alias("url")))
    signs = addresses.where(marked(F.col("url"))).select("page_id").union(generator.where(F.contains(F.lower("content"), F.lit("wordpress"))).select("page_id"))
    first = lambda rows, order, name: rows.groupBy("page_id").agg(F.min_by("version", order).alias(name))
    agreed = asset_versions(addresses).select("page_id", F.col("version").alias("third"))
    every = signs.union(told.select("page_id")).union(asked.select("page_id")).distinct()
    out = every.join(first(told, "pos", "first"), "page_id", "left").join(first(asked, "seq", "second"), "page_id", "left").join(agreed, "page_id", "left")
    how = F.when(F.col("first").isNotNull(), META).when(F.col("second").isNotNull(), REST).when(F.col("third").isNotNull(), ASSETS)
    return out.select("page_id", F.coalesce("first", "second", "third").alias("version"), how.alias("detection_method"))


def wordpress_leads(technologies: DataFrame, versions: DataFrame) -> DataFrame:
    """(page_id, lead) where WordPress is among ``technologies(page_id, name)`` and no authoritative version is known."""
    there = technologies.where(F.lower("name") == "wordpress").select("page_id").distinct()
    both = there.join(versions.select("page_id", "version", "detection_method"), "page_id", "left")
    lead = F.when(F.col("version").isNull(), "no authoritative version was seen").when(F.col("detection_method") == ASSETS, F.concat(F.lit("version "), "version", F.lit(" only by agreeing assets")))
    return both.select("page_id", lead.alias("lead")).where("lead is not null")


def react(window: DataFrame, scripts: DataFrame) -> DataFrame:
    """(page_id, name, version, detection_method): by the runtime's hook, else by the first script of a delivery network.

    ``window``: page_id, key, value, where key ``React.version`` or the hook's value has the version; ``scripts``: page_id, pos, src.
    """
    hook = F.when(F.col("key") == "React.version", F.col("value")).when(F.col("key") == "__REACT_DEVTOOLS_GLOBAL_HOOK__", F.get_json_object("value", "$.renderers[0].version"))
    live = window.select("page_id", hook.alias("version"), (F.col("key") == "React.version").cast("int").alias("k")).where("version is not null").groupBy("page_id").agg(F.min_by("version", "k").alias("live"))
    number = F.nullif(F.regexp_extract("src", CDN, 1), F.lit(""))
    linked = scripts.select("page_id", "pos", number.alias("version")).where("version is not null").groupBy("page_id").agg(F.min_by("version", "pos").alias("linked"))
    both = live.join(linked, "page_id", "full")
    return both.select("page_id", F.lit("React").alias("name"), F.coalesce("live", "linked").alias("version"), F.when(F.col("live").isNotNull(), "runtime hook").otherwise("delivery network URL").alias("detection_method"))


def next_metadata(window: DataFrame) -> DataFrame:
    """(page_id, name, version, detection_method) of pages with Next.js' page data; a development build is told by its build id."""
    own = window.where("key = '__NEXT_DATA__'").groupBy("page_id").agg(F.max(F.get_json_object("value", "$.buildId") == "development").alias("dev"))
    return own.select("page_id", F.lit("Next.js (Pages Router)").alias("name"), F.lit(None).cast("string").alias("version"), F.when(F.col("dev"), "page data, development build").otherwise("page data").alias("detection_method"))


def next_router(scripts: DataFrame) -> DataFrame:
    """(page_id, name, version, detection_method): the router by its chunks' folder; the app router if both are there."""
    has = lambda part: F.bool_or(F.contains("src", F.lit(part)))
    own = scripts.where("src is not null").groupBy("page_id").agg(has(APP_CHUNKS).alias("app"), has(PAGE_CHUNKS).alias("pages"))
    name = F.when(F.col("app"), "Next.js (App Router)").when(F.col("pages"), "Next.js (Pages Router)")
    return own.select("page_id", name.alias("name"), F.lit(None).cast("string").alias("version"), F.lit("script folder").alias("detection_method")).where("name is not null")


def frameworks(window: DataFrame, scripts: DataFrame) -> DataFrame:
    """All of the above for React and Next.js."""
    return react(window, scripts).unionByName(next_metadata(window)).unionByName(next_router(scripts))
