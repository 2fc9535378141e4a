"""Framework manifests: routes from captured globals, islands and chunk names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paths that are the framework's own, and chunk names without meaning.
INTERNAL = ("/_app", "/_error", "/_document", "/_next", "/__layout", "/__error")
GENERIC = ("app", "chunk", "index", "main", "polyfills", "runtime", "script", "signals", "vendor")
STEM = r"([A-Za-z0-9_.\[\]-]+?)(?:[-.][0-9a-f]{6,})?\.[cm]?js$"
HOPS = 64


def dynamic(path: Column) -> Column:
    return F.rlike(path, F.lit(r"[\[:*]"))


def opaque(stem: Column) -> Column:
    low = F.lower(stem)
    base36 = (F.length(stem) >= 10) & F.rlike(stem, F.lit("^[a-z0-9_-]+$")) & (F.rlike(stem, F.lit("^[0-9]")) | (F.length(F.regexp_replace(stem, "[^0-9]", "")) >= 3))
    return (stem == "") | F.rlike(stem, F.lit("^(?:[0-9]+|[0-9a-fA-F]{6,})$")) | F.startswith(low, F.lit("turbopack-")) | low.isin(*GENERIC) | base36


def chunk_stem(url: Column) -> Column:
    """The name of a chunk's file without hash; null if it says nothing."""
    stem = F.regexp_extract(F.element_at(F.split(url, "/"), -1), STEM, 1)
    return F.when(~opaque(stem), stem)


def _without_groups(segments: Column) -> Column:
    return F.filter(segments, lambda s: ~F.rlike(s, F.lit(r"^\(.*\)$")))


def flight_path(segments: Column) -> Column:
    kept = F.filter(_without_groups(F.split(segments, "/")), lambda s: (s != "") & ~F.startswith(s, F.lit("@")))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _route(path: Column, kind, source: str, order: int) -> Column:
    return F.struct(path.alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(source).alias("source"), F.lit(order).alias("order"))


def _routes(paths: Column, kind: str, source: str, order: int) -> Column:
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: _route(p, kind, source, order))


def pushed(globals_: DataFrame, chunks: DataFrame | None = None, islands: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, path, kind, source, order): every route that some source names, repeats included; sources go by ``order``, a source's routes by ``pos``.

    ``globals_``: page_id, key, value (JSON text; what isn't JSON is skipped); ``chunks``: page_id, url;
    ``islands``: page_id, attrs (JSON).
    """
    v, k = F.col("value"), F.col("key")
    outside = lambda p: ~p.isin(*INTERNAL)
    rooted = lambda a: F.filter(a, lambda p: F.startswith(p, F.lit("/")))
    page = F.get_json_object(v, "$.page")
    kept = F.when(page.isNotNull() & (page != "") & outside(page), F.array(page))
    build = F.filter(rooted(F.concat(F.coalesce(F.json_object_keys(v), F.array().cast("array<string>")), F.coalesce(F.from_json(F.get_json_object(v, "$.sortedPages"), "array<string>"), F.array().cast("array<string>")))), outside)
    rewrites = rooted(F.flatten(F.array(*[F.coalesce(F.from_json(F.get_json_object(v, f"$.__rewrites.{g}[*].destination"), "array<string>"), F.array(F.get_json_object(v, f"$.__rewrites.{g}[*].destination"))) for g in ("beforeFiles", "afterFiles", "fallback")])))
    app = r"app/([A-Za-z0-9_./()\[\]@.-]*?)/(page|layout|route)\b"
    pairs = F.arrays_zip(F.regexp_extract_all(v, F.lit(app), F.lit(1)).alias("s"), F.regexp_extract_all(v, F.lit(app), F.lit(2)).alias("t"))
    flight = F.filter(F.transform(pairs, lambda x: _route(flight_path(x["s"]), F.when(x["t"] == "route", "api").otherwise("route"), "next:flight", 4)), lambda r: outside(r["path"]))
    nuxt = F.coalesce(F.get_json_object(v, "$.path"), F.get_json_object(v, "$.routePath"))
    svelte = F.array_join(_without_groups(F.split(F.get_json_object(v, "$.route.id"), "/")), "/")
    svelte = F.when(svelte == "", "/").otherwise(svelte)
    found = (
        F.when(k == "__NEXT_DATA__", _routes(kept, "route", "next:next-data", 0))
        .when(k == "__BUILD_MANIFEST", F.concat(_routes(build, "route", "next:build-manifest", 1), _routes(F.filter(rewrites, lambda p: p.isNotNull()), "route", "next:rewrite", 2)))
        .when(k == "__SSG_MANIFEST", _routes(rooted(F.from_json(v, "array<string>")), "route", "next:ssg-manifest", 3))
        .when(k == "__next_f", flight)
        .when(k == "__NUXT__", F.concat(_routes(rooted(F.array(nuxt)), "route", "nuxt:payload", 5), _routes(rooted(F.json_object_keys(F.get_json_object(v, "$.data"))), "api", "nuxt:data-keys", 6)))
        .when(k == "__sveltekit_data", _routes(rooted(F.array(svelte)), "route", "sveltekit:start", 7))
    )
    rows = globals_.select("page_id", F.posexplode(found).alias("pos", "r")).select("page_id", "pos", "r.*")
    if islands is not None:
        stem = chunk_stem(F.get_json_object("attrs", "$.component-url"))
        rows = rows.unionByName(islands.select("page_id", F.lit(0).alias("pos"), stem.alias("path"), F.lit("component").alias("kind"), F.lit("astro:island").alias("source"), F.lit(8).alias("order")))
    if chunks is not None:
        rows = rows.unionByName(chunks.select("page_id", F.lit(0).alias("pos"), chunk_stem(F.col("url")).alias("path"), F.lit("component").alias("kind"), F.lit("chunk-graph").alias("source"), F.lit(9).alias("order")))
    return rows.where("path is not null and path <> ''")


def routes(globals_: DataFrame, chunks: DataFrame | None = None, islands: DataFrame | None = None) -> DataFrame:
    """(page_id, path, kind, source, dynamic): each (path, kind) of a page once, by the first source; see ``pushed``."""
    first = pushed(globals_, chunks, islands).groupBy("page_id", "path", "kind").agg(F.min(F.struct("order", "pos", "source")).alias("first"))
    return first.select("page_id", "path", "kind", "first.source", dynamic(F.col("path")).alias("dynamic"))


#: Which manifests list the routes that their framework's sources have named so far, and up to which source; and which list their own source's.
SO_FAR = {"next-data": 0, "nuxt-payload": 6, "sveltekit-start": 7}
OWN = {"build-manifest": 1, "ssg-manifest": 3}
#: Places of a source that are numbered together.
STRETCH = 4096


def numbered(rows: DataFrame, by: list[str], order: list[str], place: str, stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``place``: from 0, their number in ``by`` in the order of ``order``, whose last two are a source's number and a place in it.

    In two levels: inside a stretch of a source's places, and with the sum of all stretches before.  So no task sorts a group of
    very many rows; the window over groups only has a row for each stretch.
    """
    own = rows.withColumn("_stretch", F.floor(F.col(order[1]) / stretch))
    cell = [*by, order[0], "_stretch"]
    each = own.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order[0], "_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = each.withColumn("_before", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*order[1:])) - 1
    return own.withColumn("_inside", inside).join(carry, cell).withColumn(place, F.col("_before") + F.col("_inside")).drop("_stretch", "_inside", "_before")


def listed(globals_: DataFrame) -> DataFrame:
    """(page_id, framework, manifest_type, place, path): the routes that each manifest lists, in order.

    A manifest that is read when its framework's sources have named some routes lists these, each (path, kind) where it came first; the build
    and static manifests list what they name themselves.  A row a route: no list of a page is ever gathered.
    """
    rows = pushed(globals_)
    framework = F.when(F.col("order") <= 4, "Next.js").when(F.col("order") <= 6, "Nuxt").otherwise("SvelteKit")
    first = rows.withColumn("framework", framework).groupBy("page_id", "framework", "path", "kind").agg(F.min(F.struct("order", "pos")).alias("at")).select("page_id", "framework", "path", "kind", "at.order", "at.pos")
    order = numbered(first, ["page_id", "framework"], ["order", "pos", "path", "kind"], "place")
    upto = F.create_map(*[F.lit(x) for kv in SO_FAR.items() for x in kv])[F.col("manifest_type")]
    marks = captured(globals_).where(F.col("manifest_type").isin(*SO_FAR)).select("page_id", "framework", "manifest_type", upto.alias("upto")).distinct()
    so_far = order.join(marks, ["page_id", "framework"]).where("order <= upto").select("page_id", "framework", "manifest_type", "place", "path")
    type_ = F.create_map(*[F.lit(x) for k, v in OWN.items() for x in (v, k)])[F.col("order")]
    own = rows.where(F.col("order").isin(*OWN.values())).select("page_id", F.lit("Next.js").alias("framework"), type_.alias("manifest_type"), "order", "pos", "path")
    own = numbered(own, ["page_id", "framework", "manifest_type"], ["order", "pos", "path"], "place").select("page_id", "framework", "manifest_type", "place", "path")
    return so_far.unionByName(own)


def remix_entries(globals_: DataFrame) -> DataFrame:
    """(page_id, id, parent_id, path, has_action) of each page's ``__remixManifest``, else of the manifest in ``__remixContext``."""
    own = globals_.where("key in ('__remixManifest', '__remixContext')").groupBy("page_id").agg(F.min_by("value", F.when(F.col("key") == "__remixManifest", 0).otherwise(1)).alias("v"))
    kept = F.from_json(F.coalesce(F.get_json_object("v", "$.manifest.routes"), F.get_json_object("v", "$.routes")), "map<string,struct<path:string,parentId:string,hasAction:boolean>>")
    each = own.select("page_id", F.explode(kept).alias("id", "r"))
    return each.select("page_id", "id", F.col("r.parentId").alias("parent_id"), F.col("r.path").alias("path"), F.coalesce("r.hasAction", F.lit(False)).alias("has_action"))


def remix_routes(globals_: DataFrame) -> DataFrame:
    """(page_id, path, kind, source, dynamic) of Remix manifests: full paths; an id or path that says api, or an action of a dotted id, is an API."""
    entries = remix_entries(globals_)
    both = nested_paths(entries.drop("has_action")).join(entries.select("page_id", "id", "has_action"), ["page_id", "id"])
    path, id_ = F.col("full_path"), F.col("id")
    api = F.startswith(path, F.lit("/api/")) | (path == "/api") | F.contains(id_, F.lit("api.")) | (F.col("has_action") & F.contains(id_, F.lit(".")))
    return both.select("page_id", path.alias("path"), F.when(api, "api").otherwise("route").alias("kind"), F.lit("remix:manifest").alias("source"), dynamic(path).alias("dynamic")).distinct()


def gated(globals_: DataFrame, technologies: DataFrame) -> DataFrame:
    """``globals_`` without the manifests that no sign of their framework goes with: Remix's needs the technology or its context; the others are such signs themselves."""
    sign = technologies.where(F.contains(F.lower("name"), F.lit("remix"))).select("page_id").union(globals_.where("key = '__remixContext'").select("page_id")).distinct()
    other = globals_.where("key <> '__remixManifest'")
    return other.unionByName(globals_.where("key = '__remixManifest'").join(sign, "page_id", "left_semi").select(*other.columns))


def merged(*found: DataFrame) -> DataFrame:
    """(page_id, path, kind, source, dynamic): routes of several tables, each (path, kind) of a page by the first table that has it."""
    rows = None
    for k, f in enumerate(found):
        own = f.select("page_id", "path", "kind", "source", "dynamic", F.lit(k).alias("order"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("page_id", "path", "kind").agg(F.min(F.struct("order", "source", "dynamic")).alias("first"))
    return first.select("page_id", "path", "kind", "first.source", "first.dynamic")


def captured(globals_: DataFrame, chunks: DataFrame | None = None, islands: DataFrame | None = None) -> DataFrame:
    """(page_id, framework, manifest_type, build_id) of every manifest that a page's globals, islands and chunk names hold."""
    v, k = F.col("value"), F.col("key")
    kind = F.schema_of_variant(F.try_parse_json(v))
    some, object_, list_ = kind.isNotNull(), F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
    row = lambda framework, type_, build=None: F.struct(F.lit(framework).alias("framework"), F.lit(type_).alias("manifest_type"), (F.lit(None) if build is None else F.coalesce(*[F.get_json_object(v, b) for b in build])).cast("string").alias("build_id"))
    paged = F.rlike(v, F.lit(r"app/([A-Za-z0-9_./()\[\]@.-]*?)/(page|layout|route)\b"))
    routed = F.coalesce(F.get_json_object(v, "$.manifest.routes"), F.get_json_object(v, "$.routes"))
    made = (
        F.when((k == "__NEXT_DATA__") & some, row("Next.js", "next-data", ["$.buildId"]))
        .when((k == "__BUILD_MANIFEST") & object_, row("Next.js", "build-manifest"))
        .when((k == "__SSG_MANIFEST") & list_, row("Next.js", "ssg-manifest"))
        .when((k == "__next_f") & paged, row("Next.js", "next-flight"))
        .when((k == "__NUXT__") & some, row("Nuxt", "nuxt-payload", ["$.config.app.buildId"]))
        .when((k == "__sveltekit_data") & some, row("SvelteKit", "sveltekit-start"))
        .when(k.isin("__remixManifest", "__remixContext") & routed.isNotNull(), row("Remix", "remix-manifest", ["$.manifest.version", "$.version"]))
    )
    rows = globals_.select("page_id", made.alias("m")).where("m is not null").select("page_id", "m.*")
    add = lambda pages, framework, type_: pages.select("page_id", F.lit(framework).alias("framework"), F.lit(type_).alias("manifest_type"), F.lit(None).cast("string").alias("build_id")).distinct()
    if islands is not None:
        rows = rows.unionByName(add(islands, "Astro", "astro-islands"))
    if chunks is not None:
        rows = rows.unionByName(add(chunks.where(chunk_stem(F.col("url")).isNotNull()), "Vite/webpack", "chunk-graph"))
    return rows.distinct()


def nested_paths(entries: DataFrame, hops: int = HOPS) -> DataFrame:
    """(page_id, id, full_path) of ``entries(page_id, id, parent_id, path)``: segments from the root down.

    Chains that miss a parent, or run over ``hops`` (cycles), are left out.  One recursive query walks
    all pages' chains at once; its ``limit all`` lifts Spark's bound on the rows of a recursion (1,000,000).
    """
    segment = F.array_join(F.transform(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: F.when(p == "$", "*").when(F.startswith(p, F.lit("$")), F.concat(F.lit(":"), F.regexp_replace(p, r"^\$", ""))).otherwise(p)), "/")
    spark = entries.sparkSession
    entries.select("page_id", "id", "parent_id", segment.alias("seg")).createOrReplaceTempView("nested_entries")
    walked = spark.sql(f"""
        with recursive walk(page_id, id, at, full, hop) as (
            select page_id, id, parent_id, seg, 1 from nested_entries
            union all
            select w.page_id, w.id, e.parent_id, case when e.seg = '' then w.full when w.full = '' then e.seg else concat(e.seg, '/', w.full) end, w.hop + 1
            from walk w join nested_entries e on w.page_id = e.page_id and w.at = e.id where w.hop < {hops}
        ) select page_id, id, replace(concat('/', full), '//', '/') as full_path from (select * from walk limit all) where at is null""")
    return walked
