"""Sources: target lists, configuration, captured pages taken apart into elements and text artifacts."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE = 5000
DATA_KEYS = ("data-api", "data-url", "data-endpoint", "data-key", "data-token", "data-config")
GLOBAL_SIZE, MANIFEST_SIZE = 10_000, 200_000
MANIFESTS = ("__BUILD_MANIFEST", "__SSG_MANIFEST", "__next_f", "__remixManifest")
ELEMENTS = "array<struct<tag:string,attrs:map<string,string>,text:string,pos:int,controls:int>>"
_ARROW = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("pos", pa.int32()), ("controls", pa.int32())]))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url) of a list with one URL a line; blank and ``#`` lines are skipped, any other line that isn't http(s), or no URL at all, is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")
    bad = lines.where(~F.rlike("url", F.lit("^https?://"))).limit(1).collect()
    if bad:
        raise ValueError(f"not an http(s) URL: {bad[0]['url'][:80]}")
    if lines.isEmpty():
        raise ValueError("no URLs")
    return lines.select(F.monotonically_increasing_id().alias("page_id"), "url")


@dataclass
class Config:
    """What a run is asked to do; ``merge`` takes a file's settings where the caller left the default."""

    url: str | None = None
    file: str | None = None
    output: str = "reports"
    format: str = "both"
    timeout: int = 30
    captured: str = "captured"
    custom_patterns: list = field(default_factory=list)
    ignore_patterns: list = field(default_factory=list)

    FORMATS = {"json": "json", "md": "md", "markdown": "md", "both": "both"}

    @staticmethod
    def read(path: str | None, folders: tuple[str, ...] = (".", "~/.config/quarrylens")) -> dict:
        """The first of the given file and the usual places; a given file must exist."""
        if path is not None:
            return tomllib.loads(Path(path).read_text())
        for f in folders:
            p = Path(f).expanduser() / "quarrylens.toml"
            if p.is_file():
                return tomllib.loads(p.read_text())
        return {}

    @classmethod
    def arguments(cls, args: list[str] | None = None) -> Config:
        """From a command line, with the settings file's values where the caller gives none; checked."""
        import argparse

        p = argparse.ArgumentParser(description="Analyse captured pages.")
        p.add_argument("url", nargs="?")
        p.add_argument("--file")
        p.add_argument("--output", default=cls.output)
        p.add_argument("--format", default=cls.format)
        p.add_argument("--timeout", type=int, default=cls.timeout)
        p.add_argument("--captured", default=cls.captured, help="folder of captured tables, one Parquet table each")
        p.add_argument("--ignore-pattern", action="append", default=[], dest="ignore_patterns")
        p.add_argument("--config")
        given = vars(p.parse_args(args))
        settings = cls.read(given.pop("config"))
        return cls(**given).merge(settings).check()

    def merge(self, settings: dict) -> Config:
        default = Config()
        for f in fields(self):
            if f.name not in settings:
                continue
            given, own = settings[f.name], getattr(self, f.name)
            if isinstance(own, list):
                own.extend([tuple(x.values()) if isinstance(x, dict) else x for x in given])
            elif own == getattr(default, f.name):
                setattr(self, f.name, given)
        self.format = self.FORMATS.get(str(self.format).lower(), default.format)
        return self

    def check(self) -> Config:
        if (self.url is None) == (self.file is None):
            raise ValueError("exactly one of url and file is needed")
        return self


class _Elements(HTMLParser):
    RAW = ("script", "style", "title", "textarea")
    CONTROLS = ("input", "select", "textarea", "button")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.forms: list[dict] = []

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        item = {"tag": tag, "attrs": own, "text": None, "pos": len(self.out), "controls": 0}
        self.out.append(item)
        if tag in self.CONTROLS and self.forms:
            self.forms[-1]["controls"] += 1
        if tag == "form":
            self.forms.append(item)
        if tag in self.RAW:
            self.open.append(item)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.RAW and self.open:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "form" and self.forms:
            self.forms.pop()
        if self.open and self.open[-1]["tag"] == tag:
            self.open.pop()

    def handle_data(self, data):
        if self.open:
            self.open[-1]["text"] = (self.open[-1]["text"] or "") + data


def _parse(html: str | None) -> list[dict]:
    p = _Elements()
    p.feed(html or "")
    p.close()
    return [e | {"attrs": list(e["attrs"].items())} for e in p.out]


#: Pages whose elements a worker has as Python objects at once.
AT_ONCE = 64


def _sliced(column: pa.Array, made, kind: pa.DataType) -> pa.Array:
    """What ``made`` gives of the column's values, some at a time: a batch of pages is far larger as objects than as an array."""
    parts = [made(column.slice(at, AT_ONCE).to_pylist()) for at in range(0, len(column), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def elements_of(html: Column) -> Column:
    """Start tags in order, with attributes (the first of equal names), raw text of scripts and the like, and a form's controls."""

    @F.arrow_udf(ELEMENTS)
    def of(column: pa.Array) -> pa.Array:
        return _sliced(column, lambda html: pa.array([_parse(h) for h in html], _ARROW), _ARROW)

    return of(html)


#: Characters of a page's error that are kept.
ERROR = 500


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``e``, the elements, and ``error``: what kept the page from being parsed, else null.  A page that breaks the parser breaks nothing else."""

    def tried(html: str | None) -> dict:
        try:
            return {"e": _parse(html), "error": None}
        except MemoryError:  # of the worker, not of the page
            raise
        except Exception as x:  # of any other kind: it is the page's row that tells it
            return {"e": None, "error": f"{type(x).__name__}: {x}"[:ERROR]}

    @F.arrow_udf(f"struct<e:{ELEMENTS},error:string>")
    def of(column: pa.Array) -> pa.Array:
        kind = pa.struct([("e", _ARROW), ("error", pa.string())])
        return _sliced(column, lambda html: pa.array([tried(h) for h in html], kind), kind)

    return pages.withColumn("_p", of(F.col("html"))).select(*pages.columns, "_p.e", "_p.error")


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, attrs, text, controls) of pages(page_id, url, html), or of what ``parsed`` made of them."""
    e = F.col("e") if "e" in pages.columns else elements_of(F.col("html"))
    return pages.select("page_id", F.inline(e)).select("page_id", "pos", "tag", "attrs", "text", "controls")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def forms(e: DataFrame) -> DataFrame:
    return e.where("tag = 'form'").select("page_id", "pos", F.coalesce(_attr("action"), F.lit("")).alias("action"), F.coalesce(_attr("method"), F.lit("get")).alias("method"), F.col("controls").alias("input_count"))


def hidden_inputs(e: DataFrame) -> DataFrame:
    return e.where((F.col("tag") == "input") & (F.lower(_attr("type")) == "hidden")).select("page_id", "pos", F.coalesce(_attr("name"), F.lit("")).alias("name"), F.coalesce(_attr("value"), F.lit("")).alias("value"))


def meta_tags(e: DataFrame) -> DataFrame:
    return e.where("tag = 'meta'").select("page_id", "pos", F.coalesce(F.nullif(_attr("name"), F.lit("")), _attr("property"), F.lit("")).alias("name"), F.coalesce(_attr("content"), F.lit("")).alias("content"))


def data_attributes(e: DataFrame) -> DataFrame:
    some = F.arrays_overlap(F.map_keys("attrs"), F.array(*[F.lit(k) for k in DATA_KEYS]))
    return e.where(some).select("page_id", "pos", "tag", F.map_filter("attrs", lambda k, v: F.startswith(k, F.lit("data-"))).alias("attributes"))


def iframes(e: DataFrame) -> DataFrame:
    return e.where("tag = 'iframe'").select("page_id", "pos", F.coalesce(_attr("src"), F.lit("")).alias("src"))


def link_counts(pages: DataFrame) -> DataFrame:
    """(page_id, links) of every row that has any: distinct href and src values as written.  Nothing is shuffled."""
    refs = F.array_compact(F.flatten(F.transform("e", lambda x: F.array(F.try_element_at(x["attrs"], F.lit("href")), F.try_element_at(x["attrs"], F.lit("src"))))))
    made = pages.select("page_id", elements_of(F.col("html")).alias("e"))
    return made.select("page_id", F.size(F.array_distinct(refs)).cast("long").alias("links")).where("links > 0")


def scripts(e: DataFrame, inline: int | None = INLINE) -> DataFrame:
    """(page_id, pos, src, body): inline bodies are cut to ``inline`` characters, if any are given; external ones have none here."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(_attr("src").isNull(), text if inline is None else F.left(text, F.lit(inline)))
    return e.where("tag = 'script'").select("page_id", "pos", _attr("src").alias("src"), body.alias("body"))


def chunk_urls(e: DataFrame) -> DataFrame:
    """Script sources, then preloaded ones."""
    pre = (F.col("tag") == "link") & ((F.lower(_attr("rel")) == "modulepreload") | ((F.lower(_attr("rel")) == "preload") & (F.lower(_attr("as")) == "script")))
    a = e.where((F.col("tag") == "script") & _attr("src").isNotNull()).select("page_id", F.lit(0).alias("k"), "pos", _attr("src").alias("url"))
    return a.unionByName(e.where(pre & _attr("href").isNotNull()).select("page_id", F.lit(1).alias("k"), "pos", _attr("href").alias("url")))


def islands(e: DataFrame) -> DataFrame:
    return e.where("tag = 'astro-island'").select("page_id", "pos", F.to_json("attrs").alias("attrs"))


#: Labels' places in the order of capture, times 10 ** 9.
PLACES = {"html": 0, "hidden": 1, "data": 2, "local": 3, "session": 4, "script": 5, "window": 6, "map": 7}


def artifacts(pages: DataFrame, storage: DataFrame | None = None, bodies: DataFrame | None = None, window_objects: DataFrame | None = None, recovered: DataFrame | None = None, inline: int | None = INLINE, size: int | None = GLOBAL_SIZE, manifest_size: int | None = MANIFEST_SIZE) -> DataFrame:
    """(page_id, seq, label, text): everything of a page that detectors read, in the order of capture.  A page is parsed once, or not at all if ``parsed`` did so.

    ``inline``, ``size`` and ``manifest_size``: characters of inline scripts, globals and manifests that are read; null for all.

    ``storage``: page_id, area, key, value; ``bodies``: page_id, pos, src, body of external scripts;
    ``window_objects``: page_id, key, value; ``recovered``: page_id, pos, path, content.
    """
    seq = lambda kind, c: (F.lit(PLACES[kind] * 10**9) + c).cast("long").alias("seq")
    piece = lambda kind, x, label, text: F.struct(seq(kind, x["pos"]), label.alias("label"), text.alias("text"))
    attr = lambda x, name: F.try_element_at(x["attrs"], F.lit(name))
    said = lambda c: F.coalesce(c, F.lit(""))

    def of(x: Column) -> Column:
        """What an element gives."""
        some = F.arrays_overlap(F.map_keys(x["attrs"]), F.array(*[F.lit(k) for k in DATA_KEYS]))
        hidden = F.when((x["tag"] == "input") & (F.lower(attr(x, "type")) == "hidden"), piece("hidden", x, F.concat(F.lit("Hidden Input: "), said(attr(x, "name"))), said(attr(x, "value"))))
        data = F.when(some, piece("data", x, F.concat(F.lit("Data Attributes: "), x["tag"]), F.to_json(F.map_filter(x["attrs"], lambda k, v: F.startswith(k, F.lit("data-"))))))
        code = said(x["text"]) if inline is None else F.left(said(x["text"]), F.lit(inline))
        return F.array_compact(F.array(hidden, data, F.when((x["tag"] == "script") & attr(x, "src").isNull(), piece("script", x, F.lit("Inline Script"), code))))

    page = F.array(F.struct(seq("html", F.lit(0)), F.lit("HTML").alias("label"), F.col("html").alias("text")))
    own = pages.select("page_id", "html", (F.col("e") if "e" in pages.columns else elements_of(F.col("html"))).alias("e"))
    out = own.select("page_id", F.inline(F.concat(page, F.flatten(F.transform("e", of)))))
    if storage is not None:
        area = storage.groupBy("page_id", "area").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("text"))
        out = out.union(area.select("page_id", F.when(F.col("area") == "local", PLACES["local"] * 10**9).otherwise(PLACES["session"] * 10**9).cast("long"), F.concat("area", F.lit("Storage")), "text"))
    if bodies is not None:
        out = out.union(bodies.select("page_id", seq("script", F.col("pos")), F.concat(F.lit("Script: "), "src"), "body"))
    if window_objects is not None:
        part = lambda n: F.col("value") if n is None else F.left("value", F.lit(n))
        cut = F.when(F.col("key").isin(*MANIFESTS), part(manifest_size)).otherwise(part(size))
        out = out.union(window_objects.select("page_id", F.lit(PLACES["window"] * 10**9).cast("long"), F.concat(F.lit("Window Object: "), "key"), cut))
    if recovered is not None:
        out = out.union(recovered.where("content is not null and not ignored").select("page_id", seq("map", F.col("pos")), F.concat(F.lit("Source Map: "), "path"), "content"))
    return out.where("text is not null")


#: Globals that tell of a debug build, by the flag that they raise.
DEBUG_GLOBALS = {"__DEBUG__": "window.__DEBUG__", "DEBUG": "window.DEBUG", "__DEV__": "window.__DEV__", "Vue.config.devtools": "vue_devtools_enabled", "__VUE_PROD_DEVTOOLS__": "vue_prod_devtools", "ng.probe": "angular_debug_mode"}


def debug_flags(window_objects: DataFrame, e: DataFrame) -> DataFrame:
    """(page_id, flag), distinct: signs of a debug build in captured globals (page_id, key, value) and elements."""
    true = ~F.lower(F.trim("value")).isin("false", "null", "undefined", "0", '""', "")
    named = F.create_map(*[F.lit(x) for kv in DEBUG_GLOBALS.items() for x in kv])[F.col("key")]
    development = F.when((F.col("key") == "__NEXT_DATA__") & (F.get_json_object("value", "$.buildId") == "development"), "Next.js dev buildId")
    bundle = F.when((F.col("key") == "__REACT_DEVTOOLS_GLOBAL_HOOK__") & F.rlike("value", F.lit(r'"bundleType"\s*:\s*1\b')), "react_dev_bundle")
    strict = F.when((F.col("key") == "__DEV__") & (F.trim("value") == "true"), "__DEV__=true")
    own = window_objects.select("page_id", F.explode(F.array_compact(F.array(F.when(true, named), development, bundle, strict))).alias("flag"))
    overlay = F.when(_attr("id") == "react-error-overlay", "react-error-overlay")
    version = F.when(_attr("ng-version").isNotNull(), "angular_ng_version_attr")
    seen = e.select("page_id", F.explode(F.array_compact(F.array(overlay, version))).alias("flag"))
    return own.union(seen).distinct()
