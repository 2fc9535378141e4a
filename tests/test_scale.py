"""Work is dealt to all cores, done once, and held in pieces."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quarrylens.functions import jsparse, values
from quarrylens.functions.jsparse import Parser, parse
from quarrylens.operators import javascript
from quarrylens.plans import catalog, evidence
from quarrylens.plans import samples as S
from quarrylens.sources import captures

FOLDER = "/root/testdata/sf0.001"


def _longest(df) -> float:
    """The share of the rows that the fullest partition has."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_rows_of_one_row_group_are_dealt_though_its_file_is_read_by_many_tasks(spark, tmp_path):
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 4 and _longest(rows) == 1  # one row group, so one task reads all
        dealt = S.spread(rows)
        assert _longest(dealt) < 0.3 and dealt.exceptAll(rows).isEmpty() and dealt.count() == 200_000
        assert S.spread(dealt) is dealt
        empty = rows.where("false")
        assert S.spread(empty).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scripts_are_parsed_by_all_cores(spark):
    assert evidence._flow_facts(spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sections_of_one_report_parse_its_scripts_once(spark):
    for query in (evidence.report_leads, evidence.report_full):
        assert "MapInArrow" not in query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_read_once():
    text, read = "f(a, b => a.b[c] + 1 / d, {k: v});" * 20, []

    class Counting(Parser):
        def _scan(self, at, after_value):
            read.append(at)
            return super()._scan(at, after_value)

    assert repr(Counting(text).program()) == repr(parse(text))
    assert max(read.count(at) for at in set(read) if not text.startswith("/", at) and text[at - 1 : at] != " ") == 1


def test_pages_are_objects_in_pieces_only():
    sizes = []

    def made(html):
        sizes.append(len(html))
        return pa.array([captures._parse(h) for h in html], captures._ARROW)

    pages = pa.array([f"<a href='{i}'>" if i % 7 else None for i in range(3 * captures.AT_ONCE + 5)])
    got = captures._sliced(pages, made, captures._ARROW)
    assert max(sizes) == captures.AT_ONCE and got.equals(made(pages.to_pylist()))
    assert len(captures._sliced(pages.slice(0, 0), made, captures._ARROW)) == 0


def test_reports_scan_for_secrets_once(spark):
    for query in (catalog.report_markdown, catalog.report_json, evidence.json_report_sizes):
        assert "sk-ant-api03" not in query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_entropy_counts_a_character_in_one_pass(spark):
    texts = ["", "a", "aab", "AKIAaabb", "é😀é́中 \n", "0123456789abcdef" * 9 + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", values.entropy(F.col("v")).alias("bits")).collect()
    for r in rows:
        own = r["v"].removeprefix("AKIA")
        want = -sum(n / len(own) * math.log2(n / len(own)) for n in Counter(own).values())
        assert abs(r["bits"] - want) < 1e-12


def test_comments_lose_their_ink_only_where_they_are_comments():
    end = "el.innerHTML = location.hash"
    for text in (f"// 12\n/* é\n z */ {end} // 3", f"a/*1*//*2*//re/.test(b); {end}", f"a //x\r\n\u2028 /* y\u2029 */ {end}", f"'/* s */'; /* u */ {end}", f"x = `/* ${{location.hash}} */`; /* q */ eval(x); {end}", f"f = () => <b>don't /* t */</b>; {end}", f"/a[/]*b/.test(c) /* d */; {end}", f"function f() {{ return /*\n*/ 1 }} {end}", f"{end}; /* open"):
        plain = javascript.without_ink(text)
        assert len(plain) == len(text) and repr(parse(plain)) == repr(parse(text)) and javascript._analysed(plain) == javascript._analysed(text)
    assert javascript.without_ink("/* 1 */ a; // 2\n 'x' /* 3 */") == "        a;     \n 'x' /* 3 */"


def test_scripts_that_differ_by_comments_are_analysed_once(monkeypatch):
    forms = ["eval(location.hash); /* {} */", "// build {}\nwindow.onmessage = e => {{ if (e.origin.includes('a')) el.innerHTML = e.data }}", "// {}\nfetch('/api/x/y')", "a(", "'{}'"]
    texts = [f.format(100 + i) for i in range(50) for f in forms[:4]] + [forms[4].format(i) for i in range(9)] + ["", "// " + "x" * javascript.LONGEST]
    want, read = [javascript._analysed(t) for t in texts], []
    alone = javascript._analysed
    monkeypatch.setattr(javascript, "_analysed", lambda t: read.append(t) or alone(t))
    of = javascript.Remembered()
    assert [of(t) for t in texts] == want and len(read) == 4 + 9 + 2
    small = javascript.Remembered(600)
    assert [small(t) for t in texts] == want and small.held <= 600 and len(small.known) <= 3


def _found(spark, *texts):
    return javascript.facts(spark.createDataFrame([(1, k, f"https://s/{k}.js", t) for k, t in enumerate(texts)], "page_id long, seq long, url string, text string"))


def test_pollution_of_long_many_and_deep_scripts_is_found(spark):
    write = "o.__proto__ = location.hash;"
    long = "var pad = 'é';\n" * 40_000 + write
    deep = "{" * 30_000 + write + "}" * 30_000
    assert len(long.encode()) > 500_000
    got = javascript.pollution(_found(spark, long, f"{write}\n" * 450, "(" * 300 + write[:-1] + ")" * 300, deep)).groupBy("seq").count().collect()
    assert {r["seq"]: r["count"] for r in got} == {0: 1, 1: 450, 2: 1, 3: 1}


def test_what_is_read_ahead_is_read_once():
    for form, end in (("(a,", ")"), ("(`${", "}`)"), ("async(", ")"), ("(()=>{(", ")})")):
        text = "x = " + form * 1500 + "1" + end * 1500
        read = []

        class Counting(Parser):
            def _scan(self, at, after_value):
                read.append(at)
                return super()._scan(at, after_value)

        with jsparse.room(text):
            Counting(text).program()
        assert len(read) < 8 * len(text)


def test_report_markdown_holds_all_matches_groups_and_findings(spark, monkeypatch):
    def key(k):
        return f"AKIA{k:016X}"

    keys = ", ".join(f"'{key(k)}'" for k in range(25))
    art = f"select id as page_id, id as seq, 'HTML' as label, array_join(array({keys}), ' ') as text from range(2) union all select 0, 5, 'Inline Script', '{key(24)} {key(30)}'"
    stored = "select 7 as page_id, id as seq, 'auth.access_token' as key, md5(cast(id as string)) as value, 'dom' as source, false as container from range(300)"
    monkeypatch.setattr(S, "ARTIFACTS", art)
    monkeypatch.setattr(S, "STORAGE", stored)
    found = sorted((r["page_id"], r["seq"], len(r["matches"])) for r in catalog._scored(spark, FOLDER, None).collect())
    assert found == [(0, 0, 25), (0, 5, 1), (1, 1, 25)]
    for f in (catalog.sinks.markdown, catalog.sinks.markdown_parts):
        monkeypatch.setattr(f, "__defaults__", (2,))
    rows = catalog.report_markdown(spark, FOLDER).where("page_id in (0, 1, 7)").collect()
    lines = [(r["page_id"], x.split(" | ")[1]) for r in rows for x in r["text"].split("\n") if x.startswith("| ") and not x.startswith(("| Severity", "| ---"))]
    lines = Counter((k, t) for k, t in lines if t in ("Aws Key", "Access Token"))
    assert lines == {(0, "Aws Key"): 2, (1, "Aws Key"): 1, (7, "Access Token"): 300}  # storage alone makes a page, and its parts hold all of it
    assert len({(r["page_id"], r["part"]) for r in rows}) == len(rows) and {r["part"] for r in rows if r["page_id"] == 7} == set(range(150))


def test_full_report_has_every_page_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(S, "ASSETS", "select 1 as page_id, concat('https://s1.example.com/', cast(id as string), '.js') as url from range(2500)")
    monkeypatch.setattr(S, "OBSERVED", S.OBSERVED.replace("s_suppkey % 40 as page_id", "7 as page_id").replace("from supplier", "from (select id as s_suppkey from range(60))"))
    rows = evidence.report_full(spark, FOLDER).select("page_id", "part", "text").collect()
    pages = {r["page_id"] for name in ("ARTIFACTS", "MAPS", "REMIX", "FLOWS") for r in S.sample(spark, FOLDER, getattr(S, name)).select("page_id").collect()}
    assert {r["page_id"] for r in rows if r["part"] == 0} >= pages and len({(r["page_id"], r["part"]) for r in rows}) == len(rows)
    lines = Counter(x for r in rows if r["page_id"] == 1 for x in r["text"].split("\n") if x.startswith("- `https://s1.example.com/"))
    assert set(lines) == {f"- `https://s1.example.com/{i}.js`" for i in range(2500)} and max(lines.values()) == 1
    first = next(r["text"] for r in rows if r["page_id"] == 1 and r["part"] == 0)
    assert "- ... and 2485 more" in first and {r["part"] for r in rows if r["page_id"] == 1} >= {0, 1, 2, 3}
    calls = S.sample(spark, FOLDER, S.OBSERVED).where("url like '%/api/%' or url like '%.json'").count()
    shown = sum("| `https://h" in x and ("/api/" in x or ".json`" in x) for r in rows if r["page_id"] == 7 for x in r["text"].split("\n"))
    assert shown == calls > 10
    found = Counter(r["page_id"] for r in catalog._scored(spark, FOLDER, None).collect())
    for k in (k for k in found if k > 30):
        text = next(r["text"] for r in rows if r["page_id"] == k and r["part"] == 0)
        assert "### " in text and "1. " in text


def test_flows_of_long_many_and_deep_scripts_are_found(spark):
    sink = "el.innerHTML = location.hash;"
    deep = "f(" * 2000 + "location.search" + ")" * 2000
    texts = ["var pad = 'é';\n" * 40_000 + sink, f"{sink}\n" * 450, "if (a) {" * 400 + sink + "}" * 400, f"eval({deep});", "el.innerHTML = location.hash" + " + a" * 60_000]
    f = _found(spark, *texts).persist()
    got = {r["seq"]: r["count"] for r in javascript.flows(f).groupBy("seq").count().collect()}
    assert got == {0: 1, 1: 450, 2: 1, 3: 1, 4: 1}
    f.unpersist()
    heard = 'addEventListener("message", e => { eval(e.data) });\n' * 450
    f = _found(spark, heard)
    assert javascript.message_handlers(f).count() == javascript.flows(f).count() == 450
    csp = spark.createDataFrame([], "page_id long, header string")
    assert javascript.gadgets(f, csp).count() == 900 and javascript.gadgets(f, csp, javascript.CAP).count() == 200
