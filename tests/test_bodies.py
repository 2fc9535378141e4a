"""External bodies, URL resolution, run-time observation and running route lists on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import urls
from quarrylens.operators import bodies, javascript, manifests, sourcemaps

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, sections 5.4.1 and 5.4.2.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_resolution_of_the_rfc_examples(spark):
    rows = spark.createDataFrame(list(EXAMPLES.items()), "ref string, want string")
    got = rows.select("ref", "want", urls.resolved(F.lit(BASE), F.col("ref")).alias("got"))
    assert [tuple(r) for r in got.where("not (want <=> got)").collect()] == []
    assert "Python" not in got._jdf.queryExecution().toString()
    more = spark.createDataFrame([("http://h", "x", "http://h/x"), ("http://h?q", "", "http://h?q"), ("HTTP://H/a/", " b \n", "http://H/a/b"), (None, "x", None), ("http://h/", None, None), ("file:///d/e", "f", "file:///d/f"), ("http://h/a//b/", "../c", "http://h/a//c"), ("", "x/y", "x/y")], "base string, ref string, want string")
    assert [tuple(r) for r in more.withColumn("got", urls.resolved(F.col("base"), F.col("ref"))).where("not (want <=> got)").collect()] == []
    joined = more.select(sourcemaps.join_url(F.col("base"), F.col("ref")).alias("u")).collect()
    assert [r["u"] for r in joined] == ["http://h/x", "http://h?q", "http://H/a/b", None, "http://h/", None, "http://h/a//c", None]


def test_bodies_are_gated_and_pruned(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://shop.example.com/a/b"), (2, "https://example.com/"), (3, None)], "page_id long, url string")
    linked = spark.createDataFrame([(1, 0, "../x.js"), (1, 1, "https://cdn.net/y.js"), (1, 2, "file:///etc/passwd"), (1, 3, "//example.com/z.js#f"), (2, 0, "x.js"), (2, 1, None), (3, 0, "x.js"), (3, 1, "https://cdn.net/y.js")], "page_id long, pos int, src string")
    spark.createDataFrame([("https://shop.example.com/x.js", "one"), ("https://cdn.net/y.js", "two"), ("https://example.com/z.js", "three"), *((f"https://n{i}.net/", "no") for i in range(2000))], "url string, body string").write.parquet(str(tmp_path / "bodies"))
    own = bodies.pruning(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both sides were large
    found = bodies.external(linked, pages, str(tmp_path / "bodies"), own)
    got = {(r["page_id"], r["pos"]): (r["outcome"], r["body"]) for r in found.collect()}
    assert got == {(1, 0): ("read", "one"), (1, 1): ("out of scope", None), (1, 2): ("unresolvable", None), (1, 3): ("read", "three"), (2, 0): ("no body", None), (3, 0): ("unresolvable", None), (3, 1): ("read", "two")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("might_contain") :]  # the filter stands over the scan of the bodies
    assert "bloom_filter_agg" in scan and "url#" in scan.splitlines()[0]
    assert bodies.external(linked.limit(0), pages, str(tmp_path / "bodies")).collect() == []


@pytest.mark.parametrize("grams", [65_536, 2])
def test_terms_in_values(spark, monkeypatch, grams):
    monkeypatch.setattr(javascript, "GRAMS", grams)
    monkeypatch.setattr(javascript, "STRETCH", 40)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcé(.") for _ in range(n))
    terms = [(rng.randint(0, 4), text(rng.choice([1, 2, 3, 4, 7, 30]))) for _ in range(300)] + [(9, "x"), (0, "")]
    values = [(rng.randint(0, 4), text(rng.choice([0, 2, 5, 50, 400]))) for _ in range(200)] + [(9, None), (0, terms[0][1] + "!")]
    got = javascript.contained(spark.createDataFrame(terms, "page_id long, term string"), spark.createDataFrame(values, "page_id long, value string").repartition(3))
    want = {(p, t) for p, t in terms if t and any(p == q and v and t in v for q, v in values)}
    assert {tuple(r) for r in got.collect()} == want and 50 < len(want) < len(set(terms))


def test_flows_seen_at_run_time(spark):
    f = spark.createDataFrame([(1, "location.hash", "innerHTML", "a:1:1", False), (1, "window.name", "eval(...)", "a:2:1", False), (2, "location.hash", "innerHTML", "a:1:1", False), (2, "", "x", "b", False)], "page_id long, source string, sink string, location string, runtime_observed boolean")
    v = spark.createDataFrame([(1, "payload via location.hash seen"), (2, "ab"), (2, ""), (2, None), (2, " x "), (1, "unrelated")], "page_id long, value string")
    got = {(r["page_id"], r["location"]): r["runtime_observed"] for r in javascript.mark_observed(f, v).collect()}
    assert got == {(1, "a:1:1"): True, (1, "a:2:1"): False, (2, "a:1:1"): False, (2, "b"): False}
    assert javascript.mark_observed(f, v.limit(0)).where("runtime_observed").count() == 0 and javascript.mark_observed(f.limit(0), v).count() == 0


def test_a_page_of_very_many_values_is_searched_by_many_tasks(spark):
    values = spark.range(200_000).select(F.lit(1).cast("long").alias("page_id"), F.concat(F.lit("window.name "), F.col("id")).alias("value"))
    terms = spark.createDataFrame([(1, "window.name"), (1, "absent")], "page_id long, term string")
    probes = values.select(F.pmod(F.xxhash64("value"), F.lit(javascript.SALTS)).alias("salt")).groupBy("salt").count().collect()
    assert len(probes) == javascript.SALTS and max(r["count"] for r in probes) < 2 * 200_000 / javascript.SALTS
    assert [tuple(r) for r in javascript.contained(terms, values).collect()] == [(1, "window.name")]


def test_routes_so_far(spark):
    rows = [(1, "__NEXT_DATA__", '{"page":"/a","buildId":"b"}'), (1, "__BUILD_MANIFEST", '{"/a":1,"/b":1,"sortedPages":["/b","/c"]}'), (1, "__SSG_MANIFEST", '["/a","/z"]'), (1, "__NUXT__", '{"path":"/n","data":{"/n":1,"/m":2}}'), (2, "__NEXT_DATA__", "bad"), (3, "__NEXT_DATA__", '{"page":"/_app"}')]
    got = {}
    for r in sorted(manifests.listed(spark.createDataFrame(rows, "page_id long, key string, value string")).collect()):
        got.setdefault((r["page_id"], r["manifest_type"]), []).append((r["place"], r["path"]))
    assert got == {(1, "next-data"): [(0, "/a")], (1, "build-manifest"): [(0, "/a"), (1, "/b"), (2, "/b"), (3, "/c")], (1, "ssg-manifest"): [(0, "/a"), (1, "/z")], (1, "nuxt-payload"): [(0, "/n"), (1, "/n"), (2, "/m")]}


def test_numbers_over_stretches(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.randint(0, 3), rng.randint(0, 500), f"p{i}") for i in range(3000)]
    got = manifests.numbered(spark.createDataFrame(rows, "g long, o int, pos int, path string"), ["g"], ["o", "pos", "path"], "place", stretch=50).collect()
    for g in range(3):
        assert [tuple(r)[1:] for r in sorted((tuple(r) for r in got if r["g"] == g), key=lambda r: r[-1])] and [r["place"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"], r["pos"], r["path"]))] == list(range(sum(r[0] == g for r in rows)))
