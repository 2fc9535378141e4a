"""Needles of regexes, the scan against single passes, SQL table functions, pattern tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import needles, tables
from quarrylens.functions.patterns import BUILT_IN, Pattern, of_table
from quarrylens.operators import secrets, storage


@pytest.mark.parametrize(
    "regex,want",
    [
        (r"sk_live_[0-9]+", ({"sk_live_"}, False)), (r"(?i)Bearer\s+x", ({"bearer"}, True)), (r"a|bc", ({"a", "bc"}, False)), (r"(?:ab|c)?d+e{0,2}", ({"d"}, False)), (r"[0-9]*", (set(), False)), (r"(ab){2}c", ({"ab"}, False)),
        (r"x[ab]", ({"x"}, False)), (r"(?=abc)\w", (set(), False)), (r"(foo|[0-9])", (set(), False)), (r"\bkey\b-(?:one|two)", ({"key-"}, False)), (r"(?i)straße", (set(), True)), ("(", (set(), False)), (r"ab.|abc", ({"ab"}, False)),
    ],
)
def test_required_literals(regex, want):
    found, fold = needles.required(regex)
    assert (set(found), fold) == want or (not want[0] and not found)


def test_every_match_contains_a_needle():
    rng = random.Random(7)
    index = needles.Index([p.regex for p in BUILT_IN], [p.needles for p in BUILT_IN])
    assert not index.always
    for p in BUILT_IN:
        found, fold = needles.required(p.regex)
        for n in (*found, *p.needles)[:3]:
            text = "".join(rng.choice("abc 0-=:'") for _ in range(20)) + n
            for m in re.finditer(p.regex, text):
                assert any(f in (m[0].lower() if fold else m[0]) for f in found)


def test_scan_equals_single_passes(spark):
    forms = ["BEARER abc.def", "bearеr abc", "Heroku key 12345678-1234-1234-1234-123456789abc", "heroKu 12345678-1234-1234-1234-123456789abc", "baſic QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "basıc QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "ghp_" + "a" * 36, "gh", "10.1.2.3 and 192.168.0.1", "AC" + "0" * 32, "plaıd = " + "a" * 24, "", None, "eyJhbGci.eyJz.abc"]
    rng = random.Random(3)
    rows = [(1, k, "HTML", f) for k, f in enumerate(forms)] + [(2, k, "HTML", " ".join(rng.choice([f for f in forms if f]) for _ in range(rng.randint(1, 9)))) for k in range(60)]
    art = spark.createDataFrame(rows, "page_id long, seq long, label string, text string")
    patterns = [*BUILT_IN, Pattern("any", r"[a-f]+\d*"), Pattern("none", "absent")]
    single = None
    for p in patterns:
        own = art.select("page_id", "seq", F.lit(p.name).alias("pattern"), secrets.matches_of(F.col("text"), p).alias("matches")).where(F.size("matches") > 0)
        single = own if single is None else single.union(own)
    shown = lambda df: sorted(map(str, df.select("page_id", "seq", "pattern", "matches").collect()))
    assert shown(secrets.scan(art, patterns)) == shown(single)


def test_table_functions_equal_the_operators(spark):
    own = spark.newSession()
    tables.register(own)
    rows = [(1, '{"a":{"b":[1.10,true,null,1e400]},"c":"x"}'), (2, "[]"), (3, "bad"), (4, None), (5, '{"n":NaN}')]
    own.createDataFrame(rows, "id long, json string").createOrReplaceTempView("j")
    got = sorted(map(tuple, own.sql("select id, path, value from j, lateral leaves(json)").collect()))
    want = sorted(map(tuple, storage.json_leaves(spark.createDataFrame(rows, "id long, json string")).collect()))
    assert got == want == [(1, "a.b[0]", "1.10"), (1, "a.b[1]", "true"), (1, "a.b[3]", "1e400"), (1, "c", "x")]
    assert own.sql("select count(*) from j, lateral leaves(json, 0)").first()[0] == 0
    with pytest.raises(Exception, match="takes a text"):
        own.sql("select * from j, lateral leaves(id)").collect()
    with pytest.raises(Exception, match="must be a constant"):
        own.sql("select * from j, lateral leaves(json, id)").collect()
    own.createDataFrame([(1, "<a href=x>1</a><form><input></form>"), (2, None)], "id long, html string").createOrReplaceTempView("h")
    assert [tuple(r) for r in own.sql("select id, tag, attrs['href'], controls from h, lateral elements(html) order by pos").collect()] == [(1, "a", "x", 0), (1, "form", None, 1), (1, "input", None, 0)]
    assert own.sql("select count(*) from h, lateral elements(html, 'a')").first()[0] == 1


def test_secrets_in_sql_and_added_patterns(spark):
    own, other = spark.newSession(), spark.newSession()
    texts = [(1, "x AKIA" + "A" * 16 + " Bearer q, baſic QWxhZGRpbjpvcGVuIHNlc2FtZQ=="), (2, "it's \\d order-77 order-77 order-8"), (3, None), (4, "")]
    for s in (own, other):
        tables.register(s)
        s.createDataFrame(texts, "id long, text string").createOrReplaceTempView("t")
    sql = "select t.id, s.pattern, s.value from t, lateral secrets(t.text) s"
    art = spark.createDataFrame([(i, 0, "HTML", x) for i, x in texts], "page_id long, seq long, label string, text string")
    want = lambda more: sorted((r["page_id"], r["pattern"], v) for r in secrets.scan(art, [*BUILT_IN, *more]).collect() for v in r["matches"])
    assert sorted(map(tuple, own.sql(sql).collect())) == want([])
    assert not tables.register_pattern(own, "bad", "(") and not tables.register_pattern(own, "long", "a" * 501)
    assert tables.register_pattern(own, "order", "nothing") and tables.register_pattern(own, "order", r"(?i)ORDER-\d+") and tables.register_pattern(own, "quote", r"it's \\d")
    more = [Pattern("order", r"(?i)ORDER-\d+"), Pattern("quote", r"it's \\d")]
    assert sorted(map(tuple, own.sql(sql).collect())) == want(more) and len(want(more)) == len(want([])) + 3
    assert sorted(map(tuple, other.sql(sql).collect())) == want([])  # another session has its own
    assert "Python" not in own.sql(sql)._jdf.queryExecution().toString()


def test_pattern_tables(spark):
    rows = [("b", r"b\d+"), ("a", "z"), ("a", "y"), (None, "x"), ("n", None), ("broken", "(["), ("long", "x" * 501), ("gone", "g")]
    table = spark.createDataFrame(rows, "name string, regex string")
    assert [(p.name, p.regex) for p in of_table(table, ["gone"])] == [("a", "y"), ("b", r"b\d+")]
    assert [p.name for p in of_table(table.limit(0), built_in=True)] == [p.name for p in BUILT_IN]
    with pytest.raises(ValueError, match="more than"):
        of_table(spark.range(2100).selectExpr("concat('n', id) as name", "'x' as regex"))
