"""All queries over captured evidence, by name, with the SQL that gives the same rows where SQL can.

Queries over the driver's own pages and documents read them whole; the others read tables that
``samples`` derives from ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, urls, values
from ..functions.patterns import BUILT_IN, Pattern, catalog
from ..operators import advisories, endpoints, findings, javascript, manifests, posture, secrets, sourcemaps, storage, technologies
from ..sources import captures, scratch, sinks
from ..streaming import network
from . import samples as S
from .samples import sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOST = "nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# pages as they are


@query(f"select page_id, url, {HOST} as host, url like 'https://%' as secure from pages where url like 'http://%' or url like 'https://%'")
def page_targets(spark, d):
    p = table(spark, d, "pages")
    return p.where(F.rlike("url", F.lit("^https?://"))).select("page_id", "url", urls.host(F.col("url")).alias("host"), F.startswith("url", F.lit("https://")).alias("secure"))


_TARGETS = "(select unnest(['example.com', 'tionsh.example.net', 'example.net', cast(null as varchar)]) as target)"


@query(f"""select page_id, coalesce(target, '-') as target, case when target is null then 'unknown' when h is null or h = target or h like '%.' || target or target like '%.' || h then 'first' else 'third' end as origin
from (select page_id, {HOST} as h from pages) cross join {_TARGETS}""")
def origin_class(spark, d):
    t = F.explode(F.array(F.lit("example.com"), F.lit("tionsh.example.net"), F.lit("example.net"), F.lit(None).cast("string"))).alias("target")
    p = table(spark, d, "pages").select("page_id", "url", t)
    return p.select("page_id", F.coalesce("target", F.lit("-")).alias("target"), urls.origin(F.col("url"), F.col("target")).alias("origin"))


@query(f"""select page_id, coalesce(target, '-') as target, coalesce(h = target or h like '%.' || target or target like '%.' || h, true) as related, coalesce(h = target, true) as same_host, coalesce(h = target or h like '%.' || target, true) as under,
case when target is null then true when h is null then false else h = target or h like '%.' || target or target like '%.' || h end as in_scope from (select page_id, {HOST} as h from pages) cross join {_TARGETS}""")
def first_party_variants(spark, d):
    t = F.explode(F.array(F.lit("example.com"), F.lit("tionsh.example.net"), F.lit("example.net"), F.lit(None).cast("string"))).alias("target")
    p = table(spark, d, "pages").select("page_id", "url", t)
    u, g = F.col("url"), F.col("target")
    return p.select("page_id", F.coalesce("target", F.lit("-")).alias("target"), urls.related(u, g).alias("related"), urls.same_host(u, g).alias("same_host"), urls.under(u, g).alias("under"), urls.in_scope(u, g).alias("in_scope"))


@query("""select page_id, split_part(p, '=', 1) as key, split_part(p, '=', 2) as value from (select page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as p from pages where url like '%?%') where p <> ''""")
def url_params(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(urls.query_pairs(F.col("url"))).alias("p"))
    return p.select("page_id", "p.key", "p.value")


@query(f"select host, count(*)::bigint as n, count(distinct url)::bigint as distinct_urls from (select {HOST} as host, url from pages) group by rollup(host)")
def host_request_counts(spark, d):
    p = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), "url")
    return p.rollup("host").agg(F.count("*").alias("n"), F.count_distinct("url").alias("distinct_urls"))


@query("""select page_id, len(list_distinct(regexp_extract_all(html, '<(?:a|link|img|script|iframe)\\s[^>]*?(?:href|src)="([^"]*)"', 1)))::bigint as links from pages where len(regexp_extract_all(html, '<(?:a|link|img|script|iframe)\\s[^>]*?(?:href|src)="([^"]*)"', 1)) > 0""")
def link_surface(spark, d):
    return captures.link_counts(table(spark, d, "pages"))


@query("""select page_id, len(regexp_extract_all(html, '<script[ >]'))::bigint as scripts, len(regexp_extract_all(html, '<meta '))::bigint as metas, len(regexp_extract_all(html, '<form[ >]'))::bigint as forms from pages""")
def script_inventory(spark, d):
    p = table(spark, d, "pages")
    e = captures.elements(p)
    n = e.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(c) for t, c in (("script", "scripts"), ("meta", "metas"), ("form", "forms"))])
    return p.select("page_id").join(n, "page_id", "left").select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scripts", "metas", "forms")])


@query("""select page_id, 'http://' || ref as url from (select page_id, unnest(list_distinct(regexp_extract_all(html, '<(?:a|link|img|script|iframe)\\s[^>]*?(?:href|src)="http://([^"]*)"', 1))) as ref from pages where url like 'https://%')""")
def mixed_content(spark, d):
    p = table(spark, d, "pages")
    e = captures.elements(p)
    refs = e.select("page_id", F.explode(F.array(F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("src")))).alias("url")).where("url is not null").distinct()
    return posture.mixed_content(refs, p)


@query(f"""select page_id, {HOST} as host, case when regexp_matches(lower(url), '/api/|/graphql|/v1/|/v2/|/v3/|\\.json') then true else false end as api,
regexp_matches(split_part(lower(url), '?', 1), '\\.(?:js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|map|webp|avif|mp4|webm|mp3|ogg|wav)$') or regexp_matches(lower(url), '/_next/|/_nuxt/|/_vercel/|/_gatsby/|/cdn-cgi/|[?&]_rsc=|/favicon|cdn\\.jsdelivr\\.net|unpkg\\.com|cdnjs\\.cloudflare\\.com|fonts\\.googleapis\\.com|fonts\\.gstatic\\.com|api\\.iconify\\.design|cdn\\.amplitude\\.com|cdn\\.segment\\.com|cdn\\.mxpnl\\.com') as static, lower(split_part(split_part(url, '?', 1), '#', 1)) like '%.map' as map from pages""")
def url_classes(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.is_api(u).alias("api"), urls.is_static(u, F.lit(None).cast("string")).alias("static"), urls.is_map(u).alias("map"))


# secrets

TOKEN = Pattern("token_assignment", r"""(?i)token = "[0-9a-f]{40}\"""")
PASSWORD = Pattern("password_assignment", "password=[0-9a-f]{8,}")


def _documents(spark, d) -> DataFrame:
    """Documents as artifacts of their source's page."""
    return table(spark, d, "documents").select(F.crc32(F.col("source").cast("binary")).alias("page_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("Script: https://"), "source", F.lit(".example.com/x.js")).alias("label"), "text", "source")


_DOC_MATCHES = """select source, doc_id, unnest(list_slice(list_sort(list_distinct(regexp_extract_all(text, '(?i)token = "[0-9a-f]{40}"'))), 1, 10)) as value, 'token_assignment' as pattern from documents
union all select source, doc_id, unnest(list_slice(list_sort(list_distinct(regexp_extract_all(text, 'password=[0-9a-f]{8,}'))), 1, 10)), 'password_assignment' from documents"""


@query(f"select doc_id, pattern, count(*)::bigint as n from ({_DOC_MATCHES}) group by all")
def custom_secret_scan(spark, d):
    found = secrets.scan(_documents(spark, d), [TOKEN, PASSWORD], secrets.PER_ARTIFACT)
    return found.select(F.col("seq").alias("doc_id"), "pattern", F.size("matches").cast("long").alias("n"))


@query(f"select source, pattern, value, min(doc_id) as doc_id from ({_DOC_MATCHES}) group by all")
def secret_first_source(spark, d):
    docs = _documents(spark, d)
    names = docs.select("page_id", "source").distinct()
    first = secrets.first_sources(secrets.scan(docs, [TOKEN, PASSWORD], secrets.PER_ARTIFACT))
    return first.join(names, "page_id").select("source", "pattern", "value", F.col("seq").alias("doc_id"))


_ENTROPY = "(select round(-sum(n / t * log2(n / t)), 6) from (select count(*)::double as n, sum(count(*)) over () as t from (select unnest(string_split(v, '')) as ch) group by ch))"


@query(f"""with m as ({_DOC_MATCHES}), v as (select distinct value from m), c as (select value, unnest(string_split(value, '')) as ch from v), n as (select value, ch, count(*)::double as n from c group by all),
e as (select value, round(-sum(n / t * log2(n / t)), 6) as bits from (select value, n, sum(n) over (partition by value) as t from n) group by value)
select value, bits, case when strlen(value) < 12 then 'n/a' when bits < 3 then 'low' when bits >= 4 then 'high' else 'n/a' end as signal from e""")
def secret_entropy(spark, d):
    v = secrets.scan(_documents(spark, d), [TOKEN, PASSWORD], secrets.PER_ARTIFACT).select(F.explode("matches").alias("value")).distinct()
    return v.select("value", F.round(values.entropy(F.col("value")), 6).alias("bits"), values.entropy_signal(F.col("value")).alias("signal"))


_PICKED = BUILT_IN
_TEXT = lambda regex: "'" + regex.replace("'", "''") + "'"
_SCAN = " union all ".join(f"select page_id, seq, label, '{p.name}' as pattern, list_slice(list_sort(list_distinct(regexp_extract_all(text, {_TEXT(p.regex)}))), 1, 10) as ms from art" for p in _PICKED)
_FOUND = f"found as (select page_id, seq, label, pattern, unnest(ms) as value from ({_SCAN})), firsts as (select page_id, pattern, value, min(seq) as seq, arg_min(label, seq) as label from found group by page_id, pattern, value)"
_SECRETS = f"art as ({S.ARTIFACTS}), {_FOUND}"


@query(f"with {_SECRETS} select pattern, count(*)::bigint as n, count(distinct value)::bigint as distinct_values from found group by pattern")
def builtin_secret_scan(spark, d):
    found = secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, secrets.PER_ARTIFACT).select("pattern", F.explode("matches").alias("value"))
    return found.groupBy("pattern").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query(f"with {_SECRETS} select page_id, pattern, value, seq, label from firsts")
def secret_dedupe(spark, d):
    return secrets.first_sources(secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, secrets.PER_ARTIFACT))


def _values(alias: str) -> str:
    return f"(select value, case when regexp_matches(lower(value), 'example|test|xxxx|your_|your-|changeme|placeholder|dummy') or regexp_matches(trim(value), '^0{{8,}}$') then true else false end as placeholder from {alias})"


@query(f"with {_SECRETS} select distinct value, regexp_matches(lower(value), 'example|test|xxxx|your_|your-|changeme|placeholder|dummy') or regexp_matches(trim(value), '^0{{8,}}$') as placeholder from found")
def placeholder_filter(spark, d):
    v = secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, secrets.PER_ARTIFACT).select(F.explode("matches").alias("value")).distinct()
    return v.select("value", values.placeholder(F.col("value")).alias("placeholder"))


@query(f"with {_SECRETS} select distinct value, case when strlen(value) <= 12 then repeat('*', length(value)) else left(value, 4) || repeat('*', least(strlen(value) - 8, 20)::int) || '...' || right(value, 4) end as redacted from found")
def redact(spark, d):
    v = secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, secrets.PER_ARTIFACT).select(F.explode("matches").alias("value")).distinct()
    return v.select("value", values.redact(F.col("value")).alias("redacted"))


_PREFIX = "regexp_replace(value, '^(?:sk_live_|pk_live_|sk_test_|pk_test_|ghp_|AKIA|xoxb-|xoxp-)', '')"
_SCORES = f"""groups as (select page_id, pattern, seq, label, min(value) as value, list_sort(list(value)) as matches from firsts group by all),
chars as (select value, unnest(string_split({_PREFIX}, '')) as ch from (select distinct value from groups)), cn as (select value, ch, count(*)::double as n from chars group by all),
ent as (select value, -sum(n / t * log2(n / t)) as bits from (select value, n, sum(n) over (partition by value) as t from cn) group by value),
inp as (select g.*, case when label like 'Window Object:%' then 'runtime' when label like 'Source Map:%' then 'source_map' when label like 'Script:%' then 'network' when label in ('localStorage', 'sessionStorage') then 'dom' else 'ast' end as src,
 case when label like 'Script: %' then (case when regexp_extract(label, '//([^/]*)', 1) = 'example.org' or regexp_extract(label, '//([^/]*)', 1) like '%.example.org' then 'first' else 'third' end) else 'first' end as origin,
 case when strlen({_PREFIX}) < 12 then 0 when bits < 3 then -25 when bits >= 4 then 8 else 0 end as e,
 regexp_matches(lower(g.value), 'example|test|xxxx|your_|your-|changeme|placeholder|dummy') as ph from groups g join ent using (value)),
dim as (select * from (values {", ".join(f"('{p.name}', '{p.severity}', '{p.exploitability}')" for p in _PICKED)}) t(pattern, severity, exploit)),
sc as (select i.*, severity, greatest(0, least(100, greatest(0, greatest(0, 40 + case src when 'runtime' then 20 when 'network' then 14 when 'source_map' then 12 when 'dom' then 6 else 0 end + case origin when 'first' then 8 else -12 end + case src when 'runtime' then 22 else 0 end + e)
 + case exploit when 'privileged' then 10 when 'unmet' then -8 when 'benign' then -15 else 0 end))) as raw from inp i join dim using (pattern)),
final as (select page_id, pattern, seq, label, len(matches)::bigint as n, severity, case when ph then least(raw, 20) else raw end::int as score, case when ph then 'low' when raw >= 75 then 'high' when raw >= 40 then 'medium' else 'low' end as level from sc),
disp as (select *, case when severity in ('LOW', 'INFO') then 'inventory' when level = 'low' then 'lead' else 'finding' end as disposition from final)"""
_SCORED = f"{_SECRETS}, {_SCORES}"


def _scored(spark, d, limit: int | None = secrets.PER_ARTIFACT) -> DataFrame:
    """Scored secrets of the artifacts; of a pattern and artifact the first matches, as the SQL of most queries has it, or all."""
    found = secrets.grouped(secrets.first_sources(secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, limit)))
    return secrets.scored(found, F.lit("example.org"))


@query(f"with {_SCORED} select page_id, pattern, seq, label, n, severity, score, level, disposition from disp")
def secret_findings(spark, d):
    return _scored(spark, d).select("page_id", "pattern", "seq", "label", F.size("matches").cast("long").alias("n"), "severity", "confidence.score", "confidence.level", "disposition")


@query(f"with {_SCORED} select severity, disposition, count(*)::bigint as n from disp group by all")
def severity_rollup(spark, d):
    return _scored(spark, d).groupBy("severity", "disposition").agg(F.count("*").alias("n"))


@query(f"""with {_SCORED} select page_id, count_if(disposition = 'finding' and severity = 'CRITICAL')::bigint as critical, count_if(disposition = 'finding' and severity = 'HIGH')::bigint as high, count_if(disposition = 'finding' and severity = 'MEDIUM')::bigint as medium, count_if(disposition = 'lead')::bigint as leads,
case when count_if(disposition = 'finding' and severity = 'CRITICAL') > 0 then 'critical' when count_if(disposition = 'finding' and severity = 'HIGH') > 0 then 'high' when count_if(disposition = 'finding' and severity = 'MEDIUM') > 0 then 'medium' when count_if(disposition = 'finding' and severity = 'LOW') > 0 then 'low' else 'info' end as risk from disp group by page_id""")
def page_summary(spark, d):
    return findings.summary(findings.of_secrets(_scored(spark, d))).select("page_id", "critical", "high", "medium", "leads", "risk")


_RANK = "case level when 'high' then 3 when 'medium' then 2 else 1 end"


@query(f"with {_SCORED} select page_id, severity, pattern, seq, score, row_number() over (partition by page_id, severity order by {_RANK} desc, score desc, seq, pattern, label)::int as place from disp")
def unified_findings_rank(spark, d):
    rows = _scored(spark, d).withColumn("title", F.col("pattern")).withColumn("kind", F.lit("secret")).withColumn("level", F.col("confidence.level")).withColumn("score", F.col("confidence.score")).withColumn("source", F.col("label"))
    return findings.rank(rows).select("page_id", "severity", "pattern", "seq", "score", "place")


@query(f"with {_SCORED} select * exclude (r) from (select page_id, disposition, pattern, seq, score, row_number() over (partition by page_id, disposition order by score desc, seq, pattern)::int as r from disp) where r <= 10")
def leads_topk(spark, d):
    rows = _scored(spark, d).withColumn("score", F.col("confidence.score"))
    return findings.top(rows, ["page_id", "disposition"], 10, F.col("score").desc(), "seq", "pattern").select("page_id", "disposition", "pattern", "seq", "score")


@query(f"with {_SCORED} select page_id, severity, count(*)::bigint as n from disp group by rollup(page_id, severity)")
def batch_totals(spark, d):
    return _scored(spark, d).rollup("page_id", "severity").agg(F.count("*").alias("n"))


@query(f"with {_SECRETS}, st as (select distinct page_id, value from found where seq % 3 = 0), g as (select page_id, pattern, seq, label, list(value) as ms from firsts group by all) select page_id, pattern, seq from g where exists (select 1 from (select unnest(ms) as v) where not exists (select 1 from st where st.page_id = g.page_id and st.value = v))")
def storage_suppression(spark, d):
    found = secrets.scan(sample(spark, d, S.ARTIFACTS, True), _PICKED, secrets.PER_ARTIFACT)
    held = found.where("seq % 3 = 0").select("page_id", F.explode("matches").alias("value")).distinct()
    return findings.uncovered(secrets.grouped(secrets.first_sources(found)), held).select("page_id", "pattern", "seq")


_PAYLOAD = "decode(from_base64(rpad(translate(split_part(value, '.', 2), '-_', '+/'), (4 * ceil(length(split_part(value, '.', 2)) / 4.0))::int, '=')))"


@query(f"with t as ({S.TOKENS}), p as (select page_id, value, {_PAYLOAD} as body from t where value like 'eyJ%') select page_id, value, unnest(case when body like '%\"role\":\"service_role\"%' then ['supabase_service_role'] when body like '%\"role\":\"anon\"%' then ['supabase_anon_jwt'] else ['jwt'] end) as pattern from p")
def jwt_roles(spark, d):
    t = sample(spark, d, S.TOKENS).select("page_id", "seq", F.lit("localStorage").alias("label"), F.col("value").alias("text"))
    return secrets.with_token_roles(secrets.first_sources(secrets.scan(t, [p for p in BUILT_IN if p.name == "jwt"]))).select("page_id", "value", "pattern")


@query(f"""with t as ({S.TOKENS}), p as (select page_id, {_PAYLOAD} as body from t where value like 'eyJ%')
select page_id, json_extract_string(body, '$.iss') as issuer, (json_extract(body, '$.exp'))::bigint as expires_at, (json_extract(body, '$.exp'))::bigint <= 1000 as expired,
case when body like '%"roles":[%' then 'admin,user' when json_extract_string(body, '$.role') is not null then json_extract_string(body, '$.role') else '' end as roles, case when json_extract_string(body, '$.scope') is not null then 'read,write' else '' end as scopes from p""")
def jwt_claims(spark, d):
    t = sample(spark, d, S.TOKENS).select("page_id", storage.claims(F.col("value"), F.lit(1000)).alias("c")).where("c is not null")
    return t.select("page_id", "c.issuer", "c.expires_at", "c.expired", F.array_join("c.roles", ",").alias("roles"), F.array_join("c.scopes", ",").alias("scopes"))


_GRID = "select n.n_nationkey as n, r.r_regionkey as r from nation n cross join region r"


@query("""with g as (select n.n_nationkey as n, r.r_regionkey as r from nation n cross join region r), i as (select n, r, n % 6 as k, r as c, n % 4 as x, n % 3 as e, (n + r) % 5 = 0 as obs, (n + r) % 7 = 0 as sup, n % 3 as o from g),
s1 as (select *, 40 + case when c >= 4 then 24 when c = 3 then 18 when c = 2 then 10 else 0 end + case k when 0 then 20 when 1 then 14 when 2 then 12 when 3 then 10 when 4 then 6 else 0 end as a from i),
s2 as (select *, a + case o when 0 then 8 when 1 then -12 else 0 end + case when obs then 22 else 0 end as b from s1), s3 as (select *, greatest(0, b + case e when 0 then -25 when 1 then 8 else 0 end) as f from s2),
s4 as (select *, least(100, greatest(0, f + case x when 0 then 10 when 1 then -8 when 2 then -15 else 0 end)) as v from s3)
select n::int as n, r::int as r, case when sup then least(v, 20) else v end::int as score, case when sup then 'low' when v >= 75 then 'high' when v >= 40 then 'medium' else 'low' end as level from s4""")
def confidence_grid(spark, d):
    g = sample(spark, d, _GRID)
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v)).cast("int") + 1)
    n, r = F.col("n"), F.col("r")
    c = scoring.confidence(r, F.array(pick(n, "runtime", "network", "source_map", "header", "dom", "ast")), pick(n, "first", "third", "unknown"), pick(n, "privileged", "unmet", "benign", "none"), pick(n, "low", "high", "n/a"), (n + r) % 5 == 0, None, F.when((n + r) % 7 == 0, "test value"))
    return g.select("n", "r", c.alias("c")).select(F.col("n").cast("int").alias("n"), F.col("r").cast("int").alias("r"), "c.score", "c.level")


# calls, technologies, posture


def _calls(spark, d) -> DataFrame:
    c = sample(spark, d, S.CALLS)
    heads = F.map_concat(F.create_map(F.lit("server"), "server", F.lit("x-powered-by"), "powered", F.lit("Access-Control-Allow-Origin"), "cors"), F.create_map("extra", F.lit("1")))
    return c.select("page_id", "seq", "url", heads.alias("response_headers"), F.col("kind").alias("response_content_type"))


_SIG = lambda table, col: "list_filter([" + ", ".join(f"case when contains(lower({col}), '{k}') then '{v}' end" for k, v in table.items()) + "], lambda x: x is not null)"


@query(f"with c as ({S.CALLS}), n as (select page_id, unnest({_SIG(technologies.SERVER, 'server')} || {_SIG(technologies.POWERED_BY, 'powered')}) as name from c) select page_id, array_to_string(list_sort(list_distinct(list(name))), ',') as technologies from n group by page_id")
def header_signatures(spark, d):
    c = _calls(spark, d).select("page_id", technologies.from_headers(F.col("response_headers")).alias("names"))
    return technologies.detected(c).select("page_id", F.array_join("technologies", ",").alias("technologies"))


@query(f"with c as ({S.CHUNKS} union all {S.ASSETS}), n as (select page_id, unnest({_SIG(technologies.URL, 'url')} || case when contains(lower(url), '/assets/') and regexp_matches(regexp_extract(url, '([^/]*)$', 1), '-[A-Za-z0-9]{{6,10}}\\.(?:js|css)$') then ['Vite'] else [] end) as name from c) select page_id, array_to_string(list_sort(list_distinct(list(name))), ',') as technologies from n group by page_id")
def url_signatures(spark, d):
    u = sample(spark, d, S.CHUNKS).union(sample(spark, d, S.ASSETS)).select("page_id", technologies.from_url(F.col("url")).alias("names"))
    return technologies.detected(u).select("page_id", F.array_join("technologies", ",").alias("technologies"))


_CATEGORY = lambda col: "case " + " ".join(f"when contains(lower({col}), '{w}') then '{c}'" for w, c in technologies.CATEGORIES.items()) + " else 'Other' end"
_NAMES = sorted({*technologies.SERVER.values(), *technologies.URL.values(), *technologies.GENERATOR.values(), *technologies.GLOBALS.values()})


@query(f"select name, {_CATEGORY('name')} as category from (select unnest([{', '.join(repr(n) for n in _NAMES)}]) as name)")
def tech_category(spark, d):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", technologies.category(F.col("name")).alias("category"))


@query(f"""with v as ({S.VERSIONS}), t as (select page_id, 'WordPress' as name from v where seq % 2 = 0 group by page_id union all select page_id, 'Next.js' from v where seq % 4 = 2 group by page_id), o as (select page_id, name, max(version) as version from v where seq % 5 = 0 group by all)
select coalesce(t.page_id, o.page_id) as page_id, coalesce(t.name, o.name) as name, o.version, {_CATEGORY('coalesce(t.name, o.name)')} as category from t full join o on t.page_id = o.page_id and lower(t.name) = lower(o.name)""")
def tech_versions_left_join(spark, d):
    v = sample(spark, d, S.VERSIONS)
    t = v.where("seq % 2 = 0").select("page_id", F.lit("WordPress").alias("name")).distinct().union(v.where("seq % 4 = 2").select("page_id", F.lit("Next.js")).distinct())
    return technologies.versions_of(t, v.where("seq % 5 = 0").groupBy("page_id", "name").agg(F.max("version").alias("version")))


@query(f"""with a as (select distinct page_id, url from ({S.ASSETS}) where regexp_matches(lower(url), '/wp-content/|/wp-includes/|/wp-json/')), v as (select page_id, regexp_extract(url, 'ver=([^&]*)', 1) as version from a), c as (select page_id, version, count(*)::bigint as n from v where regexp_matches(version, '^[0-9]+([.][0-9]+){{1,2}}$') group by all having count(*) >= 2)
select page_id, version, n from c qualify row_number() over (partition by page_id order by n desc, version desc) = 1""")
def wp_consensus(spark, d):
    return technologies.asset_versions(sample(spark, d, S.ASSETS))


@query(f"""with v as ({S.VERSIONS}), f as (select page_id, arg_min(version, seq) as version from v where lower(name) = 'wordpress' and detection_method in ('meta generator', 'REST generator') group by page_id),
p as (select page_id, version, split_part(version, '.', 1)::int * 1000000 + split_part(version, '.', 2)::int * 1000 + coalesce(try_cast(split_part(version, '.', 3) as int), 0) as k from f),
r as (select * from (values (6009000, 6009004, 'critical', 'WordPress pre-authentication RCE chain (CVE-2026-60137/CVE-2026-63030)'), (7000000, 7000001, 'critical', 'WordPress pre-authentication RCE chain (CVE-2026-60137/CVE-2026-63030)'), (6008000, 6008005, 'medium', 'WordPress SQL injection (CVE-2026-60137)')) t(a, b, severity, vuln_type))
select page_id, version, vuln_type, severity from p join r on k between a and b""")
def wp_advisories(spark, d):
    return advisories.wordpress(sample(spark, d, S.VERSIONS))


_RSC = " union all ".join(f"select page_id, seq, '{t}' as vuln_type, '{s}' as severity, unnest(regexp_extract_all(text, '{advisories.PACKAGE}[^0-9]{{0,15}}{v}', 1)) as version from s" for t, s, v in advisories.RSC)


@query(f"with s as ({S.SCRIPTS}) {_RSC}")
def rsc_versions(spark, d):
    return advisories.rsc_versions(sample(spark, d, S.SCRIPTS))


@query(f"""with s as ({S.SCRIPTS}), v as (select page_id, vuln_type, severity, version, min(seq)::int as seq, 'finding' as disposition from ({_RSC}) group by all),
f as (select page_id, bool_or(text like '%__next_f.push%') as flight, bool_or(regexp_matches(text, 'react-server-dom-(?:webpack|parcel|turbopack)')) as bridge, bool_or(text like '%callServer(%') as actions from s group by page_id)
select * from v union all select page_id, 'React Server Components surface', 'info', concat_ws(', ', case when flight then 'flight' end, case when bridge then 'server-dom' end, case when actions then 'server actions' end), null, 'lead' from f where (flight or bridge or actions) and page_id not in (select page_id from v)""")
def rsc_findings(spark, d):
    none = spark.createDataFrame([], "page_id long, key string")
    return advisories.rsc(sample(spark, d, S.SCRIPTS), none)


@query(f"with v as (select distinct page_id from ({S.VERSIONS}) where name like 'Next.js%') select page_id, unnest([{', '.join(repr(n) for n in advisories.NEXT)}]) as vuln_type, 'info' as severity, 'lead' as disposition from v")
def next_leads(spark, d):
    return advisories.next_leads(sample(spark, d, S.VERSIONS))


@query(f"""with v as (select page_id, name, case when seq % 7 = 0 then null else version end as version from ({S.VERSIONS})), a as (select page_id, name, version from v where page_id % 2 = 0), b as (select distinct page_id, name, version from v)
select * from a union all select * from b where not exists (select 1 from a where a.page_id is not distinct from b.page_id and a.name is not distinct from b.name and a.version is not distinct from b.version)""")
def existing_vuln_anti(spark, d):
    v = sample(spark, d, S.VERSIONS).select("page_id", "name", F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("version")).alias("version"))
    return advisories.append_new(v.where("page_id % 2 = 0"), v, ["page_id", "name", "version"])


@query(f"""with c as (select *, 'https://h' || (page_id % 7) || '.example.com/' as target from ({S.CALLS})), f as (select page_id, arg_min(extra, seq) as extra from c where starts_with(url, target) and contains(kind, 'text/html') group by page_id)
select page_id, h as header from (select page_id, lower(extra) as x, unnest(['Content-Security-Policy', 'Strict-Transport-Security', 'X-Frame-Options', 'X-Content-Type-Options']) as h from f) where lower(h) <> x""")
def missing_headers(spark, d):
    c = _calls(spark, d)
    t = c.select("page_id").distinct().select("page_id", F.concat(F.lit("https://h"), (F.col("page_id") % 7).cast("string"), F.lit(".example.com/")).alias("url"))
    return posture.missing_on_document(c, t)


@query(f"with c as ({S.CALLS}) select page_id, url from c where cors = '*' and 'h' || (page_id % 7) || '.example.com' = regexp_extract(url, '//([^/]*)', 1) and not url like '%.js'")
def cors_issues(spark, d):
    c = _calls(spark, d)
    t = c.select("page_id").distinct().select("page_id", F.concat(F.lit("https://h"), (F.col("page_id") % 7).cast("string"), F.lit(".example.com/")).alias("url"))
    return posture.open_cors(c, t)


def _csp_sql() -> str:
    return f"""with p as ({S.POLICIES}), q as (select page_id, trim(unnest(regexp_split_to_array(header, '[\\n,]'))) as policy from p), r as (select page_id, policy, list_filter(list_transform(string_split(policy, ';'), lambda x: regexp_split_to_array(trim(x), '\\s+')), lambda t: len(t) > 0 and t[1] <> '') as ds from q where policy <> ''),
s as (select page_id, coalesce(list_filter(ds, lambda t: lower(t[1]) = 'script-src')[1], list_filter(ds, lambda t: lower(t[1]) = 'default-src')[1]) as tk from r), u as (select page_id, list_transform(tk[2:], lambda x: lower(x)) as so from s where tk is not null),
a as (select page_id, bool_and(list_has_any(so, ['unsafe-inline', '''unsafe-inline''']) and len(list_filter(so, lambda x: regexp_matches(x, '^''(?:nonce-|sha256-|sha384-|sha512-|strict-dynamic''$)'))) = 0) as i, bool_and(list_has_any(so, ['unsafe-eval', '''unsafe-eval'''])) as e, bool_and(list_has_any(so, ['*', 'https:', 'http:', 'data:'])) as b from u group by page_id)
select p.page_id, coalesce(i, false) as unsafe_inline, coalesce(e, false) as unsafe_eval, coalesce(b, true) as broad from p left join a using (page_id)"""


@query(_csp_sql())
def csp_flags(spark, d):
    return sample(spark, d, S.POLICIES).select("page_id", posture.csp_flags(F.col("header")).alias("f")).select("page_id", "f.*")


# scripts, source maps, manifests

_EP = " union all ".join(f"select page_id, seq, label, {k} as k, unnest(regexp_extract_all(text, {chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39)}, 1)) as url, unnest(regexp_extract_all(text, {chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39)}, 0)) as m from s" for k, p in enumerate(endpoints.CALLS))


@query(f"""with s as ({S.SCRIPTS}), e as ({_EP}), f as (select page_id, seq, label, url, arg_min(m, k) as m from e where strlen(url) >= 4 and regexp_matches(url, '^(?:/|http)') group by all)
select page_id, seq, label, url, case when lower(m) like '%post%' then 'POST' when lower(m) like '%put%' then 'PUT' when lower(m) like '%delete%' then 'DELETE' when lower(m) like '%patch%' then 'PATCH' else 'GET' end as method,
array_to_string(regexp_extract_all(url, '\\{{(\\w+)\\}}', 1) || regexp_extract_all(url, '\\$\\{{(\\w+)\\}}', 1) || regexp_extract_all(url, ':(\\w+)', 1), ',') as parameters from f""")
def api_endpoints(spark, d):
    return endpoints.endpoints(sample(spark, d, S.SCRIPTS)).withColumn("parameters", F.array_join("parameters", ","))


@query(f"with e as (select distinct url from ({S.CALLS}) where regexp_matches(url, '/api/|/graphql|/v1/|/v2/|/v3/|\\.json')), s as ({S.SCRIPTS}), j as (select unnest(regexp_extract_all(text, 'fetch\\s*\\(\\s*[`''\"]([^`''\"]+)[`''\"]', 1)) as url from s) select url from e union select url from j where regexp_matches(url, '^(?:/|http)')")
def inventory_union(spark, d):
    api = _calls(spark, d).where(urls.is_api(F.col("url"))).select("url")
    own = sample(spark, d, S.SCRIPTS).where(F.contains("text", F.lit("fetch(")))
    return api.union(endpoints.endpoints(own).select("url")).distinct()


@query(f"""with s as ({S.SCRIPTS}), c as (select page_id, seq, label, 'single' as comment_type, unnest(regexp_extract_all(text, '//(.+)', 1)) as c, 200 as n from s union all select page_id, seq, label, 'multi', unnest(regexp_extract_all(text, '/\\*([\\s\\S]*?)\\*/', 1)), 500 from s)
select page_id, seq, label, comment_type, left(trim(c), n) as content from c where strlen(trim(c)) > 5""")
def comments(spark, d):
    return secrets.comments(sample(spark, d, S.SCRIPTS))


_NORMAL = "regexp_replace(case when contains(path, '://') then regexp_replace(path, '^.*?:///*', '') else path end, '^(?:\\./)+', '')"


@query(f"""with p as (select page_id, seq, {_NORMAL} as p from ({S.PATHS})), q as (select *, string_split(p, '/') as g, list_transform(string_split(lower(p), '/'), lambda x: x in ('pages', 'app', 'routes', 'views')) as h from p where not regexp_matches(p, 'node_modules|/vendor/|^vendor/|/\\.pnpm/')),
b as (select *, len(h) + 1 - list_position(list_reverse(h), true) as back from q), r as (select *, array_to_string(g[coalesce(back, 1) + 1:], '/') as rest from b),
t as (select *, regexp_replace(rest, '\\.[^.]*$', '') as stem from r), u as (select *, '/' || regexp_replace(case when stem = 'index' then '' else regexp_replace(stem, '/index$', '') end, '^/+', '') as route from t),
k as (select page_id, seq, case when contains(lower(p), 'controller') then 'controller' when back is null or rest = '' then null when regexp_matches(route, '^/api(?:/|$)') then 'api' else 'route' end as kind, case when contains(lower(p), 'controller') then p else route end as path, case when contains(lower(p), 'controller') then false else regexp_matches(route, '[\\[:]') end as dynamic from u)
select page_id, kind, path, dynamic, min(seq) as seq from k where kind is not null group by all""")
def source_routes(spark, d):
    return sourcemaps.routes(sample(spark, d, S.PATHS))


@query(f"""with p as (select page_id, seq, {_NORMAL} as p from ({S.PATHS})), v as (select page_id, seq, unnest(regexp_extract_all(p, '{sourcemaps.PACKAGE}', 1)) as name, unnest(regexp_extract_all(p, '{sourcemaps.PACKAGE}', 2)) as version from p where regexp_matches(p, 'node_modules|/\\.pnpm/'))
select page_id, replace(regexp_replace(name, '^@+', ''), '+', '/') as name, version, min(seq) as seq from v group by all""")
def package_versions(spark, d):
    return sourcemaps.package_versions(sample(spark, d, S.PATHS))


_MAP = "concat('{\"version\":3,\"sourceRoot\":\"', case when p_partkey % 2 = 0 then 'root/' else '' end, '\",\"sources\":[\"src/a', cast(p_partkey as string), '.js\",null,\"/abs.js\"],\"sourcesContent\":[\"code\",\"\",\"\"],\"ignoreList\":[2]}')"
_MAPS = f"select p_partkey as page_id, case when p_partkey % 10 = 0 then '[]' else {_MAP} end as body from part"


@query(f"""select page_id, idx::int as idx, path, content, idx = 2 as ignored from (select page_id, unnest([0, 2]) as idx, unnest([case when page_id % 2 = 0 then 'root/' else '' end || 'src/a' || page_id || '.js', '/abs.js']) as path, unnest(['code', cast(null as varchar)]) as content from ({_MAPS}) where body <> '[]')""")
def source_map_sources(spark, d):
    return sourcemaps.parse(sample(spark, d, _MAPS)).select("page_id", "idx", "path", "content", "ignored")


@query(f"""with c as (select page_id, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '([A-Za-z0-9_.\\[\\]-]+?)(?:[-.][0-9a-f]{{6,}})?\\.[cm]?js$', 1) as path from ({S.CHUNKS}))
select distinct page_id, path, 'component' as kind, 'chunk-graph' as source, regexp_matches(path, '[\\[:*]') as dynamic from c where path <> '' and not regexp_matches(path, '^(?:[0-9]+|[0-9a-fA-F]{{6,}})$') and not lower(path) like 'turbopack-%' and lower(path) not in ('app', 'chunk', 'index', 'main', 'polyfills', 'runtime', 'script', 'signals', 'vendor')
and not (length(path) >= 10 and regexp_matches(path, '^[a-z0-9_-]+$') and (regexp_matches(path, '^[0-9]') or length(regexp_replace(path, '[^0-9]', '', 'g')) >= 3))""")
def chunk_components(spark, d):
    none = spark.createDataFrame([], "page_id long, key string, value string")
    return manifests.routes(none, chunks=sample(spark, d, S.CHUNKS))


@query(f"""with recursive e as (select page_id, id, parent_id, case when path = '$' then '*' when path = '$id' then ':id' else path end as seg from ({S.ROUTES})),
w as (select page_id, id, parent_id as up, seg as full_, 1 as hop from e union all select w.page_id, w.id, e.parent_id, case when e.seg = '' then full_ when full_ = '' then e.seg else e.seg || '/' || full_ end, hop + 1 from w join e on w.page_id = e.page_id and w.up = e.id where hop < 64)
select page_id, id, replace('/' || full_, '//', '/') as full_path from w where up is null""")
def remix_paths(spark, d):
    return manifests.nested_paths(sample(spark, d, S.ROUTES))


_GLOBALS = """select p_partkey % 60 as page_id, case p_partkey % 5 when 0 then '__NEXT_DATA__' when 1 then '__SSG_MANIFEST' when 2 then '__NUXT__' when 3 then '__sveltekit_data' else '__next_f' end as key,
 case p_partkey % 5 when 0 then concat('{"buildId":"b","page":"/p', cast(p_partkey % 8 as string), '"}') when 1 then concat('["/s', cast(p_partkey % 6 as string), '","x"]') when 2 then concat('{"path":"/n/:id', cast(p_partkey % 3 as string), '","data":{"/api/d":1,"k":2}}')
  when 3 then '{"route":{"id":"/(app)/dash/[slug]"}}' else concat('app/(m)/about', cast(p_partkey % 4 as string), '/page app/api/x/route app/@s/page') end as value from part"""


@query(f"""with g as ({_GLOBALS}), r as (select page_id, json_extract_string(value, '$.page') as path, 'route' as kind, 'next:next-data' as source, 0 as o from g where key = '__NEXT_DATA__'
union all select page_id, '/s' || regexp_extract(value, '/s([0-9])', 1), 'route', 'next:ssg-manifest', 3 from g where key = '__SSG_MANIFEST' union all select page_id, '/about' || regexp_extract(value, 'about([0-9])', 1), 'route', 'next:flight', 4 from g where key = '__next_f'
union all select page_id, unnest(['/api/x', '/']), unnest(['api', 'route']), 'next:flight', 4 from g where key = '__next_f' union all select page_id, json_extract_string(value, '$.path'), 'route', 'nuxt:payload', 5 from g where key = '__NUXT__' union all select page_id, '/api/d', 'api', 'nuxt:data-keys', 6 from g where key = '__NUXT__'
union all select page_id, '/dash/[slug]', 'route', 'sveltekit:start', 7 from g where key = '__sveltekit_data')
select page_id, path, kind, arg_min(source, o) as source, regexp_matches(path, '[\\[:*]') as dynamic from r group by page_id, path, kind""")
def manifest_routes(spark, d):
    return manifests.routes(sample(spark, d, _GLOBALS))


# storage, events


_LEAF = "lower(regexp_replace(regexp_replace(regexp_extract(key, '([^.\\[]*)$', 1), '\\]+$', ''), '[^A-Za-z0-9]', '_', 'g'))"


@query(f"""with s as ({S.STORAGE}), k as (select *, {_LEAF} as leaf, value like 'eyJ%' as jwt from s),
f as (select *, regexp_matches(leaf, 'refresh_token|refreshtoken|refresh_jwt') as rk, regexp_matches(leaf, 'access_token|accesstoken|auth_token|authtoken|bearer_token|id_token|idtoken|jwt') or leaf in ('token', 'authorization', 'bearer') as ak, regexp_matches(leaf, 'session|sessid') or leaf in ('sid', 'auth', 'authentication') as sk, regexp_matches(leaf, 'publishable|anon_key|client_id|clientid|api_url|apiurl|base_url|baseurl|endpoint') as pk,
 strlen(trim(value)) >= 16 and len(list_distinct(string_split(trim(value), ''))) >= 6 and not regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*:') as cred, regexp_matches(trim(value), '^[^.]+\\.[^.]+\\.[^.]+$') as shaped from k),
v as (select *, case when jwt then (case when pk then 'public_configuration' else 'privileged_jwt' end) when pk and not (rk or ak or sk) then 'public_configuration' when shaped and (rk or ak or sk) then 'ambiguous_sensitive_name' when (rk or ak or sk) and (container or not cred) then 'ambiguous_sensitive_name' when rk then 'refresh_token' when ak then 'access_token' when sk then 'persisted_session' end as classification from f),
w as (select *, case classification when 'public_configuration' then 'info' when 'ambiguous_sensitive_name' then 'low' when 'persisted_session' then 'medium' else 'high' end as severity, case classification when 'public_configuration' then 'inventory' when 'ambiguous_sensitive_name' then 'lead' else 'finding' end as disposition from v where classification is not null),
g as (select page_id, classification, value, array_to_string(list_sort(list_distinct(list(key))), ',') as keys, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, min(seq) as seq, arg_min(severity, seq) as severity, arg_min(disposition, seq) as disposition from w group by page_id, classification, value)
select page_id, classification, value, keys, sources, seq, severity, disposition from g qualify row_number() over (partition by page_id order by seq, value) <= 128""")
def storage_assess(spark, d):
    rows = storage.assess(storage.classify(sample(spark, d, S.STORAGE), F.lit(1000)), storage.GROUPS)
    return rows.select("page_id", "classification", "value", F.array_join("keys", ",").alias("keys"), F.array_join("sources", ",").alias("sources"), "seq", "severity", "disposition")


@query("select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def json_leaves(spark, d):
    return storage.json_leaves(table(spark, d, "events").select("event_id", F.col("props").alias("json"))).select("event_id", "path", "value")


@query(f"""with e as (select *, (kind = 'request' and url like 'http%') as q, kind = 'response' as p, kind = 'finished' as f from ({S.EVENTS})), a as (select page_id, request_id, min(seq) filter (q or p) as first, arg_max(url, seq) filter (q) as qu, arg_max(method, seq) filter (q) as method, arg_max(body, seq) filter (q) as qb, arg_max(url, seq) filter (p) as pu, arg_max(status, seq) filter (p) as ps, max(seq) filter (f) as fs, arg_max(body, seq) filter (f) as fb from e group by page_id, request_id)
select page_id, request_id, first as seq, coalesce(qu, pu) as url, coalesce(method, '') as method, (case when ps between 0 and 65535 then ps else 0 end)::int as status, qb as request_body, case when fs > first then fb end as response_body, case when fs > first then fs end as response_size from a where first is not null""")
def network_merge(spark, d):
    e = sample(spark, d, S.EVENTS).withColumn("headers", F.create_map().cast("map<string,string>"))
    return network.merge(e).select("page_id", "request_id", "seq", "url", "method", "status", "request_body", "response_body", "response_size")


@query("""with t as (select conv_id, turn, role, text, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 8))) as value from conversations) select conv_id, value, min(turn) as turn from t group by all""")
def ordered_dedupe(spark, d):
    words = Pattern("word", r"[A-Za-z]{8,}")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), F.col("role").alias("label"), "text")
    return secrets.first_sources(secrets.scan(c, [words], unicode=False)).select(F.col("page_id").alias("conv_id"), "value", F.col("seq").alias("turn"))


# without SQL: parsers, dataflow, documents


def _facts(spark, d) -> DataFrame:
    s = sample(spark, d, S.SCRIPTS, True).union(sample(spark, d, S.FLOWS, True)).select("page_id", "seq", F.col("label").alias("url"), "text")
    inline = captures.scripts(captures.elements(S.spread(table(spark, d, "pages"))), None).where("body is not null").select("page_id", F.col("pos").cast("long").alias("seq"), F.lit("Inline Script").alias("url"), F.col("body").alias("text"))
    return javascript.facts(s.union(inline))


@query()
def taint_flows(spark, d):
    return findings.flow_confidence(javascript.flows(_facts(spark, d)), F.lit("s.example.com")).select("page_id", "source", "sink", "location", "path", "script_url", "confidence")


@query()
def postmessage_handlers(spark, d):
    return findings.handler_confidence(javascript.message_handlers(_facts(spark, d)), F.lit("s.example.com"))


@query()
def proto_findings(spark, d):
    return javascript.pollution(_facts(spark, d))


@query()
def script_literals(spark, d):
    return javascript.telling_literals(_facts(spark, d))


@query()
def gadgets(spark, d):
    return findings.gadget_confidence(javascript.gadgets(_facts(spark, d), sample(spark, d, S.POLICIES)), F.lit("s.example.com"))


@query()
def page_artifact_secrets(spark, d):
    """All built-in and two custom patterns over every artifact of every page, and of what is put behind each."""
    pages = sample(spark, d, S.PAGES)
    found = secrets.scan(captures.artifacts(pages, inline=None), catalog([("token_assignment", TOKEN.regex, "HIGH"), ("password_assignment", PASSWORD.regex, "HIGH")]))
    own = secrets.grouped(secrets.with_token_roles(secrets.first_sources(found)))
    host = pages.select("page_id", urls.host(F.col("url")).alias("target"))
    return secrets.scored(own.join(host, "page_id"), F.col("target")).select("page_id", "pattern", "label", "matches", "severity", "disposition", "confidence")


def _vulnerabilities(spark, d) -> DataFrame:
    flow = advisories.rsc_versions(sample(spark, d, S.SCRIPTS)).select("page_id", "seq", "vuln_type", "severity", F.lit("finding").alias("disposition"), F.lit("").alias("description"), F.lit(None).cast("string").alias("url"), F.array(F.struct(F.lit("ast").alias("source"), F.lit("bundle").alias("location"))).alias("evidence"), F.lit("bundle").alias("location"))
    return findings.of_vulnerabilities(findings.vulnerability_confidence(flow, F.lit("example.org")))


def _ranked(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    stored = findings.of_storage(findings.storage_confidence(storage.assess(storage.classify(sample(spark, d, S.STORAGE), F.lit(1000)))))
    every = scratch.kept(findings.unify(findings.of_secrets(_scored(spark, d, None)), stored, _vulnerabilities(spark, d)), "findings")  # read several times, made once
    pages = every.select("page_id").distinct().withColumn("url", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example.org/")))
    return pages, findings.rank(every), findings.summary(every)


@query()
def report_markdown(spark, d):
    """Every page's report, and its further parts where it has more findings than a document holds."""
    pages, ranked, summary = _ranked(spark, d)
    lines = scratch.kept(sinks.numbered(ranked), "lines")  # of reports and parts, numbered once
    first = sinks.markdown(pages, lines, summary).withColumn("part", F.lit(0))
    return first.unionByName(sinks.markdown_parts(pages, lines))


@query()
def report_json(spark, d):
    pages, ranked, summary = _ranked(spark, d)
    return sinks.json_documents(pages, summary=summary, findings=ranked.select("page_id", "severity", "place", "kind", "title", "disposition", "source", "level", "score"))


@query()
def source_map_gate(spark, d):
    s = sample(spark, d, S.SCRIPTS)
    refs = s.select("page_id", "seq", F.col("label").alias("referrer"), F.concat(F.lit("maps/"), (F.col("seq") % 60).cast("string"), F.lit(".js.map")).alias("ref"))
    t = s.select("page_id").distinct().select("page_id", F.lit("https://s.example.com/").alias("url"))
    return sourcemaps.gate(refs, t)
