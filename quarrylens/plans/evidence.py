"""More queries over captured evidence: scripts with known facts, calls, versions, manifests, storage, pages' elements."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls, values
from ..operators import advice, findings, javascript, manifests, posture, secrets, sourcemaps, storage, technologies, traffic, versions
from ..sources import captures, scratch, sections, sinks
from . import catalog as C
from . import samples as S
from .catalog import query, table
from .samples import sample

# scripts: what each of the nine forms of samples.FLOWS holds


def _flow_facts(spark, d) -> DataFrame:
    s = sample(spark, d, S.FLOWS, True).select("page_id", "seq", F.col("label").alias("url"), "text")
    return javascript.facts(s)


_CASES = "select page_id, seq, label as script_url, p_partkey % 9 as k, label from (select *, seq as p_partkey from ({})) s".format(S.FLOWS)
_AT = "label || ':2:' || c"


@query(f"""with s as ({_CASES}), f as (select * from (values (2, 'e.data', 'eval(...)', '', 49), (3, 'e.data', 'document.write(...)', '', 77), (6, 'location.search', 'innerHTML', 'q', 26), (5, 'e.data', 'innerHTML', '', 0)) t(k, source, sink, path, c) where c > 0)
select page_id, source, sink, {_AT} as location, path, script_url, seq from s join f using (k)""")
def planted_flows(spark, d):
    rows = javascript.flows(_flow_facts(spark, d))
    return rows.select("page_id", "source", "sink", "location", F.array_join("path", ",").alias("path"), "script_url", "seq")


@query(f"""with s as ({_CASES}), f as (select * from (values (0, 'location.hash', 'proto-key write `__proto__`'), (1, 'location.search', 'merge(...) deep-merge')) t(k, source, sink)) select page_id, source, sink, label || ':2:1' as location, seq from s join f using (k)""")
def planted_pollution(spark, d):
    return javascript.pollution(_flow_facts(spark, d)).select("page_id", "source", "sink", "location", "seq")


@query(f"""with s as ({_CASES}), f as (select * from (values (2, 'none', true), (3, 'strict', true), (4, 'none', false), (5, 'weak', true)) t(k, origin_check, reaches_sink)) select page_id, seq, script_url, label || ':2:1' as location, origin_check, reaches_sink from s join f using (k)""")
def planted_handlers(spark, d):
    return javascript.message_handlers(_flow_facts(spark, d))


@query(f"""with s as ({_CASES}), f as (select * from (values (6, 'endpoint_literal', 'https://h.example.com/x/y', 48, 'variable'), (7, 'http_call', '/api/long/path', 1, 'fetch'), (7, 'literal', 'abcdefgh', 35, 'property')) t(k, kind, value, c, context)) select page_id, seq, script_url, kind, value, {_AT} as location, context from s join f using (k)""")
def planted_literals(spark, d):
    return javascript.telling_literals(_flow_facts(spark, d))


@query(f"""with s as ({_CASES}), f as (select * from (values
 (2, 0, 'dom-xss', 'e.data → eval(...)', 49), (3, 0, 'dom-xss', 'e.data → document.write(...)', 77), (6, 0, 'dom-xss', 'location.search → q → innerHTML', 26),
 (0, 1, 'prototype-pollution', 'location.hash → proto-key write `__proto__` (@)', 1), (1, 1, 'prototype-pollution', 'location.search → merge(...) deep-merge (@)', 1),
 (2, 2, 'postmessage-trust', 'message handler with none origin check reaches a sink (@)', 1), (5, 2, 'postmessage-trust', 'message handler with weak origin check reaches a sink (@)', 1)) t(k, o, category, description, c)),
 r as (select page_id, seq, {_AT} as location, o, category, replace(description, '@', label || ':2:1') as description, k from s join f using (k)),
 p as (select page_id from ({S.POLICIES}) where page_id % 9 in (1, 3, 4, 6, 8)),
 x as (select page_id, seq, location, 3 as o, 'csp-bypass' as category, 'the policy lets through what the sink `' || case k when 2 then 'eval(...)' when 3 then 'document.write(...)' else 'innerHTML' end || '` needs' as description, k from r where category = 'dom-xss' and page_id in (select page_id from p)
   qualify row_number() over (partition by page_id order by seq, location) = 1)
select page_id, category, description, row_number() over (partition by page_id order by o, seq, location, description)::int as place from (select * from r union all select * from x) qualify place <= 200""")
def planted_gadgets(spark, d):
    return javascript.gadgets(_flow_facts(spark, d), sample(spark, d, S.POLICIES), javascript.CAP).select("page_id", "category", "description", "place")


@query(f"""with s as ({_CASES}) select page_id, seq, kind, case when label like 'https://s.example.com/%' then 'first' else 'third' end as origin,
 greatest(0, least(100, 40 + case when label like 'https://s.example.com/%' then 8 else -12 end + 10))::int as score from (select page_id, seq, label, k, case when k in (2, 3, 6) then 'flow' end as kind from s) where kind is not null""")
def flow_scores(spark, d):
    rows = findings.flow_confidence(javascript.flows(_flow_facts(spark, d)), F.lit("s.example.com"))
    return rows.select("page_id", "seq", F.lit("flow").alias("kind"), urls.origin(F.col("script_url"), F.lit("s.example.com")).alias("origin"), "confidence.score")


# pages with known elements


def _pages(spark, d) -> DataFrame:
    return sample(spark, d, S.PAGES, True)


@query(f"with p as ({S.PAGES}), f as (select page_id, unnest(regexp_extract_all(html, '<form action=\"(/go[0-9]+)\" method=\"post\">', 1)) as action from p) select page_id, action, 'post' as method, 2::int as input_count from f")
def page_forms(spark, d):
    return captures.forms(captures.elements(_pages(spark, d))).where("action like '/go%'").select("page_id", "action", "method", "input_count")


@query("select page_id, 'k' || (page_id % 7) as name, 'AKIA' || upper(substr(md5(page_id::varchar), 1, 16)) as value from pages")
def page_hidden_inputs(spark, d):
    return captures.hidden_inputs(captures.elements(_pages(spark, d))).where("value like 'AKIA%'").select("page_id", "name", "value")


@query("select page_id, 'generator' as name, 'WordPress 6.' || (page_id % 10) as content from pages")
def page_meta_tags(spark, d):
    return captures.meta_tags(captures.elements(_pages(spark, d))).where("name = 'generator' and content like 'WordPress 6.%'").select("page_id", "name", "content")


@query("select page_id, 'div' as tag, '{\"data-token\":\"ghp_' || md5(page_id::varchar) || 'abcd\",\"data-x\":\"1\"}' as attributes from pages")
def page_data_attributes(spark, d):
    rows = captures.data_attributes(captures.elements(_pages(spark, d)))
    return rows.where("attributes['data-token'] like 'ghp_%'").select("page_id", "tag", F.to_json("attributes").alias("attributes"))


@query("select page_id, 'http://f.example.com/' || page_id as src from pages")
def page_iframes(spark, d):
    return captures.iframes(captures.elements(_pages(spark, d))).where("src like 'http://f.example.com/%'").select("page_id", "src")


@query(f"""with p as ({S.PAGES}), u as (select page_id, unnest(list_distinct(regexp_extract_all(html, '<(?:a|link|img|script|iframe)\\s[^>]*?(?:href|src)="(http://[^"]*)"', 1))) as url from p where url like 'https://%') select page_id, url from u""")
def page_mixed_content(spark, d):
    p = _pages(spark, d)
    e = captures.elements(p)
    refs = e.where("tag in ('a', 'link', 'img', 'script', 'iframe')").select("page_id", F.explode(F.array(F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("src")))).alias("url")).where("url is not null").distinct()
    return posture.mixed_content(refs, p)


_ART = f"art as (select page_id, 0 as seq, 'HTML' as label, html as text from ({S.PAGES})), {C._FOUND}"


@query(f"with {_ART}, {C._SCORES} select page_id, pattern, label, n, severity, score, level, disposition from disp")
def planted_artifact_secrets(spark, d):
    """All built-in patterns over every artifact of every page; a page's own text has them first."""
    found = secrets.scan(captures.artifacts(_pages(spark, d)), limit=secrets.PER_ARTIFACT)
    own = secrets.grouped(secrets.first_sources(found))
    return secrets.scored(own, F.lit("example.org")).select("page_id", "pattern", "label", F.size("matches").cast("long").alias("n"), "severity", "confidence.score", "confidence.level", "disposition")


@query(f"""with p as ({S.PAGES}) select label, count(*)::bigint as n from (select 'Hidden Input: k' || (page_id % 7) as label from p union all select 'Data Attributes: div' from p) group by label""")
def artifact_labels(spark, d):
    rows = captures.artifacts(_pages(spark, d)).where("label like 'Hidden Input: k_' or (label = 'Data Attributes: div' and text like '%ghp_%')")
    return rows.groupBy("label").agg(F.count("*").alias("n"))


# cookies, storage, posture


@query(f"with c as ({S.COOKIES}) select page_id, name, case when secure then '' else 'missing Secure' end || case when not secure and not http_only then ', ' else '' end || case when http_only then '' else 'missing HttpOnly' end as issues from c where not secure or not http_only")
def weak_cookies(spark, d):
    return posture.weak_cookies(sample(spark, d, S.COOKIES)).select("page_id", "name", F.array_join("issues", ", ").alias("issues"))


@query(f"""with c as ({S.COOKIES}), w as (select page_id, name from c where not secure or not http_only), x as (select page_id, url from ({S.CALLS}) where url like 'http://%')
select page_id, 'weak-cookies' as vuln_type, count(*)::bigint as n, array_to_string(list_sort(list(name)), ',') as evidence from w group by page_id union all select page_id, 'plain-http', count(*)::bigint, array_to_string(list_sort(list(url)), ',') from x group by page_id""")
def posture_leads(spark, d):
    weak = posture.weak_cookies(sample(spark, d, S.COOKIES)).select("page_id", F.col("name").alias("item"))
    plain = sample(spark, d, S.CALLS).where("startswith(url, 'http://')").select("page_id", F.col("url").alias("item"))
    return posture.validation_leads(**{"weak-cookies": weak, "plain-http": plain}).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""with m as ({S.MAPS}), k as (select *, split_part(key, '.', -1) as leaf, regexp_matches(lower(key), 'access_token|session') or lower(key) in ('auth_state') as own from m),
r as (select page_id, area, key || '.user.access_token' as key, json_extract_string(value, '$.user.access_token') as value, false as container from k where value like '{{"user"%'
 union all select page_id, area, key || '.list[0].sid', json_extract_string(value, '$.list[0].sid'), false from k where value like '{{"user"%'
 union all select page_id, area, key, trim(value, '"'), false from k where value like '"%' and key like 'access_token%' union all select page_id, area, key, value, false from k where not regexp_matches(value, '^[\\[{{"]') and key like 'access_token%'
 union all select page_id, area, key, value, false from k where value = '{{bad json' and key like 'access_token%' union all select page_id, area, key, value, true from k where value like '[%' and key like 'access_token%')
select page_id, case area when 'local' then 'localStorage' when 'session' then 'sessionStorage' else 'runtime state' end || ' `' || key || '`' as location, value, container from r
union all select page_id, 'Cookie `' || name || '`', value, false from ({S.COOKIES}) where name in ('session_id', 'client_id') or value = 'a.b.c'
union all select page_id, 'URL parameter `token`', 'abc', false from ({S.CALLS}) where url like '%token=abc'""")
def storage_candidates(spark, d):
    rows = storage.gather(sample(spark, d, S.MAPS), sample(spark, d, S.COOKIES), sample(spark, d, S.CALLS).select("page_id", "seq", "url"))
    return rows.select("page_id", "location", "value", "container")


@query("""with e as (select event_id, (event_id % 9)::int as n from events) select event_id, unnest(['a.b[0]', 'a.b[1].c', 'd', 'f']) as path, unnest([n::varchar, 'x' || n, 'true', '1.5']) as value from e""")
def json_leaves_deep(spark, d):
    text = F.concat(F.lit('{"a":{"b":['), (F.col("event_id") % 9).cast("string"), F.lit(',{"c":"x'), (F.col("event_id") % 9).cast("string"), F.lit('","z":null}]},"d":true,"e":[],"f":1.5}'))
    return storage.json_leaves(table(spark, d, "events").select("event_id", text.alias("json")))


# calls


def _observed(spark, d) -> DataFrame:
    c = sample(spark, d, S.OBSERVED)
    return c.select("page_id", "seq", "url", "method", "status", "response_content_type", "response_body", F.create_map("answered", F.lit("m.js.map")).alias("response_headers"), F.create_map("asked", F.lit("x|y")).alias("request_headers"))


def _home(spark, d) -> DataFrame:
    return _observed(spark, d).select("page_id").distinct().select("page_id", F.concat(F.lit("https://h"), (F.col("page_id") % 9).cast("string"), F.lit(".example.com/")).alias("url"))


@query(f"select page_id, seq, url as referrer, 'm.js.map' as ref from ({S.OBSERVED}) where lower(answered) in ('sourcemap', 'x-sourcemap')")
def declared_source_maps(spark, d):
    return traffic.map_headers(_observed(spark, d))


@query(f"select page_id, seq, label as referrer, 'a.js.map' as ref from ({S.SCRIPTS}) where seq % 4 = 0 union all select page_id, seq + 1000000000, url, 'm.js.map' from ({S.OBSERVED}) where lower(answered) in ('sourcemap', 'x-sourcemap')")
def all_source_map_references(spark, d):
    s = sample(spark, d, S.SCRIPTS).select("page_id", "seq", F.col("label").alias("url"), F.when(F.col("seq") % 4 == 0, F.concat("text", F.lit("\n//# sourceMappingURL=a.js.map"))).otherwise(F.col("text")).alias("text"))
    return traffic.map_references(s, _observed(spark, d))


@query(f"select page_id, seq, url from ({S.OBSERVED}) where not contains(url, 'https://h' || (page_id % 9) || '.example.com/')")
def third_party_calls(spark, d):
    return traffic.third_party(_observed(spark, d), _home(spark, d)).select("page_id", "seq", "url")


@query(f"""with c as (select page_id, url, regexp_extract(url, '//([^/]*)', 1) as h, 'h' || (page_id % 9) || '.example.com' as t from ({S.OBSERVED}))
select page_id, count(*)::bigint as requests, count_if(regexp_matches(url, '/api/|/graphql|/v1/|/v2/|/v3/|\\.json'))::bigint as api, count_if(h = t)::bigint as first_party, count_if(h <> t)::bigint as third_party, count(distinct case when h <> t then h end)::bigint as domains from c group by page_id""")
def call_totals(spark, d):
    return traffic.totals(_observed(spark, d), _home(spark, d))


@query(f"with c as (select page_id, regexp_extract(url, '//([^/]*)', 1) as domain from ({S.OBSERVED})) select page_id, domain, domain = 'h' || (page_id % 9) || '.example.com' as first_party, count(*)::bigint as n from c group by all")
def call_domains(spark, d):
    return traffic.parties(_observed(spark, d), _home(spark, d))


@query(f"""with c as (select *, regexp_matches(url, '/api/|/graphql|/v1/|/v2/|/v3/') or url like '%.json' as api from ({S.OBSERVED})), m as (select *, bool_or(api) over (partition by page_id) as any_api from c),
n as (select *, row_number() over (partition by page_id order by seq, url)::int as place from m where api or not any_api)
select page_id, place, case when method = '' then 'GET' else method end as method, case when status = 0 then '-' else status::varchar end as status, coalesce(response_content_type, case when lower(answered) = 'content-type' then 'm.js.map' end, '-') as content_type,
 replace(url, '|', '\\|') as url, case asked when 'Authorization' then 'AUTHORIZATION' when 'X-API-Key' then 'X API KEY' else '-' end as hints from n where place <= 10""")
def key_calls(spark, d):
    return traffic.key_calls(_observed(spark, d))


@query("select event_id, 'v' || event_id as text, '1, a, null' as list, 'null' as none, '' as missing from events")
def header_values(spark, d):
    json = F.concat(F.lit('{"A":"v'), F.col("event_id").cast("string"), F.lit('","b":[1,"a",null],"c":null}'))
    m = traffic.header_map(json)
    e = table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", urls.header(F.col("m"), "a").alias("text"), urls.header(F.col("m"), "b").alias("list"), urls.header(F.col("m"), "c").alias("none"), F.coalesce(urls.header(F.col("m"), "d"), F.lit("")).alias("missing"))


@query("select event_id, case when event_id % 3 = 0 then null else event_id || 'x' end as body from events")
def post_bodies(spark, d):
    pieces = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(""))).otherwise(F.array(F.col("event_id").cast("string"), F.lit("x")))
    return table(spark, d, "events").select("event_id", traffic.post_data(pieces).alias("body"))


@query(f"""with r as (select page_id, seq, label as referrer, case seq % 7 when 0 then 'data:x' when 1 then 'https://else.net/m.js.map' when 2 then '/abs/' || (seq % 60) || '.js.map' else 'maps/' || (seq % 60) || '.js.map' end as ref from ({S.SCRIPTS})),
u as (select *, case seq % 7 when 0 then null when 1 then ref when 2 then 'https://s.example.com' || ref else 'https://s.example.com/' || ref end as url from r),
s as (select *, case when seq % 7 = 0 then 'data-url' when seq % 7 = 1 then 'off-origin' end as k from u), t as (select *, coalesce(k, case when row_number() over (partition by page_id, url, k is null order by seq) > 1 then 'repeated' end) as k2 from s),
v as (select *, row_number() over (partition by page_id, k2 is null order by seq) as n from t) select page_id, seq, referrer, ref, url, case when k2 is null and n > 2 then 'count-cap' else k2 end as skip from v""")
def source_map_gate_cases(spark, d):
    s = sample(spark, d, S.SCRIPTS)
    seq = F.col("seq")
    ref = F.when(seq % 7 == 0, "data:x").when(seq % 7 == 1, "https://else.net/m.js.map").when(seq % 7 == 2, F.concat(F.lit("/abs/"), (seq % 60).cast("string"), F.lit(".js.map"))).otherwise(F.concat(F.lit("maps/"), (seq % 60).cast("string"), F.lit(".js.map")))
    refs = s.select("page_id", "seq", F.col("label").alias("referrer"), ref.alias("ref"))
    t = s.select("page_id").distinct().select("page_id", F.lit("https://s.example.com/").alias("url"))
    return sourcemaps.gate(refs, t, limit=2).select("page_id", "seq", "referrer", "ref", "url", "skip")


@query(f"""with p as (select page_id, seq, {C._NORMAL} as p from ({S.PATHS})), m as (select page_id as map, 'https://m.example.com/' || page_id || '.map' as url from p group by page_id)
select page_id, count(*)::bigint as sources from p group by page_id""")
def source_map_chain(spark, d):
    """References of a page, through the gate, to the sources of the maps that are let through."""
    paths = sample(spark, d, S.PATHS)
    url = F.concat(F.lit("https://m.example.com/"), F.col("page_id").cast("string"), F.lit(".map"))
    bodies = paths.groupBy("page_id").agg(F.to_json(F.struct(F.lit(3).alias("version"), F.array_sort(F.collect_list("path")).alias("sources"))).alias("body")).select(url.alias("url"), "body")
    refs = paths.groupBy("page_id").agg(F.min("seq").alias("seq")).select("page_id", "seq", url.alias("referrer"), F.concat(F.col("page_id").cast("string"), F.lit(".map")).alias("ref"))
    refs = refs.unionByName(refs.withColumn("seq", F.col("seq") + 1)).unionByName(refs.withColumn("seq", F.col("seq") + 2).withColumn("ref", F.lit("https://else.net/x.map")))
    targets = refs.select("page_id").distinct().select("page_id", F.lit("https://m.example.com/").alias("url"))
    return sourcemaps.intel(refs, bodies, targets)["sources"].groupBy("page_id").agg(F.count("*").alias("sources"))


# versions, manifests


def _meta(spark, d) -> DataFrame:
    return sample(spark, d, S.OBSERVED).where("seq % 5 = 1").select("page_id", F.col("seq").alias("pos"), F.lit("Generator").alias("name"), F.concat(F.lit("WordPress 5."), (F.col("seq") % 4).cast("string"), F.when(F.col("seq") % 3 == 0, "-beta").otherwise("")).alias("content"))


@query(f"""with c as ({S.OBSERVED}), m as (select page_id, arg_min('5.' || (seq % 4), seq) as v from c where seq % 5 = 1 and seq % 3 <> 0 group by page_id), r as (select page_id, arg_min('6.' || (seq % 5), seq) as v from c where seq % 12 = 0 group by page_id),
a as (select page_id, case when count(distinct url) >= 2 then '6.1' end as v from c where url like '%?ver=6.1' group by page_id), g as (select distinct page_id from c where regexp_matches(url, '/wp-content/|/wp-includes/|/wp-json/') or seq % 5 = 1)
select g.page_id, coalesce(m.v, r.v, a.v) as version, case when m.v is not null then 'meta generator' when r.v is not null then 'REST generator' when a.v is not null then 'asset consensus' end as detection_method from g left join m using (page_id) left join r using (page_id) left join a using (page_id)""")
def wordpress_versions(spark, d):
    none = spark.createDataFrame([], "page_id long, pos long, src string")
    return versions.wordpress(_observed(spark, d), _meta(spark, d), none)


@query(f"""with v as (select page_id, case seq % 3 when 0 then null when 1 then '6.1' else '6.2' end as version, case seq % 3 when 1 then 'asset consensus' when 2 then 'meta generator' end as how from ({S.OBSERVED}) qualify row_number() over (partition by page_id order by seq) = 1)
select page_id, case when version is null then 'no authoritative version was seen' else 'version 6.1 only by agreeing assets' end as lead from v where page_id % 2 = 0 and (version is null or how = 'asset consensus')""")
def wordpress_leads(spark, d):
    one = sample(spark, d, S.OBSERVED).groupBy("page_id").agg(F.min("seq").alias("seq"))
    k = F.col("seq") % 3
    known = one.select("page_id", F.when(k == 1, "6.1").when(k == 2, "6.2").alias("version"), F.when(k == 1, versions.ASSETS).when(k == 2, versions.META).alias("detection_method"))
    there = one.where("page_id % 2 = 0").select("page_id", F.lit("wordpress").alias("name"))
    return versions.wordpress_leads(there.union(there), known)


@query(f"""with w as ({S.WINDOW}), l as ({S.LINKED}), live as (select page_id, max(case when key = 'React.version' then '18.2.0' end) as a, max(case when key = '__REACT_DEVTOOLS_GLOBAL_HOOK__' then '17.0.2' end) as b from w group by page_id having a is not null or b is not null),
cdn as (select page_id, arg_min(regexp_extract(src, 'react@([0-9.]+)/', 1), pos) as v from l where contains(src, 'unpkg.com/react@') group by page_id)
select coalesce(live.page_id, cdn.page_id) as page_id, 'React' as name, coalesce(b, a, v) as version, case when live.page_id is not null then 'runtime hook' else 'delivery network URL' end as detection_method from live full join cdn on live.page_id = cdn.page_id
union all select page_id, 'Next.js (Pages Router)', null, case when bool_or(contains(value, '"development"')) then 'page data, development build' else 'page data' end from w where key = '__NEXT_DATA__' group by page_id
union all select page_id, case when bool_or(contains(src, '/chunks/app/')) then 'Next.js (App Router)' else 'Next.js (Pages Router)' end, null, 'script folder' from l where contains(src, '/_next/static/chunks/') group by page_id""")
def framework_versions(spark, d):
    return versions.frameworks(sample(spark, d, S.WINDOW), sample(spark, d, S.LINKED))


@query(f"""with w as ({S.WINDOW}), e as (select page_id from pages where page_id % 3 = 0)
select distinct page_id, flag from (select page_id, unnest(case key when '__DEV__' then case when value = 'true' then ['window.__DEV__', '__DEV__=true'] else [] end when '__NEXT_DATA__' then case when contains(value, '"development"') then ['Next.js dev buildId'] else [] end when '__REACT_DEVTOOLS_GLOBAL_HOOK__' then ['react_dev_bundle'] else [] end) as flag from w
 union all select page_id, 'react-error-overlay' from e union all select page_id, 'angular_ng_version_attr' from e)""")
def debug_flags(spark, d):
    planted = F.when(F.expr("page_id % 3 = 0"), '<div id="react-error-overlay"></div><app ng-version="9"></app>').otherwise("")
    p = table(spark, d, "pages").select("page_id", F.concat(planted, F.coalesce("html", F.lit(""))).alias("html"))
    return captures.debug_flags(sample(spark, d, S.WINDOW), captures.elements(p))


@query(f"""with r as ({S.REMIX}) select page_id, unnest(['/', '/u' || (page_id % 5) || '/:id', '/u' || (page_id % 5) || '/:id/edit', '/x']) as path, unnest(['route', 'route', 'api', 'api']) as kind, 'remix:manifest' as source, unnest([false, true, true, false]) as dynamic from r""")
def remix_manifest_routes(spark, d):
    return manifests.remix_routes(sample(spark, d, S.REMIX))


@query(f"""with r as ({S.REMIX}), t as (select page_id from r where page_id % 4 = 1) select page_id, key from r where key = '__remixContext' or page_id in (select page_id from t)""")
def manifest_gate(spark, d):
    r = sample(spark, d, S.REMIX)
    names = r.where("page_id % 4 = 1").select("page_id", F.lit("Remix Run").alias("name"))
    return manifests.gated(r, names).select("page_id", "key")


@query(f"""with w as (select * from ({S.WINDOW}) union all select * from ({S.REMIX})) select distinct page_id, case key when '__NEXT_DATA__' then 'Next.js' when '__NUXT__' then 'Nuxt' else 'Remix' end as framework, case key when '__NEXT_DATA__' then 'next-data' when '__NUXT__' then 'nuxt-payload' else 'remix-manifest' end as manifest_type,
 regexp_extract(value, '"(?:buildId|version)":"([^"]*)"', 1) as build_id from w where key in ('__NEXT_DATA__', '__NUXT__', '__remixManifest', '__remixContext')
union all select distinct page_id, 'Vite/webpack', 'chunk-graph', null from ({S.CHUNKS}) c where (page_id, url) in (select page_id, url from ({S.CHUNKS}) where url like '%UserProfile%' or url like '%checkout.%')""")
def captured_manifests(spark, d):
    named = sample(spark, d, S.CHUNKS).where("url like '%UserProfile%' or url like '%checkout.%'")
    return manifests.captured(sample(spark, d, S.WINDOW).union(sample(spark, d, S.REMIX)), named)


@query(f"""with a as (select page_id, unnest(['/x', '/only']) as path, 'route' as kind, 'map' as source from ({S.REMIX}) where page_id % 2 = 0), b as (select page_id, unnest(['/', '/x']) as path, unnest(['route', 'api']) as kind, 'remix:manifest' as source from ({S.REMIX})), c as (select page_id, '/x' as path, 'route' as kind, 'chunk' as source from ({S.REMIX}))
select page_id, path, kind, arg_min(source, o) as source from (select *, 0 as o from a union all select *, 1 from b union all select *, 2 from c) group by page_id, path, kind""")
def merged_routes(spark, d):
    r = sample(spark, d, S.REMIX)
    of = lambda rows, source, *pairs: rows.select("page_id", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind")) for p, k in pairs]))).select("*", F.lit(source).alias("source"), F.lit(False).alias("dynamic"))
    maps = of(r.where("page_id % 2 = 0"), "map", ("/x", "route"), ("/only", "route"))
    return manifests.merged(maps, of(r, "remix:manifest", ("/", "route"), ("/x", "api")), of(r, "chunk", ("/x", "route"))).select("page_id", "path", "kind", "source")


# reports


_TABLE = "string_agg('| ' || domain || ' | ' || n || ' |', chr(10) order by domain)"


@query(f"""with c as (select *, regexp_extract(url, '//([^/]*)', 1) as h, 'h' || (page_id % 9) || '.example.com' as t, regexp_matches(url, '/api/|/graphql|/v1/|/v2/|/v3/') or url like '%.json' as api from ({S.OBSERVED})),
a as (select page_id, '- Requests: ' || count(*) || chr(10) || '- API-like: ' || count_if(regexp_matches(url, '/api/|/graphql|/v1/|/v2/|/v3/|\\.json')) || chr(10) || '- First party: ' || count_if(h = t) || chr(10) || '- Third party: ' || count_if(h <> t) as text from c group by page_id),
b as (select page_id, '| Domain | Requests |' || chr(10) || '| --- | --- |' || chr(10) || {_TABLE} as text from (select page_id, h as domain, count(*) as n from c where h <> t group by all) group by page_id),
m as (select *, bool_or(api) over (partition by page_id) as any_api from c), n as (select *, row_number() over (partition by page_id order by seq, url) as place from m where api or not any_api),
k as (select page_id, '| Method | Status | Content type | URL | Credentials |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || case when method = '' then 'GET' else method end || ' | ' || case when status = 0 then '-' else status::varchar end || ' | '
  || coalesce(response_content_type, case when lower(answered) = 'content-type' then 'm.js.map' end, '-') || ' | `' || replace(url, '|', '\\|') || '` | ' || case asked when 'Authorization' then 'AUTHORIZATION' when 'X-API-Key' then 'X API KEY' else '-' end || ' |', chr(10) order by place) as text from n where place <= 10 group by page_id)
select page_id, '## Network' || chr(10) || chr(10) || a.text || coalesce(chr(10) || chr(10) || b.text, '') || chr(10) || chr(10) || k.text || chr(10) as text from a left join b using (page_id) join k using (page_id)""")
def report_network(spark, d):
    return sections.network(_observed(spark, d), _home(spark, d))


@query(f"""with e as (select distinct page_id, url from ({S.ASSETS})), f as (select *, row_number() over (partition by page_id order by url) as nth, count(*) over (partition by page_id) as total from e)
select page_id, '## Inventory' || chr(10) || chr(10) || '### Endpoints' || chr(10) || chr(10) || string_agg('- `' || url || '`', chr(10) order by nth) || case when any_value(total) > 15 then chr(10) || '- ... and ' || (any_value(total) - 15) || ' more' else '' end || chr(10) as text from f where nth <= 15 group by page_id""")
def report_endpoints(spark, d):
    none = spark.createDataFrame([], "page_id long, path string, kind string")
    kept = spark.createDataFrame([], "page_id long, classification string, keys array<string>, value string, disposition string")
    return sections.inventory(sample(spark, d, S.ASSETS), none, kept)


@query(f"""with c as ({S.COOKIES}), w as (select page_id, name, case when secure then '' else 'missing Secure' end || case when not secure and not http_only then ', ' else '' end || case when http_only then '' else 'missing HttpOnly' end as issues from c where not secure or not http_only),
n as (select *, row_number() over (partition by page_id order by name, issues) as nth, count(*) over (partition by page_id) as total from w)
select page_id, '## Security posture' || chr(10) || chr(10) || '| Cookie | Issues |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || name || ' | ' || issues || ' |', chr(10) order by nth) || case when any_value(total) > 50 then chr(10) || '- ... and ' || (any_value(total) - 50) || ' more' else '' end || chr(10) as text from n where nth <= 50 group by page_id""")
def report_posture(spark, d):
    none = spark.createDataFrame([], "page_id long, header string")
    return sections.cookies(posture.weak_cookies(sample(spark, d, S.COOKIES)), none)


@query(f"""with s as ({_CASES}), h as (select page_id, label || ':2:1' as location, case k when 2 then 'none' when 3 then 'strict' else 'weak' end as origin_check from s where k in (2, 3, 5)),
f as (select page_id, location, source, sink from (select page_id, label || ':2:' || case k when 2 then 49 when 3 then 77 else 26 end as location, case k when 6 then 'location.search' else 'e.data' end as source, case k when 2 then 'eval(...)' when 3 then 'document.write(...)' else 'innerHTML' end as sink, label from s where k in (2, 3, 6)) where label like 'https://s.example.com/%'),
l as (select page_id, 1 as k, '- Flow: `' || source || '` to `' || sink || '` at `' || location || '`' as line, row_number() over (partition by page_id order by location, source, sink) as nth, count(*) over (partition by page_id) as total from f
 union all select page_id, 2, '- Message handler at `' || location || '`, origin check: ' || origin_check, row_number() over (partition by page_id order by location), count(*) over (partition by page_id) from h),
g as (select page_id, k, string_agg(line, chr(10) order by nth) || case when any_value(total) > 10 then chr(10) || '- ... and ' || (any_value(total) - 10) || ' more' else '' end as text from l where nth <= 10 group by page_id, k)
select page_id, '## Leads' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by k) || chr(10) as text from g group by page_id""")
def report_leads(spark, d):
    f = scratch.kept(_flow_facts(spark, d), "facts")  # read twice, parsed once
    none = spark.createDataFrame([], "page_id long, lead string")
    return sections.leads(none, findings.flow_confidence(javascript.flows(f), F.lit("s.example.com")), javascript.message_handlers(f))


@query(f"""with {C._SCORED}, c as (select page_id, count_if(disposition = 'finding' and severity = 'CRITICAL') as critical, count_if(disposition = 'finding' and severity = 'HIGH') as high, count_if(disposition = 'finding' and severity = 'MEDIUM') as medium, count_if(disposition = 'lead') as leads, count_if(disposition = 'inventory') as inventory from disp group by page_id),
l as (select page_id, list_filter([case when critical > 0 then 'Revoke and replace the critical credentials now.' end, case when high > 0 then 'Look into the findings of high severity first.' end, case when medium > 0 then 'Plan work on the findings of medium severity.' end, case when leads > 0 then 'Check the leads by hand; they are no findings yet.' end,
 case when inventory > 0 then 'Review what the inventory shows to everyone.' end, 'Scan again after each release.'], lambda x: x is not null) as said from c)
select page_id, '## Recommendations' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(said) + 1), lambda i: i || '. ' || said[i]), chr(10)) || chr(10) as text from l""")
def report_recommendations(spark, d):
    return sections.recommendations(findings.summary(findings.of_secrets(C._scored(spark, d))))


@query(f"""with w as (select distinct page_id, case key when '__NEXT_DATA__' then 'Next.js' else 'Nuxt' end as framework, case key when '__NEXT_DATA__' then 'next-data' else 'nuxt-payload' end as kind, regexp_extract(value, '"buildId":"([^"]*)"', 1) as build from ({S.WINDOW}) where key in ('__NEXT_DATA__', '__NUXT__')),
o as (select *, row_number() over (partition by page_id order by framework, kind) as nth from w)
select page_id, max(nth)::bigint as manifests, count_if(build <> '')::bigint as built from o group by page_id""")
def report_surface(spark, d):
    """The manifests' table of each page's client surface, counted in its lines."""
    found = manifests.captured(sample(spark, d, S.WINDOW))
    routes = manifests.routes(sample(spark, d, S.WINDOW))
    told = findings.route_confidence(routes.where("false"), F.lit("a.example.com"))
    none = spark.createDataFrame([], "page_id long, name string, version string")
    text = sections.surface(found, told, none)
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"^\| (?:Next|Nuxt)")))
    return text.select("page_id", F.size(lines).cast("long").alias("manifests"), F.size(F.filter(lines, lambda x: ~F.endswith(x, F.lit("| - |")))).cast("long").alias("built"))


#: Every table that a full report reads, by its page.
_CAPTURED = (S.SCRIPTS, S.FLOWS, S.ARTIFACTS, S.OBSERVED, S.CALLS, S.POLICIES, S.COOKIES, S.MAPS, C._GLOBALS, S.WINDOW, S.REMIX, S.LINKED, S.ASSETS, S.CHUNKS, S.PATHS, "select page_id from pages")


@query()
def report_full(spark, d):
    """Every section of every page that anything was captured of: its first rows in part 0, all others in further parts."""
    f = scratch.kept(C._facts(spark, d), "facts")  # of many sections, parsed once
    target = F.lit("s.example.com")
    flows, handlers = findings.flow_confidence(javascript.flows(f), target), findings.handler_confidence(javascript.message_handlers(f), target)
    gadgets = findings.gadget_confidence(javascript.gadgets(f, sample(spark, d, S.POLICIES)), target)
    stored = storage.assess(storage.classify(storage.gather(sample(spark, d, S.MAPS), sample(spark, d, S.COOKIES), sample(spark, d, S.CALLS).select("page_id", "seq", "url"), None), F.lit(1000)))
    stored = scratch.kept(findings.storage_confidence(stored), "storage")
    every = scratch.kept(findings.unify(findings.of_secrets(C._scored(spark, d, None)), findings.of_storage(stored), C._vulnerabilities(spark, d)), "findings")
    named = sample(spark, d, S.CHUNKS)
    mapped = sourcemaps.routes(sample(spark, d, S.PATHS)).select("page_id", "path", "kind", F.lit("sources.js.map").alias("source"), "dynamic")
    routes = manifests.merged(mapped, manifests.routes(sample(spark, d, C._GLOBALS), named), manifests.remix_routes(sample(spark, d, S.REMIX)))
    captured = manifests.captured(sample(spark, d, S.WINDOW).union(sample(spark, d, S.REMIX)), named)
    known = functools.reduce(DataFrame.union, (sample(spark, d, t).select(F.col("page_id").cast("long")) for t in _CAPTURED)).distinct()
    pages = known.select("page_id", F.concat(F.lit("https://s.example.com/"), F.col("page_id").cast("string")).alias("url"))
    wordpress = versions.wordpress(_observed(spark, d), _meta(spark, d), spark.createDataFrame([], "page_id long, pos long, src string")).select("page_id", F.coalesce("version", F.lit("unknown")).alias("lead"))
    return sections.report(
        pages,
        sections.technologies(versions.frameworks(sample(spark, d, S.WINDOW), sample(spark, d, S.LINKED)), True),
        sections.findings(findings.rank(every), True),
        sections.network(_observed(spark, d), _home(spark, d), True),
        sections.inventory(sample(spark, d, S.ASSETS), routes, stored, True),
        sections.leads(wordpress, flows, handlers, True),
        sections.dataflow(flows, gadgets, handlers, True),
        sections.surface(captured, findings.route_confidence(routes, target), sourcemaps.package_versions(sample(spark, d, S.PATHS)), True),
        sections.cookies(posture.weak_cookies(sample(spark, d, S.COOKIES)), posture.missing_on_document(C._calls(spark, d), _home(spark, d)), True),
        sections.recommendations(findings.summary(every)),
    )


# texts and scores


@query("""select p_partkey, case when length(p_name) > 9 then left(p_name, 9) || '...' else p_name end as clipped, case when length(p_name) > 12 then left(p_name, 5) || '...' || right(p_name, 4) else p_name end as middle from part""")
def text_clips(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", values.clip(F.col("p_name"), 9).alias("clipped"), values.clip_middle(F.col("p_name"), 12).alias("middle"))


@query("select distinct pattern, array_to_string(list_transform(string_split(pattern, '_'), lambda w: upper(left(w, 1)) || w[2:]), ' ') as title from (select unnest([{}]) as pattern)".format(", ".join(f"'{n}'" for n in S.FORMS)))
def pattern_titles(spark, d):
    return spark.createDataFrame([(n,) for n in S.FORMS], "pattern string").select("pattern", values.title(F.col("pattern")).alias("title"))


@query("""select p_partkey, case p_partkey % 8 when 0 then '6.' || (p_partkey % 10) when 2 then '6.1.2' when 5 then '5.9' when 6 then '4.' || (p_partkey % 7) || '.1' end as version from part""")
def generator_versions(spark, d):
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    said = F.when(k % 8 == 0, F.concat(F.lit("WordPress 6."), n(10))).when(k % 8 == 1, "WordPress 6.9-beta1").when(k % 8 == 2, "powered by wordpress  6.1.2 today").when(k % 8 == 3, "Hugo 0.1").when(k % 8 == 4, "WordPress").when(k % 8 == 5, "https://wordpress.org/?a=1&v=5.9").when(k % 8 == 6, F.concat(F.lit("https://wordpress.org/?v=4."), n(7), F.lit(".1"))).otherwise("https://wordpress.org/?v=x")
    return table(spark, d, "part").select("p_partkey", technologies.generator_version(said).alias("version"))


_SOURCES = "select p_partkey, case p_partkey % 4 when 0 then 'https://s.example.com/a.js.map' when 1 then '__NUXT__' when 2 then 'https://other.net/x.js' else 'chunk-graph' end as source from part"


@query(f"""with r as ({_SOURCES}), s as (select p_partkey, 40 + case p_partkey % 4 when 0 then 12 + 8 when 1 then 20 + 8 + 22 when 2 then -12 else 8 end as v from r) select p_partkey, least(100, greatest(0, v))::int as score, case when v >= 75 then 'high' when v >= 40 then 'medium' else 'low' end as level from s""")
def route_scores(spark, d):
    rows = findings.route_confidence(sample(spark, d, _SOURCES), F.lit("example.com"))
    return rows.select("p_partkey", "confidence.score", "confidence.level")


@query(f"""with {C._SCORED}, p as (select distinct page_id from disp), n as (select page_id, count(*)::bigint as secrets from disp group by page_id)
select page_id, 'https://p' || page_id || '.example.org/' as url, secrets, 0::bigint as vulnerabilities, case when page_id % 5 = 0 then 'timeout while the page was still loading its many parts from elsewhere'[1:60] || '...' when page_id % 5 = 1 then 'refused' else 'ok' end as status from p join n using (page_id)""")
def batch_summary(spark, d):
    rows = findings.of_secrets(C._scored(spark, d))
    pages = rows.select("page_id").distinct().select("page_id", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example.org/")).alias("url"))
    k = F.col("page_id") % 5
    errors = pages.select("page_id", F.when(k == 0, "timeout while the page was still loading its many parts from elsewhere").when(k == 1, "refused").alias("error")).where("error is not null")
    return sinks.batch_summary(pages, rows, errors)


@query(f"""with t as ({S.TOKENS}), p as (select page_id, c_custkey from (select page_id, page_id as c_custkey, value from t) where value like 'eyJ%')
select page_id, case c_custkey % 6 when 0 then 'expires 9999999999; roles service_role' when 1 then 'issuer supabase; roles anon' when 2 then 'expires 100 (over); scopes read, write' else 'roles admin, user' end as claims from p""")
def claims_prose(spark, d):
    t = sample(spark, d, S.TOKENS).select("page_id", storage.claims(F.col("value"), F.lit(1000)).alias("c")).where("c is not null")
    return t.select("page_id", advice.claims_text(F.col("c")).alias("claims"))


@query(f"""with {C._SCORED}, g as (select page_id, pattern, seq, list_sort(list(value)) as ms from firsts group by page_id, pattern, seq)
select page_id, pattern, seq, case when strlen(ms[1]) <= 12 then repeat('*', length(ms[1])) else left(ms[1], 4) || repeat('*', least(strlen(ms[1]) - 8, 20)::int) || '...' || right(ms[1], 4) end || case when len(ms) > 1 then ' (+' || (len(ms) - 1) || ' more)' else '' end as shown,
 case pattern {" ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in advice.SECRET.items())} else '{advice.SECRET_OTHER}' end as advice from g""")
def secret_rows(spark, d):
    rows = C._scored(spark, d)
    return rows.select("page_id", "pattern", "seq", advice.shown(F.col("matches")).alias("shown"), advice.secret_advice(F.col("pattern")).alias("advice"))


_CLASSES = ", ".join(f"('{k}', '{v[0].replace(chr(39), chr(39) * 2)}', '{v[1].replace(chr(39), chr(39) * 2)}')" for k, v in advice.STORAGE.items())


@query(f"""with t as (select * from (values {_CLASSES}) t(classification, context, advice)) select p_partkey, context, advice from part join t on classification = case p_partkey % 6 {" ".join(f"when {i} then '{k}'" for i, k in enumerate(advice.STORAGE))} end""")
def storage_prose(spark, d):
    names = F.element_at(F.array(*[F.lit(k) for k in advice.STORAGE]), (F.col("p_partkey") % 6 + 1).cast("int"))
    none = F.lit(None).cast("struct<issuer:string,audience:array<string>,expires_at:bigint,expired:boolean,roles:array<string>,scopes:array<string>,tenants:array<string>,accounts:array<string>>")
    return table(spark, d, "part").select("p_partkey", advice.storage_context(names, none).alias("context"), advice.storage_advice(names).alias("advice"))


@query(f"""with {C._SCORED}, n as (select page_id, count(*) as n from disp group by page_id) select page_id, 'p' || page_id || '-example-org' as folder, '0.5' as version, least(n, 3)::bigint as kept, case when n > 3 then n::varchar else '-' end as whole from n""")
def json_report_sizes(spark, d):
    """JSON documents of a page's secrets, at most three in each."""
    rows = scratch.kept(findings.of_secrets(C._scored(spark, d)), "findings")  # read twice, scanned once
    pages = rows.select("page_id").distinct().select("page_id", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example.org/")).alias("url"))
    made = sinks.json_documents(pages, limit=3, findings=rows)
    json = F.col("json")
    return made.select("page_id", "folder", F.get_json_object(json, "$.schema_version").alias("version"), F.json_array_length(F.get_json_object(json, "$.findings")).cast("long").alias("kept"), F.coalesce(F.get_json_object(json, "$.cut.findings"), F.lit("-")).alias("whole"))
