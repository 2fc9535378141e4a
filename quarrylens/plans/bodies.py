"""Queries over external scripts and what runs with them: bodies by scope, flows seen at run time, routes so far."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import bodies, javascript, manifests
from ..sources import captures, scratch
from .catalog import HOST, query, table
from .samples import sample

#: Pages with external scripts behind what they hold: one of their own behind dot segments, one elsewhere, one of a subdomain that nobody keeps, one that isn't http.
LINKED = f"""select page_id, url, concat(coalesce(html, ''), '<script src="/lib/./x/../', cast(page_id as string), '.js#top"></script><script src="https://other.net/', cast(page_id as string), '.js"></script><script src="//sub.', {HOST}, '/y.js?v=', cast(page_id as string), '"></script><script src=" data:text/javascript,1"></script>') as html from pages"""
#: Bodies: of each page's own script, where there is such a document, and of one elsewhere for every document.
BODIES = f"""select concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/lib/', cast(page_id as string), '.js') as url, concat('// ', cast(page_id as string), chr(10), text) as body from pages join documents on page_id = doc_id where url like 'http%'
 union all select concat('https://other.net/', cast(doc_id as string), '.js') as url, text as body from documents"""


@query(f"""with p as (select page_id, url, {HOST} as host, regexp_extract(url, '^(https?://[^/?#]*)', 1) as site, regexp_extract(url, '^(https?):', 1) as scheme from pages), b as ({BODIES}),
s as (select page_id, '/lib/./x/../' || page_id || '.js#top' as src, site || '/lib/' || page_id || '.js' as url, 'asked' as outcome from p union all select page_id, 'https://other.net/' || page_id || '.js', 'https://other.net/' || page_id || '.js', 'out of scope' from p
 union all select page_id, '//sub.' || host || '/y.js?v=' || page_id, scheme || '://sub.' || host || '/y.js?v=' || page_id, 'asked' from p union all select page_id, ' data:text/javascript,1', null, 'unresolvable' from p)
select page_id, src, s.url, case when outcome = 'asked' and body is null then 'no body' when outcome = 'asked' then 'read' else outcome end as outcome, case when outcome = 'asked' then md5(body) end as digest from s left join b on s.url = b.url and outcome = 'asked'""")
def external_scripts(spark, d):
    kept = scratch.fresh(spark, "bodies")
    sample(spark, d, BODIES).write.parquet(kept)
    pages = sample(spark, d, LINKED, True)
    found = bodies.external(captures.scripts(captures.elements(pages)).where("src is not null"), pages, kept)
    return found.select("page_id", "src", "url", "outcome", F.md5("body").alias("digest"))


@query(f"""with p as (select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) as site, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages where url like 'http%')
select page_id, unnest(['/abs', '../up', './a/./b/../c', '?q=1', '#f', '//h.example/x/../y', 'g;x=1/../y', 'mailto:a', '']) as ref, unnest([site || '/abs', site || regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') || '/up', site || regexp_replace(path, '/[^/]*$', '') || '/a/c', site || path || '?q=1',
 site || path || regexp_extract(url, '(\\?[^#]*)', 1) || '#f', regexp_extract(site, '^([a-z]+:)', 1) || '//h.example/y', site || regexp_replace(path, '/[^/]*$', '') || '/y', 'mailto:a', regexp_extract(url, '^([^#]*)', 1)]) as resolved from p join pages using (page_id)""")
def resolved_references(spark, d):
    """Nine kinds of references against every page's own URL."""
    refs = ("/abs", "../up", "./a/./b/../c", "?q=1", "#f", "//h.example/x/../y", "g;x=1/../y", "mailto:a", "")
    p = table(spark, d, "pages").where("url like 'http%'").select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in refs])).alias("ref"))
    return p.select("page_id", "ref", urls.resolved(F.col("url"), F.col("ref")).alias("resolved"))


#: Flows, and what pages hold while they run: hits by source, by sink, of another case, too short, far inside of a long value.
SEEN_FLOWS = """select p_partkey % 150 as page_id, p_partkey as seq, case p_partkey % 4 when 0 then 'location.hash' when 1 then 'document.cookie' when 2 then 'window.name' else 'q' end as source,
 case p_partkey % 5 when 0 then 'innerHTML' when 1 then 'eval(...)' when 2 then 'document.write(...)' when 3 then 'location.href' else 'setTimeout(string)' end as sink, concat('f', cast(p_partkey as string), '.js:1:1') as location, cast(array() as array<string>) as path from part"""
SEEN_VALUES = """select case when o_orderkey % 3 = 0 then 7 else o_custkey % 150 end as page_id, case o_orderkey % 9 when 0 then concat('payload via location.hash seen ', cast(o_orderkey as string)) when 1 then 'LOCATION.HASH' when 2 then ' q ' when 3 then concat(repeat('x', cast(o_orderkey % 9000 as int)), 'window.name', repeat('y', 50)) when 4 then 'docu' when 5 then '  ' when 6 then concat('set innerHTML or eval(.', cast(o_orderkey as string)) when 7 then '' else md5(cast(o_orderkey as string)) end as value from orders"""


@query(f"""with f as ({SEEN_FLOWS.replace("cast(array() as array<string>) as path", "1 as none")}), v as (select distinct page_id, value from ({SEEN_VALUES}) where strlen(trim(value)) >= 3)
select page_id, seq, source, sink, location, exists (select 1 from v where v.page_id = f.page_id and (contains(v.value, f.source) or contains(v.value, f.sink))) as runtime_observed from f""")
def flows_observed(spark, d):
    f = sample(spark, d, SEEN_FLOWS)
    return javascript.mark_observed(f, sample(spark, d, SEEN_VALUES)).drop("path")


#: Five globals of each page, whose frameworks name routes one after the other.
SO_FAR = """select cast(floor(p_partkey / 5) as bigint) as page_id, case p_partkey % 5 when 0 then '__NEXT_DATA__' when 1 then '__SSG_MANIFEST' when 2 then '__NUXT__' when 3 then '__sveltekit_data' else '__BUILD_MANIFEST' end as key,
 case p_partkey % 5 when 0 then concat('{"buildId":"b","page":"', case when p_partkey % 35 = 0 then '/_app' else concat('/p', cast(p_partkey % 8 as string)) end, '"}') when 1 then concat('["/s', cast(p_partkey % 6 as string), '","x","/t","/s', cast(p_partkey % 6 as string), '"]')
  when 2 then concat('{"path":"/n/', cast(p_partkey % 3 as string), '","data":{"/api/d":1,"k":2,"/n/', cast(p_partkey % 4 as string), '":3}}') when 3 then '{"route":{"id":"/(app)/dash/[slug]"}}' else concat('{"/b', cast(p_partkey % 7 as string), '":["x.js"],"/_error":[],"sortedPages":["/c","/_app"]}') end as value from part"""


@query(f"""with g as ({SO_FAR}) select page_id, 'Next.js' as framework, 'next-data' as manifest_type, 0 as place, json_extract_string(value, '$.page') as path from g where key = '__NEXT_DATA__' and value not like '%/_app%'
 union all select page_id, 'Next.js', 'ssg-manifest', unnest([0, 1, 2]), unnest(['/s' || regexp_extract(value, '/s([0-9])', 1), '/t', '/s' || regexp_extract(value, '/s([0-9])', 1)]) from g where key = '__SSG_MANIFEST'
 union all select page_id, 'Nuxt', 'nuxt-payload', unnest([0, 1, 2]), unnest(['/n/' || regexp_extract(value, '"path":"/n/([0-9])', 1), '/api/d', '/n/' || regexp_extract(value, ',"/n/([0-9])', 1)]) from g where key = '__NUXT__'
 union all select page_id, 'SvelteKit', 'sveltekit-start', 0, '/dash/[slug]' from g where key = '__sveltekit_data'
 union all select page_id, 'Next.js', 'build-manifest', unnest([0, 1]), unnest(['/b' || regexp_extract(value, '/b([0-9])', 1), '/c']) from g where key = '__BUILD_MANIFEST'""")
def manifest_listed_routes(spark, d):
    return manifests.listed(sample(spark, d, SO_FAR)).withColumn("place", F.col("place").cast("int"))
