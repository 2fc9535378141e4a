"""Queries in SQL text over the table functions, and over patterns and signatures that tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..functions.patterns import of_table
from ..operators import secrets, technologies
from . import samples as S
from .catalog import _FOUND, ORACLES, query
from .samples import sample


def _sql(spark, d, text: str, dealt: bool = False, **views: str):
    """The SQL text's result, with its views made of the driver's tables."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name, made in views.items():
        sample(own, d, made, dealt).createOrReplaceTempView(name)
    tables.register(own)
    return own, own.sql(text)


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages")
def sql_elements(spark, d):
    """Every link of every page, by a lateral join."""
    return _sql(spark, d, "select p.page_id, e.attrs['href'] as href from p, lateral elements(p.html, 'a') e", True, p="select page_id, html from pages")[1]


@query(ORACLES["json_leaves"])
def sql_leaves(spark, d):
    return _sql(spark, d, "select e.event_id, l.path, l.value from e, lateral leaves(e.props) l", e="select event_id, props from events")[1]


@query(f"with art as ({S.ARTIFACTS}), {_FOUND} select page_id, seq, pattern, value from found union all select page_id, seq, 'nothing', unnest(regexp_extract_all(text, 'nothing [0-9a-f]{{4}}')) from art")
def sql_secrets(spark, d):
    """The built-in patterns and one that the session adds, over every artifact, in SQL text."""
    own, _ = _sql(spark, d, "select 1", True, art=S.ARTIFACTS)
    tables.register_pattern(own, "nothing", "nothing [0-9a-f]{4}")
    return own.sql("select a.page_id, a.seq, s.pattern, s.value from art a, lateral secrets(a.text) s")


#: Texts that name nations, and patterns of a table: one for each nation, one that doesn't compile, one that is too long.
NOTES = """select c_custkey as page_id, c_custkey as seq, 'HTML' as label, concat(c_name, ' ships to ', case when c_custkey % 2 = 0 then lower(n_name) else n_name end, '-', cast(c_custkey % 10000 as string), '; ', n_name, '-x') as text from customer join nation on c_nationkey = n_nationkey"""
PATTERNS = """select concat('nation_', lower(n_name)) as name, concat('(?i)', n_name, '-[0-9]+') as regex from nation union all select 'broken', '([' union all select 'long', repeat('x', 501) union all select 'Cust', 'Customer#[0-9]+(?= ships)'"""


@query(f"""with n as ({NOTES}) select page_id, 'nation_' || lower(regexp_extract(text, '; (.*)-x$', 1)) as pattern, regexp_extract(text, 'to (.*?);', 1) as value from n union all select page_id, 'Cust', regexp_extract(text, '^(\\S+) ships', 1) from n""")
def table_pattern_scan(spark, d):
    """Patterns out of a table: their needles are read out of their regexes."""
    found = secrets.scan(sample(spark, d, NOTES), of_table(sample(spark, d, PATTERNS)))
    return found.select("page_id", "pattern", F.explode("matches").alias("value"))


_GENERATORS = list(technologies.GENERATOR)
#: Generator tags of every kind in turn, in either case, and one that no signature knows.
TAGS = f"""select p_partkey, concat(case when p_partkey % 2 = 0 then 'X ' else '' end, {"case " + " ".join(f"when p_partkey % {len(_GENERATORS) + 1} = {k} then '{g.upper() if k % 3 == 0 else g}'" for k, g in enumerate(_GENERATORS)) + " else 'Selfmade' end"}, ' ', cast(p_partkey % 9 as string), '.1') as content from part"""


@query(f"""with t as ({TAGS}), s as (select unnest([{", ".join(f"'{k}'" for k in _GENERATORS)}]) as part, unnest([{", ".join(f"'{v}'" for v in technologies.GENERATOR.values())}]) as name) select distinct p_partkey, name from t join s on contains(lower(content), part)""")
def generator_signatures(spark, d):
    return sample(spark, d, TAGS).select("p_partkey", F.explode(technologies.signatures(F.col("content"), technologies.GENERATOR)).alias("name"))


_GLOBALS = list(technologies.GLOBALS)
#: Globals of every kind in turn, and some that no signature knows.
KEYS = f"""select c_custkey as page_id, case c_custkey % {len(_GLOBALS) + 2} {" ".join(f"when {k} then '{g}'" for k, g in enumerate(_GLOBALS))} when {len(_GLOBALS)} then 'Ng' else 'other' end as key from customer"""


@query(f"""with g as ({KEYS}), s as (select unnest([{", ".join(f"'{k}'" for k in _GLOBALS)}]) as key, unnest([{", ".join(f"'{v}'" for v in technologies.GLOBALS.values())}]) as name) select page_id, key, name from g join s using (key)""")
def global_signatures(spark, d):
    g = sample(spark, d, KEYS)
    return g.select("page_id", "key", technologies.from_global(F.col("key")).alias("name")).where("name is not null")
