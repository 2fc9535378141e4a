"""API endpoints in scripts: calls with a literal URL, their method and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns whose first group is a URL, in order; ones that yield no URL are left out.
CALLS = (
    r"""fetch\s*\(\s*[`'"]([^`'"]+)[`'"]""",
    r"""fetch\s*\(\s*`([^`]+)`""",
    r"""axios\s*\(\s*\{\s*url\s*:\s*[`'"]([^`'"]+)[`'"]""",
    r"""\$\.ajax\s*\(\s*\{\s*url\s*:\s*[`'"]([^`'"]+)[`'"]""",
)
PARAMETERS = (r"\{(\w+)\}", r"\$\{(\w+)\}", r":(\w+)")


def method_of(match: Column) -> Column:
    """By words in the whole match, the first that is there."""
    low = F.lower(match)
    out = F.lit("GET")
    for m in ("patch", "delete", "put", "post"):
        out = F.when(F.contains(low, F.lit(m)), m.upper()).otherwise(out)
    return out


def parameters_of(url: Column) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(url, F.lit(p), F.lit(1)) for p in PARAMETERS]))


def endpoints(scripts: DataFrame) -> DataFrame:
    """(page_id, seq, label, url, method, parameters) of every URL, by the first pattern and place in its script."""
    found = []
    for k, p in enumerate(CALLS):
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("match"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("url"))
        found.append(F.transform(pairs, _numbered(k)))
    each = scripts.select("page_id", "seq", "label", F.explode(F.concat(*found)).alias("e"))
    each = each.where((F.octet_length("e.url") >= 4) & F.rlike("e.url", F.lit("^(?:/|http)")))
    first = each.groupBy("page_id", "seq", "label", F.col("e.url").alias("url")).agg(F.min(F.struct("e.k", "e.i", "e.match")).alias("first"))
    return first.select("page_id", "seq", "label", "url", method_of(F.col("first.match")).alias("method"), parameters_of(F.col("url")).alias("parameters"))


def _numbered(k: int):
    return lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["url"].alias("url"), x["match"].alias("match"))
