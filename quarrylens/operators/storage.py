"""Browser storage, cookies, URL parameters and globals: classification of what they keep, claims of tokens."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls, values

#: Terms of keys by what they name, on keys in normal form.
REFRESH = ("refresh_token", "refreshtoken", "refresh_jwt")
ACCESS = ("access_token", "accesstoken", "auth_token", "authtoken", "bearer_token", "id_token", "idtoken", "jwt")
ACCESS_EXACT = ("token", "authorization", "bearer")
SESSION = ("session", "sessid")
SESSION_EXACT = ("sid", "auth", "authentication")
PUBLIC = ("public_config", "publicconfig", "publishable", "anon_key", "anonkey", "client_id", "clientid", "api_url", "apiurl", "base_url", "baseurl", "endpoint")
PRIVILEGED = ("admin", "administrator", "root", "superuser", "owner", "maintainer", "service", "write")
#: Payload keys of claims.
ROLES, SCOPES, TENANTS, ACCOUNTS = ("role", "roles", "groups"), ("scope", "scp", "permissions"), ("tenant", "tenant_id", "tid", "organization_id", "org_id"), ("account", "account_id")
GROUPS, DEPTH = 128, 6  # cuts of queries whose contracts have them


def refresh_key(key: Column) -> Column:
    return urls.any_of(values.normal_key(key), REFRESH)


def access_key(key: Column) -> Column:
    k = values.normal_key(key)
    return urls.any_of(k, ACCESS) | k.isin(*ACCESS_EXACT)


def session_key(key: Column) -> Column:
    k = values.normal_key(key)
    return urls.any_of(k, SESSION) | k.isin(*SESSION_EXACT)


def sensitive_key(key: Column) -> Column:
    return refresh_key(key) | access_key(key) | session_key(key)


def public_key(key: Column) -> Column:
    return urls.any_of(values.normal_key(key), PUBLIC)


def privileged_term(term: Column) -> Column:
    t = values.normal_key(term)
    return F.arrays_overlap(F.split(t, "_"), F.array(*[F.lit(p) for p in PRIVILEGED])) | F.contains(t, F.lit("service_role")) | F.contains(t, F.lit("full_access"))


def credential_like(value: Column) -> Column:
    """At least 16 bytes, no white space, six distinct characters, not a URL."""
    v = F.trim(value)
    return (F.octet_length(v) >= 16) & ~F.rlike(v, F.lit(r"\s")) & (F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))) >= 6) & ~F.rlike(v, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))


def _texts(payload: Column, path: str, words: bool = False) -> Column:
    """A string, or a list of strings, at a path as a list; strings split at white space where asked."""

    def of(raw: Column) -> Column:
        none = F.array().cast("array<string>")
        one = F.filter(F.split(F.trim(raw), r"\s+"), lambda w: w != "") if words else F.array(raw)
        return F.when(raw.isNull() | F.startswith(raw, F.lit("{")), none).when(F.startswith(raw, F.lit("[")), F.coalesce(F.array_compact(F.from_json(raw, "array<string>")), none)).otherwise(one)

    return values.let(F.get_json_object(payload, path), of)


def claims(value: Column, now: Column) -> Column:
    """The claims of a signed token (perhaps behind ``Bearer``), or null if it isn't one."""
    token = F.regexp_replace(F.trim(value), r"^(?i:bearer)\s+", "")

    def of(p: Column) -> Column:
        some = lambda keys, words=False: F.flatten(F.array(*[_texts(p, f"$.{k}", words) for k in keys]))
        exp = F.get_json_object(p, "$.exp").try_cast("bigint")
        roles = F.concat(some(ROLES), _texts(p, "$.realm_access.roles"), _texts(p, "$.app_metadata.role"), _texts(p, "$.app_metadata.roles"))
        made = F.struct(
            F.get_json_object(p, "$.iss").alias("issuer"), _texts(p, "$.aud").alias("audience"), exp.alias("expires_at"), (exp <= now).alias("expired"),
            F.array_sort(F.array_distinct(roles)).alias("roles"), F.array_sort(F.array_distinct(some(SCOPES, True))).alias("scopes"), some(TENANTS).alias("tenants"), some(ACCOUNTS).alias("accounts"),
        )
        return F.when(F.startswith(F.trim(p), F.lit("{")) & F.get_json_object(p, "$").isNotNull(), made)

    return F.when(values.jwt_shaped(token), values.let(values.jwt_payload(token), of))


def classify(candidates: DataFrame, now: Column) -> DataFrame:
    """``candidates`` (page_id, seq, key, value, source, container) with claims, class, severity, disposition; the rest go."""
    rows = candidates.withColumn("claims", claims(F.col("value"), now)).withColumn("leaf", values.leaf_key(F.col("key")))
    leaf = F.col("leaf")
    c = F.col("claims")
    anon = F.exists(c["roles"], lambda r: values.normal_key(r).isin("anon", "anonymous", "public"))
    strong = F.exists(c["roles"], privileged_term) | F.exists(c["scopes"], privileged_term)
    weak = F.col("container") | ~credential_like(F.col("value"))
    verdict = lambda a, b, d: F.struct(F.lit(a).alias("classification"), F.lit(b).alias("severity"), F.lit(d).alias("disposition"))
    kind = F.when(refresh_key(leaf), "refresh_token").when(access_key(leaf), "access_token").when(session_key(leaf), "persisted_session")
    public, unclear = verdict("public_configuration", "info", "inventory"), verdict("ambiguous_sensitive_name", "low", "lead")
    out = F.when(c.isNotNull(), F.when(F.coalesce(c["expired"], F.lit(False)) | public_key(leaf) | anon, public).when(strong, verdict("privileged_jwt", "high", "finding")).otherwise(verdict("access_token", "high", "finding")))
    out = out.when(public_key(leaf) & ~sensitive_key(leaf), public).when(values.jwt_shaped(F.col("value")) & sensitive_key(leaf), unclear)
    out = out.when(kind.isNotNull() & weak, unclear)
    out = out.when(kind.isNotNull(), F.struct(kind.alias("classification"), F.when(kind == "persisted_session", "medium").otherwise("high").alias("severity"), F.lit("finding").alias("disposition")))
    # behind a generator, so that the filter isn't pushed down with a copy of the claims for each mention
    made = rows.select(*candidates.columns, "claims", F.explode(F.array(out)).alias("v")).where("v is not null")
    return made.select(*candidates.columns, "claims", "v.classification", "v.severity", "v.disposition")


def assess(classified: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each page, class and value: keys, sources, the first candidate's verdict; all groups of a page, or its first ``limit``."""
    first = F.min_by(F.struct("severity", "disposition", "claims"), "seq").alias("first")
    made = classified.groupBy("page_id", "classification", "value").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("seq").alias("seq"), first)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("page_id").orderBy("seq", "value"))
        made = made.withColumn("place", place).where(F.col("place") <= limit)
    return made.select("page_id", "classification", "value", "keys", "sources", "seq", "first.severity", "first.disposition", "first.claims")


def url_candidates(calls: DataFrame) -> DataFrame:
    """(page_id, key, value, source) of query parameters whose key is sensitive or whose value is a signed token."""
    each = calls.select("page_id", F.explode(urls.query_pairs(F.col("url"))).alias("p"))
    return each.where(sensitive_key(F.col("p.key")) | values.jwt_payload(F.col("p.value")).isNotNull()).select("page_id", "p.key", "p.value", F.lit("network").alias("source"))


_LEAF = "array<struct<path:string,value:string>>"
_LEAVES = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def _no_number(name: str) -> str:
    raise ValueError(f"{name} isn't JSON")


def _walk(text: str | None, root: str, depth: int | None) -> list[dict] | None:
    """Scalars of a JSON object or list, in order, with their paths and numbers as written; null if the text is neither."""
    try:
        value = json.loads(text or "", parse_int=str, parse_float=str, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict | list):
        return None
    out, stack = [], [(root, value, 0)]
    while stack:
        path, v, level = stack.pop()
        if v is None or depth is not None and level > depth:
            continue
        if isinstance(v, dict):
            stack += [(f"{path}.{k}" if path else k, x, level + 1) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[{i}]", x, level + 1) for i, x in reversed(list(enumerate(v)))]
        else:
            out.append({"path": path, "value": str(v).lower() if isinstance(v, bool) else v})
    return out


def leaves_of(text: Column, root: Column, depth: int | None = DEPTH) -> Column:
    """The scalars of a JSON object or list, each once, in one walk; null where the text is neither.  Nulls are left out."""

    @F.arrow_udf(_LEAF)
    def of(texts: pa.Array, roots: pa.Array) -> pa.Array:
        return pa.array([_walk(t, r or "", depth) for t, r in zip(texts.to_pylist(), roots.to_pylist())], _LEAVES)

    return of(text, root)


def json_leaves(rows: DataFrame, json: str = "json", depth: int = DEPTH) -> DataFrame:
    """(all columns of ``rows`` but ``json``), path and value of every scalar down to ``depth``; nulls are left out.  One scan, one step."""
    keep = [c for c in rows.columns if c != json]
    return rows.select(*keep, F.inline(leaves_of(F.col(json), F.lit(""), depth)))


#: Where candidates come from, in order.
AREAS = {"local": "localStorage", "session": "sessionStorage", "runtime": "runtime state"}


def gather(maps: DataFrame, cookies: DataFrame, calls: DataFrame, depth: int | None = DEPTH - 1) -> DataFrame:
    """Candidates of a page from storage, globals, cookies and URLs: page_id, seq, key, value, source, container, location.

    ``maps``: page_id, area (local, session, runtime), key, value; ``cookies``: page_id, name, value; ``calls``: page_id, seq, url.
    Values that are JSON objects or lists are taken apart, down to ``depth`` if one is given; of their scalars those stay that have a telling key or a
    token's shape.  If none does and the whole has a sensitive key, the whole is a candidate, as a container.
    """
    telling = lambda k, v: sensitive_key(values.leaf_key(k)) | public_key(values.leaf_key(k)) | values.jwt_shaped(v)
    made = maps.withColumn("leaves", leaves_of(F.col("value"), F.col("key"), depth))
    bare = F.coalesce(F.from_json(F.when(F.startswith("value", F.lit('"')), F.concat(F.lit('{"v":'), "value", F.lit("}"))), "v string")["v"], F.col("value"))
    own = F.coalesce("leaves", F.array(F.struct(F.col("key").alias("path"), bare.alias("value"))))
    made = made.withColumn("some", F.filter(own, lambda x: telling(x["path"], x["value"])))
    item = lambda x: F.struct(x["path"].alias("key"), x["value"].alias("value"), F.lit(False).alias("container"))
    whole = F.when(F.col("leaves").isNotNull() & sensitive_key(F.col("key")), F.array(F.struct("key", "value", F.lit(True).alias("container")))).otherwise(F.array())
    each = made.select("page_id", "area", F.posexplode(F.when(F.size("some") > 0, F.transform("some", item)).otherwise(whole)).alias("pos", "c")).select("page_id", "area", "pos", "c.*")
    area = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])[F.col("area")]
    order = F.when(F.col("area") == "local", 0).when(F.col("area") == "session", 1).otherwise(2)
    place = lambda label: F.concat(label, F.lit(" `"), "key", F.lit("`"))
    out = each.select("page_id", order.alias("k"), "pos", "key", "value", F.lit("runtime").alias("source"), "container", place(area).alias("location"))
    jar = cookies.select("page_id", F.lit(3).alias("k"), F.lit(0).alias("pos"), F.col("name").alias("key"), "value", F.lit("runtime").alias("source"), F.lit(False).alias("container"))
    jar = jar.where(sensitive_key(F.col("key")) | public_key(F.col("key")) | values.jwt_shaped(F.col("value"))).withColumn("location", place(F.lit("Cookie")))
    asked = url_candidates(calls).select("page_id", F.lit(4).alias("k"), F.lit(0).alias("pos"), "key", "value", "source", F.lit(False).alias("container")).withColumn("location", place(F.lit("URL parameter")))
    rows = out.unionByName(jar).unionByName(asked)
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("k", "key", "pos", "value"))
    return rows.select("page_id", seq.cast("long").alias("seq"), "key", "value", "source", "container", "location")
