"""Prose for findings: what a class or pattern means, and what to do about it, as look-ups over literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values

#: What a class of stored value means, and what to do.
STORAGE = {
    "refresh_token": ("A refresh token lies where scripts can read it.", "Keep refresh tokens in cookies that scripts can't read, and rotate them."),
    "access_token": ("An access token lies where scripts can read it.", "Shorten its life and keep it in memory or in a guarded cookie."),
    "persisted_session": ("A session identifier outlives the page in storage.", "Bind sessions to guarded cookies and end them on the server."),
    "privileged_jwt": ("A signed token with elevated rights lies where scripts can read it.", "Take elevated rights out of tokens that reach the browser."),
    "public_configuration": ("The value is meant to be public.", "Make sure that it grants no more than it should."),
    "ambiguous_sensitive_name": ("The name suggests a credential, the value doesn't.", "Find out by hand what the value is for."),
}
OTHER = ("The value may be sensitive.", "Find out by hand what the value is for.")
#: What to do about a pattern's kind of secret, by the pattern's name.
SECRET = {
    "private_key": "Replace the key pair and remove the private key from what is served.",
    "supabase_service_role": "Replace the service key; it ignores row rules.",
    "supabase_anon_jwt": "Check the row rules that this public key depends on.",
    "stripe_publishable_key": "Nothing to do: the key is public by design.",
    "stripe_secret_key": "Revoke the key and move the calls to a server.",
    "source_map_url": "Don't publish source maps, or only what they may show.",
    "internal_ip": "Don't let internal addresses reach the browser.",
}
SECRET_OTHER = "Revoke the credential, replace it, and keep it on a server."


def _pick(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))


def storage_context(classification: Column, claims: Column) -> Column:
    """What a class means, and the claims of a token."""
    said = _pick({k: v[0] for k, v in STORAGE.items()}, classification, OTHER[0])
    told = claims_text(claims)
    return F.when(told != "", F.concat(said, F.lit(" Claims: "), told)).otherwise(said)


def storage_advice(classification: Column) -> Column:
    return _pick({k: v[1] for k, v in STORAGE.items()}, classification, OTHER[1])


def claims_text(claims: Column) -> Column:
    """A token's claims as ``; ``-joined prose, those that are empty left out."""
    many = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label} "), F.array_join(c, ", ")))
    expiry = F.when(claims["expires_at"].isNotNull(), F.concat(F.lit("expires "), claims["expires_at"].cast("string"), F.when(claims["expired"], " (over)").otherwise("")))
    issuer = F.when(claims["issuer"].isNotNull(), F.concat(F.lit("issuer "), claims["issuer"]))
    return F.concat_ws("; ", issuer, many("audience", claims["audience"]), expiry, many("roles", claims["roles"]), many("scopes", claims["scopes"]), many("tenants", claims["tenants"]), many("accounts", claims["accounts"]))


def secret_advice(pattern: Column) -> Column:
    return _pick(SECRET, pattern, SECRET_OTHER)


def reason(confidence: Column) -> Column:
    """The first factor of a confidence that has a note."""
    return F.get(F.filter(confidence["factors"], lambda f: F.coalesce(f["note"], F.lit("")) != ""), F.lit(0))["note"]


def shown(matches: Column) -> Column:
    """The first match, redacted, and how many more there are."""
    more = F.when(F.size(matches) > 1, F.concat(F.lit(" (+"), (F.size(matches) - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(values.redact(F.get(matches, F.lit(0))), more)
