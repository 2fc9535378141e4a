"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans are found by patterns.  Three labelers vote on each, or abstain: the pattern's own check (check
digits, octets, mixture of characters), a gazetteer (lists of first names, streets, area codes, countries, issuers),
and the context (words in front of the span).  The votes of all documents are counted by kind and pattern of votes,
a table with a bounded number of rows, on which expectation-maximisation estimates each labeler's
reliability by kind.  Its posteriors then train a logistic span classifier over votes and length, again on counts,
whose verdict on every combination is a small look-up.  Spans that pass the base check stay whatever the
verdict; the further kinds are looked for outside of them only.

Positions come from splitting a text at the matches and summing the pieces' lengths, in code points.  Sums
run in blocks, so the work grows with the text, not with the square of the number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_of

#: The patterns of the base kinds.  Loops are possessive and starts anchored to a run's
#: beginning (or the last match's end), which changes no match but keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = ("email", "ip", "card", "phone")
_CAP = r"\p{Lu}\p{Ll}{1,20}"
#: The kinds that the method adds: credentials, telephone numbers in national form, names of persons, postal
#: addresses, bank accounts, social security numbers.
PATTERNS |= {
    "secret": r"(?<![A-Za-z0-9+/=_.@-])(?=[A-Za-z+/_-]{0,30}[0-9])(?=[0-9+/_-]{0,30}[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9@])",
    "local": r"(?<![0-9+.()/-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|0[1-9](?:[\x20.][0-9]{2}){4}|0[1-9][0-9]{1,3}[\x20/-][0-9]{5,8})(?![0-9.-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|From|By|Contact|Name|Signed)\b){_CAP}(?:\x20\p{{Lu}}\.)?\x20{_CAP}(?![\p{{L}}\p{{N}}])",
    "address": rf"(?<![\p{{L}}\p{{N}}])(?:[1-9][0-9]{{0,4}}\x20(?:{_CAP}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way)|{_CAP}(?:straße|strasse|weg|platz|allee|gasse)\x20[1-9][0-9]{{0,3}}|[1-9][0-9]{{0,3}},?\x20(?:rue|avenue|boulevard|place|chemin)\x20(?:de\x20la\x20|du\x20|des\x20|de\x20)?{_CAP})(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
}
ADDED = tuple(k for k in PATTERNS if k not in BASE)
#: A cheap test that a text without it has no match of the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Stands for every character of a base span while further kinds are looked for.
MASK = ""
CONTEXT = 24
#: Words in front of a span that speak for its kind, and against it.
CUES = {
    "email": (r"(?i)mail|contact|write|address|@", r"[0-9A-Za-z_/=-]$"),
    "ip": (r"(?i)\bip\b|address|host|server|client|from", r"[0-9A-Za-z_/=-]$"),
    "card": (r"(?i)card|visa|master|amex|account|credit|payment", r"[0-9A-Za-z_/=-]$"),
    "phone": (r"(?i)phone|call|tel\b|mobile|cell|fax|contact", r"[0-9A-Za-z_/=-]$"),
    "secret": (r"(?i)(?:token|password|passwd|pwd|secret|key|credential|bearer|auth)[\"']?\W{0,6}$", r"(?i)(?:commit|revision|rev|sha[0-9]*|md5|hash|checksum|digest|integrity|etag|build|file|image)\W{0,6}$"),
    "local": (r"(?i)(?:phone|call|tel|mobile|cell|fax|contact|reach|ring|dial|telefon|rufnummer|téléphone|teléfono)\b.{0,12}$", r"(?i)(?:order|invoice|part|model|serial|isbn|ref|item|no)\b.{0,6}$"),
    "name": (r"(?i)(?:\bmr|\bmrs|\bms|\bdr|\bprof|\bherr|\bfrau|\bmme|monsieur|madame|\bsr|\bsra|\bdear|\bname|\bby|\bfrom|\bcontact|\bsigned|\bpatient|\bcustomer|\bemployee|\bi am|\bmy name is)\W{1,3}$", r"(?i)(?:\bthe|\bof|\bin|\bat|\bthis|\bder|\bdie|\bdas|\ble|\bla|\bel|\blos|\bunited|\bnew|\buniversity|\bcity)\W{1,2}$"),
    "address": (r"(?i)(?:address|live[sd]?|at|residing|home|ship|deliver|wohn\w*|adresse|habite|domicil\w*|dirección)\b\W{0,3}(?:\w+\W{1,2}){0,2}$", r"(?i)(?:page|chapter|section|route|highway|no|nr|kapitel|seite)\W{0,3}$"),
    "iban": (r"(?i)(?:iban|account|konto|compte|cuenta|bank|transfer)\b.{0,8}$", r"(?i)(?:order|part|model|serial|code|sku)\W{0,4}$"),
    "ssn": (r"(?i)(?:ssn|social|security|tax\s?id|taxpayer)\b.{0,10}$", r"(?i)(?:order|part|model|serial|isbn|ref|item|date|version)\b.{0,6}$"),
}
#: What a gazetteer knows about a span's own text, for and against.
KNOWN = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", r"(?i)\.(?:png|jpg|gif|js|css)$"),
    "ip": (r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|255)\.|\.0\.0\.0$"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^(?:0|1|7|8|9)"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "secret": (r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk_test_|pk_live_|rk_live_|xox[bpars]-|AIza|ya29|SG|npm_|eyJ)", r"(?i)example|placeholder|xxxx|^(?:[0-9]{4}-?){4,}|[a-z]{3,}(?:[-_/][a-z]{3,}){2}"),
    "ssn": (r"^(?:[0-6][0-9]{2}|7[0-6][0-9]|77[0-2])-", r"^(?:078-05-1120|219-09-9999|123-45-6789|987-65-43)"),
}
FIRST_NAMES = "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen daniel matthew anthony mark paul steven andrew kenneth george emily emma olivia sophia anna laura julia lisa nancy helen peter hans klaus jürgen wolfgang stefan andreas martin thomas sabine petra monika ursula heike katrin pierre jean jacques michel philippe marie sophie isabelle nathalie claire josé juan carlos luis miguel antonio manuel francisco maría carmen ana isabel lucía elena giulia marco luca ahmed mohammed fatima ali wei li chen yuki hiroshi priya raj ivan olga natasha"
NOT_NAMES = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december the this that these those and or but in on at by for with from new north south east west united states university street avenue road city county river lake mount saint king queen president high school national international general der die das und ein eine ist nicht mit von le la les des un une et est dans el los las una con por del se su que was were are is it he she they we you"
STREETS = "main oak pine maple cedar elm park church station high king queen washington lake hill market mill haupt bahnhof schul garten kirch berg linden wald dorf berliner goethe schiller mozart ring république gare victor paix église liberté"
AREAS = "201 202 203 206 212 213 214 215 216 301 302 303 305 310 312 313 314 315 317 323 401 402 404 405 407 408 410 412 414 415 416 419 425 469 480 501 502 503 504 505 510 512 513 514 515 516 518 585 602 603 604 605 612 614 615 617 619 626 630 646 650 651 702 703 704 707 708 713 714 716 717 718 719 720 727 732 734 760 770 773 781 786 801 802 803 804 805 808 810 813 815 816 817 818 832 847 850 856 858 860 865 901 903 904 908 909 910 912 914 915 916 917 918 919 925 937 940 941 949 951 954 970 971 972 973 978 800 888 877 866"
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TN TR"
YES, NO, ABSTAIN = 2, 1, 0
LABELERS = ("pattern", "gazetteer", "context")
_SPANS = "array<struct<start:int,end:int,match:string,before:string>>"
#: Values that a sum over blocks takes at a time; characters of a piece that a text is cut into.
BLOCK, PIECE = 64, 1024


def running(df: DataFrame, columns: list[str], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Each of the array columns becomes, for each place and one more at the end, the combination from 0 of all values before it.

    Nulls stay.  Steps are columns of their own, each referred to more than once, so that they are worked out once a row.
    """
    fold = lambda xs: F.aggregate(xs, F.lit(0), combine)
    sums, heads = {c: fresh(df, f"{c}_sums") for c in columns}, {c: fresh(df, f"{c}_heads") for c in columns}

    def blocks(v: Column) -> Column:
        return F.when(v.isNotNull(), F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))))

    def firsts(s: Column) -> Column:
        return F.when(s.isNotNull(), F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))))

    def every(v: Column, h: Column) -> Column:
        return F.when(h.isNotNull(), F.transform(F.sequence(F.lit(0), F.size(v)), lambda i: combine(F.get(h, F.floor(i / BLOCK).cast("int")), fold(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    df = df.withColumns({sums[c]: blocks(F.col(c)) for c in columns})
    df = df.withColumns({heads[c]: firsts(F.col(sums[c])) for c in columns})
    return df.withColumns({c: every(F.col(c), F.col(heads[c])) for c in columns}).drop(*sums.values(), *heads.values())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v) % 10 == 0


def account(m: Column) -> Column:
    """Whether a bank account's check digits hold: its characters, the first four last, letters as 10 to 35, are 1 modulo 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    worth = lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(F.rlike(c, F.lit("[0-9]")), 10).otherwise(100) + worth(c)) % 97) == 1


def valid(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)).cast("int") <= 255)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _there(text: Column, kind: str) -> Column:
    there = F.rlike(text, F.lit(PATTERNS[kind]))
    return F.contains(text, F.lit(NEEDS[kind])) & there if kind in NEEDS else there


def _cut(text: Column, kind: str) -> tuple[Column, Column]:
    """The pieces between matches, and the matches."""
    return F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def candidates(df: DataFrame, text: Column, columns: dict[str, str]) -> DataFrame:
    """For each kind of ``columns`` its leftmost non-overlapping matches as structs (start, end, match, before), positions in code points."""
    pairs, at = {k: fresh(df, f"{c}_pairs") for k, c in columns.items()}, {k: fresh(df, f"{c}_at") for k, c in columns.items()}
    cut = lambda k: F.arrays_zip(*(c.alias(n) for c, n in zip(_cut(text, k), ("gap", "hit"))))
    df = df.withColumns({pairs[k]: F.when(_there(text, k), cut(k)) for k in columns})
    hits = lambda k: F.slice(F.col(pairs[k]), F.lit(1), F.size(pairs[k]) - 1)  # noqa: E731  the last gap has no match behind it
    df = df.withColumns({at[k]: F.transform(hits(k), lambda x: F.length(x["gap"]) + F.length(x["hit"])) for k in columns})
    df = running(df, list(at.values()), lambda a, v: a + v)
    item = lambda x, s: F.struct(s.alias("start"), (s + F.length(x["hit"])).alias("end"), x["hit"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))

    def spans(k: str) -> Column:
        made = F.transform(hits(k), lambda x, i: item(x, F.get(F.col(at[k]), i) + F.length(x["gap"])))
        return F.when(F.col(at[k]).isNotNull(), made).otherwise(F.array().cast(_SPANS)).cast(_SPANS)

    return df.withColumns({columns[k]: spans(k) for k in columns}).drop(*pairs.values(), *at.values())


def masked(text: Column, kind: str) -> Column:
    """The text with every character of the kind's valid matches replaced, length unchanged."""
    gaps, hits = _cut(text, kind)
    piece = lambda x: F.concat(x["gap"], F.coalesce(F.when(valid(kind, x["hit"]), F.repeat(F.lit(MASK), F.length(x["hit"]))).otherwise(x["hit"]), F.lit("")))
    return F.when(_there(text, kind), F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), piece), "")).otherwise(text)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(no, F.lit(False)), NO).when(F.coalesce(yes, F.lit(False)), YES).otherwise(ABSTAIN)


def _in(word: Column, names: str) -> Column:
    return word.isin(*dict.fromkeys(names.split()))


def _checks(kind: str, x: Column) -> Column:
    """The first labeler's vote: does the span's own form hold?"""
    m = x["match"]
    if kind in ("ip", "card", "phone"):
        return F.when(valid(kind, m), YES).otherwise(NO)
    if kind == "email":
        return F.lit(YES)
    if kind == "secret":
        mixed = F.rlike(m, F.lit("[0-9].*[0-9].*[0-9]")) & F.rlike(m, F.lit("[a-z].*[a-z]")) & F.rlike(m, F.lit("[A-Z].*[A-Z]"))
        given = F.rlike(x["before"], F.lit(r"(?:=\s*|:\s*)[\"']$|=$"))  # a digest's form tells nothing, but a quoted or assigned one's does
        return _vote(mixed | given, F.rlike(m, F.lit(r"[a-z]{9,}|[A-Z]{12,}|(.)\1{5}")))
    if kind == "local":
        return _vote(F.rlike(m, F.lit(r"^(?:\(?[2-9][0-9]{2}\)?[\x20.-][2-9]|0[1-9])")), F.rlike(m, F.lit(r"^\(?[01][0-9]{2}\)?[\x20.-][0-9]{3}[.-]|(\d)\1{6}")))
    if kind == "name":
        begins = F.rlike(x["before"], F.lit(r"(?:^|[.!?:|\n]\s*|^\s*)$"))
        return _vote(~begins, F.rlike(m, F.lit(r"^(\p{L}+)\x20\1$")))
    if kind == "address":
        return _vote(F.rlike(m, F.lit("[0-9]")), F.rlike(m, F.lit("^(?:19|20)[0-9]{2}[ ]")))
    if kind == "iban":
        return F.when(account(m), YES).otherwise(NO)
    return _vote(F.lit(True), F.rlike(m, F.lit(r"^(?:000|666|9..)-|-00-|-0000$")))


def _gazetteer(kind: str, x: Column) -> Column:
    """The second labeler's vote: do the lists know the span's own text?"""
    m = x["match"]
    if kind == "local":
        return _vote(_in(F.substring(_digits(m), 1, 3), AREAS) | F.rlike(m, F.lit("^0")), F.rlike(m, F.lit(r"^\(?(?:000|111|123|999)")))
    if kind == "name":
        words = F.split(F.lower(m), r"[^\p{L}]+")
        return _vote(_in(F.get(words, F.lit(0)), FIRST_NAMES), F.exists(words, lambda w: _in(w, NOT_NAMES)))
    if kind == "address":
        words = F.split(F.regexp_replace(F.lower(m), "(?:straße|strasse|weg|platz|allee|gasse)", " "), r"[^\p{L}]+")
        return _vote(F.exists(words, lambda w: _in(w, STREETS)), F.lit(False))
    if kind == "iban":
        return _vote(_in(F.substring(m, 1, 2), COUNTRIES), ~_in(F.substring(m, 1, 2), COUNTRIES))
    yes, no = KNOWN[kind]
    return _vote(F.rlike(m, F.lit(yes)), F.rlike(m, F.lit(no)))


def _context(kind: str, x: Column) -> Column:
    """The third labeler's vote: do the words in front speak for it?"""
    yes, no = CUES[kind]
    for_, against = F.rlike(x["before"], F.lit(yes)), F.rlike(x["before"], F.lit(no))
    return F.when(for_, YES).when(against, NO).otherwise(ABSTAIN)


def _judged(kind: str, labelers: tuple[str, ...]):
    def judge(x: Column) -> Column:
        votes = {"pattern": _checks, "gazetteer": _gazetteer, "context": _context}
        a, b, c = (votes[n](kind, x) if n in labelers else F.lit(ABSTAIN) for n in LABELERS)
        long_ = F.least(F.lit(3), F.floor(F.length(x["match"]) / 12))
        base = valid(kind, x["match"]) if kind in BASE else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"), long_.cast("int").alias("d"))

    return judge


def with_candidates(docs: DataFrame, text: str, column: str, labelers: tuple[str, ...] = LABELERS) -> DataFrame:
    """``docs`` with all candidates and their votes in ``column``, by kind as listed, then start."""
    found = {k: fresh(docs, f"{column}_{k}") for k in PATTERNS}
    rest = fresh(docs, f"{column}_rest")
    made = candidates(docs.withColumn(rest, text_of(docs, text)), F.col(rest), {k: found[k] for k in BASE})
    some = F.size(F.concat(*[found[k] for k in BASE])) > 0
    for k in BASE:
        made = made.withColumn(rest, F.when(some, masked(F.col(rest), k)).otherwise(F.col(rest)))
    made = candidates(made, F.col(rest), {k: found[k] for k in ADDED})
    return made.withColumn(column, F.concat(*[F.transform(found[k], _judged(k, labelers)) for k in PATTERNS])).drop(rest, *found.values())


def reliabilities(rows: list[tuple[str, int, int, int, int, int]], rounds: int = 100) -> dict[tuple, float]:
    """Posterior of every (kind, votes, length) by expectation-maximisation over counted vote patterns.

    rows: (kind, three votes, length, count).  Each kind has its own share of true spans; each labeler
    has, for each kind, the chances of its votes for true and for false spans, a vote for being at least as likely
    for a true span, and one against for a false one.  It starts from the majority, where a single vote is less than
    even.  Patterns without any vote for say nothing and are false.
    """
    count: dict[tuple, int] = {}
    for r in rows:
        count[r[:4]] = count.get(r[:4], 0) + r[5]
    keys = sorted(k for k in count if YES in k[1:4])
    start = lambda k: 0.45 + 0.38 * (k[1:4].count(YES) - 1) - 0.25 * k[1:4].count(NO)
    z = {k: min(0.97, max(0.03, start(k))) for k in keys}
    for _ in range(rounds):
        prior, chance = {}, {}
        for kind in sorted({k[0] for k in keys}):
            own = [k for k in keys if k[0] == kind]
            for true in (0, 1):
                w = {k: count[k] * (z[k] if true else 1 - z[k]) for k in own}
                prior[kind, true] = sum(w.values()) + 1.0
                for j in (1, 2, 3):
                    for v in (ABSTAIN, NO, YES):
                        hint = 2.0 if v == (YES if true else NO) else 0.5
                        chance[kind, true, j, v] = (sum(w[k] for k in own if k[j] == v) + hint) / (sum(w.values()) + 3.0)
        for k in keys:
            odds = math.log(prior[k[0], 1] / prior[k[0], 0])
            for j in (1, 2, 3):
                say = math.log(chance[k[0], 1, j, k[j]] / chance[k[0], 0, j, k[j]])
                odds += max(0.0, say) if k[j] == YES else min(0.0, say) if k[j] == NO else say
            z[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return {r[:5]: z.get(r[:4], 0.0) for r in rows}


def span_classifier(rows: list[tuple[str, int, int, int, int, int]], rounds: int = 400) -> dict[tuple, float]:
    """Probability of every (kind, votes, length) by a logistic model of these, trained on the posteriors."""
    z = reliabilities(rows)
    if not z:
        return {}
    count = dict.fromkeys(z, 0)
    for r in rows:
        count[r[:5]] += r[5]
    feats = {k: [("kind", k[0]), *((k[0], j, k[j]) for j in (1, 2, 3)), (k[0], "length", k[4]), (k[0], "for", k[1:4].count(YES)), (k[0], "against", k[1:4].count(NO))] for k in z}
    weight = {f: 0.0 for fs in feats.values() for f in fs}
    share = {k: math.sqrt(count[k]) for k in z}
    total = {kind: sum(s for k, s in share.items() if k[0] == kind) for kind in {k[0] for k in z}}
    for _ in range(rounds):
        grad = {f: 1e-4 * w for f, w in weight.items()}
        for k, fs in feats.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in fs)))))
            for f in fs:
                grad[f] += share[k] / total[k[0]] * (p - z[k])
        for f in weight:
            weight[f] -= 1.5 * grad[f]
    return {k: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in fs))))) if YES in k[1:4] else 0.0 for k, fs in feats.items()}


def _code(x: Column) -> Column:
    """A span's kind, votes and length, as one text."""
    return F.concat_ws(":", x["kind"], x["a"], x["b"], x["c"], x["d"])


def _verdict(model: dict[tuple, float], x: Column) -> Column:
    """True for base spans and for combinations of votes that the classifier accepts."""
    good = sorted(":".join(map(str, k)) for k, p in model.items() if p >= 0.5 and k[0] not in BASE)
    return x["base"] | (_code(x).isin(good) if good else F.lit(False))


def learn(spans: DataFrame, column: str) -> dict[tuple, float]:
    """The span classifier, from the votes in ``column``; only counts by kind, votes and length reach the driver."""
    each = spans.select(F.explode(F.transform(column, _code)).alias("code"))
    rows = [(*r["code"].split(":"), r["n"]) for r in each.groupBy("code").agg(F.count("*").alias("n")).collect()]
    return span_classifier(sorted((kind, *map(int, votes)) for kind, *votes in rows))


def fit(docs: DataFrame, text: str = "text", labelers: tuple[str, ...] = LABELERS) -> dict[tuple, float]:
    """The span classifier of all documents."""
    column = fresh(docs, "spans")
    return learn(with_candidates(docs.select(docs[text].alias(text)), text, column, labelers), column)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", labelers: tuple[str, ...] = LABELERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and ``base_sha256`` are of the base spans that pass their check; ``spans`` has those and the ``n_added``
    ones that the classifier adds, kind:start:end by kind, then start, in code points, end exclusive.
    ``labelers``: who votes; others abstain.  The texts are read once: their candidates are written.
    A null text is empty: counts 0, no spans.  Repeated rows each get a row; a null key stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    made = materialize(with_candidates(own, "text", "found", labelers).select("doc_id", "found"), "candidates")
    model = learn(made, "found")
    made = made.withColumn("base", F.filter("found", lambda x: x["base"])).withColumn("all", F.filter("found", lambda x: _verdict(model, x)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return made.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def _replaced(df: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """``df`` with the text in ``out``, its ``spans``, in order of start, replaced by their kinds; overlapping ones become the first."""
    blocks, reach, each = fresh(df, f"{out}_blocks"), fresh(df, f"{out}_reach"), fresh(df, f"{out}_each")
    s, r = F.col(spans), F.col(reach)
    some = F.size(s) > 0
    df = df.withColumn(blocks, F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    df = running(df.withColumn(reach, F.when(some, F.transform(s, lambda x: x["end"]))), [reach], lambda a, v: F.greatest(a, v))

    def piece(a: Column, b: Column) -> Column:
        """Characters a to b, out of blocks of PIECE characters."""
        part = lambda k: F.coalesce(F.substring(F.get(F.col(blocks), k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0))), F.lit(""))
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")), part), "")).otherwise(F.lit(""))

    made = F.transform(s, lambda x, i: F.when(x["start"] >= F.get(r, i), F.concat(piece(F.get(r, i), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit("")))
    df = df.withColumn(each, F.when(some, F.array_join(made, "")))
    return df.withColumn(out, F.when(some, F.concat(F.col(each), piece(F.get(r, F.size(s)), F.length(F.col(text))))).otherwise(F.col(text))).drop(blocks, reach, each)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", labelers: tuple[str, ...] = LABELERS) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    Columns are unchanged, whatever their names; where a text changes, the column ``length``, if there, has its new
    length.  Null and empty texts stay as they are; repeated rows change alike; an empty table stays empty.
    """
    model, found, new = fit(docs, text, labelers), fresh(docs, "found"), fresh(docs, "redacted")
    made = with_candidates(docs, text, found, labelers)
    spans = F.sort_array(F.transform(F.filter(found, lambda x: _verdict(model, x)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    made = _replaced(made.withColumn(found, spans), text, found, new)
    return made.select(*[F.col(new).alias(c) if c == text else F.when(F.size(found) > 0, F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length else F.col(c) for c in docs.columns])
