"""Confidence: an additive score with its trail of factors, as one column expression.

Each dimension adds or takes a fixed amount; factors that change nothing are left out of the trail.  The
score saturates after each step, ends between 0 and 100, and has a level.  A suppressor caps it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

#: The start, the deltas of each dimension, and the levels' lower bounds.
START, MEDIUM, HIGH, CAP = 40, 40, 75, 20
COUNT = {2: 10, 3: 18, 4: 24}
TRUST = {"runtime": 20, "network": 14, "source_map": 12, "header": 10, "dom": 6, "ast": 0}
ORIGIN = {"first": 8, "third": -12, "unknown": 0}
EXPLOIT = {"privileged": 10, "unmet": -8, "benign": -15, "none": 0}
ENTROPY = {"low": -25, "high": 8, "n/a": 0}
OBSERVED, CONSTANT = 22, -20
DDL = "struct<level:string,score:int,factors:array<struct<dimension:string,delta:int,note:string>>>"


def pick(column: Column, table: dict, default: int = 0) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == F.lit(k), F.lit(v)).otherwise(out)
    return out


def trust(sources: Column, taint: bool = False) -> Column:
    """The largest trust of the kinds of evidence; for taint a source map has none."""
    table = TRUST | ({"source_map": 0} if taint else {})
    return F.coalesce(F.array_max(F.transform(sources, lambda s: pick(s, table))), F.lit(0))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence(count: Column, sources: Column, origin: Column, exploitability: Column, entropy: Column | None = None, observed: Column | None = None, constant: Column | None = None, suppressor: Column | None = None, taint: bool = False) -> Column:
    """``suppressor``: a note that caps the score at 20 and the level at low, or null."""
    given = {
        "count": count, "sources": sources, "origin": origin, "exploitability": exploitability,
        "entropy": F.lit("n/a") if entropy is None else entropy, "observed": F.lit(False) if observed is None else observed,
        "constant": F.lit(False) if constant is None else constant, "suppressor": F.lit(None).cast("string") if suppressor is None else suppressor,
    }
    return let(F.struct(*[c.alias(n) for n, c in given.items()]), lambda g: let(_deltas(g, taint), lambda d: let(_total(d, g), lambda s: _result(d, s, g))))


DIMENSIONS = ("evidence", "trust", "origin", "runtime", "entropy", "constant", "exploitability")


def _deltas(g: Column, taint: bool) -> Column:
    each = (pick(F.least(g["count"], F.lit(4)), COUNT), trust(g["sources"], taint), pick(g["origin"], ORIGIN), F.when(g["observed"], OBSERVED).otherwise(0), pick(g["entropy"], ENTROPY), F.when(g["constant"], CONSTANT).otherwise(0), pick(g["exploitability"], EXPLOIT))
    return F.array(*[d.cast("int") for d in each])


def _total(d: Column, g: Column) -> Column:
    score = F.least(F.lit(100), F.aggregate(d, F.lit(START), lambda a, x: F.greatest(F.lit(0), F.least(F.lit(255), a + x))))
    return F.when(g["suppressor"].isNotNull(), F.least(score, F.lit(CAP))).otherwise(score)


def _result(d: Column, score: Column, g: Column) -> Column:
    notes = (F.concat(g["count"].cast("string"), F.lit(" pieces of evidence")), F.lit("kind of evidence"), F.concat(g["origin"], F.lit(" party")), F.lit("observed at run time"), F.concat(g["entropy"], F.lit(" entropy")), F.lit("assigned a constant"), F.concat(F.lit("precondition: "), g["exploitability"]))
    held = g["suppressor"].isNotNull()
    trail = [F.when(d[k] != 0, F.struct(F.lit(n).alias("dimension"), d[k].alias("delta"), note.alias("note"))) for k, (n, note) in enumerate(zip(DIMENSIONS, notes))]
    trail.append(F.when(held, F.struct(F.lit("suppressor").alias("dimension"), F.lit(0).alias("delta"), g["suppressor"].alias("note"))))
    return F.struct(F.when(held, "low").otherwise(level(score)).alias("level"), score.cast("int").alias("score"), F.array_compact(F.array(*trail)).alias("factors"))


SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
LEVEL_RANK = {"high": 3, "medium": 2, "low": 1}


def severity_rank(severity: Column) -> Column:
    return pick(F.upper(severity), SEVERITY_RANK)


def level_rank(level_: Column) -> Column:
    return pick(level_, LEVEL_RANK)
