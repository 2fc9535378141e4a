"""Table functions for SQL: elements, leaves and secrets, usable in lateral joins; and patterns that a session adds.

``register(spark)`` makes them known to a session:

* ``elements(html [, tag])``: tag, attrs, text, pos, controls of the page's start tags, or of one tag's.
* ``leaves(json [, depth])``: path and value of the JSON's scalars.
* ``secrets(text)``: pattern and value of the text's secrets.  It is a function in SQL, so no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.storage import DEPTH, _walk
from ..sources.captures import _parse
from .needles import required
from .patterns import BUILT_IN, Pattern, compiles

_ADDED: dict[str, list[Pattern]] = {}


def _text(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, StringType) and argument.dataType.typeName() != "void":
        raise ValueError(f"{name} takes a text, not {argument.dataType.simpleString()}")


def _constant(argument: AnalyzeArgument | None, name: str, kind: type) -> None:
    if argument is not None and (not argument.isConstantExpression or not isinstance(argument.value, kind)):
        raise ValueError(f"{name} must be a constant {kind.__name__}")


class Elements:
    @staticmethod
    def analyze(html: AnalyzeArgument, tag: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(html, "elements")
        _constant(tag, "the tag", str)
        return AnalyzeResult(StructType().add("tag", StringType()).add("attrs", MapType(StringType(), StringType())).add("text", StringType()).add("pos", IntegerType()).add("controls", IntegerType()))

    def eval(self, html: str | None, tag: str | None = None) -> Iterator[tuple]:
        for e in _parse(html):
            if tag is None or e["tag"] == tag:
                yield e["tag"], dict(e["attrs"]), e["text"], e["pos"], e["controls"]


class Leaves:
    @staticmethod
    def analyze(json: AnalyzeArgument, depth: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(json, "leaves")
        _constant(depth, "the depth", int)
        return AnalyzeResult(StructType().add("path", StringType()).add("value", StringType()))

    def eval(self, json: str | None, depth: int | None = None) -> Iterator[tuple]:
        for leaf in _walk(json, "", DEPTH if depth is None else depth) or ():
            yield leaf["path"], leaf["value"]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _secrets(patterns: list[Pattern], limit: int = 10) -> str:
    """The body of ``secrets``: the patterns whose needles the text has, their distinct matches in order."""
    each = []
    for p in patterns:
        found, fold = required(p.regex)
        found = found or frozenset(p.needles)
        subject = "low" if fold else "t"
        some = " or ".join(f"contains({subject}, {_literal(n)})" for n in sorted(found)) or "true"
        odd = " or odd" if fold and found else ""
        matches = f"slice(array_sort(array_distinct(regexp_extract_all(t, {_literal('(?dU)' + p.regex)}, 0))), 1, {limit})"
        each.append(f"struct({_literal(p.name)} as pattern, case when {some}{odd} then {matches} else array() end as values)")
    odd = " or ".join(f"contains(t, '{c}')" for c in ("İ", "ı", "ſ", "K"))
    return f"select p, v from (select m.pattern as p, explode(m.values) as v from (select explode(array({', '.join(each)})) as m from (select secrets.t as t, lower(secrets.t) as low, {odd.replace('contains(t', 'contains(secrets.t')} as odd)))"


def _define(spark: SparkSession, patterns: list[Pattern]) -> None:
    spark.sql(f"create or replace temporary function secrets(t string) returns table (pattern string, value string) return {_secrets(patterns)}")


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session, with the patterns that it has added so far."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("elements", udtf(Elements))
    spark.udtf.register("leaves", udtf(Leaves))
    _define(spark, [*BUILT_IN, *_ADDED.get(_session(spark), [])])


def register_pattern(spark: SparkSession, name: str, regex: str) -> bool:
    """Add a pattern to the session's ``secrets``; false, and nothing added, for one of more than 500 bytes or that doesn't compile.  An added name is replaced."""
    if len(regex.encode()) > 500 or not compiles(spark, regex):
        return False
    own = _ADDED.setdefault(_session(spark), [])
    own[:] = [p for p in own if p.name != name] + [Pattern(name, regex)]
    _define(spark, [*BUILT_IN, *own])
    return True
