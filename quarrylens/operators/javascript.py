"""Static analysis of scripts: tainted flows, prototype pollution, message handlers, gadgets, telling literals.

A script is parsed once and all analyses run over its tree in one Python step per Arrow batch; scripts are
independent, so nothing is shuffled.  Scripts that are alike but for their URL and for what leading comments say (a
library on many pages, a build's number) are analysed once a task.  What an analysis finds becomes rows, and the rest
(gadgets, scores, dedupes) is columns.

The walker keeps, for each function scope, which names hold a value from a source and by which steps.  What
counts as a source or a sink is in the tables below, by the access path's first and last name.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsparse import Node, Places, parse, room
from .posture import csp_flags

#: Gadgets of a page that a query with this cut shows.
CAP = 200
#: Nodes inside of each other from which on a script gives a fact that says so.
DEEP = 10_000
#: Reads that give a source, as "first name.last name".
SOURCES = {
    "location.href": "location.href",
    "location.search": "location.search",
    "location.hash": "location.hash",
    "location.pathname": "location.pathname",
    "document.URL": "document.URL",
    "document.documentURI": "document.documentURI",
    "document.referrer": "document.referrer",
    "document.cookie": "document.cookie",
    "window.name": "window.name",
    "self.name": "window.name",
    "top.name": "window.name",
}
READS = frozenset(k.split(".")[1] for k in SOURCES)
#: Constructors, and calls of methods, that give one.
CONSTRUCTORS = ("URLSearchParams", "URL")
STORES = ("localStorage", "sessionStorage")
#: Properties that never run what is assigned to them.
SAFE = ("textContent", "innerText", "value", "className", "id")
#: Attributes that do.
ATTRIBUTES = ("href", "src", "action", "formaction", "xlink:href", "srcdoc", "style")
#: Keys and helpers that reach an object's prototype.
POLLUTION = ("__proto__", "prototype", "constructor")
HELPERS = ("merge", "mergeWith", "deepmerge", "deepMerge", "extend", "defaultsDeep", "set", "setWith", "assignInWith", "mergeDeep", "deepExtend", "deepAssign")
#: Methods that check an origin loosely.
LOOSE = ("includes", "startsWith", "endsWith", "indexOf", "search", "match")
HTTP = ("get", "post", "put", "delete", "patch", "request", "head")


def first_name(e: Node | None) -> str | None:
    """The name that an access path starts from."""
    while e is not None and e.kind in ("member", "paren"):
        e = e.object if e.kind == "member" else e.value
    return None if e is None else e.name if e.kind == "ident" else "this" if e.kind == "this" else None


def last_name(e: Node | None) -> str | None:
    """The name nearest to what is read of it."""
    if e is None:
        return None
    return {"ident": lambda: e.name, "member": lambda: e.name, "paren": lambda: last_name(e.value), "this": lambda: "this", "call": lambda: None}.get(e.kind, lambda: None)()


def bare(e: Node) -> Node:
    while e.kind == "paren":
        e = e.value
    return e


def source(e: Node) -> str | None:
    e = bare(e)
    if e.kind == "member" and e.name:
        return "location.searchParams" if e.name == "searchParams" else SOURCES.get(f"{first_name(e.object)}.{e.name}") if e.name in READS else None
    if e.kind == "new" and e.callee.kind == "ident" and e.callee.name in CONSTRUCTORS:
        return f"new {e.callee.name}(...)"
    if e.kind == "call" and e.callee.kind == "member":
        root, name = first_name(e.callee.object), e.callee.name
        if root in STORES and name == "getItem":
            return f"{root}.getItem(...)"
        if root and name == "get" and (re.search("param|query", root, re.I) or root.lower() == "search"):
            return f"{root}.get(...)"
    return None


def assigned_sink(target: Node) -> str | None:
    if target.kind == "ident":
        return "location" if target.name == "location" else None
    if target.kind != "member" or not target.name or target.name in SAFE:
        return None
    name, near = target.name, last_name(target.object)
    if name in ("innerHTML", "outerHTML"):
        return name
    if name == "srcdoc":
        return "iframe.srcdoc"
    if name == "src":
        return f"{near or 'element'}.src"
    for prop, part, label in (("text", "script", "script.text"), ("action", "form", "form.action")):
        if name == prop and near and part in near:
            return label
    return "location.href" if name == "href" and near == "location" else None


def called_sink(call: Node) -> str | None:
    callee = call.callee
    if callee.kind == "ident":
        return {"eval": "eval(...)", "Function": "Function(...)", "setTimeout": "setTimeout(string)", "setInterval": "setInterval(string)"}.get(callee.name)
    if callee.kind != "member":
        return None
    name, near = callee.name, last_name(callee.object)
    if name == "setAttribute":
        attr = call.args[0].value.lower() if call.args and call.args[0].kind == "string" else None
        return f'setAttribute("{attr}", ...)' if attr and (attr.startswith("on") or attr in ATTRIBUTES) else None
    if name == "insertAdjacentHTML":
        return "insertAdjacentHTML(...)"
    if near == "document" and name in ("write", "writeln") or near == "location" and name in ("assign", "replace"):
        return f"{near}.{name}(...)"
    return None


def hatch(name: str | None) -> bool:
    """A framework's way around its own escaping."""
    return bool(name) and (name in ("dangerouslySetInnerHTML", "v-html") or name.startswith("bypassSecurityTrust"))


def listener(call: Node) -> Node | None:
    """The function that a call registers for messages."""
    name = call.callee.name if call.callee.kind in ("ident", "member") else None
    if name == "addEventListener" and len(call.args) > 1 and call.args[0].kind == "string" and call.args[0].value == "message":
        return call.args[1]
    return None


class Walk:
    """One pass that follows values from sources.  ``pollution`` chooses what it reports and, slightly, what it follows."""

    def __init__(self, pollution: bool):
        self.pollution, self.names, self.message, self.found = pollution, {}, None, []

    def mark(self, e: Node | None):
        """(source, steps) of a value that comes from a source, or None."""
        if e is None:
            return None
        if e.kind == "call" and not self.pollution and e.callee.kind == "member" and e.callee.object.kind == "ident" and e.callee.object.name in self.names:
            return self.step(self.names[e.callee.object.name], "method call")
        if label := source(e):
            return label, ()
        if e.kind == "ident":
            return ("location", ()) if self.pollution and e.name == "location" else self.names.get(e.name)
        if e.kind == "paren":
            return self.mark(e.value)
        if e.kind == "member":
            if not self.pollution and self.message and e.name == "data" and first_name(e.object) == self.message:
                return f"{self.message}.data", ()
            return self.step(self.mark(e.object), "property access")
        if e.kind == "template":
            return self.step(self.first(e.values), "template literal")
        if e.kind == "binary":
            return self.step(self.mark(e.left) or self.mark(e.right), "concatenation")
        if e.kind == "call":
            if e.args and e.args[0].kind != "spread" and (m := self.mark(e.args[0])):
                return self.step(m, "parse/transform" if self.pollution else "function call")
            return self.step(self.mark(e.callee.object), "method call") if e.callee.kind == "member" else None
        return None

    def first(self, values: list[Node]):
        """The mark of the first value that has one.  A loop, because nested calls out of ``filter`` or ``map`` would take C stack."""
        for e in values:
            if m := self.mark(e):
                return m
        return None

    @staticmethod
    def step(m, name):
        return m and (m[0], m[1] if m[1][-1:] == (name,) else (*m[1], name))

    def report(self, m, sink: str, at: int):
        self.found.append((m[0], sink, m[1], at))

    def learn(self, name: str, value: Node):
        if m := self.mark(value):
            self.names[name] = self.step(m, name)
        else:
            self.names.pop(name, None)

    def scope(self, node: Node, message: str | None):
        outer = self.names, self.message
        self.names, self.message = {}, message
        for k in node.kids():
            self.visit(k)
        self.names, self.message = outer

    def visit(self, e: Node):
        kind = e.kind
        if kind in ("function", "arrow"):
            return self.scope(e, self.message)
        if kind == "method":
            self.visit(e.key)
            for k in e.function.kids():
                self.visit(k)
            return None
        if kind == "declaration" and e.get("statement"):
            for d in e.items:
                if d.name.kind == "ident" and d.init is not None:
                    self.learn(d.name.name, d.init)
        if kind == "assign":
            self.assignment(e)
            if e.left.kind == "ident":
                self.learn(e.left.name, e.right)
        if kind == "call":
            heard = listener(e)
            if heard is not None and not self.pollution and heard.kind in ("function", "arrow"):
                first = heard.params[0] if heard.params else None
                self.visit(e.callee)
                for a in e.args:
                    if a is heard:
                        self.scope(a, first.name if first is not None and first.kind == "ident" else None)
                    else:
                        self.visit(a)
                return None
            self.call(e)
        for k in e.kids():
            self.visit(k)
        return None

    def assignment(self, e: Node):
        if not self.pollution:
            if (label := assigned_sink(e.left)) and (m := self.mark(e.right)):
                self.report(m, label, e.at)
            return
        if e.left.kind != "member":
            return
        index = e.left.index
        key = e.left.name or (index.value if index is not None and index.kind == "string" else None)
        if key in POLLUTION:
            if m := self.mark(e.right):
                self.report(m, f"proto-key write `{key}`", e.at)
        elif index is not None and (m := self.mark(index)):
            self.report(m, "configurable-key write", e.at)

    def call(self, e: Node):
        if self.pollution:
            name = e.callee.name if e.callee.kind in ("ident", "member") else None
            label = f"{name}(...) deep-merge" if name in HELPERS and not (name in ("set", "setWith") and len(e.args) < 3) else None
        else:
            label = called_sink(e)
            if label and label.endswith("(string)") and not (e.args and e.args[0].kind in ("string", "template", "ident", "binary")):
                label = None
        if label and (m := self.first([a.value if a.kind == "spread" else a for a in e.args])):
            self.report(m, label, e.at)


def _statements(e: Node) -> int:
    """Marks declarations that stand as statements, not in loop heads or exports; gives the tree's depth."""
    stack, deepest = [(e, 1)], 0
    while stack:
        n, depth = stack.pop()
        deepest = max(deepest, depth)
        for k in n.kids():
            if k.kind == "declaration" and n.kind not in ("for", "for_each", "export"):
                k.parts["statement"] = True
            stack.append((k, depth + 1))
    return deepest


def handlers(tree: Node) -> list[tuple[str, bool, int]]:
    """(origin check, reaches a sink, offset) of message handlers and of sends to any origin."""
    out = []

    def body(f: Node):
        p = f.params[0] if f.kind in ("function", "arrow") and f.params else None
        name = p.name if p is not None and p.kind == "ident" else None
        free = p is not None and p.kind == "pattern" and p.value.kind == "object" and any(i.kind in ("property", "shorthand") and i.key.get("value") == "origin" for i in p.value.items)

        def origin(e: Node) -> bool:
            e = bare(e)
            if e.kind == "member":
                return e.name == "origin" and (name is None or first_name(e.object) == name)
            return free and e.kind == "ident" and e.name == "origin"

        check, sink, stack = 0, False, [f]
        while stack:
            n = stack.pop()
            if n.kind == "binary" and n.op in ("===", "!==") and (origin(n.left) or origin(n.right)):
                check = 2
            if n.kind == "call":
                if n.callee.kind == "member" and (n.callee.name in LOOSE and origin(n.callee.object) or n.callee.name == "test" and any(origin(a) for a in n.args)):
                    check = max(check, 1)
                sink |= called_sink(n) is not None or hatch(n.callee.name if n.callee.kind in ("ident", "member") else None)
            sink |= n.kind == "assign" and (assigned_sink(n.left) is not None or n.left.kind == "member" and hatch(n.left.name))
            sink |= n.kind == "new" and n.callee.kind == "ident" and n.callee.name == "Function" or n.kind == "jsx_attr" and hatch(n.name)
            stack.extend(n.kids())
        return ("none", "weak", "strict")[check], bool(sink)

    def visit(e: Node):
        if e.kind == "call":
            if (f := listener(e)) is not None:
                out.append((*body(f), e.at))
            elif e.callee.kind == "member" and e.callee.name == "postMessage" and len(e.args) > 1 and e.args[1].kind == "string" and e.args[1].value == "*":
                out.append(("none", False, e.at))
        elif e.kind == "assign" and (e.left.kind == "ident" and e.left.name == "onmessage" or e.left.kind == "member" and e.left.name == "onmessage"):
            out.append((*body(e.right), e.at))
        for k in e.kids():
            visit(k)

    visit(tree)
    return out


_URL = re.compile(r"^(?:https?://|//|/)\S{5,}")
_HINT = re.compile(r"(?i)(?:api[_-]?key|apikey|secret|token|passw(?:or)?d|auth|credential|private[_-]?key|endpoint|url)")
_JWT = re.compile(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$")


def plain(e: Node | None) -> str | None:
    """A literal's text."""
    if e is None:
        return None
    if e.kind in ("string", "regex"):
        return e.value
    return e.texts[0] if e.kind == "template" and not e.values else None


def literals(tree: Node) -> list[tuple[str, str, int, str]]:
    """(kind, value, offset, context) of URLs in HTTP calls and of values under telling names."""
    out, seen = [], set()

    def add(kind, value, at, context):
        if (kind, value, at) not in seen:
            seen.add((kind, value, at))
            out.append((kind, value[:180] + "..." * (len(value) > 180), at, context))

    def named(name, value, at, context):
        if name and value and _HINT.search(name):
            if _JWT.match(value):
                add("jwt_literal", value, at, context)
            elif _URL.match(value):
                add("endpoint_literal", value, at, context)
            elif re.search("(?i)key|secret|token|passw|auth|credential", name) or len(value.encode("utf-8", "replace")) > 80 or re.match("pk_|sk_|nfp_", value):
                add("literal", value, at, context)

    def visit(e: Node):
        if e.kind == "call" and e.args:
            c = e.callee
            what = c.name if c.kind == "ident" else f"{first_name(c.object)}.{c.name}" if c.kind == "member" else None
            if what in ("fetch", "axios", "$.ajax", "jQuery.ajax") or what and what.startswith("axios.") and c.name in HTTP:
                a = e.args[0]
                v = plain(a)
                if v and _URL.match(v):
                    add("http_call", v, e.at, what)
                elif a.kind == "object":
                    for i in a.items:
                        if i.kind == "property" and i.key.get("value") == "url" and (u := plain(i.value)) and _URL.match(u):
                            add("http_call", u, e.at, what)
        if e.kind == "property":
            named(e.key.get("value"), plain(e.value), e.at, "property")
        if e.kind == "declarator" and e.name.kind == "ident":
            named(e.name.name, plain(e.init), e.at, "variable")
        for k in e.kids():
            visit(k)

    visit(tree)
    return out


#: Facts that a worker gathers before it gives them out, and a script's more.
AT_ONCE = 500
FACT = "page_id long, seq long, script_url string, kind string, source string, sink string, path array<string>, location string, detail string"


#: Characters of scripts whose facts a task remembers, and the most of one script.
REMEMBERED, LONGEST = 4_000_000, 100_000
_COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/")
_INK = re.compile(r"[^\n\r\u2028\u2029]")
#: What stands before the first string, template, regex, division or tag: there, and only there, these two always begin a comment.
_PLAIN = re.compile(rf"[^'\"`/<]*+(?:(?:{_COMMENT.pattern})[^'\"`/<]*+)*")


def without_ink(text: str) -> str:
    """The text with spaces for its first comments: no token, offset or line is another."""
    end = _PLAIN.match(text).end()
    return _COMMENT.sub(lambda m: _INK.sub(" ", m[0]), text[:end]) + text[end:]


def _analysed(text: str) -> list[tuple]:
    """(kind, source, sink, path, place, detail) of all facts of one script; see ``analyse_text``."""
    tree = parse(text)
    if tree is None:
        return []
    out: list[tuple] = []
    loc, depth = Places(text).of, _statements(tree)
    with room(text):
        for pollution, kind in ((False, "flow"), (True, "pollution")):
            w = Walk(pollution)
            w.visit(tree)
            first = {}
            for src, sink, path, at in w.found:
                first.setdefault((src, sink, loc(at)), path)
            out += [(kind, s, k, list(p), at, None) for (s, k, at), p in first.items()]
        out += [("handler", check, None, [], loc(at), json.dumps(sink)) for check, sink, at in handlers(tree)]
        out += [("literal", kind, value, [], loc(at), context) for kind, value, at, context in literals(tree)]
    if depth > DEEP:
        out.append(("too deep", None, None, [], "1:1", None))
    return out


class Remembered:
    """``_analysed`` with the facts of scripts seen before, as far as ``REMEMBERED`` goes; then it begins anew."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.held, self.known = size, 0, {}

    def __call__(self, text: str) -> list[tuple]:
        if len(text) > LONGEST:
            return _analysed(text)
        text = without_ink(text)
        out = self.known.get(text)
        if out is None:
            out = _analysed(text)
            self.held += len(text) + 200 * (len(out) + 1)
            if self.held > self.size:
                self.held, self.known = 0, {}
            self.known[text] = out
        return out


def analyse_text(text: str, url: str) -> list[dict]:
    """All facts of one script; unparseable ones have none.  One that nests too deeply for a person to follow has also a fact that says so."""
    return [{"kind": kind, "source": s, "sink": k, "path": path, "location": f"{url}:{place}", "detail": detail} for kind, s, k, path, place, detail in _analysed(text)]


def facts(scripts: DataFrame) -> DataFrame:
    """Everything that the analyses find in scripts(page_id, seq, url, text), one row each."""
    names = [c.split()[0] for c in FACT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        of, rows = Remembered(), []
        for b in batches:
            for page, seq, url, text in zip(*b.columns):  # one text at a time, however long
                page, seq, url = page.as_py(), seq.as_py(), url.as_py() or ""
                rows += [(page, seq, url, kind, s, k, path, f"{url}:{place}", detail) for kind, s, k, path, place, detail in of(text.as_py() or "")]
                if len(rows) >= AT_ONCE:
                    yield made(rows)
                    rows = []
        yield made(rows)

    return scripts.select(F.col("page_id").cast("long"), F.col("seq").cast("long"), "url", "text").mapInArrow(run, FACT)


def flows(f: DataFrame) -> DataFrame:
    """Each (source, sink, location) of a page once, by its first script."""
    own = f.where("kind = 'flow'").groupBy("page_id", "source", "sink", "location").agg(F.min_by(F.struct("path", "script_url", "seq"), "seq").alias("x"))
    return own.select("page_id", "source", "sink", "location", "x.path", "x.script_url", "x.seq", F.lit(False).alias("runtime_observed"))


def pollution(f: DataFrame) -> DataFrame:
    return f.where("kind = 'pollution'").groupBy("page_id", "source", "sink", "location").agg(F.min("seq").alias("seq"))


def message_handlers(f: DataFrame) -> DataFrame:
    return f.where("kind = 'handler'").select("page_id", "seq", "script_url", "location", F.col("source").alias("origin_check"), (F.col("detail") == "true").alias("reaches_sink"))


def telling_literals(f: DataFrame) -> DataFrame:
    return f.where("kind = 'literal'").select("page_id", "seq", "script_url", F.col("source").alias("kind"), F.col("sink").alias("value"), "location", F.col("detail").alias("context"))


#: Characters of a term's signature; of a captured value that are searched at a time, at least; grams that are broadcast at most; parts that a page's values are dealt into.
GRAM, STRETCH, GRAMS, SALTS = 3, 4096, 65_536, 16


def _grams(text: Column) -> Column:
    """The text's substrings of ``GRAM`` characters; none of a shorter one."""
    last = F.length(text) - GRAM + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def contained(terms: DataFrame, values: DataFrame) -> DataFrame:
    """(page_id, term), distinct: those of ``terms(page_id, term)`` that stand in a value of ``values(page_id, value)`` of the same page.

    A containment join by an index of q-grams.  Each term is entered under one of its grams, a shorter one under none;
    values are cut into stretches that overlap by the longest term, and a stretch probes the grams that it has.  What meets is
    checked exactly.  A page's values are dealt by hash, with its terms in each part, so a page of very many values
    is searched by many tasks, and its values are never gathered.
    """
    own = terms.where("term <> ''").distinct()
    longest = own.agg(F.max(F.length("term"))).first()[0]
    if longest is None:
        return own
    gram = F.array_min(F.transform(_grams(F.col("term")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    own = own.withColumn("gram", F.coalesce(gram, F.lit(""))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    step = max(STRETCH, 4 * longest)
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.length("value"), F.lit(1)), F.lit(step)))
    piece = values.select("page_id", "value", place.alias("at")).select("page_id", F.substring("value", F.col("at"), F.lit(step + longest - 1)).alias("piece")).distinct()
    probes = piece.withColumn("gram", F.explode(F.concat(F.array_distinct(_grams(F.col("piece"))), F.array(F.lit("")))))
    known = own.select("gram").distinct()
    if known.limit(GRAMS + 1).count() <= GRAMS:  # most grams of values are no term's, and go before the shuffle
        probes = probes.join(F.broadcast(known), "gram", "left_semi")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int"))
    met = probes.join(own, ["page_id", "gram", "salt"]).where(F.contains("piece", F.col("term")))
    return met.select("page_id", "term").distinct()


def mark_observed(f: DataFrame, values: DataFrame) -> DataFrame:
    """Flows whose source or sink stands in a captured value(page_id, value) of three bytes or more besides white space."""
    told = values.where(F.octet_length(F.regexp_replace("value", r"^\s+|\s+$", "")) >= 3)
    rows = f.drop("runtime_observed")
    terms = rows.select("page_id", F.explode(F.array("source", "sink")).alias("term"))
    seen = contained(terms, told).withColumn("runtime_observed", F.lit(True))
    for side in ("source", "sink"):
        rows = rows.join(seen.withColumnsRenamed({"term": side, "runtime_observed": f"_{side}"}), ["page_id", side], "left")
    return rows.withColumn("runtime_observed", F.coalesce("_source", "_sink", F.lit(False))).select(*[c for c in f.columns if c != "runtime_observed"], "runtime_observed")


def rendered(source_: Column, path: Column, sink: Column) -> Column:
    return F.array_join(F.concat(F.array(source_), path, F.array(sink)), " → ")


def sink_class(sink: Column) -> Column:
    return (
        F.when(sink.isin("dangerouslySetInnerHTML", "v-html") | F.startswith(sink, F.lit("bypassSecurityTrust")), "unsafe-template")
        .when(sink.isin("location", "location.href", "location.assign(...)", "location.replace(...)", "form.action"), "open-redirect")
        .when((sink == "script.text") | F.rlike(sink, F.lit(r"script.*\.src$")), "jsonp")
        .when(sink.isin("innerHTML", "outerHTML", "insertAdjacentHTML(...)", "eval(...)", "Function(...)", "new Function(...)") | F.rlike(sink, F.lit(r"^document\.write|\(string\)$")), "dom-xss")
    )


def gadgets(f: DataFrame, csp: DataFrame, cap: int | None = None) -> DataFrame:
    """(page_id, category, description, script_url, exploitability_hint, place): flows, pollution, handlers, then CSP; all of a page, or its first ``cap``.

    ``f``: the facts, which are read once; ``csp``: page_id, header.  A page's first flow into HTML or code gives a
    second row where the page's policy would let it through.
    """
    kind, sink = F.col("kind"), F.col("sink")
    each = F.when(kind == "handler", F.struct("seq", "detail"))
    own = f.where("kind in ('flow', 'pollution', 'handler')").groupBy("page_id", "kind", "source", "sink", "location", each.alias("each")).agg(F.min_by(F.struct("path", "script_url", "seq", "detail"), "seq").alias("x"))
    own = own.select("page_id", "kind", "source", "sink", "location", "x.*").withColumn("class", F.when(kind == "flow", sink_class(sink)))
    open_ = csp.withColumn("f", csp_flags(F.col("header"))).where("f.unsafe_inline or f.unsafe_eval or f.broad").select("page_id", F.lit(True).alias("open")).distinct()
    mark = F.row_number().over(Window.partitionBy("page_id").orderBy((F.col("class") == "dom-xss").desc_nulls_last(), "seq", "location", "sink", "source"))
    own = own.withColumn("mark", mark).join(open_, "page_id", "left")
    row = lambda k, category, description, url, hint: F.struct(F.lit(k).alias("k"), category.alias("category"), description.alias("description"), url.alias("script_url"), F.lit(hint).alias("exploitability_hint"))
    arrow = F.concat("source", F.lit(" → "), "sink", F.lit(" ("), "location", F.lit(")"))
    heard = F.concat(F.lit("message handler with "), "source", F.lit(" origin check reaches a sink ("), "location", F.lit(")"))
    first = (
        F.when((kind == "flow") & F.col("class").isNotNull(), row(0, F.col("class"), rendered(F.col("source"), F.col("path"), sink), F.col("script_url"), "a source reaches this sink: confirm that the value can be chosen"))
        .when(kind == "pollution", row(1, F.lit("prototype-pollution"), arrow, F.element_at(F.split("location", ":"), 1), "a source reaches the prototype: confirm that a key can be chosen"))
        .when((kind == "handler") & (F.col("source") != "strict") & (F.col("detail") == "true"), row(2, F.lit("postmessage-trust"), heard, F.col("script_url"), "little origin checking before a sink: confirm that another frame can drive it"))
    )
    through = F.concat(F.lit("the policy lets through what the sink `"), "sink", F.lit("` needs"))
    second = F.when((F.col("class") == "dom-xss") & (F.col("mark") == 1) & F.col("open"), row(3, F.lit("csp-bypass"), through, F.col("script_url"), "a sink is there and the policy would not stop it"))
    rows = own.select("page_id", "seq", "location", F.explode(F.array_compact(F.array(first, second))).alias("g")).select("page_id", "seq", "location", "g.*")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("k", "seq", "location", "description"))
    rows = rows.withColumn("place", place)
    return (rows if cap is None else rows.where(F.col("place") <= cap)).select("page_id", "category", "description", "script_url", "exploitability_hint", "place")
