"""A parser for JavaScript (ES2022, simple JSX, TypeScript's plainest annotations excluded), for static analysis.

``parse(text)`` gives a tree of nodes, or None if the text is no program.  A node has a kind, the offset where it
starts, named parts, and ``kids()`` in source order.  Only what analyses need is kept: comments, white space
and most punctuation are gone.  Neither a text's size nor its nesting is bounded.
"""

from __future__ import annotations

import re
import sys
from contextlib import contextmanager

#: Calls that one character can nest at most, in the parser or in a walk over the tree; calls of Python by Python take no C stack.
CALLS = 12
_SPACE = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)+")
_LINE = re.compile("[\n\r\u2028\u2029]")
_NAME = re.compile(r"[#]?(?:[A-Za-z_$]|[^\x00-\x7f\s]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|[^\x00-\x7f\s]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\[\s\S])*+'|\"(?:[^\"\\\n\r]|\\[\s\S])*+\"")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
#: Words that can't name a variable, and the strength of binary operators.
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
POWER = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


class Node:
    __slots__ = ("kind", "at", "parts", "_kids")

    def __init__(self, kind: str, at: int, **parts):
        self.kind, self.at, self.parts, self._kids = kind, at, parts, None

    def __getattr__(self, name):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name, default=None):
        return self.parts.get(name, default)

    def kids(self) -> list[Node]:
        """Gathered once: every analysis walks the whole tree, when it is complete."""
        if self._kids is None:
            self._kids = own = []
            for v in self.parts.values():
                if v.__class__ is Node:
                    own.append(v)
                elif v.__class__ is list:
                    own += [x for x in v if x.__class__ is Node]
        return self._kids

    def __repr__(self):
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.parts.items())})"


def unescape(raw: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}

    def one(m):
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"
        return plain.get(m[4], m[4])

    return _ESCAPE.sub(one, raw)


@contextmanager
def room(text: str):
    """Room for as many nested calls as the text can need."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(before + CALLS * len(text) + 1000, 2**31 - 1))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class Parser:
    def __init__(self, text: str):
        self.s, self.n = text, len(text)
        self.end = 0
        self.token = None
        self.seen, self.closes, self.templates = {}, {}, {}
        self.advance(False)

    # tokens: (kind, value, start, end, newline before, raw)
    def scan(self, at: int, after_value: bool):
        """The token from ``at`` on.  Looking ahead reads most tokens twice, and only a slash depends on what came before."""
        out = self.seen.get(at)
        if out is None:
            out = self._scan(at, after_value)
            if not self.s.startswith("/", out[2]):
                self.seen[at] = out
        return out

    def _scan(self, at: int, after_value: bool):
        m = _SPACE.match(self.s, at)
        line = bool(m and _LINE.search(m[0]))
        at = m.end() if m else at
        if at >= self.n:
            return ("end", "", at, at, line)
        c = self.s[at]
        if c in "'\"":
            m = _STRING.match(self.s, at)
            kind = "string"
        elif c == "`":
            return ("template", "`", at, at + 1, line)
        elif c.isdigit() or c == "." and self.s[at + 1 : at + 2].isdigit():
            m, kind = _NUMBER.match(self.s, at), "number"
        elif c == "/" and not after_value and (m := _REGEX.match(self.s, at)):
            kind = "regex"
        else:
            m = _NAME.match(self.s, at)
            kind = "name"
            if not m:
                m, kind = _PUNCT.match(self.s, at), "punct"
        if not m:
            raise SyntaxError(f"unexpected character at {at}")
        return (kind, m[0], at, m.end(), line)

    def advance(self, after_value: bool):
        old = self.token
        if old:
            self.end = old[3]
        self.token = self.scan(self.end, after_value)
        self.seen.pop(self.end, None)  # it was read ahead, and is read now
        return old

    def mark(self):
        return self.end, self.token

    def back(self, mark):
        self.end, self.token = mark

    def rescan(self, after_value: bool):
        """Read the present token anew, now that it's known whether a value came before."""
        if self.token[0] != "end" and not self.s.startswith("/", self.token[2]):
            return
        self.token = self.scan(self.token[2], after_value)[:4] + (self.token[4],)

    def is_(self, value: str) -> bool:
        return self.token[0] in ("punct", "name") and self.token[1] == value

    def take(self, value: str, after: bool = False) -> bool:
        if self.is_(value):
            self.advance(after)
            return True
        return False

    def need(self, value: str, after: bool = False):
        if not self.take(value, after):
            raise SyntaxError(f"expected {value} at {self.token[2]}, found {self.token[1]!r}")

    def semicolon(self):
        if self.take(";") or self.is_("}") or self.token[0] == "end" or self.token[4]:
            return
        raise SyntaxError(f"unexpected {self.token[1]!r} at {self.token[2]}")

    # statements
    def program(self) -> Node:
        body = []
        while self.token[0] != "end":
            body.append(self.statement())
        return Node("program", 0, body=body)

    def block(self) -> Node:
        at = self.token[2]
        self.need("{")
        body = []
        while not self.is_("}"):
            if self.token[0] == "end":
                raise SyntaxError("unclosed block")
            body.append(self.statement())
        self.advance(False)
        return Node("block", at, body=body)

    def statement(self) -> Node:
        kind, v, at = self.token[:3]
        if kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.advance(False)
                return Node("empty", at)
            if v == "@":
                self.advance(False)
                self.unary()
                return self.statement()
        if kind == "name":
            if v in ("var", "const") or v == "let" and self.peek()[1] not in ("=", ";", ".", "(", ",", ")", "=>", "in", "instanceof"):
                d = self.declaration()
                self.semicolon()
                return d
            if v == "function" or v == "async" and self.peek()[1] == "function" and not self.peek()[4]:
                f = self.function()
                return Node("function_declaration", at, name=f.name, function=f)
            if v == "class":
                return Node("class_declaration", at, body=self.class_())
            if v == "if":
                self.advance(False)
                test = self.parens()
                yes = self.statement()
                no = self.statement() if self.take("else") else None
                return Node("if", at, test=test, yes=yes, no=no)
            if v == "for":
                return self.for_()
            if v == "while":
                self.advance(False)
                return Node("while", at, test=self.parens(), body=self.statement())
            if v == "do":
                self.advance(False)
                body = self.statement()
                self.need("while")
                test = self.parens()
                self.take(";")
                return Node("do", at, body=body, test=test)
            if v in ("return", "throw"):
                self.advance(False)
                value = None if self.is_(";") or self.is_("}") or self.token[0] == "end" or self.token[4] else self.expression()
                self.semicolon()
                return Node(v, at, value=value)
            if v in ("break", "continue", "debugger"):
                self.advance(False)
                if self.token[0] == "name" and not self.token[4] and self.token[1] not in RESERVED:
                    self.advance(False)
                self.semicolon()
                return Node("jump", at)
            if v == "try":
                self.advance(False)
                body, param, catch, final = self.block(), None, None, None
                if self.take("catch"):
                    if self.take("("):
                        param = self.pattern()
                        self.need(")")
                    catch = self.block()
                if self.take("finally"):
                    final = self.block()
                if catch is None and final is None:
                    raise SyntaxError("try alone")
                return Node("try", at, body=body, param=param, catch=catch, final=final)
            if v == "switch":
                self.advance(False)
                on, cases = self.parens(), []
                self.need("{")
                while not self.take("}"):
                    if self.take("default"):
                        self.need(":")
                    elif self.take("case"):
                        cases.append(self.expression())
                        self.need(":")
                    else:
                        cases.append(self.statement())
                return Node("switch", at, on=on, cases=cases)
            if v == "import" and self.peek()[1] not in ("(", "."):
                return self.import_()
            if v == "export":
                return self.export()
            if self.peek()[1] == ":" and v not in RESERVED:
                self.advance(True)
                self.advance(False)
                return self.statement()
        e = self.expression()
        self.semicolon()
        return Node("expression", at, value=e)

    def peek(self):
        return self.scan(self.token[3], True)

    def parens(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def declaration(self, no_in: bool = False) -> Node:
        at, how = self.token[2], self.advance(False)[1]
        items = []
        while True:
            start = self.token[2]
            name = self.pattern()
            init = self.assignment(no_in) if self.take("=") else None
            items.append(Node("declarator", start, name=name, init=init))
            if not self.take(","):
                return Node("declaration", at, how=how, items=items)

    def for_(self) -> Node:
        at = self.advance(False)[2]
        self.take("await")
        self.need("(")
        init = None
        if not self.is_(";"):
            if self.token[1] in ("var", "const") or self.token[1] == "let" and self.peek()[1] not in ("in", "of", "=", ";"):
                init = self.declaration(True)
            else:
                init = self.expression(True)
        if self.take("of"):
            over = self.assignment()
        elif self.take("in"):
            over = self.expression()
        else:
            self.need(";")
            test = None if self.is_(";") else self.expression()
            self.need(";")
            step = None if self.is_(")") else self.expression()
            self.need(")")
            return Node("for", at, init=init, test=test, step=step, body=self.statement())
        self.need(")")
        return Node("for_each", at, init=init, over=over, body=self.statement())

    def import_(self) -> Node:
        at = self.advance(False)[2]
        while self.token[0] != "string":
            if self.token[0] == "end" or self.is_(";"):
                raise SyntaxError("import")
            self.advance(True)
        self.advance(False)
        if self.take("with") or self.is_("assert") and not self.token[4] and self.take("assert"):
            self.object_()
        self.semicolon()
        return Node("import", at)

    def export(self) -> Node:
        at = self.advance(False)[2]
        if self.take("default"):
            if self.token[1] in ("function", "class") or self.token[1] == "async" and self.peek()[1] == "function":
                v = self.class_() if self.is_("class") else self.function()
            else:
                v = self.assignment()
                self.semicolon()
            return Node("export", at, value=v)
        if self.is_("*") or self.is_("{"):
            while not (self.token[0] == "end" or self.is_("}") or self.token[0] == "string" or self.is_("from")):
                self.advance(True)
            self.take("}")
            if self.take("from"):
                self.advance(False)
            self.semicolon()
            return Node("export", at)
        return Node("export", at, value=self.statement())

    # functions, classes, patterns
    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.is_(")"):
            if self.take("..."):
                out.append(self.pattern())
            else:
                p = self.pattern()
                out.append(Node("default", p.at, name=p, init=self.assignment()) if self.take("=") else p)
            if not self.take(","):
                break
        self.need(")")
        return out

    def function(self) -> Node:
        at = self.token[2]
        self.take("async")
        self.need("function")
        self.take("*")
        name = None
        if self.token[0] == "name" and not self.is_("("):
            name = self.advance(True)[1]
        return Node("function", at, name=name, params=self.params(), body=self.body())

    def body(self) -> Node:
        return self.block()

    def class_(self) -> Node:
        at = self.advance(False)[2]
        name = self.advance(False)[1] if self.token[0] == "name" and self.token[1] != "extends" else None
        base = self.postfix() if self.take("extends") else None
        self.need("{")
        members = []
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.take("@"):
                self.unary()
                continue
            members.append(self.member(True))
        return Node("class", at, name=name, base=base, members=members)

    def member(self, in_class: bool) -> Node:
        at = self.token[2]
        if in_class and self.is_("static") and self.peek()[1] == "{":
            self.advance(False)
            return Node("static_block", at, body=self.block())
        while self.token[1] in ("static", "async", "get", "set", "accessor") and self.token[0] == "name" and self.peek()[1] not in ("(", "=", ";", ",", ":", "}") and not (self.peek()[4] and self.token[1] != "static"):
            self.advance(False)
        self.take("*")
        computed, key = False, None
        if self.take("["):
            computed, key = True, self.assignment()
            self.need("]")
        elif self.token[0] == "string":
            t = self.advance(True)
            key = Node("string", t[2], value=unescape(t[1][1:-1]))
        elif self.token[0] in ("name", "number"):
            t = self.advance(True)
            key = Node("key", t[2], value=t[1])
        else:
            raise SyntaxError(f"unexpected {self.token[1]!r} at {self.token[2]}")
        if self.is_("("):
            f = Node("function", at, name=None, params=self.params(), body=self.body())
            return Node("method", at, key=key, computed=computed, function=f)
        if in_class:
            value = self.assignment() if self.take("=") else None
            self.semicolon()
            return Node("field", at, key=key, computed=computed, value=value)
        if self.take(":"):
            return Node("property", at, key=key, computed=computed, value=self.assignment())
        if key.kind != "key" or key.value in RESERVED:
            raise SyntaxError("property")
        short = Node("ident", key.at, name=key.value)
        init = self.assignment() if self.take("=") else None
        return Node("shorthand", at, key=key, value=short, init=init)

    def pattern(self) -> Node:
        at = self.token[2]
        if self.is_("[") or self.is_("{"):
            e = self.array() if self.is_("[") else self.object_()
            return Node("pattern", at, value=e)
        if self.token[0] == "name" and self.token[1] not in RESERVED:
            return Node("ident", at, name=self.advance(True)[1])
        raise SyntaxError(f"unexpected {self.token[1]!r} at {at}")

    # expressions
    def expression(self, no_in: bool = False) -> Node:
        e = self.assignment(no_in)
        if not self.is_(","):
            return e
        items = [e]
        while self.take(","):
            items.append(self.assignment(no_in))
        return Node("sequence", e.at, items=items)

    def assignment(self, no_in: bool = False) -> Node:
        at = self.token[2]
        if arrow := self.arrow():
            return arrow
        if self.is_("yield"):
            self.advance(False)
            self.take("*")
            some = self.token[0] != "end" and not self.token[4] and self.token[1] not in (")", "]", "}", ",", ";", ":")
            return Node("yield", at, value=self.assignment(no_in) if some else None)
        left = self.conditional(no_in)
        if self.token[0] == "punct" and self.token[1] in ASSIGN:
            if left.kind not in ("ident", "member", "array", "object", "paren"):
                raise SyntaxError("assignment to a value")
            op = self.advance(False)[1]
            return Node("assign", at, op=op, left=left, right=self.assignment(no_in))
        return left

    def arrow(self) -> Node | None:
        at, start = self.token[2], self.mark()
        kind, v = self.token[:2]
        if kind == "name" and (v not in RESERVED):
            nxt = self.peek()
            if nxt[1] == "=>" and not nxt[4]:
                p = [self.pattern()]
                self.advance(False)
                return Node("arrow", at, params=p, body=self.arrow_body())
            if v == "async" and not nxt[4] and (nxt[1] == "(" or nxt[0] == "name" and nxt[1] not in RESERVED):
                self.advance(False)
                if self.token[0] == "name":
                    if self.peek()[1] == "=>":
                        p = [self.pattern()]
                        self.advance(False)
                        return Node("arrow", at, params=p, body=self.arrow_body())
                elif made := self.arrow():
                    return made
                self.back(start)
            return None
        if not (kind == "punct" and v == "("):
            return None
        close = self.matching()
        if close is None:
            return None
        after = self.scan(close, True)
        if after[1] != "=>" or after[4]:
            return None
        p = self.params()
        self.need("=>")
        return Node("arrow", at, params=p, body=self.arrow_body())

    def matching(self) -> int | None:
        """Where the parenthesis that opens here is closed, by tokens; None if it never is.  Those inside are remembered, so each is looked for once."""
        start = at = self.token[2]
        value, opened = False, []
        while start not in self.closes:
            try:
                t = self.scan(at, value)
                if t[0] == "template":
                    at, value = self.behind(t), True
                    continue
            except SyntaxError:
                t = ("end",)
            if t[0] == "end":
                self.closes.update(dict.fromkeys(opened))
                break
            if t[0] == "punct":
                if t[1] in "([{":
                    opened.append(t[2])
                elif t[1] in ")]}":
                    self.closes[opened.pop()] = t[3]
            at = t[3]
            value = t[0] in ("string", "number", "regex") or t[0] == "name" and t[1] not in RESERVED - {"this", "super", "null", "true", "false"} or t[1] in (")", "]", "}")
        return self.closes[start]

    def behind(self, t) -> int:
        """Where the token after a template begins that is read ahead."""
        save = self.mark()
        try:
            self.token = t
            self.templates[t[2]] = self.template(), self.end, self.token
            return self.token[2]
        finally:
            self.back(save)

    def arrow_body(self) -> Node:
        return self.block() if self.is_("{") else self.assignment()

    def conditional(self, no_in: bool) -> Node:
        test = self.binary(0, no_in)
        if not self.take("?"):
            return test
        yes = self.assignment()
        self.need(":")
        return Node("conditional", test.at, test=test, yes=yes, no=self.assignment(no_in))

    def binary(self, least: int, no_in: bool) -> Node:
        if self.token[0] == "name" and self.token[1].startswith("#") and self.peek()[1] == "in":
            t = self.advance(True)
            left = Node("key", t[2], value=t[1])
        else:
            left = self.unary()
        while True:
            op = self.token[1]
            power = POWER.get(op, 0) if self.token[0] in ("punct", "name") else 0
            if power <= least or op == "in" and no_in:
                return left
            self.advance(False)
            right = self.binary(power - (op == "**"), no_in)
            left = Node("binary", left.at, op=op, left=left, right=right)

    def unary(self) -> Node:
        kind, v, at = self.token[:3]
        if kind == "punct" and v in ("!", "~", "+", "-", "++", "--") or kind == "name" and v in ("typeof", "void", "delete") or kind == "name" and v == "await" and self.peek()[1] not in (")", ",", ";", "=", ".", "=>", "]", "}"):
            self.advance(False)
            return Node("unary", at, op=v, value=self.unary())
        e = self.postfix()
        if self.token[1] in ("++", "--") and self.token[0] == "punct" and not self.token[4]:
            self.advance(True)
            return Node("unary", at, op="post", value=e)
        return e

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.is_(")"):
            at = self.token[2]
            spread = self.take("...")
            e = self.assignment()
            out.append(Node("spread", at, value=e) if spread else e)
            if not self.take(","):
                break
        self.need(")", True)
        return out

    def postfix(self) -> Node:
        at = self.token[2]
        if self.is_("new"):
            e = self.new_()
        else:
            e = self.primary()
        while True:
            if self.token[0] == "template":
                e = Node("tagged", at, tag=e, value=self.template())
            elif self.take("."):
                e = self.named(e, at)
            elif self.is_("?."):
                self.advance(False)
                if self.is_("("):
                    e = Node("call", at, callee=e, args=self.arguments())
                elif self.take("["):
                    e = self.indexed(e, at)
                else:
                    e = self.named(e, at)
            elif self.is_("["):
                self.advance(False)
                e = self.indexed(e, at)
            elif self.is_("("):
                e = Node("call", at, callee=e, args=self.arguments())
            else:
                return e

    def named(self, e: Node, at: int) -> Node:
        if self.token[0] != "name":
            raise SyntaxError(f"a name is missing at {self.token[2]}")
        t = self.advance(True)
        return Node("member", at, object=e, name=t[1], index=None)

    def indexed(self, e: Node, at: int) -> Node:
        i = self.expression()
        self.need("]", True)
        return Node("member", at, object=e, name=None, index=i)

    def new_(self) -> Node:
        at = self.advance(False)[2]
        if self.take("."):
            self.advance(True)
            return Node("meta", at)
        callee = self.new_() if self.is_("new") else self.primary()
        while True:
            if self.take("."):
                callee = self.named(callee, at)
            elif self.is_("["):
                self.advance(False)
                callee = self.indexed(callee, at)
            else:
                break
        return Node("new", at, callee=callee, args=self.arguments() if self.is_("(") else [])

    def primary(self) -> Node:
        self.rescan(False)
        kind, v, at, _, _ = self.token
        if kind == "string":
            self.advance(True)
            return Node("string", at, value=unescape(v[1:-1]))
        if kind == "number":
            self.advance(True)
            return Node("number", at, value=v)
        if kind == "regex":
            self.advance(True)
            return Node("regex", at, value=v)
        if kind == "template":
            return self.template()
        if kind == "name":
            if v == "function" or v == "async" and self.peek()[1] == "function" and not self.peek()[4]:
                f = self.function()
                self.rescan(True)
                return f
            if v == "class":
                c = self.class_()
                self.rescan(True)
                return c
            if v in ("this", "super", "null", "true", "false"):
                self.advance(True)
                return Node(v if v in ("this", "super") else "constant", at, value=v)
            if v == "import":
                self.advance(False)
                if self.take("."):
                    self.advance(True)
                    return Node("meta", at)
                return Node("ident", at, name="import")
            if v in RESERVED:
                raise SyntaxError(f"unexpected {v} at {at}")
            self.advance(True)
            return Node("ident", at, name=v)
        if v == "(":
            self.advance(False)
            e = self.expression()
            self.need(")", True)
            return Node("paren", at, value=e)
        if v == "[":
            return self.array()
        if v == "{":
            return self.object_()
        if v == "<":
            return self.jsx()
        raise SyntaxError(f"unexpected {v!r} at {at}")

    def array(self) -> Node:
        at = self.advance(False)[2]
        items = []
        while not self.is_("]"):
            if self.take(","):
                continue
            start = self.token[2]
            spread = self.take("...")
            e = self.assignment()
            items.append(Node("spread", start, value=e) if spread else e)
            if not self.is_("]"):
                self.need(",")
        self.advance(True)
        return Node("array", at, items=items)

    def object_(self) -> Node:
        at = self.token[2]
        self.need("{")
        items = []
        while not self.is_("}"):
            start = self.token[2]
            if self.take("..."):
                items.append(Node("spread", start, value=self.assignment()))
            else:
                items.append(self.member(False))
            if not self.is_("}"):
                self.need(",")
        self.advance(True)
        return Node("object", at, items=items)

    def template(self) -> Node:
        at = i = self.token[2]
        if at in self.templates:  # read ahead
            node, self.end, self.token = self.templates.pop(at)
            return node
        i += 1
        texts, values, start = [], [], i
        while True:
            if i >= self.n:
                raise SyntaxError("unclosed template")
            c = self.s[i]
            if c == "\\":
                i += 2
            elif c == "`":
                texts.append(self.s[start:i])
                break
            elif c == "$" and self.s[i + 1 : i + 2] == "{":
                texts.append(self.s[start:i])
                self.end, self.token = i + 2, None
                self.advance(False)
                values.append(self.expression())
                if not self.is_("}"):
                    raise SyntaxError("unclosed substitution")
                i = start = self.token[3]
            else:
                i += 1
        self.end, self.token = i + 1, None
        self.advance(True)
        return Node("template", at, texts=texts, values=values)

    def jsx(self) -> Node:
        at = self.token[2]
        node, i = self._jsx(at)
        self.end, self.token = i, None
        self.advance(True)
        return node

    def _jsx(self, i: int) -> tuple[Node, int]:
        at = i
        m = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*").match(self.s, i)
        if not m:
            raise SyntaxError("tag")
        name, i, attrs, kids = m[1], m.end(), [], []
        while True:
            m = re.compile(r"\s*(/?>)").match(self.s, i)
            if m:
                i = m.end()
                if m[1] == "/>":
                    return Node("jsx", at, tag=name, attrs=attrs, kids_=kids), i
                break
            m = re.compile(r"\s*([A-Za-z_$][\w$:-]*)(?:\s*=\s*(?:(\"[^\"]*\"|'[^']*')|(\{)))?").match(self.s, i)
            if m:
                value = None
                i = m.end()
                if m[3]:
                    value, i = self._braced(i)
                attrs.append(Node("jsx_attr", m.start(1), name=m[1], value=value))
                continue
            m = re.compile(r"\s*\{\s*\.\.\.").match(self.s, i)
            if not m:
                raise SyntaxError("attribute")
            value, i = self._braced(m.end())
            attrs.append(Node("spread", m.start(), value=value))
        while True:
            if i >= self.n:
                raise SyntaxError("unclosed tag")
            if self.s.startswith("</", i):
                m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.s, i)
                if not m or m[1] != name:
                    raise SyntaxError("closing tag")
                return Node("jsx", at, tag=name, attrs=attrs, kids_=kids), m.end()
            if self.s[i] == "<":
                kid, i = self._jsx(i)
                kids.append(kid)
            elif self.s[i] == "{":
                m = _SPACE.match(self.s, i + 1)
                j = m.end() if m else i + 1
                if self.s[j : j + 1] == "}":
                    i = j + 1
                else:
                    kid, i = self._braced(i + 1)
                    kids.append(kid)
            else:
                i += 1

    def _braced(self, i: int) -> tuple[Node, int]:
        self.end, self.token = i, None
        self.advance(False)
        e = self.expression()
        if not self.is_("}"):
            raise SyntaxError("unclosed expression")
        return e, self.token[3]


def parse(text: str | None) -> Node | None:
    """The tree, or None for empty or unparseable text."""
    if not text or not text.strip():
        return None
    try:
        with room(text):
            return Parser(text).program()
    except SyntaxError:
        return None


class Places:
    """Line and column, both from 1, of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, at: int) -> str:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        return f"{line}:{at - self.starts[line - 1] + 1}"
