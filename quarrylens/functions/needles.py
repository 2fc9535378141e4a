"""Literals that every match of a regex contains, so that a text without any of them needs no regex.

``required`` finds them by reading the regex; ``Index`` shares them among patterns: a text is probed once for each needle, and
only the patterns whose needles it has are tried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose case folding leaves ASCII: such a text is tried with all patterns that ignore case.
ODD = "[İıſK]"


def _best(options: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest literal is the longest; of equal ones the smaller set."""
    return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=frozenset())


def _of(parsed) -> frozenset[str]:
    """A set of literals one of which every match of the sequence contains; empty if there is none."""
    options, run = [], ""

    def close() -> None:
        nonlocal run
        options.append(frozenset([run] if run else []))
        run = ""

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name == "AT":
            continue
        close()
        if name == "SUBPATTERN":
            options.append(_of(arg[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            options.append(_of(arg[2]))
        elif name == "BRANCH":
            each = [_of(b) for b in arg[1]]
            options.append(frozenset().union(*each) if all(each) else frozenset())
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            options.append(frozenset(chr(c) for _, c in arg))
    close()
    return _best(options)


def required(regex: str) -> tuple[frozenset[str], bool]:
    """(literals, whether case is ignored); no literals if the regex needs none, or isn't understood."""
    try:
        parsed = re._parser.parse(regex)
    except (re.error, AttributeError, OverflowError, RecursionError):
        return frozenset(), False
    fold = bool(parsed.state.flags & re.IGNORECASE)
    found = _of(parsed)
    if fold:
        found = frozenset(f.lower() for f in found)
        if not all(f.isascii() for f in found):
            return frozenset(), True
    return frozenset(f for f in found if not any(g != f and g in f for g in found)), fold


class Index:
    """Needles of numbered regexes.  ``given``: literals known beforehand, where they are longer than those found."""

    def __init__(self, regexes: list[str], given: list[tuple[str, ...]] | None = None) -> None:
        self.exact: dict[str, list[int]] = {}
        self.folded: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, regex in enumerate(regexes):
            found, fold = required(regex)
            if given and given[k] and not fold and min(map(len, given[k])) > min(map(len, found), default=0):
                found = frozenset(given[k])
            for needle in found:
                (self.folded if fold else self.exact).setdefault(needle, []).append(k)
            if not found:
                self.always.append(k)

    def hits(self, text: Column, low: Column, odd: Column) -> Column:
        """The numbers of the regexes that may match, each once.  ``low``: the text in lower case; ``odd``: whether it has a letter of ``ODD``."""
        each = [F.when(F.contains(text, F.lit(n)), F.array(*map(F.lit, ks))) for n, ks in sorted(self.exact.items())]
        each += [F.when(odd | F.contains(low, F.lit(n)), F.array(*map(F.lit, ks))) for n, ks in sorted(self.folded.items())]
        own = F.array_distinct(F.flatten(F.array_compact(F.array(*each)))) if each else F.array().cast("array<int>")
        return F.concat(F.array(*map(F.lit, self.always)), own) if self.always else own
