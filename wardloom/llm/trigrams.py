"""Boolean trigram queries from regular expressions: what the trigrams of a text must be for an expression to match in it.

Expressions are read in the subset that Java, RE2 and Python write alike: literals, escapes, classes, groups, ``(?i:``,
alternation and quantifiers. Letters count in either case. A query is True (any text), a trigram, or a tuple ``("and",
...)`` or ``("or", ...)`` of queries.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

Query = bool | str | tuple

#: The most strings that are followed through an expression, and the widest class that is spelt out.
MOST = 24
ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}


def _all(kind: str, queries: Iterable[Query]) -> Query:
    """``and`` or ``or`` of queries, flat, each once; an ``and`` leaves out True, an ``or`` with True is True."""
    out: list[Query] = []
    for q in queries:
        for x in q[1:] if isinstance(q, tuple) and q[0] == kind else (q,):
            if x not in out:
                out.append(x)
    if kind == "or" and True in out:
        return True
    if kind == "or":  # what asks for more than another asks for nothing
        parts = {repr(x): set(x[1:]) if isinstance(x, tuple) and x[0] == "and" else {x} for x in out}
        out = [x for x in out if not any(parts[repr(y)] < parts[repr(x)] for y in out)]
    out = sorted((x for x in out if x is not True), key=repr)
    return True if not out else out[0] if len(out) == 1 else (kind, *out)


def _of(strings: Iterable[str]) -> Query:
    """One of these strings is in the text."""
    return _all("or", (_all("and", {x[i : i + 3] for i in range(len(x) - 2)}) for x in strings))


def _few(strings: set[str], cut: slice | None = None) -> set[str]:
    """At most ``MOST`` strings, made fewer by taking less of each at one end."""
    keep = 3
    while len(strings) > MOST or (keep == 3 and any(len(x) > 3 for x in strings)):
        strings = {x[:keep] if cut == slice(0, None) else x[-keep:] if keep else "" for x in strings}
        keep -= 1
    return strings


@dataclass
class _Seen:
    """What is known of the strings that a part matches: all of them (``exact``) or how they begin and end, and a query."""

    exact: set[str] | None = None
    begins: set[str] = field(default_factory=lambda: {""})
    ends: set[str] = field(default_factory=lambda: {""})
    query: Query = True

    def opened(self) -> _Seen:
        """The same, without the list of all strings."""
        if self.exact is None:
            return self
        return _Seen(None, _few(self.exact, slice(0, None)), _few(self.exact), _all("and", (self.query, _of(self.exact))))

    def then(self, other: _Seen) -> _Seen:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return _Seen({a + b for a, b in product(self.exact, other.exact)}, query=_all("and", (self.query, other.query)))
        a, b = self.opened(), other.opened()
        left, right = (self.exact if self.exact is not None else a.ends), (other.exact if other.exact is not None else b.begins)
        met = {x[-2:] + y[:2] for x, y in product(left, right)} if len(left) * len(right) <= 64 * MOST else {""}
        begins = {x + y for x, y in product(self.exact, right)} if self.exact is not None and len(self.exact) * len(right) <= 64 * MOST else a.begins
        ends = {x + y for x, y in product(left, other.exact)} if other.exact is not None and len(left) * len(other.exact) <= 64 * MOST else b.ends
        return _Seen(None, _few(begins, slice(0, None)), _few(ends), _all("and", (a.query, b.query, _of(met))))

    def either(self, other: _Seen) -> _Seen:
        if self.exact is not None and other.exact is not None and len(self.exact) + len(other.exact) <= MOST:
            return _Seen(self.exact | other.exact, query=_all("or", (self.query, other.query)))
        a, b = self.opened(), other.opened()
        return _Seen(None, _few(a.begins | b.begins, slice(0, None)), _few(a.ends | b.ends), _all("or", (a.query, b.query)))

    def repeated(self, least: int, most: int | None) -> _Seen:
        if least == 0:
            return self.either(_Seen({""})) if most == 1 else _Seen()
        out = self
        for _ in range(min(least, 4) - 1):
            out = out.then(self)
        if most == least <= 4:
            return out
        # More copies may stand in between: it begins as some copies do and ends as some copies do.
        out = out.opened()
        return _Seen(None, out.begins, out.ends, out.query)


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, text: str) -> bool:
        if self.text.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> _Seen:
        out = self.sequence()
        while self.take("|"):
            out = out.either(self.sequence())
        return out

    def sequence(self) -> _Seen:
        out = _Seen({""})
        while self.peek() not in ("", "|", ")"):
            out = out.then(self.quantified())
        return out

    def quantified(self) -> _Seen:
        out = self.atom()
        while self.peek() and self.peek() in "*+?{":
            c, (least, most) = self.next(), (0, None)
            if c == "+":
                least = 1
            elif c == "?":
                most = 1
            elif c == "{":
                inside = self.text[self.at : self.text.index("}", self.at)]
                self.at += len(inside) + 1
                low, _, high = inside.partition(",")
                least, most = int(low or 0), int(high) if high else None if "," in inside else int(low)
            self.take("?")
            out = out.repeated(least, most)
        return out

    def atom(self) -> _Seen:
        if self.take("("):
            if not (self.take("?:") or self.take("?i:")) and self.peek() == "?":
                raise ValueError(f"not read: {self.text[self.at - 1:]}")
            out = self.alternatives()
            if not self.take(")"):
                raise ValueError(f"a group is not closed: {self.text}")
            return out
        if self.take("["):
            return self.of_class()
        c = self.next()
        if c == ".":
            return _Seen()
        if c in "^$":
            return _Seen({""})
        if c == "\\":
            found = self.escape()
            return _Seen({found.lower()}) if found is not None and len(found) == 1 else _Seen({""}) if found == "" else _Seen()
        return _Seen({c.lower()})

    def escape(self) -> str | None:
        """The character that an escape stands for; '' for an edge, None for one of many."""
        c = self.next()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c in "bBAzZ":
            return ""
        return ESCAPED.get(c, None if c.isalnum() else c)

    def of_class(self) -> _Seen:
        chars, open_, negated = set(), False, self.take("^")
        while not self.take("]"):
            c = self.next()
            if c == "\\":
                c = self.escape()
            if c is None:
                open_ = True
            elif self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                end = self.next()
                end = self.escape() if end == "\\" else end
                chars.update(chr(x).lower() for x in range(ord(c), ord(end) + 1))
            else:
                chars.add(c.lower())
        return _Seen() if negated or open_ or len(chars) > MOST // 2 else _Seen(chars)


def query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text has wherever ``pattern`` matches in it; True if there are none it must have."""
    reader = _Reader(pattern)
    found = reader.alternatives().opened()
    if reader.at != len(pattern):
        raise ValueError(f"not read to its end: {pattern}")
    return found.query


def trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1:]))


def holds(q: Query, text: str) -> bool:
    """Is the query true of a text in lower case?"""
    return q is True or (q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1:]))
