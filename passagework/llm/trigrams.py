"""Boolean trigram queries of regular expressions.

A query says which three-letter strings a text must hold before the expression can match:
``ALL`` (no condition), a trigram, or ``("and" | "or", queries)``. Letters are folded to
lower case, so one index serves patterns with and without regard to case.
"""

from __future__ import annotations

import re._constants as names
import re._parser as parser
from dataclasses import dataclass
from itertools import product

ALL = True
Query = bool | str | tuple
MOST_STRINGS = 48


def both(kind: str, *queries: Query) -> Query:
    """The conjunction or disjunction of queries, in a simple form."""
    parts: list[Query] = []
    for q in queries:
        if q is ALL:
            if kind == "or":
                return ALL
            continue
        for x in q[1] if isinstance(q, tuple) and q[0] == kind else (q,):
            if x not in parts:
                parts.append(x)
    if not parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: frozenset[str]) -> Query:
    """What every text holds that contains one of these strings."""
    if not strings:
        return ALL
    return both("or", *(
        both("and", *(s[i:i + 3] for i in range(len(s) - 2))) for s in sorted(strings)
    ))


@dataclass(frozen=True)
class _Facts:
    """Of an expression: all its strings if they are few, how matches begin and end, the query."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query

    @classmethod
    def of(cls, strings) -> _Facts:
        strings = frozenset(strings)
        return cls(strings, strings, strings, ALL)

    def loose(self) -> _Facts:
        """The same without the list of all strings."""
        if self.exact is None:
            return self
        cut = frozenset
        return _Facts(
            None, cut(s[:2] for s in self.exact), cut(s[-2:] for s in self.exact),
            both("and", self.query, _of_strings(self.exact)),
        )

    def then(self, after: _Facts) -> _Facts:
        if self.exact is not None and after.exact is not None:
            if len(self.exact) * len(after.exact) <= MOST_STRINGS:
                return _Facts.of(a + b for a, b in product(self.exact, after.exact))
        joint = frozenset(a[-2:] + b[:2] for a, b in product(self.ends, after.begins))
        x, y = self.loose(), after.loose()
        begins = [a + b for a, b in product(self.exact, after.begins)] if self.exact else self.begins
        ends = [a + b for a, b in product(self.ends, after.exact)] if after.exact else after.ends
        return _Facts(
            None, frozenset(s[:2] for s in begins), frozenset(s[-2:] for s in ends),
            both("and", x.query, y.query, _of_strings(joint)),
        )

    def either(self, other: _Facts) -> _Facts:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST_STRINGS:
            return _Facts.of(self.exact | other.exact)
        x, y = self.loose(), other.loose()
        return _Facts(None, x.begins | y.begins, x.ends | y.ends, both("or", x.query, y.query))


_ANY = _Facts(None, frozenset([""]), frozenset([""]), ALL)
_EMPTY = _Facts.of([""])


def _letters(items) -> frozenset[str] | None:
    """The folded letters of a character class, or None when they are many or open."""
    found: set[str] = set()
    for kind, value in items:
        if kind is names.LITERAL:
            found.add(chr(value).lower())
        elif kind is names.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 4 else None


def _facts(tree) -> _Facts:
    whole = _EMPTY
    for kind, value in tree:
        if kind is names.LITERAL:
            part = _Facts.of([chr(value).lower()])
        elif kind is names.IN:
            letters = _letters(value)
            part = _ANY if letters is None else _Facts.of(letters)
        elif kind is names.SUBPATTERN:
            part = _facts(value[-1])
        elif kind is names.BRANCH:
            parts = [_facts(x) for x in value[1]]
            part = parts[0]
            for x in parts[1:]:
                part = part.either(x)
        elif kind in (names.MAX_REPEAT, names.MIN_REPEAT):
            least, most, inner = value
            once = _facts(inner)
            if least == 0:
                part = once.either(_EMPTY) if most == 1 else _ANY
            else:
                part = once
                for _ in range(min(int(least), 3) - 1):
                    part = part.then(once)
                if least != most or least > 3:
                    loose = part.loose()
                    part = _Facts(None, loose.begins, once.loose().ends, loose.query)
        elif kind is names.AT:
            continue
        else:
            part = _ANY
        whole = whole.then(part)
    return whole


def trigram_query(pattern: str) -> Query:
    """The query of a pattern in Python's syntax; ``ALL`` when it has no mandatory trigram."""
    return _facts(parser.parse(pattern)).loose().query


def trigrams_of(query: Query) -> set[str]:
    """The trigrams that a query mentions."""
    if query is ALL:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1]))
