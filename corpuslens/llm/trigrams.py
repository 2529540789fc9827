"""Boolean trigram queries of regular expressions.

A query is ``True`` (no text can be left out), a trigram, ("and", parts) or ("or", parts);
a text that matches the expression satisfies its query. Letters count in lower case, so one
index of lower-cased texts serves all expressions.

For every part of an expression there are: the strings it can match, if these are few; else
what matches can begin and end with (two characters decide what crosses a border), and a query.
"""

from __future__ import annotations

from itertools import product
from re import _constants as S
from re import _parser

#: Strings of a set at most, and characters of a class that are spelled out.
FEW = 32
CLASS = 8


class _Part:
    def __init__(self, exact=None, heads=frozenset([""]), tails=frozenset([""]), query=True):
        self.exact = exact
        self.heads, self.tails, self.query = (exact, exact, True) if exact is not None else (heads, tails, query)


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    parts = {x for q in (a, b) for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])}
    return next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(a, b):
    if a is True or b is True:
        return True
    parts = {x for q in (a, b) for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    # what asks for more than another part adds nothing
    parts = {x for x in parts if not any(y != x and _asked(y) <= _asked(x) for y in parts)}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _asked(q) -> frozenset:
    """Conjuncts of a query."""
    return q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q])


def spelled(strings):
    """All trigrams of one of the strings must be there."""
    out = None
    for s in sorted(strings):
        q = True
        for i in range(len(s) - 2):
            q = both(q, s[i:i + 3])
        out = q if out is None else either(out, q)
    return True if out is None else out


def _loose(p: _Part) -> _Part:
    """Without the exact set: its trigrams become the query."""
    if p.exact is None:
        return p
    return _Part(None, frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact), spelled(p.exact))


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= FEW:
        return _Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    x, y = _loose(a), _loose(b)
    query = both(x.query, y.query)
    # ends that are whole strings reach through a short neighbour; others stop at their two characters
    ends, starts = (a.exact or x.tails), (b.exact or y.heads)
    if len(ends) * len(starts) <= FEW * 2:
        query = both(query, spelled(e + s for e, s in product(ends, starts)))
    heads = frozenset((e + s)[:2] for e, s in product(a.exact, y.heads)) if a.exact is not None and len(a.exact) <= FEW else x.heads
    tails = frozenset((e + s)[-2:] for e, s in product(x.tails, b.exact)) if b.exact is not None and len(b.exact) <= FEW else y.tails
    return _Part(None, heads, tails, query)


def _any(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= FEW:
        return _Part(a.exact | b.exact)
    x, y = _loose(a), _loose(b)
    return _Part(None, x.heads | y.heads, x.tails | y.tails, either(x.query, y.query))


def _chars(items) -> frozenset | None:
    out = set()
    for op, arg in items:
        if op is S.LITERAL:
            out.add(chr(arg).lower())
        elif op is S.RANGE and arg[1] - arg[0] < 2 * CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= CLASS else None


def _sequence(nodes) -> _Part:
    out = _Part(frozenset([""]))
    for op, arg in nodes:
        out = _joined(out, _node(op, arg))
    return out


def _node(op, arg) -> _Part:
    if op is S.LITERAL:
        return _Part(frozenset([chr(arg).lower()]))
    if op is S.IN:
        chars = _chars(arg)
        return _Part(chars) if chars else _Part()
    if op is S.SUBPATTERN:
        return _sequence(arg[3])
    if op is S.ATOMIC_GROUP:
        return _sequence(arg)
    if op is S.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        out = parts[0]
        for p in parts[1:]:
            out = _any(out, p)
        return out
    if op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
        least, most, inner = arg
        one = _sequence(inner)
        if least == 0:
            return _any(_Part(frozenset([""])), one) if most == 1 else _Part()
        out = one
        for _ in range(min(least, 3) - 1):
            out = _joined(out, one)
        if least == most <= 3:
            return out
        x = _loose(out)
        return _Part(None, x.heads, x.tails, x.query)
    if op in (S.AT, S.ASSERT, S.ASSERT_NOT):
        return _Part(frozenset([""]))
    return _Part()  # any character, back references


def query_of(pattern: str):
    """The trigram query of an expression (also of one whose letters match in either case)."""
    p = _sequence(_parser.parse(pattern))
    return spelled(p.exact) if p.exact is not None else p.query


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))
