"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of conjunctions: a set of sets of lower-cased trigrams, of which every text that the expression
matches holds one set whole. The query of one empty set says nothing: the rule has no mandatory trigram.

The expression's parse tree is walked bottom up. Of each part the walk knows, as far as they are few, the exact strings it
matches; otherwise what they begin and end with, and the query so far.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]]
#: Says nothing: every text fulfils it.
ANY: Query = frozenset([frozenset()])
#: Strings known of one part at most, alternatives of a query at most, and members of a class that is spelled out.
STRINGS, OPTIONS, CLASS = 64, 64, 16


def grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(options) -> Query:
    """Without options that hold another whole: fulfilling them fulfils the other."""
    options = sorted(set(options), key=len)
    out: list[frozenset[str]] = []
    for o in options:
        if not any(x <= o for x in out):
            out.append(o)
    return frozenset(out)


def either(a: Query, b: Query) -> Query:
    both = _least(a | b)
    return both if len(both) <= OPTIONS else ANY


def both(a: Query, b: Query) -> Query:
    """Where the product grows too large, the operand with fewer options alone: still fulfilled by every match."""
    if len(a) * len(b) > OPTIONS**2:
        return min(a, b, key=len)
    out = _least(x | y for x in a for y in b)
    return out if len(out) <= OPTIONS else min(a, b, key=len)


def of_strings(strings) -> Query:
    return _least(grams(s) for s in strings)


@dataclass(frozen=True)
class Part:
    """exact: all strings matched, or None; then heads and tails hold what each match begins and ends with."""

    exact: frozenset[str] | None = None
    heads: frozenset[str] = field(default=frozenset([""]))
    tails: frozenset[str] = field(default=frozenset([""]))
    query: Query = ANY

    def opened(self) -> Part:
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), of_strings(self.exact))


EMPTY, ANYTHING = Part(frozenset([""])), Part()


def after(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Part(frozenset(x + y for x in a.exact for y in b.exact))
    x, y = a.opened(), b.opened()
    query = both(x.query, y.query)
    if len(x.tails) * len(y.heads) <= STRINGS:
        query = both(query, of_strings(s + t for s in x.tails for t in y.heads))
    # a head may grow only where all of the part before it is known
    heads, tails = x.heads, y.tails
    if a.exact is not None and len(a.exact) * len(y.heads) <= STRINGS:
        heads = frozenset((s + t)[:2] for s in a.exact for t in y.heads)
    if b.exact is not None and len(b.exact) * len(x.tails) <= STRINGS:
        tails = frozenset((s + t)[-2:] for s in x.tails for t in b.exact)
    return Part(None, heads, tails, query)


def branch(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Part(a.exact | b.exact)
    x, y = a.opened(), b.opened()
    return Part(None, x.heads | y.heads, x.tails | y.tails, either(x.query, y.query))


def _class(members) -> Part:
    chars: set[str] = set()
    for kind, value in members:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < CLASS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    return Part(frozenset(chars)) if 0 < len(chars) <= CLASS and all(c.isascii() for c in chars) else ANYTHING


def _walk(tree) -> Part:
    out = EMPTY
    for kind, value in tree:
        if kind is op.LITERAL:
            part = Part(frozenset([chr(value).lower()])) if value < 128 else ANYTHING
        elif kind is op.IN:
            part = _class(value)
        elif kind is op.SUBPATTERN:
            part = _walk(value[3])
        elif kind is op.BRANCH:
            part, *others = [_walk(x) for x in value[1]]
            for x in others:
                part = branch(part, x)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one, part = _walk(inner), EMPTY
            if (least, most) == (0, 1):
                part = branch(EMPTY, one)
            else:
                # three copies hold every trigram that more would
                for _ in range(min(least, 3)):
                    part = after(part, one)
                part = part if least == most <= 3 else after(after(part, ANYTHING), one if least > 3 else EMPTY)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = EMPTY
        else:
            part = ANYTHING
        out = after(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """What every text holds, lower-cased, in which the pattern matches. Letters of either case count as one."""
    return _walk(parser.parse(pattern)).opened().query
