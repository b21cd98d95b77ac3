"""Boolean trigram queries of regular expressions.

``query(pattern)`` is a formula over trigrams that every text with a match satisfies:
``None`` (no trigram is mandatory: all texts are candidates) or a nested tuple ``("and" | "or", part, ...)`` with trigrams
as leaves.  Texts and trigrams are compared in lower case, so case does not weaken a query.  The pattern is read with the
standard library's parser; what that parser accepts and this analysis does not know counts as "anything".
"""

from __future__ import annotations

from re import _constants as c
from re import _parser as parser

#: Strings kept for one part of a pattern, and characters of a class that are tried one by one.
MOST_STRINGS, MOST_CHARACTERS = 40, 8


class Info:
    """exact: all strings that the part matches, or None; else prefixes and suffixes of its matches; need: its formula."""

    def __init__(self, exact=None, prefix=frozenset({""}), suffix=frozenset({""}), need=None):
        self.exact, self.prefix, self.suffix, self.need = exact, prefix, suffix, need


def _and(*parts):
    flat = []
    for p in parts:
        if p is not None:
            flat += p[1:] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*parts):
    if any(p is None for p in parts) or not parts:
        return None
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == "or" else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _of_strings(strings) -> object:
    """Each of the strings has its trigrams; one shorter than three characters has none, so nothing is mandatory."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _loose(i: Info) -> Info:
    """Without its exact strings, which became too many or end here."""
    if i.exact is None:
        return i
    return Info(None, frozenset(s[:2] for s in i.exact), frozenset(s[-2:] for s in i.exact), _of_strings(i.exact))


def _join(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Info(frozenset(x + y for x in a.exact for y in b.exact))
    ends = a.exact if a.exact is not None else a.suffix
    begins = b.exact if b.exact is not None else b.prefix
    across = None
    if len(ends) * len(begins) <= MOST_STRINGS:
        across = _of_strings(x[-2:] + y[:2] if a.exact is None or b.exact is None else x + y for x in ends for y in begins)
    la, lb = _loose(a), _loose(b)
    prefix, suffix = la.prefix, lb.suffix
    if a.exact is not None and len(a.exact) * len(lb.prefix) <= MOST_STRINGS:
        prefix = frozenset((x + y)[:2] for x in a.exact for y in lb.prefix)
    if b.exact is not None and len(b.exact) * len(la.suffix) <= MOST_STRINGS:
        suffix = frozenset((x + y)[-2:] for x in la.suffix for y in b.exact)
    return Info(None, prefix, suffix, _and(la.need, across, lb.need))


def _either(parts: list[Info]) -> Info:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return Info(frozenset().union(*(p.exact for p in parts)))
    parts = [_loose(p) for p in parts]
    return Info(None, frozenset().union(*(p.prefix for p in parts)), frozenset().union(*(p.suffix for p in parts)), _or(*(p.need for p in parts)))


ANYTHING = Info()


def _class(items) -> Info:
    chars: set[str] = set()
    for op, value in items:
        if op is c.LITERAL:
            chars.add(chr(value).lower())
        elif op is c.RANGE and value[1] - value[0] < 64:
            chars.update(chr(x).lower() for x in range(value[0], value[1] + 1))
        else:
            return ANYTHING
    return Info(frozenset(chars)) if 0 < len(chars) <= MOST_CHARACTERS else ANYTHING


def _walk(items) -> Info:
    out = Info(frozenset({""}))
    for op, value in items:
        if op is c.LITERAL:
            part = Info(frozenset({chr(value).lower()}))
        elif op is c.IN:
            part = _class(value)
        elif op is c.SUBPATTERN:
            part = _walk(value[-1])
        elif op is c.ATOMIC_GROUP:
            part = _walk(value)
        elif op is c.BRANCH:
            part = _either([_walk(x) for x in value[1]])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = value
            one = _walk(inner)
            if low == 0:
                part = _either([Info(frozenset({""})), one]) if high == 1 else ANYTHING
            else:
                part = one
                for _ in range(min(low, 8) - 1):
                    part = _join(part, one)
                if high != low or low > 8:
                    part = _loose(part)
                    part = Info(None, part.prefix, part.suffix if low <= 8 else _loose(one).suffix if one.exact is None else frozenset({""}), part.need)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            part = Info(frozenset({""}))
        else:
            part = ANYTHING
        out = _join(out, part)
    return out


def query(pattern: str):
    """The formula of a pattern; trigrams in lower case."""
    return _loose(_walk(parser.parse(pattern))).need


def leaves(need) -> list[str]:
    if need is None:
        return []
    if isinstance(need, str):
        return [need]
    return list(dict.fromkeys(t for part in need[1:] for t in leaves(part)))


def holds(need, has) -> bool:
    """Whether a set of trigrams satisfies a formula."""
    if need is None:
        return True
    if isinstance(need, str):
        return need in has
    return (all if need[0] == "and" else any)(holds(p, has) for p in need[1:])
