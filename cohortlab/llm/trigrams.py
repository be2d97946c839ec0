"""Boolean trigram queries from regular expressions.

A query is a list of alternatives (any may hold), each a frozenset of trigrams
that must all occur in a matching text. ``None`` means no trigram is mandatory.
Trigrams are of lower-cased ASCII, so one index serves either case.
"""

from __future__ import annotations

import re
from itertools import product

MAX_STRINGS = 64  # strings kept exactly while walking a pattern; more end the run early, which only loosens the query


def _strings(node) -> list[str] | None:
    """All strings one parsed item can match, or None when there are too many to list."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(arg)]
    if op == "IN":
        if any(str(k) != "LITERAL" for k, _ in arg):
            return None
        return [chr(v) for _, v in arg] if len(arg) <= MAX_STRINGS else None
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        one = _all(body)
        if one is None or int(high) > 3:
            return None
        out = {"".join(p) for n in range(low, int(high) + 1) for p in product(one, repeat=n)}
        return sorted(out) if len(out) <= MAX_STRINGS else None
    if op == "SUBPATTERN":
        return _all(arg[-1])
    if op == "BRANCH":
        parts = [_all(b) for b in arg[1]]
        return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
    if op == "AT":
        return [""]
    return None


def _all(seq) -> list[str] | None:
    out = [""]
    for node in seq:
        own = _strings(node)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = sorted({a + b for a in out for b in own})
    return out


def _grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _any_of(strings: list[str]):
    """Alternatives for "one of these strings occurs"; None if one has no trigram."""
    alts = {_grams(s) for s in strings}
    return None if frozenset() in alts else alts


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    return {x | y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else a


def _walk(seq):
    """Query for a concatenation: runs of listable items give mandatory strings,
    anything else either brings a query of its own or cuts the run."""
    query, run = None, [""]
    for node in seq:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= MAX_STRINGS:
            run = sorted({a + b for a in run for b in own})
            continue
        query, run = _and(query, _any_of(run)), [""]
        op, arg = str(node[0]), node[1]
        if own is not None:
            run = own
        elif op == "SUBPATTERN":
            query = _and(query, _walk(arg[-1]))
        elif op == "BRANCH":
            parts = [_walk(b) for b in arg[1]]
            if all(p is not None for p in parts):
                query = _and(query, set().union(*parts))
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            query = _and(query, _walk(arg[2]))
    return _and(query, _any_of(run))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams of ``pattern``, or None for a full scan.
    An alternative that holds another one's trigrams adds nothing and is left out."""
    alts = _walk(re._parser.parse(pattern))
    if alts is None:
        return None
    return sorted((a for a in alts if not any(b < a for b in alts)), key=sorted)
