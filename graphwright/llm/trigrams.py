"""Boolean trigram queries of regular expressions: which trigrams must any match hold?

A query is in disjunctive form, a set of clauses, each a set of trigrams: a text can match only if
for some clause it holds all trigrams. ``None`` means that nothing is mandatory. Trigrams are of
lower-case text (A-Z folded), so one index serves patterns of either case.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

Query = frozenset[frozenset[str]] | None

#: Beyond these a set of literal strings is closed, and a query is given up as too wide.
MOST_STRINGS, MOST_CLAUSES, MOST_TRIGRAMS = 48, 64, 6
MOST_OF_CLASS = 8


def _least(clauses: set[frozenset[str]]) -> Query:
    """Drops clauses that another clause implies; an empty clause makes all void."""
    kept = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return None if frozenset() in kept or len(kept) > MOST_CLAUSES else kept


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=len)
    return _least({x | y for x in a for y in b})


def either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _least(set(a | b))


def _of_strings(strings: frozenset[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _class(items) -> frozenset[str] | None:
    """The characters of a small class, folded; None for a wide or negated one."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_OF_CLASS:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_OF_CLASS else None


def _walk(nodes) -> tuple[frozenset[str] | None, Query]:
    """(all strings the nodes can match, if few; the query that every match fulfils)."""
    run, exact, query = frozenset({""}), True, None
    for op, arg in nodes:
        strings, inner, open_end = None, None, False
        if op is C.LITERAL:
            strings = frozenset({chr(arg).lower()})
        elif op is C.IN:
            strings = _class(arg)
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = frozenset().union(*(s for s, _ in parts))
            else:
                inner = parts[0][1] if parts[0][0] is None else both(parts[0][1], _of_strings(parts[0][0]))
                for s, q in parts[1:]:
                    inner = either(inner, q if s is None else both(q, _of_strings(s)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            got, q = _walk(body)
            if (low, high) == (0, 1) and got is not None:
                strings = got | {""}
            elif low and got is not None:
                strings, open_end = got, (low, high) != (1, 1)
            elif low:
                inner = q
        elif op is C.AT:
            continue
        if strings is not None and len(strings) <= MOST_STRINGS and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            if not open_end:
                continue
            strings = None
        exact = False
        query = both(query, _of_strings(run))
        if strings is not None:
            inner = both(inner, _of_strings(strings))
        query, run = both(query, inner), frozenset({""})
    return (run, query) if exact else (None, both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The mandatory trigrams of ``pattern``; of a long clause the first ``MOST_TRIGRAMS`` in order."""
    strings, query = _walk(parser.parse(pattern))
    if strings is not None:
        query = both(query, _of_strings(strings))
    return query and _least({frozenset(sorted(c)[:MOST_TRIGRAMS]) for c in query})
