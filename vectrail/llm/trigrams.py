"""Boolean trigram queries that a pattern's matches must meet.

A query is ``True`` (anything may match), a trigram, or ``("and" | "or", parts)``.
Trigrams are lower-cased, so one index of lower-cased texts serves patterns of
either kind.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser

#: Sets of literal texts larger than this are given up.
MOST_TEXTS, MOST_CHARS = 64, 12


def _all(parts) -> tuple | str | bool:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts) -> tuple | str | bool:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_text(text: str):
    return _all(text[i : i + 3].lower() for i in range(len(text) - 2))


def _of_texts(texts):
    return _any(_of_text(t) for t in sorted(texts))


def _sequence(nodes):
    """(all texts that can match or None, query) of parts in a row."""
    queries, run, whole = [], {""}, True
    for node in nodes:
        texts, query = _node(node)
        queries.append(query)
        if texts is not None and len(texts) * len(run) <= MOST_TEXTS:
            run = {a + b for a, b in itertools.product(run, texts)}
            continue
        queries.append(_of_texts(run))
        run, whole = (texts, False) if texts is not None else ({""}, False)
    if whole:
        return run, _all(queries)
    return None, _all([*queries, _of_texts(run)])


def _node(node):
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg)}, True
    if kind is op.IN:
        chars: set[str] = set()
        for k, x in arg:
            if k is op.LITERAL:
                chars.add(chr(x))
            elif k is op.RANGE and x[1] - x[0] < MOST_CHARS:
                chars.update(map(chr, range(x[0], x[1] + 1)))
            else:
                return None, True
        return (chars, True) if len(chars) <= MOST_CHARS else (None, True)
    if kind is op.SUBPATTERN:
        return _sequence(arg[3])
    if kind is op.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(texts is not None for texts, _ in found):
            texts = set().union(*(t for t, _ in found))
            return texts if len(texts) <= MOST_TEXTS else None, True if len(texts) <= MOST_TEXTS else _of_texts(texts)
        return None, _any(_all([q, _of_texts(t) if t is not None else True]) for t, q in found)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = arg
        texts, query = _sequence(body)
        if (least, most) == (1, 1):
            return texts, query
        if (least, most) == (0, 1) and texts is not None:
            return texts | {""}, True
        if least == 0:
            return None, True
        return None, _all([query, _of_texts(texts) if texts is not None else True])
    if kind in (op.ASSERT, op.ASSERT_NOT, op.AT):
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """The query that every match of ``pattern`` meets."""
    texts, query = _sequence(re._parser.parse(pattern))
    return _all([query, _of_texts(texts) if texts is not None else True])


def clauses(query) -> list[frozenset[str]] | None:
    """The query as alternatives, each a set of trigrams of which all are needed; None if nothing is."""
    if query is True:
        return None
    if isinstance(query, str):
        return [frozenset([query])]
    parts = [clauses(q) for q in query[1]]
    if query[0] == "or":
        found = [c for p in parts for c in p]
    else:
        found = [frozenset().union(*x) for x in itertools.product(*parts)]
    # a clause that holds another one adds nothing
    return sorted({c for c in found if not any(d < c for d in found)}, key=sorted)
