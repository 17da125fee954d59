"""Rewrites on patterns before they are compiled."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from ..facts import Fact, key_of
from ..operators.compile import variables_of
from ..terms import Q, Var


def optimize_query(patterns: list[Fact]) -> list[Fact]:
    """Each variable carries, wherever it occurs, the conjunction of all constraints on its name."""
    merged = {}
    for name, v in variables_of(patterns).items():
        every = v.simple + v.cross
        merged[name] = reduce(and_, every) if every else None
    return [type(p)(*(Var(t.name, where=merged[t.name]) if isinstance(t, Var) else t for t in p.terms)) for p in patterns]


def prefix_q(q: Q, prefix: str) -> Q:
    """A constraint on an entity as one on a row that refers to it."""
    return q.prefixed(prefix)


def fact_filters(pattern: Fact) -> tuple[dict[str, Any], list[Q]]:
    """A pattern's constants by side, and its constraints as constraints on the fact's row."""
    fixed, trees = {}, []
    for side, term in zip(("subject", "object"), pattern.terms, strict=True):
        if not isinstance(term, Var):
            fixed[side] = key_of(term)
        elif term.where is not None:
            trees.append(term.where.prefixed(side))
    return fixed, trees
