"""Terms of the rule language: logic variables and constraint trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(slots=True)
class Var:
    """A logic variable; its identity is its name.  `where` constrains the entity bound to it."""

    name: str
    where: Q | None = None

    def __repr__(self) -> str:
        return f"Var({self.name!r})" if self.where is None else f"Var({self.name!r}, where={self.where!r})"


class Q:
    """A boolean tree over `path__lookup=value` leaves; `&`, `|`, `^` and `~` combine trees."""

    __slots__ = ("children", "connector", "negated")

    def __init__(self, *children: Q | tuple[str, Any], connector: str = "AND", negated: bool = False, **leaves: Any):
        if connector not in ("AND", "OR", "XOR"):
            raise ValueError(f"unknown connector {connector}")
        self.children = [*children, *sorted(leaves.items())]
        self.connector, self.negated = connector, negated

    def _with(self, other: Any, connector: str) -> Q:
        if not isinstance(other, Q):
            raise TypeError(f"a constraint can't be combined with {type(other).__name__}")
        if not self.children:
            return other
        return Q(self, other, connector=connector) if other.children else self

    def __and__(self, other: Any) -> Q:
        return self._with(other, "AND")

    def __or__(self, other: Any) -> Q:
        return self._with(other, "OR")

    def __xor__(self, other: Any) -> Q:
        return self._with(other, "XOR")

    def __invert__(self) -> Q:
        return Q(*self.children, connector=self.connector, negated=not self.negated)

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Q) and (self.children, self.connector, self.negated) == (other.children, other.connector, other.negated)

    __hash__ = None

    def __repr__(self) -> str:
        inside = f" {self.connector} ".join(repr(c) if isinstance(c, Q) else f"{c[0]}={c[1]!r}" for c in self.children)
        return f"~({inside})" if self.negated else f"({inside})"

    def leaves(self) -> Iterator[tuple[str, Any]]:
        for child in self.children:
            if isinstance(child, Q):
                yield from child.leaves()
            else:
                yield child

    def mapped(self, change: Callable[[str, Any], tuple[str, Any]]) -> Q:
        """The same tree with every leaf changed."""
        return Q(*(c.mapped(change) if isinstance(c, Q) else change(*c) for c in self.children), connector=self.connector, negated=self.negated)

    def prefixed(self, prefix: str) -> Q:
        """The same tree one relation further away."""
        return self.mapped(lambda path, value: (f"{prefix}__{path}", value))

    def conjuncts(self) -> list[Q]:
        """Trees whose conjunction is this tree."""
        if self.negated or self.connector != "AND" and len(self.children) > 1:
            return [self]
        out: list[Q] = []
        for child in self.children:
            out += child.conjuncts() if isinstance(child, Q) else [Q(child)]
        return out


def _vars_in(value: Any) -> Iterator[str]:
    if isinstance(value, Var):
        yield value.name
    elif isinstance(value, (list, tuple)):
        for item in value:
            yield from _vars_in(item)


def has_variable_references(q: Q | None) -> bool:
    """Whether a leaf's value is a variable or a list that holds one."""
    return q is not None and any(True for _, value in q.leaves() for _ in _vars_in(value))


def extract_variable_references(q: Q | None) -> dict[str, list[str]]:
    """Variable name -> the leaf paths that mention it."""
    found: dict[str, list[str]] = {}
    for path, value in q.leaves() if q is not None else ():
        for name in _vars_in(value):
            found.setdefault(name, []).append(path)
    return found


def substitute_variables_in_q(q: Q, bindings: dict[str, Any]) -> Q:
    """The tree with bound variables replaced by their values; unbound ones stay."""

    def bound(value: Any) -> Any:
        if isinstance(value, Var):
            return bindings.get(value.name, value)
        if isinstance(value, (list, tuple)):
            return type(value)(bound(x) for x in value)
        return value

    return q.mapped(lambda path, value: (path, bound(value)))
