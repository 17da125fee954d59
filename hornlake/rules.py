"""Horn clauses and scoped rule sets."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any

from .facts import Fact


@dataclass
class Rule:
    """`head` holds wherever all facts of `body` hold."""

    head: Fact
    body: list[Fact]

    def __repr__(self) -> str:
        return f"Rule({self.head!r} :- {', '.join(map(repr, self.body))})"


#: Rules are values of a context, so threads and tasks that scope rules don't see each other's.
_rules: ContextVar[tuple[Rule, ...]] = ContextVar("rules", default=())


def alternatives(body: Any) -> list[list[Fact]]:
    """A body as a disjunction of conjunctions; lists inside conjunctions are multiplied out."""
    if isinstance(body, Fact):
        return [[body]]
    if isinstance(body, list):
        return [conjunction for part in body for conjunction in alternatives(part)]
    if isinstance(body, tuple):
        out: list[list[Fact]] = [[]]
        for part in body:
            out = [left + right for left in out for right in alternatives(part)]
        return out
    raise TypeError(f"a rule's body can't hold {type(body).__name__}")


def clauses(head: Fact, body: Any) -> list[Rule]:
    if not isinstance(head, Fact):
        raise TypeError(f"a rule's head must be a fact, not {type(head).__name__}")
    if not type(head).inferred:
        raise TypeError(f"Rule head {type(head).__name__} must be marked with inferred=True")
    return [Rule(head, conjunction) for conjunction in alternatives(body)]


def rule(head: Fact, body: Any) -> None:
    """Add the clause head :- body; a tuple or `&` is a conjunction, a list or `|` gives a clause for each alternative."""
    _rules.set((*_rules.get(), *clauses(head, body)))


def get_rules() -> list[Rule]:
    """A copy of the rules in force."""
    return list(_rules.get())


class rule_context:  # noqa: N801  used like a function
    """Rules added inside are gone afterwards, also after an error.

    `with rule_context():`, `@rule_context`, `@rule_context()`, or with rules to add: `rule_context(Rule(...), ...)`.
    """

    def __new__(cls, *args: Any):
        if len(args) == 1 and callable(args[0]) and not isinstance(args[0], (Rule, Fact)):
            return super().__new__(cls)(args[0])
        return super().__new__(cls)

    def __init__(self, *rules: Rule):
        self.rules, self._tokens = rules, []

    def __enter__(self) -> rule_context:
        self._tokens.append(_rules.set((*_rules.get(), *(c for r in self.rules for c in clauses(r.head, tuple(r.body))))))
        return self

    def __exit__(self, *_: Any) -> None:
        _rules.reset(self._tokens.pop())

    def __call__(self, function: Callable) -> Callable:
        rules = getattr(self, "rules", ())

        @functools.wraps(function)
        def scoped(*args: Any, **kwargs: Any) -> Any:
            with rule_context(*rules):
                return function(*args, **kwargs)

        return scoped
