"""Fact types and the operators that join them: `&` conjunction, `|` disjunction."""

from __future__ import annotations

import sys
import types
import typing
import warnings
from collections.abc import Iterable
from typing import Any

from .sources.entities import Entity
from .terms import Var


def _is_conjunction(x: Any) -> bool:
    return isinstance(x, tuple)


def _any_of(left: Any, right: Any) -> list:
    """Alternatives: a list is spread, a tuple is one alternative."""
    out: list = []
    for side in (left, right):
        if isinstance(side, list):
            out += side
        elif isinstance(side, (Fact, tuple)):
            out.append(side)
        else:
            raise TypeError(f"a disjunction can't hold {type(side).__name__}")
    return out


def _all_of(left: Any, right: Any) -> FactConjunction:
    parts: list = []
    for side in (left, right):
        if isinstance(side, Fact):
            parts.append(side)
        elif _is_conjunction(side):
            parts += side
        elif isinstance(side, list):
            raise TypeError("Lists represent disjunction; a conjunction holds facts and tuples")
        else:
            raise TypeError(f"a conjunction can't hold {type(side).__name__}")
    return FactConjunction(parts)


class _Algebra:
    __slots__ = ()

    def __or__(self, other: Any) -> list:
        return _any_of(self, other)

    def __ror__(self, other: Any) -> list:
        return _any_of(other, self)

    def __and__(self, other: Any) -> FactConjunction:
        return _all_of(self, other)

    def __rand__(self, other: Any) -> FactConjunction:
        return _all_of(other, self)


class FactConjunction(_Algebra, tuple):
    """Facts that hold together."""

    __slots__ = ()

    def __new__(cls, facts: Iterable[Fact] = ()):
        return super().__new__(cls, facts)

    def __repr__(self) -> str:
        return " & ".join(map(repr, self)) if self else "FactConjunction()"


class Fact(_Algebra):
    """A binary relation type, or a pattern or row of it.

    Subclasses annotate `subject` and `object` with entity types, as in `subject: Person | Var`.  With
    `inferred=True` a type has no stored rows: rules derive it at query time.
    """

    inferred = False
    types: dict[str, type[Entity] | None]

    def __init_subclass__(cls, inferred: bool = False, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.inferred = inferred
        own = cls.__dict__.get("__annotations__") or typing.cast("dict", getattr(cls, "__annotations__", {}))
        if not inferred:
            for side in ("subject", "object"):
                if side not in own:
                    raise ValueError(f"{cls.__name__} must annotate {side} with an entity type")
        cls._frame = sys._getframe(1).f_locals  # names of the defining scope, for annotations kept as text
        if not inferred and not any(isinstance(v, str) for v in own.values()):
            cls.entity_types()

    @classmethod
    def entity_types(cls) -> dict[str, type[Entity] | None]:
        """The entity type of each side; None where an inferred type doesn't say."""
        if "types" not in cls.__dict__:
            module = vars(sys.modules.get(cls.__module__, types.ModuleType("none")))
            found: dict[str, type[Entity] | None] = {}
            for side in ("subject", "object"):
                hint = getattr(cls, "__annotations__", {}).get(side)
                if isinstance(hint, str):
                    hint = eval(hint, module, dict(cls._frame))  # noqa: S307  an annotation of the caller's own class
                named = [x for x in typing.get_args(hint) or (hint,) if isinstance(x, type) and issubclass(x, Entity)]
                if not named and not cls.inferred:
                    raise ValueError(f"{cls.__name__}.{side} names no entity type")
                if len(named) > 1:
                    warnings.warn(f"{cls.__name__}.{side} names several entity types; {named[0].__name__} is taken", stacklevel=2)
                found[side] = named[0] if named else None
            cls.types = found
        return cls.types

    def __init__(self, subject: Any, object: Any):  # noqa: A002
        self.subject, self.object = subject, object

    @property
    def terms(self) -> tuple[Any, Any]:
        return self.subject, self.object

    @property
    def variables(self) -> list[Var]:
        return [t for t in self.terms if isinstance(t, Var)]

    def _identity(self) -> tuple:
        return (type(self), *(("var", t.name, repr(t.where)) if isinstance(t, Var) else ("pk", key_of(t)) for t in self.terms))

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Fact) and self._identity() == other._identity()

    def __hash__(self) -> int:
        return hash(self._identity())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.subject!r}, {self.object!r})"


def key_of(term: Any) -> Any:
    """The primary key of a constant."""
    return term.pk if isinstance(term, Entity) else term
