"""Entity types: keyed tables with scalar fields, foreign keys, and many-to-many relations."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Bridge:
    """A many-to-many relation: rows of entity `through` join its two foreign keys."""

    through: type[Entity]
    own: str
    other: str


class Entity:
    """A keyed table.  An instance is a constant: the entity with that primary key.

    key: the key's column.  fields: field name -> column; by default fields are columns.
    references: field name -> the entity type that its value is a key of.
    bridges: field name -> Bridge.  Reverse relations are named by the lower-case type name.
    """

    key: str = "id"
    fields: dict[str, str] = {}
    references: dict[str, type[Entity]] = {}
    bridges: dict[str, Bridge] = {}
    known: list[type[Entity]] = []

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        Entity.known.append(cls)

    def __init__(self, pk: Any):
        self.pk = pk

    def __eq__(self, other: Any) -> bool:
        return type(self) is type(other) and self.pk == other.pk

    def __hash__(self) -> int:
        return hash((type(self), self.pk))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.pk!r})"

    @classmethod
    def column(cls, field: str, columns: list[str]) -> str | None:
        """The column of a field, or None if there is no such field."""
        if field in ("pk", "id") and field not in cls.fields:
            return cls.key
        if (name := cls.fields.get(field, field)) in columns:
            return name
        short = field.removesuffix("_id")
        return cls.fields.get(short) if short in cls.references else None

    @classmethod
    def reverse(cls, name: str) -> tuple[type[Entity], str] | None:
        """The entity type and its foreign key to this type that a reverse relation's name means."""
        for other in reversed(Entity.known):
            if other.__name__.lower() == name:
                for field, target in other.references.items():
                    if target is cls:
                        return other, field
        return None
