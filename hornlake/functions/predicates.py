"""Constraint trees as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import key_of
from ..sources.entities import Entity
from ..terms import Q, Var

_numbers = count()

#: Parts of dates and times that may stand before a comparison.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": F.weekofyear,
    "week_day": F.dayofweek,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "date": F.to_date,
}


def _text(c: Column) -> Column:
    return c.cast("string")


def _is_in(c: Column, values: Any) -> Column:
    """Any of the values; constants in one IN list, columns as equalities, None never."""
    values = [v for v in values if v is not None]
    fixed = [v for v in values if not isinstance(v, Column)]
    out = c.isin(fixed) if fixed else F.lit(False)
    for v in values:
        if isinstance(v, Column):
            out = out | (c == v)
    return out


LOOKUPS: dict[str, Callable[[Column, Any], Column]] = {
    "exact": lambda c, v: c.isNull() if v is None else c == v,
    "iexact": lambda c, v: c.isNull() if v is None else F.lower(_text(c)) == F.lower(_text(F.lit(v))),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": _is_in,
    "range": lambda c, v: c.between(v[0], v[1]),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "contains": lambda c, v: F.contains(_text(c), _text(F.lit(v))),
    "icontains": lambda c, v: F.contains(F.lower(_text(c)), F.lower(_text(F.lit(v)))),
    "startswith": lambda c, v: F.startswith(_text(c), _text(F.lit(v))),
    "istartswith": lambda c, v: F.startswith(F.lower(_text(c)), F.lower(_text(F.lit(v)))),
    "endswith": lambda c, v: F.endswith(_text(c), _text(F.lit(v))),
    "iendswith": lambda c, v: F.endswith(F.lower(_text(c)), F.lower(_text(F.lit(v)))),
    "regex": lambda c, v: _text(c).rlike(v),
    "iregex": lambda c, v: _text(c).rlike(f"(?i){v}"),
}


class Unbound(ValueError):
    """A constraint names a variable that the query does not bind."""


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


class Path:
    """A leaf's path taken apart: forward keys, then a field, transforms and lookup, or a reverse or bridged relation.

    far: the entity across that relation, its column back to us, its column to compare if the path ends there; rest: the
    path that goes on from that entity, which may cross further relations; final: the lookup at the path's very end.
    """

    def __init__(self, entity: type[Entity], path: str, columns: Callable[[type[Entity]], list[str]]):
        parts = path.split("__")
        self.entity = entity
        self.forward: list[tuple[str, type[Entity]]] = []
        self.far: tuple[type[Entity], str, str] | None = None
        self.rest, self.transforms, self.lookup, self.column = "", [], "exact", entity.key
        at = entity
        while parts:
            name = parts[0]
            ends = len(parts) == 1 or all(p in LOOKUPS or p in TRANSFORMS for p in parts[1:])
            column = at.column(name, columns(at))
            if name in at.references and not ends:
                self.forward.append((column, at.references[name]))
                at, parts = at.references[name], parts[1:]
                continue
            if column is not None:
                self.column, parts = column, parts[1:]
                break
            if name in at.bridges:
                bridge = at.bridges[name]
                own = bridge.through.column(bridge.own, columns(bridge.through))
                other = bridge.through.column(bridge.other, columns(bridge.through))
                self.far, field = (bridge.through, own, other), bridge.other
                if not ends:
                    self.rest, parts = "__".join([bridge.other, *parts[1:]]), ["exact"]
            elif found := at.reverse(name):
                self.far, field = (found[0], found[0].column(found[1], columns(found[0])), found[0].key), "pk"
                if not ends:
                    self.rest, parts = "__".join(parts[1:]), ["exact"]
            elif at is not entity and name in LOOKUPS | TRANSFORMS:
                parts = [name, *parts[1:]]
                self.column = at.key
                break
            else:
                raise ValueError(f"{at.__name__} has no field {name!r} (in {path!r})")
            parts = parts[1:] if not self.rest else []
            self.column = at.key
            break
        else:
            self.column = at.key
        for name in parts:
            if name in TRANSFORMS:
                self.transforms.append(name)
            elif name in LOOKUPS and name == parts[-1]:
                self.lookup = name
            else:
                raise ValueError(f"unknown lookup {name!r} in {path!r}")
        self.ends = self.far is not None and not self.rest
        if self.ends:
            self.rest = "__".join([field, *parts])
        self.final = Path(self.far[0], self.rest, columns).final if self.far else self.lookup


class Compiler:
    """Adds to a table what a constraint needs, and gives the constraint as a column.

    Forward keys become left joins on keys, which keep one row for each; a reverse or bridged relation becomes a left join
    with distinct keys and a mark, so rows never multiply.
    """

    def __init__(self, table: Callable[[type[Entity]], DataFrame], unbound: str = "raise"):
        self.table, self.unbound = table, unbound
        self.columns = lambda entity: table(entity).columns

    def apply(self, df: DataFrame, key: str, entity: type[Entity], q: Q, bound: dict[str, str], own: bool = False) -> tuple[DataFrame, Column]:
        """`key` is the column of df that holds the entity's key; `bound` maps variables to columns of df.

        own: df is the entity's table, or rows of it, so its fields are read where they are, without a join.
        """
        self._start(df, key, entity, [path for path, _ in q.leaves()], own)
        fits = self._tree(q, bound)  # adds joins to self.df
        return self.df, fits

    def _start(self, df: DataFrame, key: str, entity: type[Entity], paths: list[str], own: bool) -> None:
        """One join for each entity on a forward path, with only the columns that some leaf needs."""
        self.df, self.fetched = df, {}
        self.paths: dict[str, Path] = {}
        needs: dict[tuple, set[str]] = {}
        owner: dict[tuple, type[Entity]] = {(): entity}
        for path in paths:
            p = self.paths.setdefault(path, Path(entity, path, self.columns))
            at: tuple = ()
            for column, target in p.forward:
                needs.setdefault(at, set()).add(column)
                at = (*at, column)
                owner[at] = target
            if p.column != owner[at].key:
                needs.setdefault(at, set()).add(p.column)
        for at in sorted(owner, key=len):
            wanted = needs.get(at, set()) - {owner[at].key}
            held = key if not at else self._at(at)
            names = {owner[at].key: held}
            if own and not at:
                names |= {c: c for c in wanted}
            elif wanted:
                n = next(_numbers)
                names |= {c: f"__f{n}_{i}" for i, c in enumerate(sorted(wanted))}
                side = self.table(owner[at]).select(named(owner[at].key).alias(f"__k{n}"), *(named(c).alias(names[c]) for c in sorted(wanted)))
                self.df = self.df.join(side, named(held) == F.col(f"__k{n}"), "left").drop(f"__k{n}")
            self.fetched[at] = names

    def _at(self, at: tuple) -> str:
        return self.fetched[at[:-1]][at[-1]]

    def _held(self, p: Path) -> str:
        return self.fetched[tuple(column for column, _ in p.forward)][p.column]

    def _shown(self, p: Path) -> Column:
        column = named(self._held(p))
        for name in p.transforms:
            column = TRANSFORMS[name](column)
        return column

    def _value(self, value: Any, bound: dict[str, str]) -> Any:
        if isinstance(value, Var):
            if value.name not in bound:
                raise Unbound(f"constraint names {value.name!r}, which the query does not bind")
            return named(bound[value.name])
        if isinstance(value, (list, tuple, set, frozenset)):
            return [self._value(v, bound) for v in value]
        return key_of(value)

    def _tree(self, q: Q, bound: dict[str, str]) -> Column:
        parts = [self._tree(c, bound) if isinstance(c, Q) else self._leaf(*c, bound) for c in q.children]
        if not parts:
            out = F.lit(True)
        elif q.connector == "XOR":
            out = sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts[1:]), F.coalesce(parts[0], F.lit(False)).cast("int")) % 2 == 1
        else:
            out = parts[0]
            for p in parts[1:]:
                out = out & p if q.connector == "AND" else out | p
        return ~F.coalesce(out, F.lit(False)) if q.negated else out

    def _leaf(self, path: str, value: Any, bound: dict[str, str]) -> Column:
        p = self.paths[path]
        try:
            value = self._value(value, bound)
        except Unbound:
            if self.unbound == "ignore":
                return F.lit(True)
            raise
        if p.far is None:
            return LOOKUPS[p.lookup](self._shown(p), value)
        items = value if isinstance(value, list) else [value]
        return self._far_column(p, items) if any(isinstance(v, Column) for v in items) else self._far(p, value)

    def _mark(self, keys: DataFrame, held: str) -> Column:
        """Whether a row's `held` is among the keys (one column)."""
        n = next(_numbers)
        keys = keys.toDF(f"__b{n}").filter(F.col(f"__b{n}").isNotNull()).distinct().withColumn(f"__m{n}", F.lit(True))
        self.df = self.df.join(keys, named(held) == F.col(f"__b{n}"), "left").drop(f"__b{n}")
        return F.coalesce(F.col(f"__m{n}"), F.lit(False))

    def _far(self, p: Path, value: Any) -> Column:
        """Whether some row on the other side of a reverse or bridged relation fits; the other side may go on to further ones.

        A test for null also holds where there is no row on the other side, as over an outer join.
        """
        entity, back, _ = p.far
        far, fits = Compiler(self.table, self.unbound).apply(self.table(entity), entity.key, entity, Q((p.rest, value)), {}, own=True)
        out = self._mark(far.filter(fits).select(named(back)), self._held(p))
        if value is None and p.final in ("exact", "iexact") or value and p.final == "isnull":
            out = out | ~self._mark(self.table(entity).select(named(back)), self._held(p))
        return out

    def _far_column(self, p: Path, items: list) -> Column:
        """The same for values that are columns of ours: distinct pairs of key and far value are joined by equality."""
        pairs, lookup = _pairs(self.table, p)
        if lookup not in ("exact", "in"):
            raise ValueError("across a reverse relation a variable can only be compared by equality")
        out = F.lit(False)
        for v in items:
            if v is None:
                continue
            n = next(_numbers)
            found = pairs.toDF(f"__b{n}", f"__v{n}").distinct().withColumn(f"__m{n}", F.lit(True))
            on = (named(self._held(p)) == F.col(f"__b{n}")) & (F.col(f"__v{n}") == (v if isinstance(v, Column) else F.lit(v)))
            self.df = self.df.join(found, on, "left").drop(f"__b{n}", f"__v{n}")
            out = out | F.coalesce(F.col(f"__m{n}"), F.lit(False))
        return out


def _pairs(table: Callable[[type[Entity]], DataFrame], p: Path) -> tuple[DataFrame, str]:
    """(key, value) for each row that a reverse or bridged relation, and what follows it in the path, leads to."""
    entity, back, _ = p.far
    n = next(_numbers)
    back_name, key_name = f"__pb{n}", f"__pk{n}"
    far = table(entity)
    inner = Path(entity, p.rest, lambda e: table(e).columns)
    start = far.select(named(back).alias(back_name), named(entity.key).alias(key_name), *(named(c).alias(f"__pc{n}_{c}") for c in {c for c, _ in inner.forward[:1]} | ({inner.column} if not inner.forward else set())))
    held = key_name if inner.column == entity.key and not inner.forward else f"__pc{n}_{inner.forward[0][0] if inner.forward else inner.column}"
    for i, (_, target) in enumerate(inner.forward):
        m = next(_numbers)
        want = inner.forward[i + 1][0] if i + 1 < len(inner.forward) else inner.column
        side = table(target).select(named(target.key).alias(f"__rk{m}"), named(want).alias(f"__rv{m}"))
        start = start.join(side, named(held) == F.col(f"__rk{m}")).drop(f"__rk{m}")
        held = f"__rv{m}"
    if inner.far is None:
        shown = named(held)
        for name in inner.transforms:
            shown = TRANSFORMS[name](shown)
        return start.select(named(back_name), shown.alias(f"__pv{n}")).filter(named(back_name).isNotNull() & named(f"__pv{n}").isNotNull()), inner.lookup
    further, lookup = _pairs(table, inner)
    further = further.toDF(f"__qk{n}", f"__qv{n}")
    return start.join(further, named(held) == F.col(f"__qk{n}")).select(named(back_name), F.col(f"__qv{n}")).filter(named(back_name).isNotNull()), lookup


def linked(table: Callable[[type[Entity]], DataFrame], entity: type[Entity], path: str) -> DataFrame:
    """(key, value): what the path from each entity leads to, without nulls."""
    compiler = Compiler(table)
    compiler._start(table(entity), entity.key, entity, [path], True)
    p, n = compiler.paths[path], next(_numbers)
    if p.far is None:
        out = compiler.df.select(named(entity.key).alias(f"__lk{n}"), compiler._shown(p).alias(f"__lv{n}"))
    else:
        pairs = _pairs(table, p)[0].toDF(f"__lb{n}", f"__lv{n}")
        if not p.forward:
            out = pairs.withColumnRenamed(f"__lb{n}", f"__lk{n}")
        else:
            rows = compiler.df.select(named(entity.key).alias(f"__lk{n}"), named(compiler._held(p)).alias(f"__lb{n}"))
            out = rows.join(pairs, f"__lb{n}").select(f"__lk{n}", f"__lv{n}")
    return out.where(F.col(f"__lk{n}").isNotNull() & F.col(f"__lv{n}").isNotNull())


def determines(p: Path, columns: Callable[[type[Entity]], list[str]]) -> tuple[bool, bool]:
    """Whether an entity has one value at the path at most, and whether a value has one entity.

    The latter holds over reverse relations to the key of their last entity.  Entities that tie others, as a bridge's, may
    repeat their key.
    """
    own = not p.forward and not p.transforms
    if p.far is None:
        return True, own and p.column == p.entity.key
    far = p.far[0]
    ties = any(b.through is far for e in Entity.known for b in e.bridges.values())
    return False, own and not ties and determines(Path(far, p.rest, columns), columns)[1]
