"""Clauses as DataFrames: scans, filters, joins and projections that Catalyst then plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Fact, key_of
from ..functions.predicates import Compiler, Path, Unbound, determines, linked, named
from ..sources.entities import Entity
from ..terms import Q, Var, extract_variable_references, has_variable_references
from .spread import crossed, distinct_rows, spread_join


@dataclass
class Variable:
    """What a conjunction says of one variable: its entity type, and its constraints without and with other variables."""

    name: str
    entity: type[Entity] | None = None
    simple: list[Q] = field(default_factory=list)
    cross: list[Q] = field(default_factory=list)

    @property
    def constraint(self) -> Q:
        """All constraints without other variables as one."""
        return self.simple[0] if len(self.simple) == 1 else Q(*self.simple)


def variables_of(atoms: list[Fact], also: list[Fact] = ()) -> dict[str, Variable]:
    """The variables of `atoms`, with the constraints of all occurrences of a name, also those in `also`, taken together."""
    found: dict[str, Variable] = {}
    for atom in [*atoms, *also]:
        types = type(atom).entity_types()
        for side, term in zip(("subject", "object"), atom.terms, strict=True):
            if not isinstance(term, Var):
                entity = types[side]
                if isinstance(term, Entity) and entity and not issubclass(type(term), entity):
                    raise TypeError(f"{term!r} can't be the {side} of {type(atom).__name__}, which holds {entity.__name__}")
                continue
            v = found.setdefault(term.name, Variable(term.name))
            entity = types[side]
            if entity and v.entity and entity is not v.entity:
                raise TypeError(f"variable {term.name!r} stands for both {v.entity.__name__} and {entity.__name__}")
            v.entity = v.entity or entity
            for q in term.where.conjuncts() if term.where is not None else ():
                kind = v.cross if has_variable_references(q) else v.simple
                if q not in kind:
                    kind.append(q)
    return found


@dataclass
class Link:
    """An equality between a path from one variable's entity and another variable: a relation like a pattern's.

    forth: the first variable determines the second; back: the second the first.
    """

    subject: Var
    object: Var
    path: str
    forth: bool
    back: bool

    @property
    def terms(self) -> tuple[Var, Var]:
        return self.subject, self.object

    @property
    def variables(self) -> list[Var]:
        return [self.subject, self.object]


#: Variables -> the variables that they determine.
Determined = list[tuple[frozenset[str], frozenset[str]]]


def determined(names: set[str], rules: Determined) -> set[str]:
    """All that the names determine."""
    out, size = set(names), -1
    while size != len(out):
        size = len(out)
        for given, follows in rules:
            if given <= out:
                out |= follows
    return out


def ordered(atoms: list[Fact | Link], variables: dict[str, Variable], rules: Callable[[Fact | Link], Determined] = lambda atom: []) -> list[Fact | Link]:
    """Atoms with constants and constrained variables first, each next one connected to those before where that is possible.

    rules: what an atom's variables determine.  Joins that can multiply rows on both sides come as late as they can.
    """

    def weight(atom: Fact | Link) -> int:
        return sum(2 if not isinstance(t, Var) else bool(variables[t.name].simple) for t in atom.terms)

    def from_(first: Fact | Link) -> tuple[int, list[Fact | Link]]:
        left, out, bound, known, cost = [a for a in atoms if a is not first], [first], {v.name for v in first.variables}, [*rules(first)], 0

        def single(a: Fact | Link) -> bool:
            own = {v.name for v in a.variables}
            return own <= determined(own & bound, rules(a)) or bound <= determined(own & bound, known)

        while left:
            best = max(left, key=lambda a: (any(v.name in bound for v in a.variables) or not bound or not a.variables, single(a), weight(a)))
            cost += 0 if single(best) else len(left)
            left = [a for a in left if a is not best]
            out.append(best)
            bound |= {v.name for v in best.variables}
            known += rules(best)
        return cost, out

    starts = sorted(atoms, key=weight, reverse=True)
    return min(map(from_, starts), key=lambda found: found[0])[1] if atoms else []


def column_of(name: str) -> str:
    """The internal column of a variable: safe characters only, and distinct for names that differ only in case."""
    return "v_" + "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else f"_{ord(c):x}_" for c in name)


class ClauseCompiler:
    """Compiles conjunctions over the relations that `relation` gives.  Variables are columns named by column_of().

    held: a fact type -> the side whose entity's table holds its rows and the expression of the other side, or None.
    limited: relation() takes, besides a pattern, keys that a side is limited to, where that can save work; the
    limits are applied here in any case.  spread: joins that can multiply rows on both sides are dealt out in blocks.
    """

    def __init__(self, relation: Callable[..., DataFrame], table: Callable[[type[Entity]], DataFrame], unbound: str = "raise", held: Callable = lambda kind: None, limited: Callable = lambda kind: set(), spread: bool = True):
        self.relation, self.table, self.unbound, self.held, self.limited, self.spread = relation, table, unbound, held, limited, spread

    def atom(self, atom: Fact, variables: dict[str, Variable], done: set[str]) -> DataFrame:
        """A column for each variable of the pattern; constants, a repeated variable and constraints are filters.

        The constraints of the pattern's variables that are not `done` are applied, and are done then.
        """
        todo = [t for t in dict.fromkeys(v.name for v in atom.variables) if variables[t].simple and t not in done]
        done |= set(todo)
        if (held := self.held(type(atom))) and isinstance(own := getattr(atom, held[0]), Var) and own.name in todo:
            entity = type(atom).entity_types()[held[0]]
            df, fits = Compiler(self.table, self.unbound).apply(self.table(entity), entity.key, entity, variables[own.name].constraint, {}, own=True)
            df = df.where(fits)
            sides = {held[0]: named(entity.key), "object" if held[0] == "subject" else "subject": F.expr(held[1])}
            df = df.select(*(sides[s].alias(s) for s in ("subject", "object"))).where(F.col("subject").isNotNull() & F.col("object").isNotNull())
            todo.remove(own.name)
        elif passed := {s: variables[t.name] for s in self.limited(type(atom)) if isinstance(t := getattr(atom, s), Var) and t.name in todo}:
            df = self.relation(atom, {side: (repr(v.constraint), self.allowed(v, side)) for side, v in passed.items()})
        else:
            df = self.relation(atom)
        columns = {}
        for side, term in zip(("subject", "object"), atom.terms, strict=True):
            if isinstance(term, Var):
                if term.name in columns:
                    df = df.where(F.col("subject") == F.col("object"))
                else:
                    columns[term.name] = side
            else:
                df = df.where(F.col(side) == F.lit(key_of(term)))
        df = df.select(*(F.col(side).alias(column_of(name)) for name, side in columns.items()))
        for name in todo:
            df = df.join(self.allowed(variables[name], column_of(name)), column_of(name), "left_semi")
        return df

    def allowed(self, v: Variable, column: str) -> DataFrame:
        """Keys of the entities that a variable's own constraints accept: one scan of the entity's table."""
        df, fits = Compiler(self.table, self.unbound).apply(self.table(v.entity), v.entity.key, v.entity, v.constraint, {}, own=True)
        return df.where(fits).select(named(v.entity.key).alias(column))

    def rules(self, atom: Fact | Link) -> Determined:
        """What an atom's variables determine: rows that an entity's table holds are one for each key."""
        if isinstance(atom, Link):
            ways = [(atom.subject, atom.object, atom.forth), (atom.object, atom.subject, atom.back)]
        elif held := self.held(type(atom)):
            ways = [(getattr(atom, held[0]), getattr(atom, "object" if held[0] == "subject" else "subject"), True)]
        else:
            return []
        return [(frozenset(v.name for v in (given,) if isinstance(v, Var)), frozenset([follows.name])) for given, follows, holds in ways if holds and isinstance(follows, Var)]

    def body(self, atoms: list[Fact], head: Fact | None = None) -> tuple[DataFrame, bool]:
        """The bindings of a conjunction, a column for each variable that is needed, and whether no row can repeat."""
        variables = variables_of(atoms, [head] if head is not None else [])
        for v in variables.values():
            if (v.simple or v.cross) and v.entity is None:
                raise ValueError(f"variable {v.name!r} is constrained, but no pattern says its entity type")
        bound = {v.name for a in atoms for v in a.variables}
        choices = [[(v.name, *way) for way in self._one_of(v, q, bound)] for v in variables.values() for q in v.cross]
        out, unique = [], True
        for chosen in product(*choices):
            here = {name: Variable(name, v.entity, [*v.simple]) for name, v in variables.items()}
            links = []
            for name, own, link, rest in chosen:
                here[name].simple += [q for q in own if q not in here[name].simple]
                here[name].cross += rest
                links += link
            df, alone = self._joined([*atoms, *links], here, head)
            out.append(df)
            unique &= alone
        return reduce(DataFrame.unionByName, out), unique

    def _joined(self, atoms: list[Fact | Link], variables: dict[str, Variable], head: Fact | None) -> tuple[DataFrame, bool]:
        needed = set(variables) if head is None else {t.name for t in head.variables}
        for v in variables.values():
            if v.cross:
                needed |= {v.name, *(name for q in v.cross for name in extract_variable_references(q))}
        df: DataFrame | None = None
        done: set[str] = set()
        known: Determined = []
        unique = True
        todo = ordered(atoms, variables, self.rules)
        for i, atom in enumerate(todo):
            right = self.link(atom, variables) if isinstance(atom, Link) else self.atom(atom, variables, done)
            later = {column_of(n) for n in needed | {v.name for rest in todo[i + 1 :] for v in rest.variables}}
            rules = [(frozenset(map(column_of, given)), frozenset(map(column_of, follows))) for given, follows in self.rules(atom)]
            single = True
            if df is None:
                df = right
            else:
                shared = [c for c in right.columns if c in df.columns]
                single = {*right.columns} <= determined({*shared}, rules)
                if not right.columns or all(c in shared or c not in later for c in right.columns):
                    df = df.join(right.select(*shared), shared, "left_semi") if shared else df.join(right.limit(1).select(F.lit(1).alias("__one")), F.lit(True), "left_semi")
                elif shared and len(shared) == len(df.columns):
                    df, unique = right.join(df if unique else df.distinct(), shared, "left_semi"), True
                else:
                    if not unique and not single:  # a row repeated n times would join n times
                        df, unique = df.distinct(), True
                    right = right.select(*[c for c in right.columns if c in later or c in shared])
                    if not shared:
                        df = crossed(df, right)
                    elif single or unique and {*df.columns} <= determined({*shared}, known) or not self.spread:
                        df = df.join(right, shared)
                    else:
                        df = spread_join(df, right, shared)
            known += rules
            kept = [c for c in df.columns if c in later]
            if len(kept) < len(df.columns) and head is not None:
                unique &= {*df.columns} <= determined({*kept}, known)
                df = df.select(*kept)
        for v in variables.values():
            for q in v.cross:
                df = self._cross(df, v, q, {column_of(n): n for n in variables})
        return df, unique

    def link(self, link: Link, variables: dict[str, Variable]) -> DataFrame:
        """The distinct pairs of a link, as columns of its variables."""
        df = linked(self.table, variables[link.subject.name].entity, link.path).toDF(*(column_of(t.name) for t in link.terms))
        return df if link.forth or link.back else df.distinct()

    def _cross(self, df: DataFrame, v: Variable, q: Q, names: dict[str, str]) -> DataFrame:
        bound = {names[c]: c for c in df.columns}
        missing = [name for name in extract_variable_references(q) if name not in bound]
        if missing and self.unbound == "raise":
            raise Unbound(f"a constraint of {v.name!r} names {missing[0]!r}, which no pattern binds")
        if v.name not in bound:
            return df
        out, holds = Compiler(self.table, self.unbound).apply(df, column_of(v.name), v.entity, q, bound)
        return out.where(holds).select(*df.columns)

    def _one_of(self, v: Variable, q: Q, bound: set[str]) -> list[tuple[list[Q], list[Link], list[Q]]]:
        """A constraint with variables as disjoint alternatives: constraints of `v` alone, links, and constraints that are left.

        `path=x` is a link; `path__in=[...]` is an alternative for the constants together and a link for each variable.
        Each alternative leaves out what those before it have.
        """
        if q.negated or len(q.children) != 1 or isinstance(q.children[0], Q):
            return [([], [], [q])]
        path, value = q.children[0]
        p = Path(v.entity, path, lambda e: self.table(e).columns)
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        names = [*dict.fromkeys(x.name for x in values if isinstance(x, Var))]
        if p.final not in ("exact", "in") or (p.final == "in") != isinstance(value, (list, tuple)) or v.name not in bound or not bound.issuperset(names) or v.name in names:
            return [([], [], [q])]
        fixed = [x for x in values if not isinstance(x, Var)]
        forth, back = determines(p, lambda e: self.table(e).columns)
        not_fixed = [~Q((path, fixed))] if fixed else []
        out: list[tuple[list[Q], list[Link], list[Q]]] = [([Q((path, fixed))], [], [])] if fixed else []
        for i, name in enumerate(names):
            link = Link(Var(v.name), Var(name), path.removesuffix("__in"), forth, back)
            out.append((not_fixed, [link], [~Q((path, [Var(before)])) for before in names[:i]]))
        return out

    def clause(self, head: Fact, atoms: list[Fact]) -> tuple[DataFrame, bool] | None:
        """The facts that a rule derives and whether none can repeat, or None if it can't derive any: a head variable that the body doesn't bind."""
        bound = {v.name for a in atoms for v in a.variables}
        if any(v.name not in bound for v in head.variables):
            return None
        if not atoms:
            return None  # a ground axiom is the engine's to give
        df, unique = self.body(atoms, head)
        sides = [F.col(column_of(t.name)) if isinstance(t, Var) else F.lit(key_of(t)) for t in head.terms]
        df = df.select(sides[0].alias("subject"), sides[1].alias("object"))
        if not unique and self.spread and len(atoms) > 1:  # a join's rows: as many tasks as its input asks for keep each one's table small
            return distinct_rows(df), True
        return df, unique


