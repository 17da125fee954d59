"""The engine: entity tables, fact relations and rules on a Spark session."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import Fact, key_of
from .functions.predicates import named
from .operators.compile import column_of, variables_of
from .operators.fixpoint import MAX_ROUNDS, Inference
from .operators.hydrate import hydrated
from .rules import Rule, get_rules
from .sources import storage
from .sources.entities import Entity
from .terms import Var

_KEYS = {int: T.LongType(), str: T.StringType()}


class Engine:
    """Answers queries over registered tables.

    path: where stored facts go; a shared folder that ends with the process if None.
    unbound: what a constraint on a variable that nothing binds does, "raise" or "ignore" (it then holds).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, unbound: str = "raise", max_rounds: int | None = MAX_ROUNDS):
        self.spark, self.unbound, self.max_rounds = spark, unbound, max_rounds
        self.path = path or storage.new_dir(spark, "store")
        self._entities: dict[type[Entity], DataFrame | Callable[[], DataFrame]] = {}
        self._relations: dict[type[Fact], DataFrame | Callable[[], DataFrame]] = {}
        self._held: dict[type[Fact], tuple[str, str]] = {}
        self._tables: dict[type[Fact], storage.FactTable] = {}
        self._inferred: tuple | None = None

    # -- sources

    def entity(self, kind: type[Entity], df: DataFrame | Callable[[], DataFrame]) -> None:
        """Register the table of an entity type, or a function that opens it at its first use; its key must be unique."""
        self._entities[kind], self._inferred = df, None
        if not callable(df):
            self.table(kind)

    def relation(self, kind: type[Fact], df: DataFrame | Callable[[], DataFrame], unique: bool = False) -> None:
        """Register rows (subject, object) of a stored fact type, or a function that opens them; `unique` says that no pair repeats."""
        self._may_store(kind)
        pairs = lambda: (df() if callable(df) else df).select("subject", "object")
        self._relations[kind], self._inferred = (pairs if unique else lambda: pairs().distinct()), None
        self._held.pop(kind, None)

    def reference(self, kind: type[Fact], other: str, side: str = "subject") -> None:
        """Register a stored fact type whose rows the entity table of `side` holds, one a row: the SQL expression `other`
        gives the opposite side, and null is no fact.  A constraint on `side`'s variable then needs no join.
        """
        self._may_store(kind)
        entity = kind.entity_types()[side]
        sides = (named(entity.key), F.expr(other)) if side == "subject" else (F.expr(other), named(entity.key))
        pairs = lambda: self.table(entity).select(sides[0].alias("subject"), sides[1].alias("object"))
        self._relations[kind], self._inferred = lambda: pairs().where(F.col("subject").isNotNull() & F.col("object").isNotNull()), None
        self._held[kind] = (side, other)

    @staticmethod
    def _may_store(kind: type[Fact]) -> None:
        if kind.inferred:
            raise ValueError(f"Cannot store inferred fact {kind.__name__}: it is computed automatically from rules")

    def table(self, kind: type[Entity]) -> DataFrame:
        if kind not in self._entities:
            raise ValueError(f"no table is registered for {kind.__name__}")
        if callable(df := self._entities[kind]):
            df = self._entities[kind] = df()
        if kind.key not in df.columns:
            del self._entities[kind]
            raise ValueError(f"{kind.__name__} has no column {kind.key!r}")
        return df

    def _schema(self, kind: type[Fact], row: tuple | None = None) -> T.StructType:
        out = []
        for i, side in enumerate(("subject", "object")):
            entity = kind.entity_types()[side]
            if entity in self._entities:
                type_ = self.table(entity).schema[entity.key].dataType
            else:
                type_ = _KEYS.get(type(row[i]) if row else int, T.LongType())
            out.append(T.StructField(side, type_))
        return T.StructType(out)

    def empty(self, kind: type[Fact]) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(kind))

    def stored(self, kind: type[Fact]) -> DataFrame:
        """All stored rows of a fact type: registered ones and those of store_facts."""
        parts = []
        if kind in self._relations:
            parts.append(self._relations[kind]())
        if kind in self._tables:
            parts.append(self._tables[kind].read())
        if not parts:
            return self.empty(kind)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()

    # -- sinks

    def _by_type(self, facts: tuple[Fact, ...], what: str) -> dict[type[Fact], list[tuple]]:
        out: dict[type[Fact], list[tuple]] = {}
        for fact in facts:
            if type(fact).inferred:
                raise ValueError(f"Cannot {what} inferred fact {type(fact).__name__}: it is computed automatically from rules")
            if fact.variables:
                raise ValueError(f"{fact!r} has variables; only ground facts can be stored or retracted")
            out.setdefault(type(fact), []).append(tuple(key_of(t) for t in fact.terms))
        return out

    def _stored_table(self, kind: type[Fact], row: tuple) -> storage.FactTable:
        if kind not in self._tables:
            schema = self._schema(kind, row)
            table = storage.FactTable(self.spark, f"{self.path}/{kind.__name__}", schema)
            if kind in self._relations:
                table.store(self._relations.pop(kind)().select(*(F.col(f.name).cast(f.dataType) for f in schema)))
                self._held.pop(kind, None)
            self._tables[kind] = table
        self._inferred = None  # what was derived before is derived anew
        return self._tables[kind]

    def store_facts(self, *facts: Fact) -> None:
        """Add facts; those that are there stay as they are."""
        for kind, rows in self._by_type(facts, "store").items():
            table = self._stored_table(kind, rows[0])
            table.store(self.spark.createDataFrame(rows, table.schema), len(rows) <= storage.FEW)

    def retract_facts(self, *facts: Fact) -> None:
        """Remove exactly these facts; one that isn't there changes nothing."""
        for kind, rows in self._by_type(facts, "retract").items():
            table = self._stored_table(kind, rows[0])
            table.retract(self.spark.createDataFrame(rows, table.schema))

    def store_rows(self, kind: type[Fact], df: DataFrame) -> None:
        """Add a table of (subject, object) rows, at any size."""
        self._may_store(kind)
        table = self._stored_table(kind, (0, 0))
        table.store(df.select(*(F.col(f.name).cast(f.dataType) for f in table.schema)))

    def retract_rows(self, kind: type[Fact], df: DataFrame) -> None:
        """Remove a table of (subject, object) rows, at any size."""
        table = self._stored_table(kind, (0, 0))
        table.retract(df.select(*(F.col(f.name).cast(f.dataType) for f in table.schema)))

    # -- queries

    def _inference(self) -> Inference:
        """The relations of the rules in force; closures found by an earlier query hold while facts and rules are the same."""
        rules = get_rules()
        state = (tuple(map(id, rules)), self.unbound, self.max_rounds)
        if self._inferred is None or self._inferred[0] != state:
            self._inferred = (state, rules, Inference(self.spark, rules, self.stored, self.table, self.empty, self.unbound, self.max_rounds, self._held.get))
        return self._inferred[2]

    def query(self, *patterns: Fact, hydrate: bool = True) -> DataFrame:
        """The bindings under which all patterns hold: a column for each variable, no row twice, in no order.

        hydrate: variables of registered entity types are structs of `pk` and the entity's columns, else keys.
        A ground query has no columns, and one row if it holds.  Names may hold any characters; to pick one of several
        columns whose names differ only in case by name, set spark.sql.caseSensitive.  A recursive relation is computed,
        and written to the shared folder, while the query is built; later queries of this engine read it from there.
        """
        atoms = [a for p in patterns for a in ([p] if isinstance(p, Fact) else p)]
        if not atoms:
            return self.spark.range(1).select()
        df, _ = self._inference().compiler().body(atoms)
        names = list(dict.fromkeys(v.name for a in atoms for v in a.variables))
        if not names:
            return df.limit(1).select()
        df = df.select(*map(column_of, names))
        if hydrate:
            df = hydrated(df, {column_of(n): v.entity for n, v in variables_of(atoms).items() if v.entity in self._entities}, self.table)
        return df.toDF(*names)

    def ask(self, *patterns: Fact) -> bool:
        """Whether some binding makes all patterns hold."""
        return not self.query(*patterns, hydrate=False).isEmpty()

    def iter(self, *patterns: Fact, hydrate: bool = True) -> Iterator[dict[str, Any]]:
        """Bindings as dicts, fetched a partition at a time; an entity that is missing is its key."""
        for row in self.query(*patterns, hydrate=hydrate).toLocalIterator():
            out = {}
            for name, value in zip(row.__fields__, row, strict=True):
                if isinstance(value, T.Row) and "pk" in value and all(value[f] is None for f in value.__fields__ if f != "pk"):
                    value = value["pk"]
                out[name] = value
            yield out

    def frames(self, facts: Iterable[Fact]) -> dict[type[Fact], DataFrame]:
        """A list of ground facts as a table for each type."""
        rows: dict[type[Fact], list[tuple]] = {}
        for fact in facts:
            if fact.variables:
                raise ValueError(f"{fact!r} has variables; only ground facts are rows")
            rows.setdefault(type(fact), []).append(tuple(key_of(t) for t in fact.terms))
        return {kind: self.spark.createDataFrame(own, self._schema(kind, own[0])) for kind, own in rows.items()}

    def materialize(self, base: dict[type[Fact], DataFrame] | Iterable[Fact] | None = None, rules: list[Rule] | None = None) -> dict[type[Fact], DataFrame]:
        """All inferred relations of the rules, over the given relations or, for types not given, the stored ones.

        base: tables by fact type, or a list of ground facts.  Given rows of an inferred type are part of its relation, and
        rules derive others from them.  The result holds the given relations too.
        """
        base = base if isinstance(base, dict) else self.frames(base or ())
        given = {kind: df.select("subject", "object").distinct() for kind, df in base.items()}
        stored = lambda kind: given[kind] if kind in given else self.stored(kind)
        held = lambda kind: None if kind in given else self._held.get(kind)
        chosen = get_rules() if rules is None else rules
        seeds = {kind: df for kind, df in given.items() if kind.inferred}
        inference = Inference(self.spark, chosen, stored, self.table, self.empty, self.unbound, self.max_rounds, held, seeds)
        heads = dict.fromkeys(type(r.head) for r in chosen)
        return base | {kind: inference.relation(kind(Var("s"), Var("o"))) for kind in heads}

    def check_references(self, kind: type[Fact]) -> DataFrame:
        """Stored rows without those whose entities are gone, as a cascading delete would leave them."""
        df = self.stored(kind)
        for side, entity in kind.entity_types().items():
            if entity in self._entities:
                df = df.join(self.table(entity).select(named(entity.key).alias(side)), side, "left_semi")
        return df.select("subject", "object")


_current: ContextVar[Engine | None] = ContextVar("engine", default=None)


def connect(spark: SparkSession, **options: Any) -> Engine:
    """Make an engine, which the module's functions use from now on in this context."""
    engine = Engine(spark, **options)
    _current.set(engine)
    return engine


def current() -> Engine:
    if (engine := _current.get()) is None:
        raise RuntimeError("no engine in use: call connect(spark) first")
    return engine


def query(*patterns: Fact, hydrate: bool = True) -> DataFrame:
    return current().query(*patterns, hydrate=hydrate)


def store_facts(*facts: Fact) -> None:
    current().store_facts(*facts)


def retract_facts(*facts: Fact) -> None:
    current().retract_facts(*facts)


def apply_rules(base: dict[type[Fact], DataFrame] | Iterable[Fact]) -> dict[type[Fact], DataFrame]:
    """Everything that the rules in force derive from the given relations or facts, and these."""
    return current().materialize(base)


def apply_targeted_rules(rules: list[Rule], base: dict[type[Fact], DataFrame] | Iterable[Fact]) -> dict[type[Fact], DataFrame]:
    """Everything that the given rules alone derive from the given relations or facts, and these."""
    return current().materialize(base, rules)
