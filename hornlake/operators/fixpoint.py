"""Inferred relations: one expression where rules don't recurse, semi-naive iteration where they do."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..facts import Fact, key_of
from ..rules import Rule
from ..sources import storage
from ..terms import Var
from .compile import ClauseCompiler

#: Rounds of a recursive group after which the engine gives up, by raising; None sets no bound.
MAX_ROUNDS: int | None = None
#: Facts of a round that are sent to every executor, and facts of a group up to which each round looks for repeats.
SMALL = 100_000


def strongly_connected(graph: dict[type[Fact], set[type[Fact]]]) -> list[list[type[Fact]]]:
    """Groups of mutually dependent relations, dependencies first."""
    order: dict = {}
    low: dict = {}
    path: list = []
    out: list[list] = []
    for root in graph:
        work = [(root, iter(sorted(graph[root], key=lambda t: t.__name__)))] if root not in order else []
        if work:
            order[root] = low[root] = len(order)
            path.append(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in graph:
                    continue
                if other not in order:
                    order[other] = low[other] = len(order)
                    path.append(other)
                    work.append((other, iter(sorted(graph[other], key=lambda t: t.__name__))))
                    break
                if other in path:
                    low[node] = min(low[node], order[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    at = path.index(node)
                    out.append(path[at:])
                    del path[at:]
    return out


def is_axiom(rule: Rule) -> bool:
    return not rule.body and not rule.head.variables


def kept_side(rules: list[Rule], relation: type[Fact]) -> set[str]:
    """Sides that every recursive clause of `relation` passes on unchanged from its one recursive pattern.

    A filter on such a side may be put on the clauses that don't recurse: the fixpoint of the filtered relation is the
    filtered fixpoint.
    """
    sides = {"subject", "object"}
    for r in rules:
        calls = [a for a in r.body if type(a) is relation]
        if not calls:
            continue
        if len(calls) > 1:
            return set()
        for side in list(sides):
            term, passed = getattr(r.head, side), getattr(calls[0], side)
            if not (isinstance(term, Var) and isinstance(passed, Var) and term.name == passed.name):
                sides.discard(side)
    return sides


class Inference:
    """The inferred relations over one state of the stored ones; each is computed once, closures at the first use.

    seeds: facts of inferred types that are given, as rules derive others from them.
    """

    def __init__(self, spark: SparkSession, rules: list[Rule], stored: Callable[[type[Fact]], DataFrame], table, empty: Callable[[type[Fact]], DataFrame], unbound: str = "raise", max_rounds: int | None = MAX_ROUNDS, held: Callable = lambda kind: None, seeds: dict[type[Fact], DataFrame] | None = None):
        self.spark, self.stored, self.table, self.empty, self.held = spark, stored, table, empty, held
        self.unbound, self.max_rounds, self.seeds = unbound, max_rounds, seeds or {}
        self.by_head: dict[type[Fact], list[Rule]] = {}
        for r in rules:
            self.by_head.setdefault(type(r.head), []).append(r)
        graph = {head: {type(a) for r in own for a in r.body} for head, own in self.by_head.items()}
        self.group_of = {t: group for group in strongly_connected(graph) for t in group}
        self.graph = graph
        self.done: dict = {}

    def compiler(self, relation: Callable | None = None, spread: bool = True) -> ClauseCompiler:
        return ClauseCompiler(relation or self.relation, self.table, self.unbound, lambda kind: None if kind in self.by_head else self.held(kind), self._limited, spread)

    def _limited(self, kind: type[Fact]) -> set[str]:
        """Sides of a recursive relation whose limits hold for the whole iteration."""
        if kind not in self.by_head or not self._recursive(group := self.group_of[kind]) or len(group) > 1:
            return set()
        return kept_side(self.by_head[kind], kind)

    def relation(self, atom: Fact, limits: dict[str, tuple[str, DataFrame]] | None = None) -> DataFrame:
        """The relation of a pattern; a constant or a limit on a side that recursion keeps limits the iteration.

        limits: side -> (what the limit is, the keys that it leaves).
        """
        kind = type(atom)
        if kind not in self.by_head:
            return self.seeds.get(kind, self.empty(kind)) if kind.inferred else self.stored(kind)
        group = self.group_of[kind]
        if not self._recursive(group):
            return self._whole(kind)
        if len(group) == 1:
            sides = kept_side(self.by_head[kind], kind)
            fixed = {s: key_of(getattr(atom, s)) for s in sides if not isinstance(getattr(atom, s), Var)}
            limits = {s: limit for s, limit in (limits or {}).items() if s in sides}
            if fixed or limits:
                key = (kind, *sorted(fixed.items()), *((s, what) for s, (what, _) in sorted(limits.items())))
                if key not in self.done and kind not in self.done:
                    self.done[key] = self._iterate([kind], fixed, {s: keys for s, (_, keys) in limits.items()})[kind]
                found = self.done.get(key, self.done.get(kind))
                for side, (_, keys) in limits.items():
                    found = found.join(keys, side, "left_semi").select("subject", "object")
                return found
        return self._whole(kind)

    def _recursive(self, group: list[type[Fact]]) -> bool:
        return len(group) > 1 or group[0] in self.graph[group[0]]

    def _whole(self, kind: type[Fact]) -> DataFrame:
        if kind not in self.done:
            group = self.group_of[kind]
            if self._recursive(group):
                self.done |= self._iterate(group, {}, {})
            else:
                compiler = self.compiler()
                self.done[kind] = self._union(kind, [self._given(kind), *(self._clause(compiler, r) for r in self.by_head[kind])])
        return self.done[kind]

    def _clause(self, compiler: ClauseCompiler, rule: Rule) -> tuple[DataFrame, bool] | None:
        if is_axiom(rule):
            return self.spark.createDataFrame([tuple(key_of(t) for t in rule.head.terms)], self.empty(type(rule.head)).schema), True
        return compiler.clause(rule.head, rule.body)

    def _union(self, kind: type[Fact], parts: list[tuple[DataFrame, bool] | None]) -> DataFrame:
        """All parts' facts, each once; a single part that says that none repeats is taken as it is."""
        some = [p for p in parts if p is not None]
        if len(some) == 1 and some[0][1]:
            return some[0][0]
        return reduce(DataFrame.unionByName, (df for df, _ in some)).distinct() if some else self.empty(kind)

    def _given(self, kind: type[Fact]) -> tuple[DataFrame, bool] | None:
        return (self.seeds[kind], True) if kind in self.seeds else None

    def _step(self, kind: type[Fact], group: list[type[Fact]], delta: dict, whole: Callable) -> DataFrame:
        """What one round derives: every recursive pattern in turn reads only the last round's facts."""
        parts = []
        for r in self.by_head[kind]:
            for call in r.body:
                if type(call) not in group:
                    continue

                def turn(atom: Fact, limits=None, call=call) -> DataFrame:
                    if atom is call:
                        return delta[type(atom)]
                    return whole(type(atom)) if type(atom) in group else self.relation(atom, limits)

                found = self.compiler(turn, spread=False).clause(r.head, r.body)
                if found is not None and sum(type(a) in group for a in r.body) > 1:
                    found = found[0], False  # earlier rounds may repeat a fact
                parts.append(found)
        return self._union(kind, parts)

    def _iterate(self, group: list[type[Fact]], fixed: dict, limits: dict) -> dict[type[Fact], DataFrame]:
        """Semi-naive evaluation.

        Each round's new facts are written once to the shared folder, so plans stay short and lost executors cost a read;
        their number comes with the write.  Looking for repeats reads all earlier rounds, so beyond SMALL facts it is done
        at doubling distances for as long as none is found; the facts are made distinct at the end then.
        """
        compiler = self.compiler()
        delta, count, total, facts = {}, {}, {}, {}

        def keep(kind: type[Fact], df: DataFrame) -> None:
            path, rows, count[kind] = storage.stage_counted(df, kind.__name__)
            total.setdefault(kind, []).append(path)
            facts[kind] = facts.get(kind, 0) + count[kind]
            # files are far smaller than rows in memory, so what may be sent to all is said here
            delta[kind] = F.broadcast(rows) if count[kind] <= SMALL else rows.hint("merge")

        for kind in group:
            start = self._union(kind, [self._given(kind), *(self._clause(compiler, r) for r in self.by_head[kind] if not any(type(a) in group for a in r.body))])
            for side, value in fixed.items():
                start = start.where(F.col(side) == F.lit(value))
            for side, keys in limits.items():
                start = start.join(keys, side, "left_semi").select("subject", "object")
            keep(kind, start)
        schema = {kind: delta[kind].schema for kind in group}
        whole = lambda kind: self.spark.read.schema(schema[kind]).parquet(*total[kind])
        rounds, distance, wait, loose = 0, 1, 0, False
        while any(count.values()):
            if self.max_rounds is not None and rounds >= self.max_rounds:
                raise RuntimeError(f"no fixpoint of {', '.join(k.__name__ for k in group)} after {self.max_rounds} rounds")
            rounds += 1
            found = {kind: self._step(kind, group, delta, whole) for kind in group}
            look = not wait or sum(facts.values()) <= SMALL
            seen = {kind: Observation() for kind in group}
            if look:
                for kind, df in found.items():
                    known = whole(kind) if facts[kind] <= SMALL else whole(kind).hint("merge")
                    found[kind] = df.observe(seen[kind], F.count(F.lit(1)).alias("n")).join(known, ["subject", "object"], "left_anti").select("subject", "object")
            for kind, df in found.items():
                keep(kind, df)
            if look:
                distance = 2 * distance if all(seen[kind].get.get("n") == count[kind] for kind in group) else 1
                wait = distance - 1
            else:
                wait, loose = wait - 1, True
        return {kind: whole(kind).distinct() if loose else whole(kind) for kind in group}
