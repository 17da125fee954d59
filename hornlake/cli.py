"""Command line: analyse queries written in Python source, and print them as SQL or as Spark's plan."""

from __future__ import annotations

import argparse
import ast
import json
import sys
from dataclasses import asdict
from typing import Any

from .facts import Fact
from .plans.analyze import analyze_query_patterns
from .plans.to_sql import KNOWN_PATTERNS, ConversionResult, convert_to_sql
from .sources.entities import Entity
from .terms import Q, Var

#: Queries over the catalogue's fact types, to try.
EXAMPLES = {
    "1": "query(SupplierIn(Var('s'), Var('n')), CustomerIn(Var('c', where=Q(nation=Var('n'))), Var('m')))",
    "2": "query(PlacedBy(Var('o'), Var('c')), CustomerIn(Var('c'), Var('n')))",
    "3": "query(PartParent(Var('p'), Var('q', where=Q(size__gte=10))))",
}


class _Open(dict):
    """References of a stand-in entity type: any field may lead to another one."""

    def __init__(self, entity):
        super().__init__()
        self.entity = entity

    def __contains__(self, name: object) -> bool:
        return True

    def __getitem__(self, name: str) -> type[Entity]:
        return self.entity(name.capitalize())


class _Reader:
    """Builds patterns from the syntax of query(...) calls; nothing of the source is run."""

    def __init__(self):
        self.types: dict[str, type] = {}
        self.entities: dict[str, type[Entity]] = {}

    def entity(self, name: str) -> type[Entity]:
        """A stand-in entity type that has every field."""
        if name not in self.entities:
            column = classmethod(lambda cls, field, columns: cls.key if field in ("id", "pk") else field)
            self.entities[name] = type(name, (Entity,), {"column": column, "references": _Open(self.entity)})
            Entity.known.remove(self.entities[name])
        return self.entities[name]

    def value(self, node: ast.expr) -> Any:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name = node.func.id
            args, named = [self.value(a) for a in node.args], {k.arg: self.value(k.value) for k in node.keywords}
            if name in ("Var", "Q"):
                return {"Var": Var, "Q": Q}[name](*args, **named)
            if len(args) == 2 and not named:
                if name not in self.types:
                    self.types[name] = type(Fact)(name, (Fact,), {"__annotations__": {}}, inferred=True)
                    self.types[name].types = {side: self.entity(f"{name}_{side}") for side in ("subject", "object")}
                return self.types[name](*args)
            return self.entity(name)(*args)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            a, b = self.value(node.left), self.value(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b if isinstance(node.op, ast.BitOr) else a ^ b
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return ~self.value(node.operand)
        if isinstance(node, (ast.List, ast.Tuple)):
            return [self.value(x) for x in node.elts]
        return ast.literal_eval(node)


def parse_patterns(source: str) -> list[list[Fact]]:
    """The patterns of each query(...) call in Python source.  Variables of one name share one stand-in type."""
    out = []
    for node in ast.walk(ast.parse(source)):
        if not (isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "query"):
            continue
        reader = _Reader()
        patterns = [p for a in node.args for v in [reader.value(a)] for p in ([v] if isinstance(v, Fact) else v)]
        shared: dict[str, type[Entity]] = {}
        for p in patterns:
            for side, term in zip(("subject", "object"), p.terms, strict=True):
                if isinstance(term, Var):
                    p.types[side] = shared.setdefault(term.name, p.types[side])
                elif isinstance(term, Entity):
                    p.types[side] = type(term)
        out.append(patterns)
    return out


def shown(patterns: list[Fact], result: ConversionResult, shape: str) -> str:
    if shape == "json":
        return json.dumps({"patterns": [repr(p) for p in patterns], "analysis": analyze_query_patterns(patterns), "conversion": asdict(result)}, default=str, indent=2)
    counts = f"{result.original_query_count} -> {result.optimized_query_count} statements, {result.improvement_percentage:.1f} % fewer"
    kinds = ", ".join(p.name for p in result.patterns_used)
    if shape == "markdown":
        notes = "".join(f"\n- warning: {w}" for w in result.warnings)
        return f"## {kinds}\n\n```\n{' & '.join(map(repr, patterns))}\n```\n\n```sql\n{result.sql}\n```\n\n- {counts}{notes}"
    notes = "".join(f"\n-- warning: {w}" for w in result.warnings)
    return f"-- {' & '.join(map(repr, patterns))}\n-- {kinds}: {counts}{notes}\n{result.sql}"


def explained(patterns: list[Fact]) -> str:
    """What the analysis says of the patterns, and Spark's plan of them over empty tables that have the fields named."""
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .functions.predicates import Path

    kinds = {bool: "boolean", str: "string", float: "double"}
    tables: dict[type[Entity], dict[str, str]] = {t: {} for p in patterns for t in type(p).entity_types().values() if t}
    for term in (t for p in patterns for t in p.variables if t.where is not None):
        at = next(t for p in patterns for side, t in type(p).entity_types().items() if getattr(p, side) is term)
        for path, value in term.where.leaves():
            own, found = at, Path(at, path, lambda _: [])
            for column, target in found.forward:
                tables.setdefault(own, {}).setdefault(column, "bigint")
                tables.setdefault(own := target, {})
            first = value[0] if isinstance(value, (list, tuple)) and value else value
            kind = "timestamp" if found.transforms else kinds.get(type(first), "date" if hasattr(first, "isoformat") else "bigint")
            if found.column != own.key:
                tables.setdefault(own, {}).setdefault(found.column, kind)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark)
    for entity, fields in tables.items():
        engine.entity(entity, spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in {entity.key: "bigint", **fields}.items())))
    for p in patterns:
        own = type(p)
        own.inferred = False
        engine.relation(own, spark.createDataFrame([], "subject bigint, object bigint"), unique=True)
    plan = engine.query(*patterns, hydrate=False)._jdf.queryExecution().optimizedPlan().toString()
    return json.dumps(analyze_query_patterns(patterns), default=str, indent=2) + "\n" + plan


def report(source: str, shape: str, explain: bool = False) -> str:
    if explain:
        return "\n\n".join(map(explained, parse_patterns(source)))
    return "\n\n".join(shown(p, convert_to_sql(p), shape) for p in parse_patterns(source))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hornlake", description=__doc__)
    parser.add_argument("--interactive", "-i", action="store_true", help="read query(...) calls, or the number of an example")
    parser.add_argument("--file", "-f", help="Python source with query(...) calls")
    parser.add_argument("--analyze", "-a", action="store_true", help="list the query shapes that reports tell apart")
    parser.add_argument("--output", "-o", help="write the report to this file")
    parser.add_argument("--format", choices=["code", "json", "markdown"], default="code")
    parser.add_argument("--explain", "-e", action="store_true", help="with --file or --interactive: the analysis and Spark's optimized plan instead of SQL")
    args = parser.parse_args(argv)
    if args.analyze:
        text = "\n".join(f"{p.name}: {p.description} ({p.query_count_improvement} statements)" for p in KNOWN_PATTERNS)
    elif args.file:
        try:
            with open(args.file, encoding="utf-8") as file:
                text = report(file.read(), args.format, args.explain)
        except OSError as error:
            print(f"{args.file}: {error.strerror}", file=sys.stderr)
            return 2
    elif args.interactive:
        while (line := input("query, example number, or empty to end: ").strip()):
            try:
                print(report(EXAMPLES.get(line, line), args.format, args.explain) or "no query(...) call there")
            except (SyntaxError, TypeError, ValueError) as error:
                print(f"not understood: {error}")
        return 0
    else:
        parser.print_help()
        return 1
    if args.output:
        with open(args.output, "w", encoding="utf-8") as file:
            file.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
