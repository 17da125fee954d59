"""Small worlds with known answers."""

import random
import re

import pytest

from hornlake import Bridge, Engine, Entity, Fact, Q, Var, analyze_query_patterns, convert_to_sql, rule, rule_context
from hornlake.cli import EXAMPLES, main, parse_patterns
from hornlake.functions.predicates import Unbound
from hornlake.plans.to_sql import to_sql
from hornlake.sources import storage


class Person(Entity):
    pass


class Company(Entity):
    pass


class Department(Entity):
    fields = {"company": "company_id"}
    references = {"company": Company}


class Project(Entity):
    fields = {"company": "company_id"}
    references = {"company": Company}


class Employee(Entity):
    fields = {"company": "company_id", "department": "department_id"}
    references = {"company": Company, "department": Department}


class Assignment(Entity):
    fields = {"employee": "employee_id", "project": "project_id"}
    references = {"employee": Employee, "project": Project}


Project.bridges = {"employees": Bridge(Assignment, "project", "employee")}


class ParentOf(Fact):
    subject: Person | Var
    object: Person | Var


class WorksFor(Fact):
    subject: Employee | Var
    object: Company | Var


class MemberOf(Fact):
    subject: Employee | Var
    object: Department | Var


class WorksOn(Fact):
    subject: Employee | Var
    object: Project | Var


class GrandparentOf(Fact, inferred=True):
    subject: Person | Var
    object: Person | Var


class SiblingOf(Fact, inferred=True):
    subject: Person | Var
    object: Person | Var


class Ancestor(Fact, inferred=True):
    subject: Person | Var
    object: Person | Var


class ColleaguesOf(Fact, inferred=True):
    subject: Employee | Var
    object: Employee | Var


JOHN, ALICE, BOB, CHARLIE = 1, 2, 3, 4


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def family(spark):
    e = Engine(spark)
    e.entity(Person, spark.createDataFrame([(1, "John", 65, "New York"), (2, "Alice", 40, "New York"), (3, "Bob", 18, "Boston"), (4, "Charlie", 10, None)], "id long, name string, age int, city string"))
    e.store_facts(ParentOf(JOHN, ALICE), ParentOf(ALICE, BOB), ParentOf(Person(ALICE), Person(CHARLIE)))
    return e


@pytest.fixture
def firm(spark):
    e = Engine(spark)
    make = spark.createDataFrame
    e.entity(Company, make([(1, "Tech", True), (2, "Old", False)], "id long, name string, is_active boolean"))
    e.entity(Department, make([(1, 1, 100000), (2, 1, 50000), (3, 2, 25000)], "id long, company_id long, budget int"))
    e.entity(Employee, make([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 2, False), (4, 2, 3, False)], "id long, company_id long, department_id long, is_manager boolean"))
    e.entity(Project, make([(1, 1, "Alpha"), (2, 2, "Beta"), (3, 2, "Cross")], "id long, company_id long, name string"))
    e.entity(Assignment, make([(1, 1, 1), (2, 2, 1), (3, 4, 2)], "id long, employee_id long, project_id long"))
    e.relation(WorksFor, make([(1, 1), (2, 1), (3, 1), (4, 2)], "subject long, object long"))
    e.relation(MemberOf, make([(1, 1), (2, 1), (3, 2), (4, 3)], "subject long, object long"))
    e.relation(WorksOn, make([(1, 1), (2, 1), (4, 2), (3, 3)], "subject long, object long"))
    return e


def test_constants_and_ground_queries(family):
    assert rows(family.query(ParentOf(ALICE, Var("c")), hydrate=False)) == [(BOB,), (CHARLIE,)]
    assert family.ask(ParentOf(ALICE, BOB)) and not family.ask(ParentOf(BOB, ALICE))
    assert family.query(ParentOf(ALICE, BOB)).count() == 1 and family.query().count() == 1
    assert rows(family.query(ParentOf(Var("x"), Var("x")), hydrate=False)) == []
    assert family.ask(ParentOf(JOHN, Var("a")), ParentOf(Var("a"), BOB))


def test_store_and_retract(family):
    family.store_facts(ParentOf(JOHN, ALICE), ParentOf(JOHN, ALICE))
    assert family.stored(ParentOf).count() == 3
    before = family.stored(ParentOf)
    family.retract_facts(ParentOf(JOHN, ALICE), ParentOf(9, 9))
    assert rows(family.query(ParentOf(JOHN, Var("c")), hydrate=False)) == [] and before.count() == 3
    for act in (family.store_facts, family.retract_facts):
        with pytest.raises(ValueError, match="inferred fact GrandparentOf.*computed automatically from rules"):
            act(GrandparentOf(1, 2))
        with pytest.raises(ValueError):
            act(ParentOf(1, Var("x")))
    family.store_facts()
    again = Engine(family.spark, path=family.path)
    again.entity(Person, family.table(Person))
    again.store_facts(ParentOf(7, 8))
    assert rows(again.stored(ParentOf)) == [(2, 3), (2, 4), (7, 8)]
    assert rows(again.check_references(ParentOf)) == [(2, 3), (2, 4)]


def test_inference(family):
    with rule_context():
        rule(GrandparentOf(Var("g"), Var("c")), ParentOf(Var("g"), Var("p")) & ParentOf(Var("p"), Var("c")))
        rule(SiblingOf(Var("a"), Var("b")), ParentOf(Var("p"), Var("a")) & ParentOf(Var("p"), Var("b")))
        assert rows(family.query(GrandparentOf(JOHN, Var("g")), hydrate=False)) == [(BOB,), (CHARLIE,)]
        assert rows(family.query(GrandparentOf(JOHN, Var("g", where=Q(age__gte=18))), hydrate=False)) == [(BOB,)]
        assert rows(family.query(SiblingOf(BOB, Var("s")), hydrate=False)) == [(BOB,), (CHARLIE,)]
        assert rows(family.query(SiblingOf(Var("x"), Var("x")), ParentOf(Var("p"), Var("x")), hydrate=False)) == [(ALICE, JOHN), (BOB, ALICE), (CHARLIE, ALICE)]
    assert rows(family.query(GrandparentOf(JOHN, Var("g")), hydrate=False)) == []


def test_hydration(family, spark):
    family.store_facts(ParentOf(CHARLIE, 99))
    found = {r["c"]["pk"]: r["c"]["name"] for r in family.query(ParentOf(Var("p"), Var("c"))).collect()}
    assert found == {ALICE: "Alice", BOB: "Bob", CHARLIE: "Charlie", 99: None}
    assert [b["c"] for b in family.iter(ParentOf(CHARLIE, Var("c")))] == [99]
    assert next(iter(family.iter(ParentOf(JOHN, Var("c")))))["c"]["name"] == "Alice"


def test_null_negation_and_bad_fields(family):
    ask = lambda q: [r[0] for r in rows(family.query(ParentOf(Var("p"), Var("c", where=q)), hydrate=False).select("c"))]
    assert ask(~Q(city="Boston")) == [ALICE, CHARLIE] and ask(Q(city=None)) == [CHARLIE] and ask(Q(city__isnull=False)) == [ALICE, BOB]
    assert ask(Q(city="Boston") ^ Q(age__lt=20)) == [CHARLIE] and ask(Q(name__iexact="bob") | Q(id=ALICE)) == [ALICE, BOB]
    assert ask(Q(name__in=["Bob", None])) == [BOB] and ask(Q(age__in=[])) == [] and ask(Q(name__istartswith="CH", name__regex="e$")) == [CHARLIE]
    for bad in (Q(nope=1), Q(name__nope=1), Q(nope=Var("p"))):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(Unbound):
        ask(Q(age=Var("zzz")))
    family.unbound = "ignore"
    assert ask(Q(age=Var("zzz"))) == [ALICE, BOB, CHARLIE]


CROSS = (WorksFor(Var("emp"), Var("company")), WorksOn(Var("emp"), Var("project", where=Q(company=Var("company")))))


def test_cross_variable_constraints(firm):
    emps = lambda *p: [r[0] for r in rows(firm.query(*p, hydrate=False).select("emp"))]
    assert emps(*CROSS) == [1, 2, 4]
    company = Var("company", where=Q(is_active=True, department__in=[Var("dept")]))
    assert emps(MemberOf(Var("emp"), Var("dept")), WorksFor(Var("emp"), company)) == [1, 2, 3]
    assert emps(MemberOf(Var("emp", where=Q(is_manager=True)), Var("dept", where=Q(budget__gt=75000))), WorksFor(Var("emp"), company)) == [1]
    assert emps(WorksFor(Var("emp", where=Q(company__is_active=True, department__budget__lt=60000)), Var("c"))) == [3]
    assert emps(WorksOn(Var("emp"), Var("p", where=Q(employees=4)))) == [4] and emps(WorksOn(Var("emp"), Var("p", where=Q(employees__is_manager=True)))) == [1, 2]
    assert emps(WorksOn(Var("emp"), Var("p", where=Q(employees=Var("emp"))))) == [1, 2, 4]
    active = firm.query(WorksFor(Var("e1"), Var("c", where=Q(is_active=True))), WorksFor(Var("e2"), Var("c")), hydrate=False)
    assert active.count() == 9


def test_paths_over_several_relations(spark):
    e, make = Engine(spark), spark.createDataFrame
    e.entity(Company, make([(1, "Tech"), (2, "Old"), (3, "New")], "id long, name string"))
    e.entity(Department, make([(1, 1, 5), (2, 2, None)], "id long, company_id long, budget int"))
    e.entity(Employee, make([(1, 1, 1, True), (2, 2, 2, False), (3, None, None, False)], "id long, company_id long, department_id long, is_manager boolean"))
    e.entity(Project, make([(1, 1, "A"), (2, 2, "B"), (3, 2, "C")], "id long, company_id long, name string"))
    e.entity(Assignment, make([(1, 1, 1), (2, 2, 1), (3, 2, 2)], "id long, employee_id long, project_id long"))
    e.relation(WorksFor, make([(1, 1), (2, 2), (3, 3)], "subject long, object long"))
    e.relation(WorksOn, make([(1, 1), (2, 2), (2, 3)], "subject long, object long"))
    for kind in (Company, Department, Employee, Project, Assignment):
        e.table(kind).createOrReplaceTempView(kind.__name__)
    for kind in (WorksFor, WorksOn):
        e.stored(kind).createOrReplaceTempView(kind.__name__)

    def ask(q, side="c"):
        patterns = [WorksFor(Var("e", where=q if side == "e" else None), Var("c", where=q if side == "c" else None))]
        got = rows(e.query(*patterns, hydrate=False))
        assert rows(spark.sql(to_sql(patterns, lambda k: e.table(k).columns))) == got
        return got

    assert ask(Q(department__employee__id__lt=2)) == ask(Q(department__employee__is_manager=True)) == [(1, 1)]
    assert ask(Q(department__employee__department__budget=None)) == [(2, 2), (3, 3)] and ask(Q(department__isnull=True)) == [(3, 3)]
    assert ask(~Q(department__employee=1)) == [(2, 2), (3, 3)] and ask(Q(department__employee=Var("e"))) == [(1, 1), (2, 2)]
    assert ask(Q(project__employees__department__company=Var("c"))) == [(1, 1), (2, 2)] and ask(Q(project__employees__id__in=[1])) == [(1, 1)]
    assert ask(Q(company__name=None), "e") == [(3, 3)] and ask(Q(company__name__isnull=True) | Q(assignment__project__name="B"), "e") == [(2, 2), (3, 3)]
    assert rows(e.query(WorksOn(Var("x"), Var("p", where=Q(employees__isnull=True))), hydrate=False)) == [(2, 3)]


def test_names_of_variables(family):
    got = family.query(ParentOf(Var("a.b"), Var("X`")), ParentOf(Var("X`"), Var("x`")), hydrate=False)
    assert got.columns == ["a.b", "X`", "x`"] and rows(got) == [(JOHN, ALICE, BOB), (JOHN, ALICE, CHARLIE)]
    assert [b["a.b"]["name"] for b in family.iter(ParentOf(Var("a.b"), BOB))] == ["Alice"]
    ages = family.query(ParentOf(Var("the parent", where=Q(age__gt=50)), Var("The Parent")), hydrate=False)
    assert rows(ages) == [(JOHN, ALICE)]


def test_given_facts_of_inferred_types(family, spark):
    with rule_context():
        rule(Ancestor(Var("x"), Var("y")), ParentOf(Var("x"), Var("y")))
        rule(Ancestor(Var("x"), Var("z")), Ancestor(Var("x"), Var("y")) & ParentOf(Var("y"), Var("z")))
        rule(SiblingOf(Var("x"), Var("y")), Ancestor(Var("z"), Var("x")) & GrandparentOf(Var("z"), Var("y")))
        base = {Ancestor: spark.createDataFrame([(7, 8), (9, JOHN)], "subject long, object long"), GrandparentOf: spark.createDataFrame([(7, 5)], "subject long, object long")}
        found = family.materialize(base)
        assert {(7, 8), (9, 1), (9, 2), (9, 3), (9, 4), (1, 3)} <= set(rows(found[Ancestor])) and len(rows(found[Ancestor])) == 10
        assert rows(found[SiblingOf]) == [(8, 5)] and rows(found[GrandparentOf]) == [(7, 5)]
        listed = family.materialize([ParentOf(1, 2), ParentOf(2, 3), Ancestor(3, 9)])
        assert rows(listed[Ancestor]) == [(1, 2), (1, 3), (2, 3), (3, 9)] and rows(listed[ParentOf]) == [(1, 2), (2, 3)]
        with pytest.raises(ValueError, match="ground"):
            family.materialize([ParentOf(1, Var("x"))])


def test_limits_are_pushed_into_recursion(spark):
    e = Engine(spark)
    e.entity(Person, spark.createDataFrame([(i, i) for i in range(15)], "id long, age int"))
    e.relation(ParentOf, spark.createDataFrame([(i, i + 1) for i in range(14)], "subject long, object long"), unique=True)
    with rule_context():
        rule(Ancestor(Var("x"), Var("y")), ParentOf(Var("x"), Var("y")))
        rule(Ancestor(Var("x"), Var("z")), Ancestor(Var("x"), Var("y")) & ParentOf(Var("y"), Var("z")))
        few = e.query(Ancestor(Var("a", where=Q(age__gte=12)), Var("b", where=Q(age__lt=14))), hydrate=False)
        assert rows(few) == [(12, 13)]
        assert all(df.count() == 3 for key, df in e._inference().done.items()) and len(e._inference().done) == 1
        assert e.query(Ancestor(Var("a"), Var("b")), hydrate=False).count() == 14 * 15 // 2
        again = e._inference()
        assert e.query(Ancestor(Var("a"), 14), hydrate=False).count() == 14 and e._inference() is again
    e.store_facts(ParentOf(14, 15))
    assert e._inference() is not again


def test_storage_adds_and_deletes_segments(spark, monkeypatch):
    monkeypatch.setattr(storage, "DELETES", 3)
    e = Engine(spark)
    for i in range(5):
        e.store_facts(*(ParentOf(i, j) for j in range(3)))
        e.retract_facts(ParentOf(i, 0), ParentOf(i, 7))
    e.store_facts(ParentOf(3, 0), ParentOf(3, 1))
    assert rows(e.stored(ParentOf)) == sorted({(i, j) for i in range(5) for j in (1, 2)} | {(3, 0)})
    assert sum(s.startswith("-") for s in e._tables[ParentOf].segments) < 3


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    from hornlake.plans import catalogue

    for name, rows_ in {"region": "id r_regionkey, 'ASIA' r_name", "nation": "id n_nationkey, 'N' n_name, id % 5 n_regionkey", "customer": "id c_custkey, 'C' c_name, id % 9 c_nationkey, 1.0D c_acctbal, 'MACHINERY' c_mktsegment", "supplier": "id s_suppkey, 'S' s_name, id % 9 s_nationkey, 1.0D s_acctbal"}.items():
        spark.range(9).selectExpr(*rows_.split(", ")).write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = lambda name: physical(catalogue.QUERIES[name](spark, str(tmp_path)))
    assert plan("where_eq").count("FileScan parquet") == 1 and "PushedFilters: [IsNotNull(c_mktsegment)" in plan("where_eq")
    assert plan("where_fk_path").count("FileScan parquet") == 3
    mixed = catalogue.QUERIES["cross_in_mixed"](spark, str(tmp_path))
    products = re.findall("Join Cross\n", mixed._jdf.queryExecution().optimizedPlan().toString())
    assert len(products) == 1  # the constant's branch, whose result is one


def test_rule_body_constraints_are_enforced(firm):
    with rule_context():
        dept = Var("d2", where=Q(company=Var("company")))
        rule(ColleaguesOf(Var("a"), Var("b")), (MemberOf(Var("a"), Var("d1", where=Q(company=Var("company")))), WorksFor(Var("a"), Var("company")), WorksFor(Var("b"), Var("company")), MemberOf(Var("b"), dept)))
        assert rows(firm.query(ColleaguesOf(1, Var("c")), hydrate=False)) == [(1,), (2,), (3,)]
    with rule_context():
        rule(ColleaguesOf(Var("a", where=Q(is_manager=True)), Var("b")), (WorksFor(Var("a"), Var("k")), WorksFor(Var("b"), Var("k"))))
        assert rows(firm.query(ColleaguesOf(Var("x"), Var("y")), hydrate=False)) == [(1, 1), (1, 2), (1, 3)]


def test_type_checks(firm):
    with pytest.raises(TypeError):
        firm.query(WorksFor(Var("x"), Var("y")), MemberOf(Var("x"), Var("y")))
    with pytest.raises(TypeError):
        firm.query(WorksFor(Company(1), Var("y")))


def closure(edges):
    out = set(edges)
    while new := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= new
    return out


@pytest.mark.parametrize("linear", [True, False])
def test_recursion_matches_a_naive_closure(spark, linear):
    random.seed(5 + linear)
    edges = {(1, 2), (2, 3), (3, 4), (4, 2)} | {(random.randrange(12), random.randrange(12)) for _ in range(14)}
    e = Engine(spark)
    e.relation(ParentOf, spark.createDataFrame(sorted(edges), "subject long, object long"))
    with rule_context():
        rule(Ancestor(Var("x"), Var("y")), ParentOf(Var("x"), Var("y")))
        rule(Ancestor(Var("x"), Var("z")), Ancestor(Var("x"), Var("y")) & (ParentOf if linear else Ancestor)(Var("y"), Var("z")))
        assert set(rows(e.query(Ancestor(Var("a"), Var("b")), hydrate=False))) == closure(edges)
        assert {r[0] for r in rows(e.query(Ancestor(1, Var("b")), hydrate=False))} == {b for a, b in closure(edges) if a == 1}
        e.max_rounds = 1
        with pytest.raises(RuntimeError, match="no fixpoint"):
            e.query(Ancestor(Var("a"), Var("b"))).count()


def test_analysis_and_sql(firm, spark):
    report = analyze_query_patterns(list(CROSS))
    assert report["join_variables"] == ["emp"] and report["optimization_potential"] == "HIGH" and report["complexity_score"] == 3
    assert set(report["variables"]) == {"emp", "company", "project"} and report["primary_model"] == "Employee"
    result = convert_to_sql(list(CROSS), columns=lambda k: firm.table(k).columns)
    assert (result.original_query_count, result.optimized_query_count) == (7, 1) and round(result.improvement_percentage, 1) == 85.7
    assert result.patterns_used[0].name == "CROSS_VARIABLE" and convert_to_sql([]).improvement_percentage == 0
    for kind in (Company, Department, Employee, Project, Assignment):
        firm.table(kind).createOrReplaceTempView(kind.__name__)
    for kind in (WorksFor, MemberOf, WorksOn):
        firm.stored(kind).createOrReplaceTempView(kind.__name__)
    columns = lambda k: firm.table(k).columns
    for patterns in (CROSS, (WorksFor(Var("e", where=~Q(is_manager=True) & Q(company__name__icontains="TE")), Var("c")),), (WorksOn(Var("e"), Var("p", where=Q(employees__is_manager=True) | Q(name="Beta"))),), (MemberOf(Var("e"), Var("d")), WorksFor(Var("e"), Var("c", where=Q(department__in=[Var("d")])))), (WorksFor(1, Var("c")),)):
        assert rows(spark.sql(to_sql(list(patterns), columns))) == rows(firm.query(*patterns, hydrate=False))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    source = tmp_path / "q.py"
    source.write_text("query(WorksFor(Var('emp'), Var('company')), WorksOn(Var('emp'), Var('p', where=Q(company=Var('company')))))\n")
    assert len(parse_patterns(source.read_text())[0]) == 2
    for shape in ("code", "json", "markdown"):
        out = tmp_path / shape
        assert main(["--file", str(source), "--format", shape, "--output", str(out)]) == 0 and "WorksFor" in out.read_text()
    source.write_text("query(SupplierIn(Var('s', where=Q(nation__region__name='ASIA', acctbal__gt=1.5, opened__year=1999)), Var('n')))\n")
    assert main(["--file", str(source), "--explain"]) == 0 and "Join" in capsys.readouterr().out
    for number, text in EXAMPLES.items():
        said = iter([number, "query(", ""])
        monkeypatch.setattr("builtins.input", lambda _, said=said: next(said))
        assert main(["--interactive"]) == 0
        shown = capsys.readouterr().out
        assert text.split("(")[1] in shown and "not understood" in shown
    assert main(["--analyze"]) == 0 and "CROSS_VARIABLE" in capsys.readouterr().out
    assert main(["--file", str(tmp_path / "none.py")]) == 2


def test_catalogue_has_sql_for_every_query():
    from hornlake.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_stream(spark, tmp_path):
    from hornlake.streaming import store_stream

    e = Engine(spark)
    spark.createDataFrame([(1, 2), (2, 3), (1, 2)], "subject long, object long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject long, object long").parquet(str(tmp_path / "in"))
    store_stream(e, ParentOf, stream, str(tmp_path / "check"), availableNow=True).awaitTermination(60)
    assert rows(e.stored(ParentOf)) == [(1, 2), (2, 3)]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Few nations, each with many customers and suppliers."""
    at = tmp_path_factory.mktemp("star")
    tables = {
        "region": (3, ["id r_regionkey", "'ASIA' r_name"]),
        "nation": (5, ["id n_nationkey", "'A' n_name", "id % 3 n_regionkey"]),
        "customer": (60, ["id c_custkey", "'C' c_name", "cast(id % 3 as int) c_nationkey", "1.0D c_acctbal", "if(id % 2 = 0, 'BUILDING', 'MACHINERY') c_mktsegment"]),
        "supplier": (30, ["id s_suppkey", "'S' s_name", "id % 3 s_nationkey", "1.0D s_acctbal"]),
        "part": (9, ["id p_partkey", "'P' p_name", "'B' p_brand", "'T' p_type", "1 p_size", "1.0D p_retailprice"]),
        "lineitem": (9, ["id l_orderkey", "id l_partkey", "id l_suppkey", "1.0D l_quantity"]),
        "orders": (60, ["id o_orderkey", "id o_custkey", "'F' o_orderstatus", "if(id % 4 = 1, 490000D, 1D) o_totalprice"]),
    }
    for name, (n, columns) in tables.items():
        spark.range(n).selectExpr(*columns).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_keys_with_many_rows_are_dealt_in_blocks(spark, star, monkeypatch):
    from hornlake.operators import spread
    from hornlake.plans import catalogue

    monkeypatch.setattr(spread, "PAIRS", 7)  # 20 customers and 10 suppliers of a nation are 200 pairs
    got = catalogue.QUERIES["cross_eq"](spark, star)
    assert rows(got) == sorted((s, s % 3, c, c % 3) for s in range(30) for c in range(60) if s % 3 == c % 3)
    assert "RepartitionByExpression" in optimized(got)
    left = spark.range(40).selectExpr("cast(if(id < 35, 1, id) as int) k", "id a")
    right = spark.range(11).selectExpr("if(id < 9, 1L, id + 30) k", "id b")
    joined = spread.spread_join(left, right, ["k"]).select("k", "a", "b")
    assert rows(joined) == rows(left.join(right, "k").select("k", "a", "b")) and joined.count() == 35 * 9 + 1
    blocks = spread.spread_join(left, right, ["k"]).selectExpr("spark_partition_id() p").distinct().count()
    assert blocks > 5  # one key, yet many tasks


def test_variable_across_a_reverse_relation_needs_no_product(spark, star):
    from hornlake.plans import catalogue

    got = catalogue.QUERIES["where_reverse_var"](spark, star)
    assert rows(got) == sorted((s, s % 3, o, o) for s in range(30) for o in range(1, 60, 4) if s % 3 in (o % 3, 0))
    assert optimized(got).count("Join Cross") == 1  # the constant's branch, whose result is one


def test_rule_whose_facts_cannot_repeat_has_no_distinct(spark, star):
    from hornlake.plans import catalogue

    got = catalogue.QUERIES["rule_body_where"](spark, star)
    assert rows(got) == sorted((a, b) for a in range(0, 60, 2) for b in range(0, 60, 2) if a % 3 == b % 3)
    assert not re.search(r"Aggregate \[a#\d+L?, b#|Aggregate \[v_a#\d+L?, v_b#", optimized(got)) and "Aggregate [subject" not in optimized(got)


def test_body_variable_that_is_not_needed_multiplies_nothing(spark, star):
    from hornlake.plans import catalogue

    got = catalogue.QUERIES["rule_disjunction"](spark, star)
    assert rows(got) == sorted({(c, c % 3) for c in range(60)} | {(s, s % 3) for s in range(30)})
    assert "Join Inner" not in optimized(got) and "Join LeftSemi" in optimized(got)


def test_links_with_several_variables_and_constants_are_disjoint(spark):
    e, make = Engine(spark), spark.createDataFrame
    e.entity(Company, make([(i,) for i in range(6)], "id long"))
    e.entity(Department, make([(1, 1), (2, 2), (3, None)], "id long, company_id long"))
    e.entity(Employee, make([(1, 1, 1), (2, 2, 2), (3, 2, 3), (4, None, 1), (5, 3, 1)], "id long, company_id long, department_id long"))
    e.relation(MemberOf, make([(1, 1), (1, 2), (2, 2), (3, 3), (4, 1), (5, 1)], "subject long, object long"))
    e.relation(WorksFor, make([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)], "subject long, object long"))
    company = {1: 1, 2: 2, 3: 2, 4: None, 5: 3}
    member, works = [(1, 1), (1, 2), (2, 2), (3, 3), (4, 1), (5, 1)], [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    q = Q(company__in=[Var("c"), Var("c2"), 3])
    got = e.query(MemberOf(Var("e", where=q), Var("d")), WorksFor(Var("x"), Var("c")), WorksFor(Var("y"), Var("c2")), hydrate=False)
    want = sorted((a, d, x, c, y, c2) for a, d in member for x, c in works for y, c2 in works if company[a] is not None and company[a] in (c, c2, 3))
    assert rows(got.select("e", "d", "x", "c", "y", "c2")) == want
    far = e.query(WorksFor(Var("x"), Var("c", where=Q(department__employee__in=[Var("e"), 5]))), MemberOf(Var("e"), Var("d")), hydrate=False)
    reach = {1: {1, 4, 5}, 2: {2}}
    assert rows(far.select("x", "c", "e", "d")) == sorted((x, c, a, d) for x, c in works for a, d in member if reach.get(c, set()) & {a, 5})


def test_sql_text_filters_first_and_has_no_distinct_over_sets(spark, star):
    from hornlake.plans import catalogue

    got = catalogue.QUERIES["sql_text"](spark, star)  # every supplier has less than 100, and no name ends with 7
    assert got.columns == ["c", "n", "s", "r"] and got.count() == 0
    assert "SortMergeJoin" in physical(got) and "BroadcastHashJoin" not in physical(got) and "Aggregate [c#" not in optimized(got)
    text = to_sql(catalogue._TEXT_PATTERNS, lambda kind: catalogue.world(spark, star).table(kind).columns, sets=True)
    assert "DISTINCT" not in text and "FROM SupplierIn f1 WHERE" in text
    assert "DISTINCT" in to_sql(catalogue._TEXT_PATTERNS, lambda kind: catalogue.world(spark, star).table(kind).columns)


@pytest.mark.parametrize("linear", [True, False])
def test_recursion_that_looks_for_repeats_at_doubling_distances(spark, monkeypatch, linear):
    from hornlake.operators import fixpoint

    monkeypatch.setattr(fixpoint, "SMALL", 0)
    edges = {(i, i + 1) for i in range(9)} | {(9, 6), (20, 3)}  # a path into a circle
    e = Engine(spark)
    e.relation(ParentOf, spark.createDataFrame(sorted(edges), "subject long, object long"))
    with rule_context():
        rule(Ancestor(Var("x"), Var("y")), ParentOf(Var("x"), Var("y")))
        rule(Ancestor(Var("x"), Var("z")), Ancestor(Var("x"), Var("y")) & (ParentOf if linear else Ancestor)(Var("y"), Var("z")))
        found = e.query(Ancestor(Var("a"), Var("b")), hydrate=False)
        assert rows(found) == sorted(closure(edges))
        if linear:
            assert "Aggregate" in physical(found)  # some rounds were not compared with the earlier ones


def test_distinct_over_a_join_has_tasks_by_its_input(spark, tmp_path, monkeypatch):
    from hornlake.operators import spread

    monkeypatch.setattr(spread, "BYTES", 16)
    spark.range(500).selectExpr("id % 7 a", "id % 3 b").write.parquet(str(tmp_path / "t"))
    got = spread.distinct_rows(spark.read.parquet(str(tmp_path / "t")))
    assert got.count() == 21 and int(re.search(r"hashpartitioning\(a.*?, (\d+)\)", physical(got)).group(1)) > spread._tasks(got)


def partitions(df):
    return int(re.search(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", physical(df)).group(1))


def test_tasks_of_a_join_grow_with_its_pairs(spark, star, monkeypatch):
    from hornlake.operators import spread
    from hornlake.plans import catalogue

    monkeypatch.setattr(spread, "PAIRS", 2)  # a region's one nation has 20 customers and 10 suppliers
    got = catalogue.QUERIES["shared_constraint"](spark, star)
    assert rows(got) == sorted((c, n, s) for c in range(60) for n in (2,) for s in range(30) if c % 3 == s % 3 == n)
    assert partitions(got) == 200 > spread._tasks(got)
    even = spread.spread_join(spark.range(300).selectExpr("id k", "1 a"), spark.range(300).selectExpr("id k", "2 b"), ["k"])
    assert even.count() == 300 and partitions(even) == 300  # no key has several blocks


def test_products_are_dealt_in_blocks(spark, star, monkeypatch):
    from hornlake.operators import spread
    from hornlake.plans import catalogue

    monkeypatch.setattr(spread, "PAIRS", 2)
    got = catalogue.QUERIES["cross_in_mixed"](spark, star)
    assert rows(got) == sorted((s, s % 3, c, c % 3) for s in range(30) for c in range(1, 60, 2) if c % 3 == s % 3)
    left, right = spark.range(40).selectExpr("id a"), spark.range(11).selectExpr("id % 10 b")
    product = spread.crossed(left, right)
    assert rows(product) == rows(left.crossJoin(right)) and "Join Cross" not in optimized(product)
    assert partitions(product) == 440 and product.selectExpr("spark_partition_id() p").distinct().count() > spread._tasks(product)
    one = spread.crossed(spark.range(1).select(), right)  # a side without columns, as a ground pattern's
    assert rows(one) == rows(right)


def test_constant_across_a_reverse_relation_is_dealt_in_blocks(spark, star, monkeypatch):
    from hornlake.operators import spread
    from hornlake.plans import catalogue

    monkeypatch.setattr(spread, "PAIRS", 2)
    got = catalogue.QUERIES["where_reverse_var"](spark, star)
    assert rows(got) == sorted((s, s % 3, o, o) for s in range(30) for o in range(1, 60, 4) if s % 3 in (o % 3, 0))
    assert not re.search(r"Join Cross|Join Inner\n", optimized(got))


def test_tasks_of_a_rule_grow_with_its_facts(spark, star, monkeypatch):
    from hornlake.operators import spread
    from hornlake.plans import catalogue

    monkeypatch.setattr(spread, "PAIRS", 2)  # 3 nations of 10 customers each: 300 pairs
    got = catalogue.QUERIES["rule_body_where"](spark, star)
    assert rows(got) == sorted((a, b) for a in range(0, 60, 2) for b in range(0, 60, 2) if a % 3 == b % 3)
    assert partitions(got) == 300
