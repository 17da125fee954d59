"""The rule language: variables, constraints, fact algebra, rule registration.  No session is needed."""

import pytest

from hornlake import Entity, Fact, FactConjunction, Q, Rule, Var, extract_variable_references, fact_filters, get_rules, has_variable_references, optimize_query, prefix_q, rule, rule_context, substitute_variables_in_q
from hornlake.operators.fixpoint import strongly_connected
from hornlake.rules import alternatives


class Thing(Entity):
    pass


class Other(Entity):
    pass


class Has(Fact):
    subject: Thing | Var
    object: Thing | Var


class Sees(Fact):
    subject: Thing | Var
    object: Thing | Var


class Knows(Fact, inferred=True):
    subject: Thing | Var
    object: Thing | Var


A, B = Has(Var("x"), Var("y")), Sees(Var("y"), Var("z"))


def test_reprs():
    assert repr(Var("x")) == "Var('x')"
    assert repr(Var("x", where=Q(a=1))) == "Var('x', where=(a=1))"
    assert repr(A & B) == f"{A!r} & {B!r}"
    assert repr(Rule(Knows(Var("x"), Var("y")), [A])) == f"Rule({Knows(Var('x'), Var('y'))!r} :- {A!r})"


def test_algebra():
    assert isinstance(A & B, FactConjunction) and (A & B) == (A, B)
    assert A & (B, A) == (A, B, A) and (B, A) & A == (B, A, A)
    assert A | B == [A, B] and A | [B, A] == [A, B, A] and [B] | A == [B, A]
    assert A | (B, A) == [A, (B, A)] and (B, A) | A == [(B, A), A]
    assert (A & B) | A == [(A, B), A] and (A & B) & B == (A, B, B)
    for bad in (lambda: A & [B], lambda: A | 1, lambda: A & "x", lambda: 1 | A, lambda: [A] & B):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(TypeError, match="Lists represent disjunction"):
        A & [B]


def test_fact_identity_and_declaration():
    assert Has(Thing(1), Thing(2)) == Has(Thing(1), Thing(2)) != Sees(Thing(1), Thing(2))
    assert len({Has(1, 2), Has(Thing(1), Thing(2)), Has(Var("x"), 2), Has(Var("x"), 2)}) == 2
    with pytest.raises(ValueError):
        type("Bad", (Fact,), {"__annotations__": {"subject": Thing}})
    with pytest.raises(ValueError):
        type("Bad", (Fact,), {"__annotations__": {"subject": Thing, "object": int}})
    with pytest.warns(UserWarning, match="several"):
        kind = type("Two", (Fact,), {"__annotations__": {"subject": Thing | Other, "object": Thing}})
    assert kind.entity_types() == {"subject": Thing, "object": Thing}


def test_constraint_trees():
    q = Q(a=1) & ~(Q(b=Var("v")) | Q(c__in=[Var("w"), (Var("v"), 2)]))
    assert has_variable_references(q) and not has_variable_references(Q(a=1)) and not has_variable_references(None)
    assert extract_variable_references(q) == {"v": ["b", "c__in"], "w": ["c__in"]}
    bound = substitute_variables_in_q(q, {"v": 7})
    assert extract_variable_references(bound) == {"w": ["c__in"]} and dict(bound.leaves())["b"] == 7
    assert [p for p, _ in prefix_q(q, "subject").leaves()] == ["subject__a", "subject__b", "subject__c__in"]
    assert prefix_q(~Q(a=1), "s").negated and prefix_q(Q(a=1) ^ Q(b=2), "s").connector == "XOR"
    assert len((Q(a=1, b=2) & Q(c=3)).conjuncts()) == 3 and len((Q(a=1) | Q(b=2)).conjuncts()) == 1


def test_rewrites():
    one, two = optimize_query([Has(Var("x", where=Q(a=1)), Var("y")), Sees(Var("x", where=Q(b=Var("y"))), Var("y"))])
    assert one.subject.where == two.subject.where and {p for p, _ in one.subject.where.leaves()} == {"a", "b"}
    fixed, trees = fact_filters(Has(Var("x", where=Q(a=1)), Thing(3)))
    assert fixed == {"object": 3} and [list(t.leaves()) for t in trees] == [[("subject__a", 1)]]
    with pytest.raises(TypeError):
        optimize_query([Has(Var("x"), Other(3))])


def test_rules_and_scopes():
    head = Knows(Var("x"), Var("y"))
    assert get_rules() == []
    with pytest.raises(TypeError, match="must be marked with inferred=True.*|Has must be marked"):
        rule(A, B)
    with rule_context():
        rule(head, A)
        rule(head, [A, (A, B)])
        assert len(get_rules()) == 3
        with rule_context(Rule(head, [B])):
            assert len(get_rules()) == 4
        assert len(get_rules()) == 3
    assert get_rules() == []

    @rule_context
    def plain():
        rule(head, A)
        return len(get_rules())

    @rule_context(Rule(head, [A]))
    def given():
        return len(get_rules())

    assert plain() == 1 and given() == 1 and get_rules() == []
    with pytest.raises(ZeroDivisionError), rule_context():
        rule(head, A)
        1 / 0  # noqa: B018
    assert get_rules() == []
    assert alternatives((A, [B, A])) == [[A, B], [A, A]]
    with pytest.raises(TypeError):
        alternatives(3)


def test_components():
    graph = {1: {2}, 2: {3, 1}, 3: {4}, 4: set(), 5: {4, 5}}
    graph = {type(f"T{k}", (), {}): v for k, v in graph.items()}
    by = {t.__name__: t for t in graph}
    graph = {t: {by[f"T{k}"] for k in v} for t, v in graph.items()}
    groups = [sorted(t.__name__ for t in g) for g in strongly_connected(graph)]
    assert groups.index(["T4"]) < groups.index(["T3"]) < groups.index(["T1", "T2"]) and ["T5"] in groups
