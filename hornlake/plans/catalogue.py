"""The registered queries over the star-schema tables, each with equivalent SQL."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..facts import Fact
from ..rules import Rule, clauses, get_rules, rule, rule_context
from ..sources import storage
from ..sources.entities import Bridge, Entity
from ..streaming import store_stream
from ..terms import Q, Var, substitute_variables_in_q
from .rewrite import fact_filters, optimize_query
from .to_sql import to_sql


class Region(Entity):
    key = "r_regionkey"
    fields = {"name": "r_name"}


class Nation(Entity):
    key = "n_nationkey"
    fields = {"name": "n_name", "region": "n_regionkey"}
    references = {"region": Region}


class Customer(Entity):
    key = "c_custkey"
    fields = {"name": "c_name", "nation": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}
    references = {"nation": Nation}


class Supplier(Entity):
    key = "s_suppkey"
    fields = {"name": "s_name", "nation": "s_nationkey", "acctbal": "s_acctbal"}
    references = {"nation": Nation}


class Part(Entity):
    key = "p_partkey"
    fields = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}


class Order(Entity):
    key = "o_orderkey"
    fields = {"customer": "o_custkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}
    references = {"customer": Customer}


class Line(Entity):
    """Rows that tie orders to parts; they are read across relations only, so their key need not be unique."""

    key = "l_orderkey"
    fields = {"order": "l_orderkey", "part": "l_partkey", "quantity": "l_quantity"}
    references = {"order": Order, "part": Part}


Order.bridges = {"parts": Bridge(Line, "order", "part")}


class CustomerIn(Fact):
    subject: Customer | Var
    object: Nation | Var


class SupplierIn(Fact):
    subject: Supplier | Var
    object: Nation | Var


class NationIn(Fact):
    subject: Nation | Var
    object: Region | Var


class PlacedBy(Fact):
    subject: Order | Var
    object: Customer | Var


class Includes(Fact):
    subject: Order | Var
    object: Part | Var


class Supplies(Fact):
    subject: Supplier | Var
    object: Part | Var


class PartParent(Fact):
    subject: Part | Var
    object: Part | Var


class Ancestor(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


class GrandparentOf(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


class SiblingOf(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


class Compatriots(Fact, inferred=True):
    subject: Customer | Var
    object: Customer | Var


class TradesIn(Fact, inferred=True):
    object: Nation | Var


class CustomerInRegion(Fact, inferred=True):
    subject: Customer | Var
    object: Region | Var


class RegionMates(Fact, inferred=True):
    subject: Nation | Var
    object: Nation | Var


class EvenDepth(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


class OddDepth(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


class CoIncluded(Fact, inferred=True):
    subject: Part | Var
    object: Part | Var


ENTITIES = {Region: "region", Nation: "nation", Customer: "customer", Supplier: "supplier", Part: "part", Order: "orders", Line: "lineitem"}

#: Fact types that an entity's table holds: the other side's expression, and the entity's side.
REFERENCES: dict[type[Fact], tuple[str, str]] = {
    CustomerIn: ("c_nationkey", "subject"),
    SupplierIn: ("s_nationkey", "subject"),
    NationIn: ("n_regionkey", "subject"),
    PlacedBy: ("o_custkey", "subject"),
    PartParent: ("p_partkey div 2", "object"),
}

#: Fact type -> table, subject and object, where pairs may repeat.
RELATIONS: dict[type[Fact], tuple[str, str, str]] = {
    Includes: ("lineitem", "l_orderkey", "l_partkey"),
    Supplies: ("lineitem", "l_suppkey", "l_partkey"),
}


def world(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the star-schema tables; a table is opened at its first use."""
    engine = Engine(spark, **options)
    read = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    for kind, name in ENTITIES.items():
        engine.entity(kind, functools.partial(read, name))
    for kind, (other, side) in REFERENCES.items():
        engine.reference(kind, other, side)
    for kind, (name, subject, object_) in RELATIONS.items():
        engine.relation(kind, lambda name=name, subject=subject, object_=object_: read(name).selectExpr(f"{subject} AS subject", f"{object_} AS object"))
    return engine


def V(name: str, **where) -> Var:  # noqa: N802
    return Var(name, where=Q(**where) if where else None)


def keys(*patterns: Fact) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: world(spark, sf_dir).query(*patterns, hydrate=False)


def derived(pattern: Fact, *rules: tuple[Fact, object]) -> Callable[[SparkSession, str], DataFrame]:
    """The bindings of a pattern under rules that hold for this query only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with rule_context():
            for head, body in rules:
                rule(head, body)
            return world(spark, sf_dir).query(pattern, hydrate=False)

    return run


def counted(*patterns: Fact) -> Callable[[SparkSession, str], DataFrame]:
    """A ground query's answer as a row count, 0 or 1."""
    return lambda spark, sf_dir: world(spark, sf_dir).query(*patterns, hydrate=False).agg(F.count(F.lit(1)).alias("found"))


def _store_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = world(spark, sf_dir)
    engine.store_rows(SupplierIn, engine.stored(SupplierIn).where("object < 5"))
    return engine.query(SupplierIn(V("s"), V("n")), hydrate=False)


def _retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = world(spark, sf_dir)
    engine.retract_rows(SupplierIn, engine.stored(SupplierIn).where("object = 3"))
    return engine.query(SupplierIn(V("s"), V("n")), hydrate=False)


def _store_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = world(spark, sf_dir)
    engine.store_facts(NationIn(Nation(100), Region(1)), NationIn(Nation(3), Region(1)), NationIn(Nation(100), Region(1)))
    engine.retract_facts(NationIn(Nation(999), Region(1)))
    return engine.query(NationIn(V("n"), V("r")), hydrate=False)


def _store_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are retracted, some of which are stored again."""
    engine = world(spark, sf_dir)
    engine.retract_rows(SupplierIn, engine.stored(SupplierIn).where("object < 9"))
    engine.store_rows(SupplierIn, engine.stored(SupplierIn).where("object = 10").selectExpr("subject + 1000000 AS subject", "2 AS object"))
    engine.store_facts(SupplierIn(1000, 3), SupplierIn(1001, 3))
    engine.retract_facts(SupplierIn(1001, 3), SupplierIn(1002, 3))
    return engine.query(SupplierIn(V("s"), V("n")), hydrate=False)


def _unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint on a variable that nothing binds holds, if the engine is told so."""
    engine = world(spark, sf_dir, unbound="ignore")
    return engine.query(CustomerIn(V("c", nation=Var("nowhere"), mktsegment="BUILDING"), V("n")), hydrate=False)


def _shown(found: dict[type[Fact], DataFrame], *kinds: type[Fact]) -> DataFrame:
    parts = [found[kind].select(F.lit(kind.__name__).alias("kind"), F.col("subject").cast("long"), F.col("object").cast("long")) for kind in kinds]
    return functools.reduce(DataFrame.union, parts)


def _targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rules given, not those in force, over given rows; given rows of an inferred type take part in recursion."""
    engine = world(spark, sf_dir)
    given = engine.table(Part).where("p_partkey < 10").selectExpr("p_partkey + 10000000 AS subject", "p_partkey AS object")
    with rule_context():
        rule(SiblingOf(V("a"), V("b")), PartParent(V("p"), V("a")) & PartParent(V("p"), V("b")))
        found = engine.materialize({Ancestor: given}, [c for head, body in _ANCESTOR for c in clauses(head, body)])
    return _shown(found, *found)


def _from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules derive from a list of facts."""
    engine = world(spark, sf_dir)
    with rule_context():
        rule(RegionMates(V("a"), V("b")), NationIn(V("a"), V("r")) & NationIn(V("b"), V("r")))
        rule(RegionMates(V("a"), V("c")), RegionMates(V("a"), V("b")) & RegionMates(V("b"), V("c")))
        found = engine.materialize([NationIn(Nation(1), Region(1)), NationIn(Nation(2), Region(1)), RegionMates(Nation(2), Nation(9)), RegionMates(Nation(9), Nation(8))])
    return _shown(found, RegionMates)


def _references_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts without those whose entities are not there."""
    engine = world(spark, sf_dir)
    engine.store_facts(NationIn(Nation(100), Region(1)), NationIn(Nation(3), Region(77)), NationIn(Nation(3), Region(2)))
    return engine.check_references(NationIn)


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns rewritten so that every occurrence of a variable carries all its constraints, each then answered by itself."""
    engine = world(spark, sf_dir)
    patterns = optimize_query([CustomerIn(V("c", mktsegment="BUILDING"), V("n")), PlacedBy(V("o", totalprice__gt=400000), V("c", acctbal__gt=0))])
    fixed = fact_filters(PlacedBy(Order(7), V("c")))[0]
    parts = [engine.query(p, hydrate=False) for p in patterns]
    return parts[0].join(parts[1], "c").where(F.col("o") != fixed["subject"])


def _rule_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as objects in a scope, one body of which is made with every operator; the scope inside the scope is gone."""
    engine = world(spark, sf_dir)
    either = [NationIn(V("a"), Region(0))] | (NationIn(V("a"), V("r")),) & NationIn(Nation(7), V("r")) | NationIn(V("a"), Region(2))
    with rule_context(Rule(RegionMates(V("a"), V("a")), [NationIn(V("a"), Region(1))])):
        rule(RegionMates(V("a"), V("a")), either)
        with rule_context():
            rule(RegionMates(V("a"), V("b")), (NationIn(V("a"), V("r")), NationIn(V("b"), V("r"))))
        return engine.query(RegionMates(V("a"), V("b")), hydrate=False).withColumn("rules", F.lit(len(get_rules())))


def _substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint with a variable replaced by what it is bound to."""
    q = substitute_variables_in_q(Q(nation__in=[Var("n"), Var("m")], acctbal__gt=Var("least")), {"n": Nation(3), "m": 5, "least": 100})
    return world(spark, sf_dir).query(CustomerIn(Var("c", where=q), V("k")), hydrate=False)


def _stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive as a stream, some of them twice."""
    engine, at = world(spark, sf_dir), storage.new_dir(spark, "stream")
    pairs = engine.stored(CustomerIn).where("object < 9")
    pairs.union(pairs.where("object = 3")).write.parquet(f"{at}/in")
    rows = spark.readStream.schema(pairs.schema).parquet(f"{at}/in")
    own = Engine(spark)
    store_stream(own, CustomerIn, rows, f"{at}/checkpoint", availableNow=True).awaitTermination()
    return own.query(CustomerIn(V("c"), V("n")), hydrate=False)


_TEXT_PATTERNS = [
    CustomerIn(V("c", nation__region__name__startswith="A"), V("n")),
    SupplierIn(Var("s", where=~Q(acctbal__lt=100) | Q(name__endswith="7")), V("n")),
    NationIn(V("n", customer__order__totalprice__gt=1000), V("r")),
]


def _sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patterns by the SQL text that the converter writes, over views in a session of their own."""
    own = spark.newSession()
    # a broadcast join streamed from the few rows of a tiny table is one task; joined by key, each key is in a task of its own
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    engine = world(own, sf_dir)
    for kind in ENTITIES:
        engine.table(kind).createOrReplaceTempView(kind.__name__)
    for kind in [*REFERENCES, *RELATIONS]:
        engine.stored(kind).createOrReplaceTempView(kind.__name__)
    return own.sql(to_sql(_TEXT_PATTERNS, lambda kind: engine.table(kind).columns, sets=True))


def _hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = world(spark, sf_dir).query(CustomerIn(V("c", mktsegment="BUILDING"), V("n")))
    return df.select("c.pk", "c.c_name", "c.c_acctbal", F.col("n.pk").alias("n_pk"), "n.n_name")


def _materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = world(spark, sf_dir)
    with rule_context():
        rule(CustomerInRegion(V("c"), V("r")), CustomerIn(V("c"), V("n")) & NationIn(V("n"), V("r")))
        rule(RegionMates(V("a"), V("b")), NationIn(V("a"), V("r")) & NationIn(V("b"), V("r")))
        found = engine.materialize({NationIn: engine.stored(NationIn).where("object < 2")})
    return _shown(found, CustomerInRegion, RegionMates)


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a rule's relation inside its context, and outside, where there are none."""
    engine = world(spark, sf_dir)
    with rule_context():
        rule(RegionMates(V("a"), V("b")), NationIn(V("a"), V("r")) & NationIn(V("b"), V("r")))
        inside = engine.query(RegionMates(V("a"), V("b")), hydrate=False)
    outside = engine.query(RegionMates(V("a"), V("b")), hydrate=False)
    return inside.withColumn("scope", F.lit("inside")).union(outside.withColumn("scope", F.lit("outside")))


_ANCESTOR = [(Ancestor(V("x"), V("y")), PartParent(V("x"), V("y"))), (Ancestor(V("x"), V("z")), Ancestor(V("x"), V("y")) & PartParent(V("y"), V("z")))]
_CLOSURE = [_ANCESTOR[0], (Ancestor(V("x"), V("z")), Ancestor(V("x"), V("y")) & Ancestor(V("y"), V("z")))]
_PARITY = [
    (OddDepth(V("x"), V("y")), PartParent(V("x"), V("y")) & PartParent(V("y", retailprice__gte=0), V("w"))),
    (EvenDepth(V("x"), V("z")), OddDepth(V("x"), V("y")) & PartParent(V("y"), V("z"))),
    (OddDepth(V("x"), V("z")), EvenDepth(V("x"), V("y")) & PartParent(V("y"), V("z"))),
]
_C, _N, _S = "c_custkey AS c", "c_nationkey AS n", "s_suppkey AS s"
_TREE = "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) "

#: Name -> query, SQL.
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_stored": (keys(CustomerIn(V("c"), V("n"))), f"SELECT {_C}, {_N} FROM customer"),
    "filter_const_object": (keys(CustomerIn(V("c"), Nation(3))), f"SELECT {_C} FROM customer WHERE c_nationkey = 3"),
    "filter_const_subject": (keys(Includes(Order(7), V("p"))), "SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey = 7"),
    "ground_ask": (counted(NationIn(Nation(3), Region(1))), "SELECT least(count(*), 1) AS found FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1"),
    "ground_ask_false": (counted(NationIn(Nation(3), Region(77))), "SELECT 0::BIGINT AS found"),
    "empty_query": (counted(), "SELECT 1::BIGINT AS found"),
    "where_eq": (keys(CustomerIn(V("c", mktsegment="BUILDING"), V("n"))), f"SELECT {_C}, {_N} FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "where_compare": (keys(PlacedBy(V("o", totalprice__gt=1000, totalprice__lte=200000, priority__in=["1-URGENT", "2-HIGH"]), V("c"))), "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "where_range_text": (keys(Supplies(V("s", acctbal__range=(0, 5000)), V("p", brand__startswith="Brand", size__gte=10, size__lt=30))), "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_acctbal BETWEEN 0 AND 5000 AND starts_with(p_brand, 'Brand') AND p_size >= 10 AND p_size < 30"),
    "where_or_not": (keys(CustomerIn(Var("c", where=~(Q(mktsegment="BUILDING") | Q(acctbal__lt=0))), V("n"))), f"SELECT {_C}, {_N} FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)"),
    "where_xor": (keys(CustomerIn(Var("c", where=Q(mktsegment="BUILDING") ^ Q(acctbal__lt=0)), V("n"))), f"SELECT {_C}, {_N} FROM customer WHERE (c_mktsegment = 'BUILDING') <> (c_acctbal < 0)"),
    "where_icontains": (keys(PartParent(V("p"), V("q", brand__icontains="#1"))), "SELECT p_partkey // 2 AS p, p_partkey AS q FROM part WHERE p_brand ILIKE '%#1%'"),
    "where_regex": (keys(NationIn(V("n", name__regex="_1?[2-8]$"), V("r", name__iendswith="a"))), "SELECT n_nationkey AS n, n_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(n_name, '_1?[2-8]$') AND r_name ILIKE '%a'"),
    "where_date_part": (keys(PlacedBy(V("o", orderdate__year=1995, orderdate__month__lte=6), V("c"))), "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) <= 6"),
    "where_date_parts": (
        keys(PlacedBy(Var("o", where=Q(orderdate__quarter=2, orderdate__week_day=1) | Q(orderdate__week=10, orderdate__day__lte=9) | Q(orderdate__date=datetime.date(1998, 10, 3), orderdate__hour=0, orderdate__minute=0, orderdate__second__lt=30)), V("c"))),
        "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE quarter(o_orderdate) = 2 AND dayofweek(o_orderdate) = 0 OR weekofyear(o_orderdate) = 10 AND day(o_orderdate) <= 9 OR o_orderdate::DATE = DATE '1998-10-03'",
    ),
    "where_lookups_text": (
        keys(PartParent(V("p"), Var("q", where=Q(name__istartswith="RED", brand__regex="#1[0-9]$") | Q(type__iexact="small", name__iendswith="BOLT") | Q(name__iregex="^BLUE R", brand__endswith="7")))),
        "SELECT p_partkey // 2 AS p, p_partkey AS q FROM part WHERE p_name ILIKE 'red%' AND regexp_matches(p_brand, '#1[0-9]$') OR lower(p_type) = 'small' AND p_name ILIKE '%bolt' OR p_name ILIKE 'blue r%' AND ends_with(p_brand, '7')",
    ),
    "where_m2m": (keys(PlacedBy(V("o", parts__size__lt=4, parts=Part(7)), V("c"))), "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size < 4) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 7)"),
    "where_isnull": (keys(PlacedBy(V("o", parts__isnull=True, customer__nation__isnull=False), V("c"))), "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "where_reverse_2": (keys(NationIn(V("n", customer__order__totalprice__gt=499000, supplier__nation__region__name__contains="A"), V("r"))), "SELECT n_nationkey AS n, n_regionkey AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 499000) AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AND contains(r_name, 'A')"),
    "where_reverse_var": (keys(SupplierIn(V("s"), V("n", customer__order__in=[Var("o"), Order(3)])), PlacedBy(V("o", totalprice__gt=480000), V("c"))), f"SELECT DISTINCT {_S}, s_nationkey AS n, o.o_orderkey AS o, o.o_custkey AS c FROM supplier, orders o WHERE o.o_totalprice > 480000 AND EXISTS (SELECT 1 FROM customer JOIN orders x ON x.o_custkey = c_custkey WHERE c_nationkey = s_nationkey AND x.o_orderkey IN (o.o_orderkey, 3))"),
    "where_fk_path": (keys(CustomerIn(V("c", nation__region__name="ASIA"), V("n"))), f"SELECT {_C}, {_N} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "where_reverse_path": (keys(NationIn(V("n", supplier__acctbal__gt=9000), V("r"))), "SELECT n_nationkey AS n, n_regionkey AS r FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)"),
    "join_2": (keys(CustomerIn(V("c"), V("n")) & NationIn(V("n"), V("r"))), f"SELECT {_C}, {_N}, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_3": (keys(CustomerIn(V("c"), V("n")), NationIn(V("n"), V("r")), PlacedBy(V("o"), V("c"))), f"SELECT {_C}, {_N}, n_regionkey AS r, o_orderkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"),
    "join_self": (keys(NationIn(V("a"), V("r")), NationIn(V("b"), V("r"))), "SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_regionkey AS r FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey"),
    "join_multi_key": (keys(PlacedBy(V("o"), V("c")), CustomerIn(V("c"), V("n")), Includes(V("o"), V("p")), Supplies(V("s"), V("p")), SupplierIn(V("s"), V("n")), PartParent(V("p"), V("p"))), "SELECT DISTINCT o_orderkey AS o, c_custkey AS c, c_nationkey AS n, l.l_partkey AS p, s_suppkey AS s FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN customer ON c_custkey = o_custkey JOIN lineitem m ON m.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = m.l_suppkey AND s_nationkey = c_nationkey WHERE l.l_partkey // 2 = l.l_partkey"),
    "join_cartesian": (keys(NationIn(V("n"), Region(1)), SupplierIn(V("s"), V("m"))), "SELECT n_nationkey AS n, s_suppkey AS s, s_nationkey AS m FROM nation, supplier WHERE n_regionkey = 1"),
    "repeated_var": (keys(PartParent(V("x"), V("x"))), "SELECT p_partkey AS x FROM part WHERE p_partkey // 2 = p_partkey"),
    "shared_constraint": (keys(CustomerIn(V("c"), V("n", name__contains="A")), SupplierIn(V("s"), V("n", region=Region(2)))), f"SELECT {_C}, {_N}, {_S} FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey WHERE contains(n_name, 'A') AND n_regionkey = 2"),
    "cross_eq": (keys(SupplierIn(V("s"), V("n")), CustomerIn(V("c", nation=Var("n")), V("m"))), f"SELECT {_S}, s_nationkey AS n, {_C}, c_nationkey AS m FROM supplier JOIN customer ON s_nationkey = c_nationkey"),
    "cross_in_mixed": (keys(SupplierIn(V("s"), V("n")), CustomerIn(V("c", nation__in=[Var("n"), Nation(4)], mktsegment="MACHINERY"), V("m"))), f"SELECT {_S}, s_nationkey AS n, {_C}, c_nationkey AS m FROM supplier JOIN customer ON c_nationkey = s_nationkey OR c_nationkey = 4 WHERE c_mktsegment = 'MACHINERY'"),
    "cross_theta": (keys(NationIn(V("a", region__gt=Var("r")), V("q")), NationIn(V("b"), V("r"))), "SELECT x.n_nationkey AS a, x.n_regionkey AS q, y.n_nationkey AS b, y.n_regionkey AS r FROM nation x JOIN nation y ON x.n_regionkey > y.n_regionkey"),
    "cross_reverse_in": (keys(NationIn(V("n"), V("r", nation__in=[Var("n")]))), "SELECT n_nationkey AS n, n_regionkey AS r FROM nation"),
    "rule_grandparent": (derived(GrandparentOf(V("g"), V("c")), (GrandparentOf(V("g"), V("c")), PartParent(V("g"), V("p")) & PartParent(V("p"), V("c")))), "SELECT DISTINCT x.p_partkey // 2 AS g, y.p_partkey AS c FROM part x JOIN part y ON y.p_partkey // 2 = x.p_partkey"),
    "rule_sibling": (derived(SiblingOf(V("a"), V("b")), (SiblingOf(V("a"), V("b")), PartParent(V("p"), V("a")) & PartParent(V("p"), V("b")))), "SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_partkey // 2 = y.p_partkey // 2"),
    "rule_body_where": (derived(Compatriots(V("a"), V("b")), (Compatriots(V("a", mktsegment="BUILDING"), V("b", mktsegment="BUILDING")), CustomerIn(V("a"), V("n")) & CustomerIn(V("b"), V("n")))), "SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey WHERE x.c_mktsegment = 'BUILDING' AND y.c_mktsegment = 'BUILDING'"),
    "rule_disjunction": (derived(TradesIn(V("t"), V("n")), (TradesIn(V("t"), V("n")), CustomerIn(V("t"), V("n")) | SupplierIn(V("t2", acctbal__gt=0), V("n")) & CustomerIn(V("t"), V("n"))), (TradesIn(V("t"), V("n")), SupplierIn(V("t"), V("n")))), "SELECT c_custkey AS t, c_nationkey AS n FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier"),
    "rule_existential": (derived(TradesIn(V("c"), V("n")), (TradesIn(V("c"), V("n")), CustomerIn(V("c"), V("n")) & PlacedBy(V("o", totalprice__gt=300000), V("c")))), f"SELECT {_C}, {_N} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "rule_layered": (derived(RegionMates(V("a"), Nation(4)), (CustomerInRegion(V("c"), V("r")), CustomerIn(V("c"), V("n")) & NationIn(V("n"), V("r"))), (RegionMates(V("a"), V("b")), CustomerInRegion(V("c"), V("r")) & CustomerIn(V("c"), V("a")) & NationIn(V("b"), V("r")))), "SELECT DISTINCT c_nationkey AS a FROM customer JOIN nation x ON c_nationkey = x.n_nationkey JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE y.n_nationkey = 4"),
    "rule_cross": (derived(TradesIn(V("s"), V("n")), (TradesIn(V("s"), V("n")), SupplierIn(V("s"), V("n")) & CustomerIn(V("c", nation=Var("n"), mktsegment="BUILDING"), V("m")))), f"SELECT {_S}, s_nationkey AS n FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING')"),
    "rule_constants": (derived(RegionMates(V("a"), V("b")), (RegionMates(V("a"), Nation(7)), NationIn(V("a"), Region(2))), (RegionMates(Nation(1), Nation(2)), ())), "SELECT n_nationkey AS a, 7 AS b FROM nation WHERE n_regionkey = 2 UNION SELECT 1, 2"),
    "rule_unsafe": (derived(RegionMates(V("a"), V("b")), (RegionMates(V("a"), V("zz")), NationIn(V("a"), V("r")))), "SELECT n_nationkey AS a, n_nationkey AS b FROM nation WHERE FALSE"),
    "rule_scoped": (_scoped, "SELECT x.n_nationkey AS a, y.n_nationkey AS b, 'inside' AS scope FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey"),
    "rule_nested_or": (derived(TradesIn(V("t"), V("n")), (TradesIn(V("t"), V("n")), (CustomerIn(V("t"), V("n")), [NationIn(V("n"), Region(1)), (NationIn(V("n"), V("r")), NationIn(Nation(3), V("r")))]))), f"SELECT c_custkey AS t, {_N} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 OR n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)"),
    "rec_ancestor": (derived(Ancestor(V("a"), V("d")), *_ANCESTOR), _TREE + "SELECT a, b AS d FROM t"),
    "rec_ancestor_nonlinear": (derived(Ancestor(V("a"), V("d")), *_CLOSURE), _TREE + "SELECT a, b AS d FROM t"),
    "rec_from_const": (derived(Ancestor(Part(5), V("d")), *_ANCESTOR), _TREE + "SELECT b AS d FROM t WHERE a = 5"),
    "rec_where": (derived(Ancestor(V("a", size__gt=45), V("d", brand="Brand#7")), *_ANCESTOR), _TREE + "SELECT a, b AS d FROM t JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_size > 45 AND y.p_brand = 'Brand#7'"),
    "rec_mutual": (derived(EvenDepth(V("a"), V("d")), *_PARITY), "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part), t AS (SELECT a, b, 1 AS odd FROM e WHERE b IN (SELECT a FROM e) UNION SELECT t.a, e.b, 1 - t.odd FROM t JOIN e ON t.b = e.a) SELECT a, b AS d FROM t WHERE odd = 0"),
    "store_idempotent": (_store_idempotent, f"SELECT {_S}, s_nationkey AS n FROM supplier"),
    "store_new": (_store_new, "SELECT n_nationkey AS n, n_regionkey AS r FROM nation UNION SELECT 100, 1 UNION SELECT 3, 1"),
    "retract": (_retract, f"SELECT {_S}, s_nationkey AS n FROM supplier WHERE s_nationkey <> 3"),
    "store_again": (_store_again, f"SELECT {_S}, s_nationkey AS n FROM supplier WHERE s_nationkey >= 9 UNION ALL SELECT s_suppkey + 1000000, 2 FROM supplier WHERE s_nationkey = 10 UNION ALL SELECT 1000, 3"),
    "unbound_ignore": (_unbound, f"SELECT {_C}, {_N} FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "targeted_rules": (_targeted, "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part), t AS (SELECT a, b FROM e UNION SELECT p_partkey + 10000000, p_partkey FROM part WHERE p_partkey < 10 UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT 'Ancestor' AS kind, a AS subject, b AS object FROM t"),
    "facts_from_list": (_from_list, "WITH RECURSIVE e AS (SELECT * FROM (VALUES (1, 1), (1, 2), (2, 1), (2, 2), (2, 9), (9, 8)) x(a, b)), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT 'RegionMates' AS kind, a::BIGINT AS subject, b::BIGINT AS object FROM t"),
    "sql_text": (_sql_text, f"SELECT DISTINCT {_C}, {_N}, s_suppkey AS s, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name LIKE 'A%' AND (s_acctbal >= 100 OR s_name LIKE '%7') AND EXISTS (SELECT 1 FROM customer x JOIN orders ON o_custkey = x.c_custkey WHERE x.c_nationkey = n_nationkey AND o_totalprice > 1000)"),
    "references_checked": (_references_checked, "SELECT n_nationkey AS subject, n_regionkey AS object FROM nation UNION SELECT 3, 2"),
    "rewritten": (_rewritten, f"SELECT {_C}, {_N}, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND o_totalprice > 400000 AND o_orderkey <> 7"),
    "rule_objects": (_rule_objects, "SELECT n_nationkey AS a, n_nationkey AS b, 4 AS rules FROM nation WHERE n_regionkey IN (0, 1, 2) OR n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)"),
    "substituted": (_substituted, "SELECT c_custkey AS c, c_nationkey AS k FROM customer WHERE c_nationkey IN (3, 5) AND c_acctbal > 100"),
    "stored_stream": (_stored_stream, f"SELECT {_C}, {_N} FROM customer WHERE c_nationkey < 9"),
    "variable_names": (keys(CustomerIn(Var("Cust-Id"), Var("nation key")), NationIn(Var("nation key"), Region(2))), 'SELECT c_custkey AS "Cust-Id", c_nationkey AS "nation key" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2'),
    "hydrate": (_hydrate, "SELECT c_custkey AS pk, c_name, c_acctbal, n_nationkey AS n_pk, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "materialize": (_materialize, "SELECT 'CustomerInRegion' AS kind, c_custkey AS subject, n_regionkey::BIGINT AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2 UNION ALL SELECT 'RegionMates', x.n_nationkey::BIGINT, y.n_nationkey::BIGINT FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE x.n_regionkey < 2"),
    "co_included": (derived(CoIncluded(V("a"), V("b")), (CoIncluded(V("a"), V("b")), Includes(V("o"), V("a")) & Includes(V("o"), V("b")))), "SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey"),
}

QUERIES = {name: query for name, (query, _) in CATALOGUE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOGUE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with their nations and regions, by two stored relations and a constraint."""
    return world(spark, sf_dir).query(CustomerIn(V("c", mktsegment="BUILDING"), V("n")), NationIn(V("n"), V("r")), hydrate=False)
