"""Queries of the rule engine over the driver's tables, each next to its SQL.

Every query encodes rows of tables as triples by a SELECT that Spark and the SQL
oracle both read, and runs a subset of the rules, so that a query shows one rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.core_queries import nt
from axiomill.functions import datatypes as DT
from axiomill.functions.terms import same_term
from axiomill.operators.components import components
from axiomill.plans.diagnostics import diagnostics
from axiomill.plans.fixpoint import Closure, triple_frame
from axiomill.plans.lists import list_members
from axiomill.session import Reasoner, class_histogram
from axiomill.sources import read_triples, write_ntriples
from axiomill.streaming import StreamingClosure
from axiomill.vocab import FIRST, NIL, RDF, REST, SAME, THING, TYPE, owl, rdf, rdfs, xsd
from axiomill.workspace import Workspace

Triple = tuple[str, str, str]


def u(name: str) -> str:
    return f"<urn:{name}>"


def key(table: str, column: str) -> str:
    """SQL of the IRI of a row; keys are integers, whose text is the same in both engines."""
    return f"'<urn:{table}/' || cast({column} as string) || '>'"


def facts(table: str, s: str, p: str, o: str, where: str = "true") -> str:
    p = f"'{p}'" if p.startswith("<") else p
    o = f"'{o}'" if o.startswith("<") else o
    return f"select {s} as s, {p} as p, {o} as o from {{{table}}} where {where}"


def rows(*triples: Triple) -> str:
    lit = lambda t: t.replace("'", "''")
    return " union all ".join(f"select '{lit(s)}' as s, '{lit(p)}' as p, '{lit(o)}' as o" for s, p, o in triples)


def sql_list(head: str, members: list[str]) -> list[Triple]:
    """The cells of an RDF list."""
    out, node = [], head
    for i, m in enumerate(members):
        nxt = NIL if i == len(members) - 1 else f"{head}n{i}"
        out += [(node, FIRST, m), (node, REST, nxt)]
        node = nxt
    return out


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}) if names else spark.sql(sql)


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("as string)", "as varchar)")


@dataclass(frozen=True)
class Case:
    """Triples to start from, the rules to run, and SQL of the closure over ``b``, the triples."""

    base: str
    rules: tuple[str, ...]
    derived: str  # selects s, p, o from b; united with b itself

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Closure(spark, self.rules)
        c.add(load(spark, sf_dir, self.base))
        return c.output()

    def sql(self) -> str:
        rec = "recursive " if "recursive" in self.derived else ""
        d = self.derived.replace("recursive", "", 1)
        return f"with {rec}b as (select distinct s, p, o from ({duck(self.base)}) x){', ' + d.split(';')[0] if ';' in d else ''} select s, p, o from b union {d.split(';')[-1]}"


def union(*parts: str) -> str:
    return " union all ".join(parts)


CUSTOMER, NATION, ORDER, PART, DOC = (key(*x) for x in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("order", "o_orderkey"), ("part", "p_partkey"), ("doc", "doc_id")))
IN_NATION = facts("customer", CUSTOMER, u("locatedIn"), key("nation", "c_nationkey"))
IN_REGION = facts("nation", NATION, u("locatedIn"), key("region", "n_regionkey"))
PLACED = facts("orders", ORDER, u("placedBy"), key("customer", "o_custkey"))
KIND = "'<urn:kind/' || replace(p_type, ' ', '_') || '>'"
PART_KIND = facts("part", PART, TYPE, KIND)
KINDS = facts("part", KIND, rdfs("subClassOf"), u("Part"))
SHIPPED = facts("lineitem", key("order", "l_orderkey"), u("shippedPart"), key("part", "l_partkey"))
TEXT = "'<urn:text/' || md5(text) || '>'"
HAS_DOC = facts("documents", TEXT, u("hasDoc"), DOC, "text is not null")
HAS_TEXT = facts("documents", DOC, u("hasText"), TEXT, "text is not null")
SAME_DOC = f"select '<urn:doc/' || cast(doc_id as string) || '>' as s, '{SAME}' as p, '<urn:doc/' || cast(nxt as string) || '>' as o from (select doc_id, lead(doc_id) over (partition by md5(text) order by doc_id) as nxt from {{documents}} where text is not null) d where nxt is not null"
DOC_LANG = facts("documents", DOC, u("lang"), "'\"' || lang || '\"'", "lang is not null")
STATUS = facts("orders", ORDER, TYPE, "'<urn:status/' || o_orderstatus || '>'")
PRIORITY = facts("orders", ORDER, TYPE, "'<urn:priority/' || substring(o_orderpriority, 1, 1) || '>'")
SEGMENT = facts("customer", CUSTOMER, TYPE, "'<urn:segment/' || c_mktsegment || '>'")
EVENT = facts("events", key("event", "event_id"), TYPE, "'<urn:event/' || event_type || '>'")
EVENT_SUB = facts("events", "'<urn:event/' || event_type || '>'", rdfs("subClassOf"), u("Event"))
NEXT = f"select '<urn:nation/' || cast(n_nationkey as string) || '>' as s, '{u('borders')}' as p, '<urn:nation/' || cast(n_nationkey + 1 as string) || '>' as o from {{nation}}"

# closures of sameAs for the SQL: symmetric and transitive, with the pairs of a term with itself
EQ = f"""recursive e(x, y) as (select s, o from b where p = '{SAME}' union select o, s from b where p = '{SAME}'), q(x, y) as (select x, y from e union select q.x, e.y from q join e on q.y = e.x);"""


def axiom(p: str, kind: str) -> str:
    return rows((u(p), TYPE, owl(kind)))


def restriction(name: str, kind: str, prop: str, value: str) -> str:
    return rows((u(name), owl("onProperty"), u(prop)), (u(name), owl(kind), value))


MEMBERS = f"""recursive walk(h, n) as (select s, s from b where p = '{FIRST}' union select walk.h, b.o from walk join b on b.s = walk.n and b.p = '{REST}'),
m(l, m) as (select walk.h, b.o from walk join b on b.s = walk.n and b.p = '{FIRST}');"""

CASES: dict[str, Case] = {
    "prp_trp": Case(union(IN_NATION, IN_REGION, axiom("locatedIn", "TransitiveProperty")), ("prp-trp",),
        f"recursive r(x, y) as (select s, o from b where p = '{u('locatedIn')}' union select r.x, b.o from r join b on b.s = r.y and b.p = '{u('locatedIn')}'); select x, '{u('locatedIn')}', y from r"),
    "cax_sco": Case(union(PART_KIND, KINDS, rows((u("Part"), rdfs("subClassOf"), u("Product")))), ("cax-sco",),
        f"select s, '{TYPE}', c from (select s from b where p = '{TYPE}') x, (select '{u('Part')}' c union select '{u('Product')}') y"),
    "rdfs11": Case(union(KINDS, rows((u("Part"), rdfs("subClassOf"), u("Product")), (u("Product"), rdfs("subClassOf"), u("Asset")))), ("rdfs11",),
        f"recursive r(x, y) as (select s, o from b union select r.x, b.o from r join b on b.s = r.y); select x, '{rdfs('subClassOf')}', y from r"),
    "cax_eqc": Case(union(facts("customer", CUSTOMER, TYPE, u("Customer"), "c_acctbal >= 0"), facts("customer", CUSTOMER, TYPE, u("Client"), "c_acctbal < 0"), rows((u("Customer"), owl("equivalentClass"), u("Client")))), ("cax-eqc1", "cax-eqc2"),
        f"select s, '{TYPE}', c from (select s from b where p = '{TYPE}') x, (select '{u('Customer')}' c union select '{u('Client')}') y"),
    "scm_eqc": Case(facts("part", KIND, owl("equivalentClass"), "'<urn:alias/' || replace(p_type, ' ', '_') || '>'"), ("scm-eqc1", "scm-eqc2"),
        f"select s, '{rdfs('subClassOf')}', o from b union select o, '{rdfs('subClassOf')}', s from b"),
    "prp_dom": Case(union(PLACED, rows((u("placedBy"), rdfs("domain"), u("Order")))), ("prp-dom",), f"select s, '{TYPE}', '{u('Order')}' from b where p = '{u('placedBy')}'"),
    "prp_rng": Case(union(PLACED, rows((u("placedBy"), rdfs("range"), u("Customer")))), ("prp-rng",), f"select o, '{TYPE}', '{u('Customer')}' from b where p = '{u('placedBy')}'"),
    "prp_inv": Case(union(PLACED, facts("customer", CUSTOMER, u("placed"), "'<urn:order/0>'", "c_mktsegment = 'BUILDING'"), rows((u("placedBy"), owl("inverseOf"), u("placed")))), ("prp-inv1", "prp-inv2"),
        f"select o, '{u('placed')}', s from b where p = '{u('placedBy')}' union select o, '{u('placedBy')}', s from b where p = '{u('placed')}'"),
    "prp_symp": Case(union(NEXT, axiom("borders", "SymmetricProperty")), ("prp-symp",), f"select o, p, s from b where p = '{u('borders')}'"),
    "prp_spo1": Case(union(SHIPPED, rows((u("shippedPart"), rdfs("subPropertyOf"), u("involves")), (u("involves"), rdfs("subPropertyOf"), u("concerns")))), ("prp-spo1",),
        f"select s, q, o from b, (select '{u('involves')}' q union select '{u('concerns')}') y where p = '{u('shippedPart')}'"),
    "prp_eqp": Case(union(SHIPPED, facts("orders", ORDER, u("partShipped"), "'<urn:part/0>'", "o_orderstatus = 'F'"), rows((u("shippedPart"), owl("equivalentProperty"), u("partShipped")))), ("prp-eqp1", "prp-eqp2"),
        f"select s, q, o from b, (select '{u('shippedPart')}' q union select '{u('partShipped')}') y where p in ('{u('shippedPart')}', '{u('partShipped')}')"),
    "prp_fp": Case(union(HAS_DOC, axiom("hasDoc", "FunctionalProperty")), ("prp-fp",), f"select a.o, '{SAME}', c.o from b a join b c on a.s = c.s where a.p = '{u('hasDoc')}' and c.p = '{u('hasDoc')}'"),
    "prp_ifp": Case(union(HAS_TEXT, axiom("hasText", "InverseFunctionalProperty")), ("prp-ifp",), f"select a.s, '{SAME}', c.s from b a join b c on a.o = c.o where a.p = '{u('hasText')}' and c.p = '{u('hasText')}'"),
    "eq_sym_trans": Case(SAME_DOC, ("eq-sym", "eq-trans"), EQ + f" select x, '{SAME}', y from q"),
    "eq_rep_s": Case(union(SAME_DOC, DOC_LANG), ("eq-rep-s", "eq-sym", "eq-trans"), EQ + " select y, p, o from b join q on q.x = b.s union select x, '" + SAME + "', y from q"),
    "eq_rep_o": Case(union(SAME_DOC, HAS_DOC), ("eq-rep-o", "eq-sym", "eq-trans"), EQ + " select s, p, y from b join q on q.x = b.o union select x, '" + SAME + "', y from q"),
    "eq_rep_p": Case(union(IN_NATION, rows((u("locatedIn"), SAME, u("livesIn")))), ("eq-rep-p",), f"select s, '{u('livesIn')}', o from b where p = '{u('locatedIn')}'"),
    "cls_uni": Case(union(STATUS, rows((u("Open"), owl("unionOf"), u("l1")), *sql_list(u("l1"), [u("status/O"), u("status/P")]))), ("cls-uni",),
        f"select s, '{TYPE}', '{u('Open')}' from b where p = '{TYPE}' and o in ('{u('status/O')}', '{u('status/P')}')"),
    "cls_int1": Case(union(STATUS, PRIORITY, rows((u("UrgentOpen"), owl("intersectionOf"), u("l2")), *sql_list(u("l2"), [u("status/O"), u("priority/1")]))), ("cls-int1",),
        f"select s, '{TYPE}', '{u('UrgentOpen')}' from b where p = '{TYPE}' and o in ('{u('status/O')}', '{u('priority/1')}') group by s having count(distinct o) = 2"),
    "cls_int2": Case(union(facts("orders", ORDER, TYPE, u("UrgentOpen"), "o_orderstatus = 'O'"), rows((u("UrgentOpen"), owl("intersectionOf"), u("l3")), *sql_list(u("l3"), [u("status/O"), u("priority/1"), u("Order")]))), ("cls-int2",),
        f"select s, '{TYPE}', m from (select s from b where p = '{TYPE}' and o = '{u('UrgentOpen')}') x, (select '{u('status/O')}' m union select '{u('priority/1')}' union select '{u('Order')}') y"),
    "cls_hv1": Case(union(facts("customer", CUSTOMER, TYPE, u("Local"), "c_nationkey = 3"), restriction("Local", "hasValue", "locatedIn", u("nation/3"))), ("cls-hv1",), f"select s, '{u('locatedIn')}', '{u('nation/3')}' from b where p = '{TYPE}' and o = '{u('Local')}'"),
    "cls_hv2": Case(union(IN_NATION, restriction("Local", "hasValue", "locatedIn", u("nation/3"))), ("cls-hv2",), f"select s, '{TYPE}', '{u('Local')}' from b where p = '{u('locatedIn')}' and o = '{u('nation/3')}'"),
    "cls_avf": Case(union(PLACED, facts("orders", ORDER, TYPE, u("Plain"), "o_orderstatus = 'P'"), restriction("Plain", "allValuesFrom", "placedBy", u("Buyer"))), ("cls-avf",),
        f"select a.o, '{TYPE}', '{u('Buyer')}' from b a join b c on a.s = c.s where a.p = '{u('placedBy')}' and c.p = '{TYPE}' and c.o = '{u('Plain')}'"),
    "cls_svf1": Case(union(PLACED, SEGMENT, restriction("Building", "someValuesFrom", "placedBy", u("segment/BUILDING"))), ("cls-svf1",),
        f"select a.s, '{TYPE}', '{u('Building')}' from b a join b c on a.o = c.s where a.p = '{u('placedBy')}' and c.p = '{TYPE}' and c.o = '{u('segment/BUILDING')}'"),
    "cls_svf2": Case(union(PLACED, restriction("Placed", "someValuesFrom", "placedBy", THING)), ("cls-svf2",), f"select s, '{TYPE}', '{u('Placed')}' from b where p = '{u('placedBy')}'"),
    "rdfs12": Case(f"select '<urn:order/' || cast(l_orderkey as string) || '>' as s, '<{RDF}_' || cast(l_linenumber - 1 as string) || '>' as p, '<urn:part/' || cast(l_partkey as string) || '>' as o from {{lineitem}}", ("rdfs12", "prp-spo1"),
        f"select distinct p, '{TYPE}', t from b, (select '{rdf('Property')}' t union select '{rdfs('ContainerMembershipProperty')}') y where p <> '<{RDF}_0>' union select distinct p, '{rdfs('subPropertyOf')}', '{rdfs('member')}' from b where p <> '<{RDF}_0>' union select s, '{rdfs('member')}', o from b where p <> '<{RDF}_0>'"),
    "owl_thing": Case(union(PLACED, IN_NATION), ("owl-thing", "cls-thing", "cls-nothing1"),
        f"select s, '{TYPE}', '{THING}' from b union select '{THING}', '{TYPE}', t from (select '{THING}' t union select '{owl('Class')}') y union select '{owl('Nothing')}', '{TYPE}', t from (select '{THING}' t union select '{owl('Class')}') y"),
    # several rules that feed one another: inverse, sub-property, domain, subclass, union, Thing
    "full_closure": Case(union(PLACED, IN_NATION, IN_REGION, SEGMENT, rows((u("placedBy"), owl("inverseOf"), u("placed")), (u("placed"), rdfs("subPropertyOf"), u("knows")), (u("knows"), rdfs("domain"), u("Agent")), (u("Agent"), rdfs("subClassOf"), u("Being")), (u("locatedIn"), TYPE, owl("TransitiveProperty")))), ("prp-inv1", "prp-inv2", "prp-spo1", "prp-dom", "cax-sco", "prp-trp"),
        f"""recursive r(x, y) as (select s, o from b where p = '{u('locatedIn')}' union select r.x, b.o from r join b on b.s = r.y and b.p = '{u('locatedIn')}'), k(s, o) as (select o, s from b where p = '{u('placedBy')}');
        select s, '{u('placed')}', o from k union select s, '{u('knows')}', o from k union select s, '{TYPE}', '{u('Agent')}' from k union select s, '{TYPE}', '{u('Being')}' from k union select x, '{u('locatedIn')}', y from r"""),
}


# --- integrity rules: code, rule, s, p, o, extra -----------------------------------

VALUE = f"'\"' || cast(p_size as string) || '\"^^{xsd('int')}'"
DIAGNOSED: dict[str, tuple[str, str]] = {
    "prp_irp": (union(NEXT, facts("nation", NATION, u("borders"), NATION, "n_regionkey = 0"), axiom("borders", "IrreflexiveProperty")), f"select 'prp-irp' as rule, 'property ' || p || ' of ' || s || ' is irreflexive' as message from b where s = o and p = '{u('borders')}'"),
    "prp_asyp": (union(NEXT, facts("nation", key("nation", "n_nationkey + 1"), u("borders"), NATION, "n_regionkey = 0"), axiom("borders", "AsymmetricProperty")), f"select 'prp-asyp' as rule, 'property ' || a.p || ' of ' || a.s || ' and ' || a.o || ' is asymmetric' as message from b a join b c on a.s = c.o and a.o = c.s where a.p = '{u('borders')}' and c.p = a.p"),
    "prp_pdw": (union(SHIPPED, facts("lineitem", key("order", "l_orderkey"), u("returnedPart"), key("part", "l_partkey"), "l_returnflag = 'R'"), rows((u("shippedPart"), owl("propertyDisjointWith"), u("returnedPart")))), f"select distinct 'prp-pdw' as rule, 'property ' || a.p || ' is disjoint with ' || c.p || ' for pair (' || a.s || ' ' || a.p || ' ' || a.o || ')' as message from b a join b c on a.s = c.s and a.o = c.o where a.p = '{u('shippedPart')}' and c.p = '{u('returnedPart')}'"),
    "cax_dw": (union(STATUS, PRIORITY, rows((u("status/F"), owl("disjointWith"), u("priority/1")))), f"select 'cax-dw' as rule, 'inst ' || a.s || ' is both ' || a.o || ' and ' || c.o || ' (disjoint classes)' as message from b a join b c on a.s = c.s where a.p = '{TYPE}' and c.p = '{TYPE}' and a.o = '{u('status/F')}' and c.o = '{u('priority/1')}'"),
    "cls_com": (union(STATUS, PRIORITY, rows((u("status/F"), owl("complementOf"), u("priority/1")))), f"select 'cls-com' as rule, 'inst ' || a.s || ' is both ' || a.o || ' and ' || c.o || ' (complementary classes)' as message from b a join b c on a.s = c.s where a.p = '{TYPE}' and c.p = '{TYPE}' and a.o = '{u('status/F')}' and c.o = '{u('priority/1')}'"),
    "cls_nothing2": (union(STATUS, facts("orders", ORDER, TYPE, owl("Nothing"), "o_orderstatus = 'P'")), f"select 'cls-nothing2' as rule, 'instance ' || s || ' is owl:Nothing (unsatisfiable)' as message from b where o = '{owl('Nothing')}'"),
    "rdfs_datatype": (union(facts("part", PART, u("size"), VALUE), facts("part", PART, u("size"), f"'\"' || p_brand || '\"^^{xsd('int')}'", "p_size > 40"), facts("lineitem", key("order", "l_orderkey"), u("flag"), f"'\" ' || l_linenumber || '\"^^{xsd('integer')}'", "l_returnflag = 'R'")),
        "select 'rdfs-datatype' as rule, 'ill-formed literal ' || o || ' used in triple ' || s || ' ' || p || ' ' || o as message from b where not regexp_matches(o, '^\"[+-]?[0-9]+\"\\^\\^')"),
    "rdfs_datatype_range": (union(facts("part", PART, u("size"), VALUE), facts("part", PART, u("size"), "'\"' || p_brand || '\"'"), facts("part", PART, u("size"), f"'\"' || cast(p_partkey + 3000000000 as string) || '\"^^{xsd('integer')}'"), rows((u("size"), rdfs("range"), xsd("int")))),
        f"select distinct 'rdfs-datatype-range' as rule, 'range clash: object ' || o || ' is not in datatype {xsd('int')[1:-1]} for predicate {u('size')}' as message from b where p = '{u('size')}' and o not like '%XMLSchema#int>'"),
}


def diagnosed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diagnostics(load(spark, sf_dir, DIAGNOSED[name][0]), {name.replace("_", "-")}).select("rule", "message")

    return run


# --- plumbing ---------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, facts("orders", ORDER, u("placedBy"), key("customer", "o_custkey"), "o_orderstatus = 'O'")), load(spark, sf_dir, PLACED)


def triple_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, all_ = _split(spark, sf_dir)
    return all_.join(first, ["s", "p", "o"], "left_anti")


def base_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether replacing the asserted triples removed some: a superset, the same, a subset."""
    first, all_ = _split(spark, sf_dir)
    r = Reasoner(spark, rules=())
    r.load_triples(first)
    steps = [("superset", r.set_base_triples(all_)), ("same", r.set_base_triples(all_)), ("subset", r.set_base_triples(first))]
    return spark.createDataFrame(steps, "step string, removed boolean")


def incremental_eq_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure reached in two additions, the axioms coming with the second."""
    first, all_ = _split(spark, sf_dir)
    c = Closure(spark, ("prp-dom", "prp-inv1"))
    c.add(first)
    c.add(all_.unionByName(triple_frame(spark, [(u("placedBy"), rdfs("domain"), u("Order")), (u("placedBy"), owl("inverseOf"), u("placed"))])))
    return c.output()


def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of triples in micro-batches; the final state is the closure of all."""
    ws = Workspace(spark)
    events = load(spark, sf_dir, EVENT)
    events.repartition(4).write.parquet(ws.path("events"))
    closure = Closure(spark, ("cax-sco",), ws=ws)
    closure.add(load(spark, sf_dir, EVENT_SUB))
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 2).parquet(ws.path("events"))
    StreamingClosure(closure).start(stream, ws.path("offsets"), availableNow=True).awaitTermination()
    return closure.output()


def list_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lists of the nations of each region, each cell pointing to the next."""
    cells = load(spark, sf_dir, LIST_CELLS)
    return list_members(cells, Workspace(spark)).select(F.col("s").alias("head"), F.col("o").alias("member"))


LIST_CELLS = union(
    facts("nation", key("cell", "n_nationkey"), FIRST, NATION),
    f"select '<urn:cell/' || cast(n_nationkey as string) || '>' as s, '{REST}' as p, case when nxt is null then '{NIL}' else '<urn:cell/' || cast(nxt as string) || '>' end as o from (select n_nationkey, lead(n_nationkey) over (partition by n_regionkey order by n_nationkey) as nxt from {{nation}}) c",
)


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_histogram(CASES["cax_sco"].run(spark, sf_dir), TYPE)


# the table's prefixed datatypes as IRIs
SPELLED = f"case when o like '%^^xsd:%' then regexp_replace(o, '^(.*)\"[^\"]*$', '$1') || '\"^^{xsd('')[:-1]}' || regexp_extract(o, 'xsd:([A-Za-z]+)$', 1) || '>' else o end"


def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literals of the triples table, written as N-Triples and read again."""
    ws = Workspace(spark)
    t = load(spark, sf_dir, f"select '<urn:row/' || cast(triple_id as string) || '>' as s, '{u('says')}' as p, {SPELLED} as o from {{triples}} where o like '\"%'")
    write_ntriples(t, ws.path("out.nt"))
    return read_triples(spark, ws.path("out.nt"))


def datatype_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical checks over raw objects of the triples table."""
    o = spark.read.parquet(f"{sf_dir}/triples.parquet").where("o like '\"%'").select(F.regexp_extract("o", '^"([^"\\\\]*)"', 1).alias("lex")).distinct()
    return o.select("lex", DT.integer_valid(F.col("lex")).cast("int").alias("is_integer"), DT.int_valid(F.col("lex")).cast("int").alias("is_int"))


def eq_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality held by classes: the same rows as the eq- rules give."""
    c = Closure(spark, (), equality="classes")
    c.add(load(spark, sf_dir, union(SAME_DOC, DOC_LANG)))
    return c.output()


def prp_fp_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functional rule with equality held by classes: one link a value, the same pairs in the output."""
    c = Closure(spark, ("prp-fp",), equality="classes")
    c.add(load(spark, sf_dir, CASES["prp_fp"].base))
    return c.output()


def prp_ifp_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse-functional rule in mode compat: any two subjects of the property."""
    c = Closure(spark, ("prp-ifp",), mode="compat")
    c.add(load(spark, sf_dir, union(IN_REGION, axiom("locatedIn", "InverseFunctionalProperty"))))
    return c.output()


def cls_uni_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in mode compat: all cells that are joined share their members, so every nation of a region counts."""
    c = Closure(spark, ("cls-uni",), mode="compat")
    c.add(load(spark, sf_dir, union(LIST_CELLS, COUNTRY_TYPES, UNIONS)))
    return c.output().where(F.col("p") == TYPE)


def cls_uni_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists in mode spec: a union lists what follows its own cell."""
    c = Closure(spark, ("cls-uni",))
    c.add(load(spark, sf_dir, union(LIST_CELLS, COUNTRY_TYPES, UNIONS)))
    return c.output().where(F.col("p") == TYPE)


def range_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range clashes in mode compat: an IRI lies outside every range."""
    t = load(spark, sf_dir, union(IN_REGION, rows((u("locatedIn"), rdfs("range"), u("Region")))))
    return diagnostics(t, {"rdfs-datatype-range"}, "compat").select("rule", "message")


def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the hierarchy rows of part_links."""
    links = spark.read.parquet(f"{sf_dir}/part_links.parquet").where(same_term("p").isin("hv:partOf", "rdfs:subClassOf", "hv:hasPart"))
    return components(links.select(same_term("s").alias("a"), same_term("o").alias("b")), "a", "b")


def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the triples table written as N-Triples, which is Turtle, and read by the Turtle reader."""
    ws = Workspace(spark)
    t = load(spark, sf_dir, f"select '<urn:row/' || cast(triple_id as string) || '>' as s, '{u('says')}' as p, case when o like '\"%' then {SPELLED} when o like '\\_:%' then o else '<' || o || '>' end as o from {{triples}} where o is not null and o <> ''")
    write_ntriples(t, ws.path("out.ttl"))
    return read_triples(spark, ws.path("out.ttl"), scope=False)


def value_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects of the triples table lie in the value space of xsd:int and xsd:string; null is unknown."""
    o = load(spark, sf_dir, f"select distinct {SPELLED} as o from {{triples}} where o like '\"%'")
    dt = DT.literal_parts(F.col("o"))[2]
    in_ = lambda t: DT.in_space(F.col("o"), dt, F.lit(t)).cast("int")
    return o.select("o", in_(DT.INT).alias("in_int"), in_(DT.STRING).alias("in_string"), in_("urn:own").alias("in_own"))


COUNTRY_TYPES = facts("nation", "'<urn:of/' || cast(n_nationkey as string) || '>'", TYPE, NATION)
UNIONS = facts("nation", "'<urn:union/' || cast(n_nationkey as string) || '>'", owl("unionOf"), key("cell", "n_nationkey"))

PLUMBING: dict[str, tuple[Callable, str | None]] = {
    "triple_except": (triple_except, "select '<urn:order/' || o_orderkey || '>' as s, '<urn:placedBy>' as p, '<urn:customer/' || o_custkey || '>' as o from orders where o_orderstatus <> 'O'"),
    "base_diff": (base_diff, "select 'superset' as step, false as removed union all select 'same', false union all select 'subset', true"),
    "incremental_eq_full": (
        incremental_eq_full,
        f"with b as (select distinct s, p, o from ({duck(PLACED)}) x) select s, p, o from b union select s, '{TYPE}', '{u('Order')}' from b union select o, '{u('placed')}', s from b union select '{u('placedBy')}', '{rdfs('domain')}', '{u('Order')}' union select '{u('placedBy')}', '{owl('inverseOf')}', '{u('placed')}'",
    ),
    "incremental_stream": (incremental_stream, f"with b as (select distinct s, p, o from ({duck(union(EVENT, EVENT_SUB))}) x) select s, p, o from b union select s, p, '{u('Event')}' from b where p = '{TYPE}'"),
    "eq_classes": (eq_classes, CASES["eq_rep_s"].sql()),
    "prp_fp_classes": (prp_fp_classes, CASES["prp_fp"].sql()),
    "prp_ifp_compat": (prp_ifp_compat, f"with b as (select distinct s, p, o from ({duck(union(IN_REGION, axiom('locatedIn', 'InverseFunctionalProperty')))}) x) select s, p, o from b union select a.s, '{SAME}', c.s from b a, b c where a.p = '{u('locatedIn')}' and c.p = '{u('locatedIn')}'"),
    "cls_uni_compat": (cls_uni_compat, f"select '<urn:of/' || a.n_nationkey || '>' as s, '{TYPE}' as p, '<urn:nation/' || a.n_nationkey || '>' as o from nation a union select '<urn:of/' || a.n_nationkey || '>', '{TYPE}', '<urn:union/' || c.n_nationkey || '>' from nation a join nation c on a.n_regionkey = c.n_regionkey"),
    "cls_uni_tails": (cls_uni_tails, f"select '<urn:of/' || a.n_nationkey || '>' as s, '{TYPE}' as p, '<urn:nation/' || a.n_nationkey || '>' as o from nation a union select '<urn:of/' || a.n_nationkey || '>', '{TYPE}', '<urn:union/' || c.n_nationkey || '>' from nation a join nation c on a.n_regionkey = c.n_regionkey and a.n_nationkey >= c.n_nationkey"),
    "rdfs_datatype_range_compat": (range_compat, "select distinct 'rdfs-datatype-range' as rule, 'range clash: object <urn:region/' || n_regionkey || '> is not in datatype urn:Region for predicate <urn:locatedIn>' as message from nation"),
    "connected_components": (
        connected,
        f"with recursive l as (select {nt('p')} p, {nt('s')} a, {nt('o')} b from part_links), e as (select a, b from l where p in ('hv:partOf', 'rdfs:subClassOf', 'hv:hasPart') and a is not null and b is not null union select b, a from l where p in ('hv:partOf', 'rdfs:subClassOf', 'hv:hasPart') and a is not null and b is not null), r as (select a x, a y from e union select r.x, e.b from r join e on r.y = e.a) select x as term, min(y) as root from r group by x",
    ),
    "turtle_round_trip": (turtle_round_trip, f"select distinct '<urn:row/' || triple_id || '>' as s, '{u('says')}' as p, case when o like '%^^xsd:string' then o[1:length(o) - 12] when o like '\"%' then {SPELLED.replace('$1', chr(92) + '1')} when o like '\\_:%' escape '\\' then o else '<' || o || '>' end as o from triples where o is not null and o <> ''"),
    "value_spaces": (
        value_spaces,
        f"""select distinct {SPELLED.replace('$1', chr(92) + '1')} as o,
        (case when o like '%^^xsd:int' or o like '%^^xsd:integer' then regexp_matches(o, '^"[+-]?[0-9]+"') and coalesce(try_cast(regexp_extract(o, '^"([^"]*)"', 1) as hugeint) between -2147483648 and 2147483647, false) else false end)::int as in_int,
        (o not like '%^^%' and not regexp_matches(o, '"@[A-Za-z0-9-]+$') or o like '%^^xsd:string')::int as in_string, null::int as in_own from triples where o like '"%'""",
    ),
    "list_expand": (list_expand, "select '<urn:cell/' || a.n_nationkey || '>' as head, '<urn:nation/' || b.n_nationkey || '>' as member from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey >= a.n_nationkey"),
    "class_histogram": (histogram, "select '<urn:kind/' || replace(p_type, ' ', '_') || '>' as class, count(*) as n_instances from part group by 1 union all select c, count(*) from part, (select '<urn:Part>' c union select '<urn:Product>') y group by c"),
    "ntriples_round_trip": (ntriples_round_trip, f"select '<urn:row/' || triple_id || '>' as s, '{u('says')}' as p, case when o like '%^^xsd:string' then o[1:length(o) - 12] else {SPELLED.replace('$1', chr(92) + '1')} end as o from triples where o like '\"%'"),
    "datatype_functions": (
        datatype_functions,
        """select lex, regexp_full_match(lex, '[+-]?[0-9]+')::int as is_integer, (regexp_full_match(lex, '[+-]?[0-9]+') and coalesce(try_cast(lex as hugeint) between -2147483648 and 2147483647, false))::int as is_int
        from (select distinct regexp_extract(o, '^"([^"\\\\]*)"', 1) as lex from triples where o like '"%')""",
    ),
}


def queries() -> dict:
    return {n: c.run for n, c in CASES.items()} | {n: diagnosed(n) for n in DIAGNOSED} | {n: f for n, (f, _) in PLUMBING.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: c.sql() for n, c in CASES.items()}
    out |= {n: f"with b as (select distinct s, p, o from ({duck(base)}) x) {sql}" for n, (base, sql) in DIAGNOSED.items()}
    return out | {n: sql for n, (_, sql) in PLUMBING.items() if sql}
