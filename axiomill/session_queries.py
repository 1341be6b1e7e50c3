"""Queries of sessions, files and the command line over the driver's tables, each next to its SQL."""

from __future__ import annotations

import io
import json
import os
import tempfile
from collections.abc import Callable
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill import cli
from axiomill.plans.diagnostics import diagnostics
from axiomill.plans.fixpoint import Closure
from axiomill.plans.lists import list_members
from axiomill.rule_queries import IN_NATION, IN_REGION, NATION, PLACED, PRIORITY, STATUS, duck, facts, key, load, restriction, rows, sql_list, u, union
from axiomill.session import Options, Reasoner
from axiomill.sources import read_triples, write_ntriples
from axiomill.terms import IRI, BNode, Literal, from_canonical, to_canonical
from axiomill.vocab import CLASS, NOTHING, SAME, THING, TYPE, XSD, owl, rdf, rdfs
from axiomill.workspace import Workspace

NAMES = facts("nation", NATION, u("name"), "'\"' || n_name || '\"@en'")
TWO_CLASSES = union(facts("nation", NATION, TYPE, u("Land")), facts("nation", NATION, TYPE, u("Sea"), "n_regionkey < 2"), rows((u("Land"), owl("disjointWith"), u("Sea"))))


def asserted(sql: str) -> str:
    return f"select distinct s, p, o from ({duck(sql)}) x"


# --- all rules together

PROFILE = union(
    PLACED, STATUS, PRIORITY,
    facts("customer", key("customer", "c_custkey"), SAME, key("client", "c_custkey"), "c_mktsegment = 'BUILDING'"),
    rows((u("placedBy"), owl("inverseOf"), u("placed")), (u("placedBy"), rdfs("domain"), u("Order")), (u("placedBy"), rdfs("range"), u("Customer")), (u("Order"), rdfs("subClassOf"), u("Document"))),
    # an intersection of a status and a restriction, equivalent to a class that is below another and disjoint with a third
    rows((u("Hot"), owl("intersectionOf"), u("hl")), *sql_list(u("hl"), [u("status/O"), u("priority/1")]), (u("Hot"), owl("equivalentClass"), u("Urgent")), (u("Urgent"), rdfs("subClassOf"), u("Watched"))),
    rows((u("Party"), owl("unionOf"), u("pl")), *sql_list(u("pl"), [u("Customer"), u("Supplier")])),
    restriction("ByFirst", "hasValue", "placedBy", u("customer/1")),
    restriction("Buys", "someValuesFrom", "placed", u("Hot")),
    restriction("Plain", "allValuesFrom", "placedBy", u("Steady")),
    rows((u("status/F"), rdfs("subClassOf"), u("Plain"))),
)


def full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule at once: lists, restrictions, equality and derived axioms feed one another."""
    c = Closure(spark)
    c.add(load(spark, sf_dir, PROFILE))
    return c.output()


def _type(source: str, c: str) -> str:
    return f"select {source}, '{TYPE}', '{u(c)}'"


SUBS = [("Order", "Document"), ("Hot", "Urgent"), ("Urgent", "Hot"), ("Hot", "Hot"), ("Urgent", "Urgent"), ("Urgent", "Watched"), ("Hot", "Watched"), ("status/F", "Plain")]
FULL = f"""with b as ({asserted(PROFILE)}),
pl as (select s, o from b where p = '{u('placedBy')}'),
hot as (select s from b where p = '{TYPE}' and o in ('{u('status/O')}', '{u('priority/1')}') group by s having count(distinct o) = 2),
buys as (select distinct pl.o s from pl join hot on hot.s = pl.s),
d as (select s, p, o from b
  union select o, '{u('placed')}', s from pl
  union {_type('s', 'Order')} from pl union {_type('s', 'Document')} from pl
  union {_type('o', 'Customer')} from pl union {_type('o', 'Party')} from pl
  union select s, '{TYPE}', c from hot, (select '{u('Hot')}' c union select '{u('Urgent')}' union select '{u('Watched')}') y
  union {_type('s', 'ByFirst')} from pl where o = '{u('customer/1')}'
  union {_type('s', 'Buys')} from buys
  union {_type('s', 'Plain')} from b where p = '{TYPE}' and o = '{u('status/F')}'
  union {_type('pl.o', 'Steady')} from pl join b f on f.s = pl.s and f.p = '{TYPE}' and f.o = '{u('status/F')}'
  union {" union ".join(f"select '{u(a)}', '{rdfs('subClassOf')}', '{u(b)}'" for a, b in SUBS)}),
q as (select s x, o y from b where p = '{SAME}' union select o, s from b where p = '{SAME}' union select s, s from b where p = '{SAME}' union select o, o from b where p = '{SAME}'),
e as (select coalesce(x.y, d.s) s, d.p, coalesce(z.y, d.o) o from d left join q x on x.x = d.s left join q z on z.x = d.o where d.p <> '{SAME}'
  union select x, '{SAME}', y from q
  union select '{THING}', '{TYPE}', '{CLASS}' union select '{NOTHING}', '{TYPE}', '{CLASS}')
select s, p, o from e union select s, '{TYPE}', '{THING}' from e"""


# --- integrity rules

XML = union(
    facts("nation", NATION, u("text"), rf"""'"<n k=\\"1\\"\\n>' || n_name || '</n>"^^{rdf("XMLLiteral")}'""", "n_regionkey <> 1"),
    facts("nation", NATION, u("text"), f"""'"<n>' || n_name || '</m>"^^{rdf("XMLLiteral")}'""", "n_regionkey = 1"),
)


def xml_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML literals with attributes and line ends within their tags, some of them open."""
    return diagnostics(load(spark, sf_dir, XML), {"rdfs-datatype"}).select("rule", "message")


def range_clash_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that is added after a run, whose facts were there before: the next run reports them."""
    r = Reasoner(spark, rules=("prp-rng", "rdfs-datatype-range"))
    r.load_triples(load(spark, sf_dir, NAMES))
    r.reason()
    before = r.diagnostics().select(F.lit("before").alias("step"), "rule", "message")
    r.load_triples(load(spark, sf_dir, rows((u("name"), rdfs("range"), f"<{XSD}integer>"))))
    r.reason()
    return before.unionByName(r.diagnostics().select(F.lit("after").alias("step"), "rule", "message"))


def first_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five by code and message; the limit is the feature."""
    r = Reasoner(spark, rules=("cax-dw",), options=Options(max_diagnostics=5))
    r.load_triples(load(spark, sf_dir, TWO_CLASSES))
    r.reason()
    return r.diagnostics().select("code", "message")


def diagnostics_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of many findings, once or as often as it is found."""
    out = None
    for dedupe in (True, False):
        r = Reasoner(spark, rules=("rdfs-datatype-range",), options=Options(dedupe=dedupe))
        r.load_triples(load(spark, sf_dir, union(facts("customer", key("customer", "c_custkey"), u("nationName"), "'\"' || cast(c_nationkey as string) || '\"'"), rows((u("nationName"), rdfs("range"), f"<{XSD}integer>")))))
        r.reason()
        n = r.diagnostics().groupBy("message").agg(F.count("*").alias("n")).select(F.lit(dedupe).alias("dedupe"), "message", "n")
        out = n if out is None else out.unionByName(n)
    return out


def collected_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None while they are not collected; all once they are."""
    r = Reasoner(spark, rules=("cax-dw",), options=Options(collect_diagnostics=False))
    r.load_triples(load(spark, sf_dir, TWO_CLASSES))
    r.reason()
    off = r.errors().agg(F.lit("off").alias("step"), F.count("*").alias("n"))
    r.set_options(Options())
    return off.unionByName(r.errors().agg(F.lit("on").alias("step"), F.count("*").alias("n")))


# --- sessions


def output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived triples whose subject is a literal are held, and left out of the output."""
    c = Closure(spark, ("prp-inv1", "prp-rng"))
    c.add(load(spark, sf_dir, union(NAMES, rows((u("name"), owl("inverseOf"), u("nameOf")), (u("name"), rdfs("range"), u("Name"))))))
    held = c.triples().where(F.col("s").startswith('"')).select(F.lit("held").alias("kind"), "s", "p", "o")
    return held.unionByName(c.output().select(F.lit("output").alias("kind"), "s", "p", "o"))


def removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure after a part of what was asserted was taken back."""
    r = Reasoner(spark, rules=("prp-trp",))
    r.load_triples(load(spark, sf_dir, union(IN_NATION, IN_REGION, rows((u("locatedIn"), TYPE, owl("TransitiveProperty"))))))
    r.reason()
    r.set_base_triples(load(spark, sf_dir, union(IN_NATION, facts("nation", NATION, u("locatedIn"), key("region", "n_regionkey"), "n_regionkey > 1"), rows((u("locatedIn"), TYPE, owl("TransitiveProperty"))))))
    return r.reason()


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after clear, and after the full run that follows, of triples that were loaded but never reasoned over."""
    r = Reasoner.build(spark, triples=load(spark, sf_dir, IN_REGION), rules=("prp-dom",))
    r.reason()
    r.load_triples(load(spark, sf_dir, rows((u("locatedIn"), rdfs("domain"), u("Place")))))
    r.clear()
    empty = r.get_triples().agg(F.lit("cleared").alias("step"), F.count("*").alias("n"))
    base = r.get_base_triples().agg(F.lit("base").alias("step"), F.count("*").alias("n"))
    return empty.unionByName(base).unionByName(r.reason_full().agg(F.lit("full").alias("step"), F.count("*").alias("n")))


def string_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples given and taken as tuples of strings; a row with a term that is no IRI is skipped and counted."""
    n = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").toLocalIterator()]
    r = Reasoner.build(spark, strings=[(f"urn:nation/{k}", "urn:kind", "urn:Land") for k in n], rules=())
    r.load_triples_str([("no iri", "urn:kind", "urn:Land"), ("<urn:nation/extra>", "urn:kind", "urn:Land")])
    r.reason()
    return spark.createDataFrame([(*t, r.skipped) for t in r.get_triples_string()], "s string, p string, o string, skipped int")


def python_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term objects in and out: IRIs, blank nodes, literals with language, datatype and signs to escape."""
    names = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").toLocalIterator()]
    r = Reasoner(spark, rules=())
    graph = [(BNode(f"b{k}"), IRI("urn:says"), Literal(f'the "{n}" \\ of\nday', lang="en")) for k, n in names]
    graph += [(BNode(f"b{k}"), IRI("urn:number"), Literal(str(k), f"{XSD}integer")) for k, _ in names]
    r.from_graph(graph)
    r.reason()
    back = r.get_triples_python()
    assert all(from_canonical(to_canonical(t)) == t for row in back for t in row)
    kind = lambda t: (t.value, getattr(t, "datatype", ""), getattr(t, "lang", None) or "")
    return spark.createDataFrame([(s.value, p.value, *kind(o)) for s, p, o in back], "s string, p string, o string, datatype string, lang string")


# --- files and the command line


def _folder() -> str:
    return tempfile.mkdtemp(prefix="axiomill-cli-")


def turtle_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure written as one Turtle file and read again."""
    r = Reasoner(spark, rules=("prp-symp",))
    r.load_triples(load(spark, sf_dir, union(IN_REGION, NAMES, rows((u("locatedIn"), TYPE, owl("SymmetricProperty"))))))
    r.reason()
    path = os.path.join(_folder(), "dump.ttl")
    r.dump_file(path)
    again = Reasoner(spark, rules=())
    with open(path, encoding="utf-8") as f:  # a local file: what the driver wrote is handed to the shared folder
        text = f.read()
    ws = Workspace(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(ws.path("dump.ttl"))
    again.load_file(ws.path("dump.ttl"))
    return again.get_base_triples()


def turtle_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes, bases, lists of predicates, objects and nodes, blank nodes and numbers."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()
    lines = ["@prefix : <urn:> .", "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>", "@base <http://base/> ."]
    for k, name, region in n:
        lines.append(f':n{k} a :Land, :Place ; :name "{name}"@en, \'{name.lower()}\' ; :code {k} ; :in <r{region}> ; :part [ :of :n{k} ] ; :near ( :n{k} <x{k}> ) .')
    ws = Workspace(spark)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(ws.path("in.ttl"))
    t = read_triples(spark, ws.path("in.ttl"), scope=False)
    lists = list_members(t, ws).withColumnRenamed("s", "head").select("head", "o")
    near = t.where(F.col("p") == u("near")).select("s", "p", F.col("o").alias("head")).join(lists, "head").select("s", "p", "o")
    part = t.where(F.col("p") == u("part")).select("s", "p", F.col("o").alias("b")).join(t.where(F.col("p") == u("of")).select(F.col("s").alias("b"), "o"), "b").select("s", "p", "o")
    plain = t.where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))
    return plain.unionByName(near).unionByName(part)


def repeats_in_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written twice count once."""
    ws = Workspace(spark)
    t = load(spark, sf_dir, PLACED)
    write_ntriples(t.unionAll(t), ws.path("twice.nt"))
    return read_triples(spark, ws.path("twice.nt"))


def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file that cannot be read says: an unknown suffix, no such path, lines that are no triples."""
    ws = Workspace(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").write.text(ws.path("names.nt"))
    out = []
    for name in ("names.csv", "none.nt", "names.nt"):
        try:
            read_triples(spark, ws.path(name)).count()
            out.append((name, "read"))
        except ValueError:
            out.append((name, "unknown suffix"))
        except OSError:
            out.append((name, "no such path"))
        except Exception as e:
            out.append((name, "no triple" if "not an N-Triples line" in str(e) else "other"))
    return spark.createDataFrame(out, "name string, error string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of exit and lines printed in each format, over a file of clashing classes."""
    ws = Workspace(spark)
    write_ntriples(load(spark, sf_dir, TWO_CLASSES), ws.path("in.nt"))
    folder, out = _folder(), []
    for args in (["--error-format", "text"], ["--error-format", "json"], ["--error-format", "ndjson", "--fail-on", "prp-irp,CAX-DW"], ["--summary-only", "--fail-on", "prp-irp"], ["--error-format", "ndjson", "--max-diagnostics", "3"]):
        said = io.StringIO()
        with redirect_stdout(said):
            code = cli.main([ws.path("in.nt"), "-o", os.path.join(folder, "out.nt"), *args], spark)
        text = said.getvalue()
        lines = [json.dumps(x, ensure_ascii=False) for x in json.loads(text)] if "json" in args else text.splitlines()
        out += [(" ".join(args), code, line) for line in lines]
    return spark.createDataFrame(out, "args string, exit_code int, line string")


_CLASH = "'inst <urn:nation/' || n_nationkey || '> is both <urn:Land> and <urn:Sea> (disjoint classes)'"
_JSON = f"""'{{"code": "OWLRL.CAX_DW", "rule": "cax-dw", "severity": "error", "message": "' || {_CLASH} || '"}}'"""
_RANGE = f"'range clash: object \"' || n_name || '\"@en is not in datatype {XSD}integer for predicate <urn:name>'"

QUERIES: dict[str, tuple[Callable, str]] = {
    "full_profile": (full_profile, FULL),
    "xml_literals": (xml_literals, f"""select 'rdfs-datatype' as rule, 'ill-formed literal "<n>' || n_name || '</m>"^^{rdf("XMLLiteral")} used in triple <urn:nation/' || n_nationkey || '> <urn:text> "<n>' || n_name || '</m>"^^{rdf("XMLLiteral")}' as message from nation where n_regionkey = 1"""),
    "range_clash_later": (range_clash_later, f"select 'after' as step, 'rdfs-datatype-range' as rule, {_RANGE} as message from nation"),
    "first_diagnostics": (first_diagnostics, f"select 'OWLRL.CAX_DW' as code, {_CLASH} as message from nation where n_regionkey < 2 order by 2 limit 5"),
    "diagnostics_dedupe": (diagnostics_dedupe, f"""with m as (select 'range clash: object "' || c_nationkey || '" is not in datatype {XSD}integer for predicate <urn:nationName>' as message, count(*) as n from customer group by 1)
        select true as dedupe, message, 1::bigint as n from m union all select false, message, n from m"""),
    "collected_diagnostics": (collected_diagnostics, "select 'off' as step, 0::bigint as n union all select 'on', count(*) from nation where n_regionkey < 2"),
    "output_filter": (output_filter, f"""with b as ({asserted(union(NAMES, rows((u("name"), owl("inverseOf"), u("nameOf")), (u("name"), rdfs("range"), u("Name")))))})
        select 'output' as kind, s, p, o from b union all select 'held', o, '{u("nameOf")}', s from b where p = '{u("name")}' union all select 'held', o, '{TYPE}', '{u("Name")}' from b where p = '{u("name")}'"""),
    "removal": (removal, f"""with recursive b as ({asserted(union(IN_NATION, facts("nation", NATION, u("locatedIn"), key("region", "n_regionkey"), "n_regionkey > 1"), rows((u("locatedIn"), TYPE, owl("TransitiveProperty")))))}),
        r(x, y) as (select s, o from b where p = '{u("locatedIn")}' union select r.x, b.o from r join b on b.s = r.y and b.p = '{u("locatedIn")}') select s, p, o from b union select x, '{u("locatedIn")}', y from r"""),
    "cleared": (cleared, "select 'cleared' as step, 0::bigint as n union all select 'base', count(*) + 1 from nation union all select 'full', 2 * count(*) + 1 from nation"),
    "string_triples": (string_triples, "select '<urn:nation/' || n_nationkey || '>' as s, '<urn:kind>' as p, '<urn:Land>' as o, 1::int as skipped from nation union all select '<urn:nation/extra>', '<urn:kind>', '<urn:Land>', 1"),
    "python_terms": (python_terms, f"""select 'b' || n_nationkey as s, 'urn:says' as p, 'the "' || n_name || '" \\ of' || chr(10) || 'day' as o, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' as datatype, 'en' as lang from nation
        union all select 'b' || n_nationkey, 'urn:number', n_nationkey::varchar, '{XSD}integer', '' from nation"""),
    "turtle_dump": (turtle_dump, f"""with b as ({asserted(union(IN_REGION, NAMES, rows((u("locatedIn"), TYPE, owl("SymmetricProperty")))))}) select s, p, o from b union select o, p, s from b where p = '{u("locatedIn")}'"""),
    "turtle_syntax": (turtle_syntax, f"""with n as (select '<urn:n' || n_nationkey || '>' as s, * from nation)
        select s, '{TYPE}' as p, '<urn:Land>' as o from n union select s, '{TYPE}', '<urn:Place>' from n union select s, '<urn:name>', '"' || n_name || '"@en' from n union select s, '<urn:name>', '"' || lower(n_name) || '"' from n
        union select s, '<urn:code>', '"' || n_nationkey || '"^^<{XSD}integer>' from n union select s, '<urn:in>', '<http://base/r' || n_regionkey || '>' from n union select s, '<urn:part>', s from n
        union select s, '<urn:near>', s from n union select s, '<urn:near>', '<http://base/x' || n_nationkey || '>' from n"""),
    "repeats_in_a_file": (repeats_in_a_file, asserted(PLACED)),
    "file_errors": (file_errors, "select 'names.csv' as name, 'unknown suffix' as error union all select 'none.nt', 'no such path' union all select 'names.nt', 'no triple'"),
    "command_line": (command_line, f"""with c as (select {_CLASH} as m, {_JSON} as j from nation where n_regionkey < 2)
        select '--error-format text' as args, 0::int as exit_code, 'OWLRL.CAX_DW cax-dw: ' || m as line from c union all select '--error-format json', 0, j from c
        union all select '--error-format ndjson --fail-on prp-irp,CAX-DW', 2, j from c union all select '--summary-only --fail-on prp-irp', 0, 'diagnostics: ' || count(*) from c
        union all (select '--error-format ndjson --max-diagnostics 3', 0, j from c order by m limit 3)"""),
}


def queries() -> dict:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
