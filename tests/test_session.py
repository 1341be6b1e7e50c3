import json

import pytest

from axiomill import cli
from axiomill.session import Options, Reasoner
from axiomill.sources import TripleSyntaxError, read_triples
from axiomill.sources.turtle import parse_turtle
from axiomill.streaming import StreamingClosure
from axiomill.plans.fixpoint import Closure, triple_frame
from axiomill.terms import IRI, BNode, Literal, from_canonical, to_canonical
from axiomill.vocab import TYPE, owl, rdfs, xsd


def u(x):
    return f"<urn:{x}>"


SUB = (u("B"), rdfs("subClassOf"), u("A"))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_names_of_the_package():
    import axiomill

    assert axiomill.Reasoner is Reasoner and axiomill.Options is Options and axiomill.__version__
    with pytest.raises(AttributeError):
        axiomill.nothing  # noqa: B018


def test_additions_and_removals(spark):
    r = Reasoner(spark)
    r.load_triples(triple_frame(spark, [SUB, (u("x"), TYPE, u("B"))]))
    assert (u("x"), TYPE, u("A")) in rows(r.reason())
    # a superset adds, and the same again changes nothing
    more = triple_frame(spark, [SUB, (u("x"), TYPE, u("B")), (u("y"), TYPE, u("B"))])
    assert r.set_base_triples(more) is False
    assert (u("y"), TYPE, u("A")) in rows(r.reason())
    assert r.update_graph(more) is False
    # a removal drops what followed from it
    assert r.set_base_triples(triple_frame(spark, [SUB, (u("y"), TYPE, u("B"))])) is True
    got = rows(r.reason())
    assert (u("y"), TYPE, u("A")) in got and (u("x"), TYPE, u("A")) not in got
    fresh = Reasoner(spark)
    fresh.load_triples(triple_frame(spark, [SUB, (u("y"), TYPE, u("B"))]))
    assert rows(fresh.reason()) == got


def test_pending_triples_survive_a_full_run(spark):
    r = Reasoner(spark)
    r.load_triples_str([("urn:B", rdfs("subClassOf")[1:-1], "urn:A")])
    r.reason()
    r.load_triples_str([("urn:x", TYPE[1:-1], "urn:B"), ("no iri", "urn:p", "urn:y")])
    assert r.skipped == 1
    assert (u("x"), TYPE, u("A")) in rows(r.reason_full())
    assert rows(r.get_base_triples()) == {SUB, (u("x"), TYPE, u("B"))}


def test_asserted_after_it_was_inferred(spark):
    r = Reasoner(spark)
    r.load_triples(triple_frame(spark, [SUB, (u("x"), TYPE, u("B"))]))
    r.reason()
    r.load_triples(triple_frame(spark, [(u("x"), TYPE, u("A"))]))
    assert (u("x"), TYPE, u("A")) in rows(r.get_base_triples())
    r.set_base_triples(triple_frame(spark, [SUB, (u("x"), TYPE, u("A"))]))
    assert (u("x"), TYPE, u("A")) in rows(r.reason())


def test_terms_round_trip(spark):
    terms = [IRI("urn:a"), BNode("b1"), Literal("42", xsd("integer")[1:-1]), Literal('say "hi"\n\\', lang=None), Literal("hello", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")]
    for t in terms:
        assert from_canonical(to_canonical(t)) == t
    r = Reasoner(spark, rules=())
    r.from_graph([(IRI("urn:a"), IRI("urn:p"), t) for t in terms])
    r.reason()
    assert {o for _, _, o in r.get_triples_python()} == set(terms)
    with pytest.raises(ValueError):
        r.from_graph([("a", "b")])


def test_diagnostic_options(spark):
    r = Reasoner(spark, options=Options(max_diagnostics=1))
    r.load_triples(triple_frame(spark, [(u("A"), owl("disjointWith"), u("B")), *[(u(x), TYPE, u(c)) for x in "xyz" for c in "AB"]]))
    r.reason()
    assert r.diagnostics().count() == 1
    r.set_options(Options())
    assert r.errors().count() == 3
    r.set_options(Options(collect_diagnostics=False))
    assert r.errors().count() == 0


TURTLE = """@prefix : <urn:> . @base <http://x/y/> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
:a a :B ; :p "one", 'two'@de-AT , \"\"\"three "quoted"
lines\"\"\" ; :n 5, -1.5, 1e3, true ; :q [ :r :s ; ] , [] ; .
:l :list ( :x "y" () ) . # a comment
<rel> :p <#frag>, "caf\\u00e9"^^xsd:string, "7"^^xsd:int .
[ :only :this ] .
_:b1 :p _:b1 ."""


def test_turtle():
    t = set(parse_turtle(TURTLE, scope="f."))
    assert ("<urn:a>", TYPE, "<urn:B>") in t
    objects = {o for _, p, o in t if p == "<urn:p>"}
    assert {'"one"', '"two"@de-AT', '"three \\"quoted\\"\\nlines"', "<http://x/y/#frag>", '"café"', f'"7"^^{xsd("int")}', "_:f.b1"} <= objects
    assert {o for _, p, o in t if p == "<urn:n>"} == {f'"5"^^{xsd("integer")}', f'"-1.5"^^{xsd("decimal")}', f'"1e3"^^{xsd("double")}', f'"true"^^{xsd("boolean")}'}
    assert ("<http://x/y/rel>", "<urn:p>", f'"7"^^{xsd("int")}') in t
    for bad in (":a :b :c .", "<urn:a> <urn:b> .", "<urn:a> <urn:b> <<x>> .", '<urn:a> <urn:b> "open', "<urn:a> <urn:b> ( <urn:c>"):
        with pytest.raises(TripleSyntaxError):
            parse_turtle(bad)


def test_files(spark, tmp_path):
    one, two = tmp_path / "one.nt", tmp_path / "two.n3"
    one.write_text('# c\n\n<urn:a> <urn:p> "x\\ty\\u00e9"@en .\n_:b <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#string> . # end\n_:b <urn:p> "1" .\n')
    two.write_text("_:b <urn:p> <urn:c> .\n")
    got = rows(read_triples(spark, str(one)))
    assert ("<urn:a>", "<urn:p>", '"x\tyé"@en') in got and len(got) == 2
    blank = {s for s, _, _ in got | rows(read_triples(spark, str(two))) if s.startswith("_:")}
    assert len(blank) == 2  # equal labels of two files are two nodes
    assert {s for s, _, _ in rows(read_triples(spark, str(two), scope=False))} == {"_:b"}
    (tmp_path / "x.ttl").write_text(TURTLE)
    assert read_triples(spark, str(tmp_path / "x.ttl")).count() == len(set(parse_turtle(TURTLE)))
    with pytest.raises(ValueError):
        read_triples(spark, str(tmp_path / "x.csv"))
    with pytest.raises(OSError):
        read_triples(spark, str(tmp_path / "none.nt"))
    (tmp_path / "bad.nt").write_text("<urn:a> <urn:b> .\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        read_triples(spark, str(tmp_path / "bad.nt")).collect()


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "in.ttl"
    f.write_text('@prefix : <urn:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . :A owl:disjointWith :B . :x a :A, :B ; :says "a\\nb"@en .')
    out = tmp_path / "out.nt"
    assert cli.main([str(f), "-o", str(out), "--error-format", "json", "--fail-on", "prp-irp,cax-DW"], spark) == 2
    found = json.loads(capsys.readouterr().out)
    assert found[0]["code"] == "OWLRL.CAX_DW" and found[0]["severity"] == "error"
    assert '"a\\nb"@en' in out.read_text()  # the language survives
    assert (u("x"), TYPE, owl("Thing")) in rows(read_triples(spark, str(out)))
    assert cli.main([str(f), "-o", str(out), "--summary-only", "--fail-on", "prp-irp"], spark) == 0
    assert capsys.readouterr().out == "diagnostics: 1\n"
    cli.main([str(f), "-o", str(out), "--error-format", "ndjson", "--max-diagnostics", "0"], spark)
    assert capsys.readouterr().out == ""


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    """Half of the files, a stop, new objects on the same folders, the other half: the full closure."""
    schema = "s string, p string, o string"

    def run(n):
        triple_frame(spark, [(u(f"x{n}{k}"), TYPE, u("B")) for k in range(10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        c = Closure.open(spark, str(tmp_path / "closure"), rules=["cax-sco"])
        if not c.parts:
            c.add(triple_frame(spark, [SUB]))
        s = StreamingClosure(c)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        s.start(stream, str(tmp_path / "at"), availableNow=True).awaitTermination()
        return c

    run(0)
    c = run(1)
    assert c.marks == {"batch": 1} and sum(1 for _, p, o in rows(c.output()) if (p, o) == (TYPE, u("A"))) == 20
    again = Closure.open(spark, str(tmp_path / "closure"))
    assert rows(again.output()) == rows(c.output()) and again.counts == c.counts
    again.add(triple_frame(spark, [(u("late"), TYPE, u("B"))]))
    assert (u("late"), TYPE, u("A")) in rows(again.output())


def test_a_session_goes_on_in_its_folder(spark, tmp_path):
    at = str(tmp_path / "session")
    one = Reasoner(spark, folder=at)
    one.load_triples(triple_frame(spark, [SUB, (u("x"), TYPE, u("B")), (u("x"), owl("sameAs"), u("z")), (u("C"), owl("unionOf"), u("l")), (u("l"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>", u("A"))]))
    one.reason()
    one.load_triples(triple_frame(spark, [(u("y"), TYPE, u("B"))]))
    two = Reasoner(spark, folder=at)  # what was loaded and not reasoned over is still to come
    assert (u("z"), TYPE, u("C")) in rows(two.get_triples()) and (u("y"), TYPE, u("A")) not in rows(two.get_triples())
    assert {(u("y"), TYPE, u("A")), (u("y"), TYPE, u("C"))} <= rows(two.reason())
    three = Reasoner(spark, folder=at)
    assert rows(three.get_triples()) == rows(two.get_triples())
    assert three.set_base_triples(triple_frame(spark, [SUB])) is True
    assert (u("y"), TYPE, u("A")) not in rows(Reasoner(spark, folder=at).reason())


def test_equal_terms_that_rules_name(spark):
    """Classes cannot hold them; by default the rules of equality take over, with the same closure."""
    graph = [(u("a"), owl("sameAs"), u("b")), (u("a"), u("p"), u("c")), (rdfs("subClassOf"), owl("sameAs"), TYPE), (u("x"), TYPE, u("B"))]
    by_rules = Closure(spark, equality="rules")
    by_rules.add(triple_frame(spark, graph))
    other = Closure(spark)
    other.add(triple_frame(spark, graph[:2]))
    other.add(triple_frame(spark, graph[2:]))
    assert rows(other.output()) == rows(by_rules.output()) and not other.by_class


def test_stream(spark, tmp_path):
    triple_frame(spark, [(u(f"x{k}"), TYPE, u("B")) for k in range(20)]).repartition(4).write.parquet(str(tmp_path / "in"))
    c = Closure(spark, ["cax-sco"])
    c.add(triple_frame(spark, [SUB]))
    s = StreamingClosure(c)
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s.start(stream, str(tmp_path / "at"), availableNow=True).awaitTermination()
    assert sum(1 for _, p, o in rows(c.output()) if (p, o) == (TYPE, u("A"))) == 20
    before = rows(c.output())
    s._take(triple_frame(spark, [(u("late"), TYPE, u("B"))]), 0)  # a batch delivered again
    assert rows(c.output()) == before
