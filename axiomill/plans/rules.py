"""Rules as data: bodies and heads of triple patterns, compiled to joins when they can fire.

A pattern is three strings, variables beginning with ``?``. The order of a body is
from its axioms, which are few, to its facts. What is said here is the OWL 2 RL
profile (W3C) in the part that the engine covers, with its RDFS rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from axiomill.vocab import MEMBER, NOTHING, SAME, THING, TYPE, owl, rdfs

Pattern = tuple[str, str, str]


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[Pattern, ...]
    head: Pattern
    # rows must also satisfy this: names of two variables that have to differ
    differ: tuple[str, str] | None = None


def _rule(name: str, text: str) -> Rule:
    """``a b c, d e f => g h i``; names are looked up among the terms below."""
    body, head = text.split("=>")
    parse = lambda s: tuple(TERMS.get(w, w) for w in s.split())
    return Rule(name, tuple(parse(b) for b in body.split(",")), parse(head))


TERMS = {
    "type": TYPE, "same": SAME, "Thing": THING, "member": MEMBER,
    "sub": rdfs("subClassOf"), "subp": rdfs("subPropertyOf"), "domain": rdfs("domain"), "range": rdfs("range"),
    "eqc": owl("equivalentClass"), "eqp": owl("equivalentProperty"), "inverse": owl("inverseOf"),
    "Functional": owl("FunctionalProperty"), "InverseFunctional": owl("InverseFunctionalProperty"),
    "Symmetric": owl("SymmetricProperty"), "Transitive": owl("TransitiveProperty"),
    "hasValue": owl("hasValue"), "onProperty": owl("onProperty"), "all": owl("allValuesFrom"), "some": owl("someValuesFrom"),
    "intersection": owl("intersectionOf"), "union": owl("unionOf"),
}

INT1 = "cls-int1"  # a division, not a conjunction: compiled by itself
RULES: tuple[Rule, ...] = (
    _rule("owl-thing", "?s ?p ?o => ?s type Thing"),
    _rule("eq-sym", "?x same ?y => ?y same ?x"),
    _rule("eq-trans", "?x same ?y, ?y same ?z => ?x same ?z"),
    _rule("eq-rep-s", "?s same ?t, ?s ?p ?o => ?t ?p ?o"),
    _rule("eq-rep-p", "?p same ?q, ?s ?p ?o => ?s ?q ?o"),
    _rule("eq-rep-o", "?o same ?t, ?s ?p ?o => ?s ?p ?t"),
    _rule("prp-dom", "?p domain ?c, ?s ?p ?o => ?s type ?c"),
    _rule("prp-rng", "?p range ?c, ?s ?p ?o => ?o type ?c"),
    _rule("prp-fp", "?p type Functional, ?s ?p ?x, ?s ?p ?y => ?x same ?y"),
    _rule("prp-ifp", "?p type InverseFunctional, ?x ?p ?o, ?y ?p ?o => ?x same ?y"),
    _rule("prp-symp", "?p type Symmetric, ?s ?p ?o => ?o ?p ?s"),
    _rule("prp-trp", "?p type Transitive, ?x ?p ?y, ?y ?p ?z => ?x ?p ?z"),
    _rule("prp-spo1", "?p subp ?q, ?s ?p ?o => ?s ?q ?o"),
    _rule("prp-eqp1", "?p eqp ?q, ?s ?p ?o => ?s ?q ?o"),
    _rule("prp-eqp2", "?q eqp ?p, ?s ?p ?o => ?s ?q ?o"),
    _rule("prp-inv1", "?p inverse ?q, ?s ?p ?o => ?o ?q ?s"),
    _rule("prp-inv2", "?q inverse ?p, ?s ?p ?o => ?o ?q ?s"),
    _rule("cls-int2", "?c intersection ?l, ?l member ?m, ?x type ?c => ?x type ?m"),
    _rule("cls-uni", "?c union ?l, ?l member ?m, ?x type ?m => ?x type ?c"),
    _rule("cls-hv1", "?r hasValue ?v, ?r onProperty ?p, ?u type ?r => ?u ?p ?v"),
    _rule("cls-hv2", "?r hasValue ?v, ?r onProperty ?p, ?u ?p ?v => ?u type ?r"),
    _rule("cls-avf", "?r all ?c, ?r onProperty ?p, ?u type ?r, ?u ?p ?v => ?v type ?c"),
    _rule("cls-svf1", "?r some ?c, ?r onProperty ?p, ?u ?p ?v, ?v type ?c => ?u type ?r"),
    _rule("cls-svf2", "?r some Thing, ?r onProperty ?p, ?u ?p ?v => ?u type ?r"),
    _rule("cax-sco", "?c sub ?d, ?x type ?c => ?x type ?d"),
    _rule("cax-eqc1", "?c eqc ?d, ?x type ?c => ?x type ?d"),
    _rule("cax-eqc2", "?d eqc ?c, ?x type ?c => ?x type ?d"),
    _rule("rdfs11", "?a sub ?b, ?b sub ?c => ?a sub ?c"),
    _rule("scm-eqc1", "?a eqc ?b => ?a sub ?b"),
    _rule("scm-eqc2", "?a eqc ?b => ?b sub ?a"),
)
EQUALITY = frozenset({"eq-sym", "eq-trans", "eq-rep-s", "eq-rep-p", "eq-rep-o"})
# the inverse-functional rule as deployed engines of this profile have it: any two subjects of the property
IFP_COMPAT = _rule("prp-ifp", "?p type InverseFunctional, ?x ?p ?o, ?y ?p ?z => ?x same ?y")
ALL = frozenset(r.name for r in RULES) | {INT1, "rdfs12", "cls-thing", "cls-nothing1"}
# predicates and classes whose rows are counted each round, to know which rules can fire and what may be broadcast
AXIOM_PREDICATES = tuple(v for k, v in TERMS.items() if k in {"sub", "subp", "domain", "range", "eqc", "eqp", "inverse", "hasValue", "onProperty", "all", "some", "intersection", "union", "same"})
AXIOM_CLASSES = tuple(TERMS[k] for k in ("Functional", "InverseFunctional", "Symmetric", "Transitive"))
CLASH_PREDICATES = (owl("disjointWith"), owl("propertyDisjointWith"), owl("complementOf"))
CLASH_CLASSES = (owl("IrreflexiveProperty"), owl("AsymmetricProperty"), NOTHING)
