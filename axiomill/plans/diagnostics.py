"""Integrity rules over a closure: rows that report, and add no triples.

The rules are monotone, so one pass after the fixpoint finds what checks within it
would have found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.functions.datatypes import XML_LITERAL, in_space, literal_parts, well_formed_but_xml, xml_valid
from axiomill.plans.compile import BROADCAST_ROWS, Counts, count_axioms, join_body
from axiomill.vocab import NOTHING, TYPE, owl, rdfs

SCHEMA = "code string, rule string, severity string, message string, s string, p string, o string, extra string"
# fixed values: users match on these codes and on the messages below
CODES = {
    "cax-dw": "OWLRL.CAX_DW",
    "prp-pdw": "OWLRL.PRP_PDW",
    "cls-nothing2": "OWLRL.CLS_NOTHING",
    "prp-asyp": "OWLRL.PRP_ASYP",
    "prp-irp": "OWLRL.PRP_IRP",
    "cls-com": "OWLRL.CLS_COM",
    "rdfs-datatype": "RDFS.DATATYPE",
    "rdfs-datatype-range": "RDFS.DATATYPE_RANGE",
}


def _says(template: str) -> Column:
    """``{x}`` in a message stands for the binding of ?x."""
    parts = template.replace("}", "{").split("{")
    return F.concat(*[F.col(t) if k % 2 else F.lit(t) for k, t in enumerate(parts) if t])


# rule: body, message, and what its columns s, p, o, extra are
CLASHES = {
    "prp-irp": ([("?p", TYPE, owl("IrreflexiveProperty")), ("?x", "?p", "?x")], "property {p} of {x} is irreflexive", ("x", "p", "x", None)),
    "prp-asyp": ([("?p", TYPE, owl("AsymmetricProperty")), ("?x", "?p", "?y"), ("?y", "?p", "?x")], "property {p} of {x} and {y} is asymmetric", ("x", "p", "y", None)),
    "prp-pdw": ([("?p", owl("propertyDisjointWith"), "?q"), ("?x", "?p", "?y"), ("?x", "?q", "?y")], "property {p} is disjoint with {q} for pair ({x} {p} {y})", ("x", "p", "y", "q")),
    "cax-dw": ([("?c", owl("disjointWith"), "?d"), ("?x", TYPE, "?c"), ("?x", TYPE, "?d")], "inst {x} is both {c} and {d} (disjoint classes)", ("x", None, "c", "d")),
    "cls-com": ([("?c", owl("complementOf"), "?d"), ("?x", TYPE, "?c"), ("?x", TYPE, "?d")], "inst {x} is both {c} and {d} (complementary classes)", ("x", None, "c", "d")),
    "cls-nothing2": ([("?x", TYPE, NOTHING)], "instance {x} is owl:Nothing (unsatisfiable)", ("x", None, None, None)),
}


def _row(df: DataFrame, rule: str, message: Column, cols: tuple) -> DataFrame:
    pick = [(F.col(c) if c else F.lit(None).cast("string")).alias(n) for c, n in zip(cols, ("s", "p", "o", "extra"))]
    return df.select(F.lit(CODES[rule]).alias("code"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), message.alias("message"), *pick)


def _datatypes(t: DataFrame) -> DataFrame:
    """Ill-formed literals; only XML literals go through Python."""
    lits = t.where(F.col("o").startswith('"'))
    lex, _, dt = literal_parts(F.col("o"))
    lits = lits.select("s", "p", "o", lex.alias("lex"), dt.alias("dt"))
    bad = lits.where(well_formed_but_xml(F.col("lex"), F.col("dt")) == F.lit(False)).unionByName(lits.where(F.col("dt") == XML_LITERAL).where(~xml_valid("lex")))
    return _row(bad, "rdfs-datatype", _says("ill-formed literal {o} used in triple {s} {p} {o}"), ("s", "p", "o", None))


def _ranges(t: DataFrame, mode: str, few: bool) -> DataFrame:
    ranges = t.where((F.col("p") == rdfs("range")) & F.col("o").startswith("<")).select(F.col("s").alias("p"), F.expr("substring(o, 2, length(o) - 2)").alias("r")).distinct()
    _, _, dt = literal_parts(F.col("o"))
    j = t.join(F.broadcast(ranges) if few else ranges, "p")
    ok = in_space(F.col("o"), dt, F.col("r"))
    if mode == "compat":  # there, any object that is no literal lies outside any range
        ok = F.when(~F.col("o").startswith('"'), F.lit(False)).otherwise(ok)
    bad = j.where(ok == F.lit(False))
    return _row(bad, "rdfs-datatype-range", _says("range clash: object {o} is not in datatype {r} for predicate {p}"), ("s", "p", "o", "r"))


def diagnostics(t: DataFrame, rules=None, mode: str = "spec", counts: Counts | None = None, dedupe: bool = True) -> DataFrame:
    """SCHEMA rows of a closure (s, p, o), once per code and message, or with ``dedupe=False`` once per finding.

    Mode ``compat`` reports what engines of this profile do: nothing for cls-com, and a
    range clash for every IRI or blank node under a range.
    """
    counts = counts or count_axioms(t)
    out = []
    for rule, (body, message, cols) in CLASHES.items():
        if (rules is not None and rule not in rules) or (mode == "compat" and rule == "cls-com"):
            continue
        parts = [(p, t, counts.of(p)) for p in body]
        if any(n == 0 for _, _, n in parts):
            continue
        out.append(_row(join_body(parts), rule, _says(message), cols))
    if rules is None or "rdfs-datatype" in rules:
        out.append(_datatypes(t))
    if (rules is None or "rdfs-datatype-range" in rules) and counts.by.get((rdfs("range"), None)):
        out.append(_ranges(t, mode, counts.by[rdfs("range"), None] <= BROADCAST_ROWS))
    if not out:
        return t.sparkSession.createDataFrame([], SCHEMA)
    all_ = out[0]
    for d in out[1:]:
        all_ = all_.unionByName(d)
    if not dedupe:
        return all_
    firsts = [F.min(F.struct("s", "p", "o", "extra")).alias("x")]
    return all_.groupBy("code", "rule", "severity", "message").agg(*firsts).select("code", "rule", "severity", "message", "x.*")
