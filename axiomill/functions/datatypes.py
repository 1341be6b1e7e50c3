"""Lexical and value-space checks of the recognised datatypes, three-valued: null is unknown."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from axiomill.sources.ntriples import unescape
from axiomill.vocab import RDF, XSD

LANG_STRING, XML_LITERAL = f"{RDF}langString", f"{RDF}XMLLiteral"
STRING, INTEGER, INT = f"{XSD}string", f"{XSD}integer", f"{XSD}int"
# canonical N-Triples literal: lexical form, language, datatype
CANONICAL = r'(?s)\A"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>"]*)>)?\z'


def literal_parts(term: Column) -> tuple[Column, Column, Column]:
    """(escaped lexical form, language, datatype) of a canonical literal, nulls for any other term."""
    is_lit = term.startswith('"')
    lex, lang, dt = (F.when(is_lit, F.regexp_extract(term, CANONICAL, k)) for k in (1, 2, 3))
    datatype = F.when(lang != "", F.lit(LANG_STRING)).when(dt != "", dt).when(is_lit, F.lit(STRING))
    return lex, F.nullif(lang, F.lit("")), datatype


def integer_valid(lex: Column) -> Column:
    return lex.rlike(r"\A[+-]?[0-9]+\z")


def int_valid(lex: Column) -> Column:
    return F.when(integer_valid(lex), lex.try_cast("decimal(38,0)").between(-(2**31), 2**31 - 1) & lex.try_cast("decimal(38,0)").isNotNull()).otherwise(F.lit(False))


def xml_is_well_formed(text: str) -> bool:
    """Whether a text could stand between two tags; plain text could."""
    parser = expat.ParserCreate()
    try:
        parser.Parse(f"<r>{text}</r>", True)
    except expat.ExpatError:
        return False
    return True


@F.pandas_udf(BooleanType())
def xml_valid(lex: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else xml_is_well_formed(unescape(x)) for x in lex], dtype=object)


def well_formed_but_xml(lex: Column, datatype: Column) -> Column:
    """Whether a literal is well-formed for its datatype; null for XML literals and unknown datatypes."""
    return F.when(datatype == INTEGER, integer_valid(lex)).when(datatype == INT, int_valid(lex)).when(datatype.isin(STRING, LANG_STRING), F.lit(True))


def in_space(term: Column, datatype: Column, target: Column) -> Column:
    """Whether a term lies in the value space of one of the recognised datatypes.

    ``xsd:int`` is within ``xsd:integer``; a language string is no ``xsd:string``; an IRI
    or blank node lies in none of them. Null where ``target`` or the literal's datatype
    is not recognised.
    """
    lex = literal_parts(term)[0]
    known = target.isin(STRING, INTEGER, INT, LANG_STRING, XML_LITERAL)
    number = datatype.isin(INTEGER, INT)
    lit = (
        F.when(target == INTEGER, number)
        .when(target == INT, F.when(number, int_valid(lex)).otherwise(F.lit(False)))
        .otherwise(datatype == target)
    )
    return F.when(~known, F.lit(None).cast("boolean")).when(~term.startswith('"'), F.lit(False)).otherwise(lit)


def container_property(iri: Column) -> Column:
    """Whether a bare IRI is ``rdf:_n`` with n from 1 to 2^64 - 1."""
    n = F.regexp_extract(iri, r"\A" + RDF.replace(".", r"\.") + r"_([0-9]+)\z", 1)
    return F.coalesce((n != "") & n.try_cast("decimal(20,0)").between(F.lit(1), F.lit(str(2**64 - 1)).cast("decimal(20,0)")), F.lit(False))
