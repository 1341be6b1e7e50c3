"""Terms as Python objects, and their canonical spelling."""

from __future__ import annotations

import re
from dataclasses import dataclass

from axiomill.functions.datatypes import CANONICAL, LANG_STRING, STRING
from axiomill.sources.ntriples import canonical_literal, unescape

ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*")


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = STRING
    lang: str | None = None


def to_canonical(term: object) -> str:
    """Canonical N-Triples of a term object or string.

    Objects count by the name of their class, so those of other RDF libraries do:
    URIRef and IRI, BNode, Literal; anything else is taken as an IRI by its string.
    """
    kind = type(term).__name__
    if kind == "BNode":
        return f"_:{getattr(term, 'value', term)}"
    if kind == "Literal":
        lang = getattr(term, "language", None) or getattr(term, "lang", None)
        datatype = getattr(term, "datatype", None)
        lex = term.value if isinstance(term, Literal) else str(term)
        return canonical_literal(lex, lang, str(datatype) if datatype and str(datatype) != LANG_STRING else None)
    text = term.value if isinstance(term, IRI) else str(term)
    return text if text.startswith("<") and text.endswith(">") else f"<{text}>"


def from_canonical(term: str) -> IRI | BNode | Literal:
    if term.startswith("<"):
        return IRI(term[1:-1])
    if term.startswith("_:"):
        return BNode(term[2:])
    m = re.match(CANONICAL.replace(r"\A", "").replace(r"\z", r"\Z"), term)
    if not m:
        raise ValueError(f"not a term: {term!r}")
    return Literal(unescape(m[1]), LANG_STRING if m[2] else m[3] or STRING, m[2])


def is_iri(text: str) -> bool:
    return bool(ABSOLUTE.fullmatch(text))
