"""Turtle: a recursive-descent reader of whole files, one file a row of a distributed scan."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.sources.ntriples import TripleSyntaxError, canonical_literal, file_scope, unescape
from axiomill.vocab import FIRST, NIL, REST, TYPE, XSD

TOKEN = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n\r]*)+)
    |(?P<star><<)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<bnode>_:[^\W](?:[\w.·-]*[\w·-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
LOCAL_ESCAPE = re.compile(r"\\(.)")


class TurtleReader:
    """Triples of one text, as canonical terms."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.text, self.base, self.scope = text, base, scope
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple[str, str, str]] = []
        self.made = 0
        self.tokens = self._scan()
        self.kind, self.value = next(self.tokens)

    def _scan(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = TOKEN.match(self.text, at)
            if not m:
                raise self._error(f"unexpected {self.text[at : at + 20]!r}", at)
            at = m.end()
            if m.lastgroup == "star":
                raise TripleSyntaxError("quoted triples are not supported")
            if m.lastgroup != "space":
                self.at = m.start()
                yield m.lastgroup, m[0]
        self.at = at
        while True:
            yield "end", ""

    def _error(self, what: str, at: int | None = None) -> TripleSyntaxError:
        line = self.text.count("\n", 0, self.at if at is None else at) + 1
        return TripleSyntaxError(f"line {line}: {what}")

    def _step(self) -> str:
        value = self.value
        self.kind, self.value = next(self.tokens)
        return value

    def _mark(self, mark: str) -> None:
        if self.kind != "mark" or self.value != mark:
            raise self._error(f"expected {mark!r}, found {self.value!r}")
        self._step()

    def read(self) -> list[tuple[str, str, str]]:
        while self.kind != "end":
            word = self.value.lower() if self.kind == "word" else ""
            if self.kind == "directive" or word in ("prefix", "base"):
                self._directive(word)
            else:
                self._statement()
        return self.out

    def _directive(self, word: str) -> None:
        at_form = self.kind == "directive"
        what = self._step().lstrip("@").lower()
        if what == "prefix":
            name = self._step()
            if not name.endswith(":"):
                raise self._error(f"bad prefix {name!r}")
            self.prefixes[name[:-1]] = self._iri(self._step())[1:-1]
        else:
            self.base = self._iri(self._step())[1:-1]
        if at_form:
            self._mark(".")

    def _statement(self) -> None:
        if self.kind == "mark" and self.value == "[":
            subject, alone = self._nested(), True
            if self.kind == "mark" and self.value == ".":
                self._step()
                return
        else:
            subject, alone = self._term(subject=True), False
        del alone
        self._pairs(subject)
        self._mark(".")

    def _pairs(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self._step()
                verb = TYPE
            else:
                verb = self._term(verb=True)
            while True:
                self.out.append((subject, verb, self._term()))
                if self.kind == "mark" and self.value == ",":
                    self._step()
                    continue
                break
            more = False
            while self.kind == "mark" and self.value == ";":
                self._step()
                more = True
            if not more or (self.kind == "mark" and self.value in ".]") or self.kind == "end":
                return

    def _fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def _nested(self) -> str:
        self._mark("[")
        node = self._fresh()
        if not (self.kind == "mark" and self.value == "]"):
            self._pairs(node)
        self._mark("]")
        return node

    def _list(self) -> str:
        self._mark("(")
        items = []
        while not (self.kind == "mark" and self.value == ")"):
            if self.kind == "end":
                raise self._error("list left open")
            items.append(self._term())
        self._mark(")")
        head = NIL
        for item in reversed(items):
            node = self._fresh()
            self.out += [(node, FIRST, item), (node, REST, head)]
            head = node
        return head

    def _iri(self, token: str) -> str:
        if not token.startswith("<"):
            raise self._error(f"expected an IRI, found {token!r}")
        iri = unescape(token[1:-1])
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            if not self.base:
                raise self._error(f"relative IRI {iri!r} without a base")
            iri = urljoin(self.base, iri) if iri else self.base
        return f"<{iri}>"

    def _term(self, subject: bool = False, verb: bool = False) -> str:
        kind = self.kind
        if kind == "iri":
            return self._iri(self._step())
        if kind == "name":
            prefix, local = self._step().split(":", 1)
            if prefix not in self.prefixes:
                raise self._error(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{LOCAL_ESCAPE.sub(lambda m: m[1], local)}>"
        if verb:
            raise self._error(f"{self.value!r} is no predicate")
        if kind == "bnode":
            return f"_:{self.scope}{self._step()[2:]}"
        if kind == "mark" and self.value == "[":
            return self._nested()
        if kind == "mark" and self.value == "(":
            return self._list()
        if subject:
            raise self._error(f"{self.value!r} is no subject")
        if kind in ("long", "short"):
            token = self._step()
            cut = 3 if kind == "long" else 1
            lex = unescape(token[cut:-cut])
            if self.kind == "lang":
                return canonical_literal(lex, lang=self._step()[1:])
            if self.kind == "type":
                self._step()
                return canonical_literal(lex, datatype=self._term(verb=True)[1:-1])
            return canonical_literal(lex)
        if kind == "number":
            token = self._step()
            name = "double" if "e" in token.lower() else "decimal" if "." in token else "integer"
            return canonical_literal(token, datatype=XSD + name)
        if kind == "word" and self.value in ("true", "false"):
            return canonical_literal(self._step(), datatype=XSD + "boolean")
        raise self._error(f"unexpected {self.value!r}" if kind != "end" else "unexpected end")


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[tuple[str, str, str]]:
    return TurtleReader(text, base, scope).read()


def _parse(scope: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, path in zip(b["value"], b["file"]):
                yield pd.DataFrame(parse_turtle(text, path, f"f{file_scope(path)}." if scope else ""), columns=["s", "p", "o"])

    return run


def read_turtle(spark: SparkSession, path: str, scope: bool = True) -> DataFrame:
    """(s, p, o) of the distinct triples of Turtle files: files are parsed side by side, each as a whole."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.mapInPandas(_parse(scope), "s string, p string, o string").distinct()
