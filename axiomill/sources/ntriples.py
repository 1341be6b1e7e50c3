"""N-Triples: read line by line inside generated code, write as text."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from axiomill.vocab import XSD

IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
BNODE = r"_:[\p{L}\p{N}_][\p{L}\p{N}_.·-]*"
# a greedy dot up to the last quote: an alternation under a star would recurse once a character
LITERAL = rf'".*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI})?'
LINE = rf"\A\s*({IRI}|{BNODE})\s*({IRI})\s*({IRI}|{BNODE}|{LITERAL})\s*\.\s*(?:#.*)?\z"
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf\"'\\])")
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TripleSyntaxError(ValueError):
    """A line or file that is not what its suffix says."""


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: PLAIN[m[1]] if len(m[1]) == 1 else chr(int(m[1][1:], 16)), text)


def quote(text: str) -> str:
    r"""A lexical form as it stands in a canonical literal: only ``\`` and ``"`` and line ends are escaped."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def canonical_literal(lex: str, lang: str | None = None, datatype: str | None = None) -> str:
    body = f'"{quote(lex)}"'
    if lang:
        return f"{body}@{lang}"
    return f"{body}^^<{datatype}>" if datatype and datatype != f"{XSD}string" else body


def _canonical(term: str | None) -> str | None:
    if term is None or "\\" not in term:
        return term
    if not term.startswith('"'):
        return unescape(term)
    end = term.rindex('"')
    return f'"{quote(unescape(term[1:end]))}"{unescape(term[end + 1 :])}'


@F.pandas_udf(StringType())
def canonical_udf(term: pd.Series) -> pd.Series:
    return term.map(_canonical)


TRIPLE = re.compile(rf'''\s*({IRI}|_:[^\s<"]+)\s*({IRI})\s*({IRI}|_:[^\s<"]*[^\s<".]|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI})?)\s*\.\s*(?:#.*)?''')


@F.pandas_udf(ArrayType(StringType()))
def reparsed_udf(line: pd.Series) -> pd.Series:
    return line.map(lambda x: None if x is None or not (m := TRIPLE.fullmatch(x)) else list(m.groups()))


def file_scope(path: str) -> str:
    """A prefix that keeps the blank nodes of a file apart from others, the same at every load of it."""
    return hashlib.sha256(path.encode()).hexdigest()[:12]


def read_ntriples(spark: SparkSession, path: str, scope: bool = True, strict: bool = True) -> DataFrame:
    """(s, p, o) of the distinct triples of N-Triples files; splittable and without Python where no escape is.

    Blank lines and comments are skipped. In strict mode a line that is no triple fails the
    query with that line; else it is left out. With ``scope`` blank nodes get a prefix of
    their file, so equal labels of two files stay two nodes.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(r"value not rlike '\\A\\s*(#.*)?\\z'")
    got = [F.regexp_extract("value", LINE, k) for k in (1, 2, 3)]
    ok = lines.select("value", "file", *[g.alias(n) for g, n in zip(got, "spo")])
    # a quote inside the literal: it is no triple, or its comment has quotes too, which only a parser can tell
    bare = F.regexp_replace(F.regexp_extract("o", r'\A"(.*)"', 1), r"\\.", "")
    odd = bare.contains('"') | bare.contains("\\")
    part = F.when(odd, reparsed_udf("value"))
    ok = ok.withColumn("again", part).withColumns({n: F.when(odd, F.coalesce(F.col("again")[k], F.lit(""))).otherwise(F.col(n)) for k, n in enumerate("spo")})
    if strict:
        fail = F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.col("value")))
        ok = ok.withColumn("p", F.when(F.col("p") == "", fail).otherwise(F.col("p")))
    ok = ok.where("p <> ''")
    drop = f"^^<{XSD}string>"
    trim = F.when(F.col("o").startswith('"') & F.col("o").endswith(drop), F.expr(f"substring(o, 1, length(o) - {len(drop)})")).otherwise(F.col("o"))
    ok = ok.withColumn("o", trim)
    if scope:
        mark = F.concat(F.lit("_:f"), F.substring(F.sha2("file", 256), 1, 12), F.lit("."))
        for c in "so":
            ok = ok.withColumn(c, F.when(F.col(c).startswith("_:"), F.concat(mark, F.substring(F.col(c), F.lit(3), F.length(c)))).otherwise(F.col(c)))
    escaped = F.col("value").contains("\\")
    plain = ok.where(~escaped).select("s", "p", "o")
    coded = ok.where(escaped).select(*[canonical_udf(c).alias(c) for c in "spo"])
    return plain.unionByName(coded).distinct()


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of N-Triples files, one per task; every one is valid Turtle as well."""
    lines(triples).write.mode(mode).text(path)


def lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
