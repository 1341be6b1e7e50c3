"""Terms in the compact spelling of the tables: IRIs, ``_:x`` and literals in quotes.

All functions are plain column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# a literal in its quotes, then language or datatype; no quote can follow the closing one. The greedy dot runs in a loop
# where an alternation under a star would recurse once a character, and overflow the stack of a long text
QUOTED = r'(?s)\A(".*")(?:@[A-Za-z0-9-]+|\^\^[^\s"]+)?\z'
ESCAPE = r"(?s)\\."


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def same_term(c: Column | str) -> Column:
    """The term without surrounding blanks and angle brackets; null where nothing is left.

    What stands inside the quotes of a literal is never touched: a literal starts
    with a quote, so only blanks outside the quotes are dropped.
    """
    t = F.btrim(_c(c), F.lit(BLANKS))
    bare = F.btrim(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(BLANKS))
    t = F.when(t.startswith("<") & t.endswith(">"), bare).otherwise(t)
    return F.nullif(t, F.lit(""))


def is_literal(t: Column | str) -> Column:
    return _c(t).startswith('"')


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexical(t: Column | str) -> Column:
    """Escaped lexical form of a literal, null for anything else, such as one with a bare quote inside."""
    t = _c(t)

    def inner(q: Column) -> Column:
        lex = F.substring(q, F.lit(2), F.length(q) - 2)
        rest = F.when(lex.contains("\\"), F.regexp_replace(lex, ESCAPE, "")).otherwise(lex)
        return F.when((q != "") & ~rest.contains('"') & ~rest.contains("\\"), lex)

    return F.when(t.startswith('"'), let(F.regexp_extract(t, QUOTED, 1), inner))


def unescaped(lex: Column | str) -> Column:
    """``\\"`` and ``\\\\`` resolved, each escape once, from left to right."""
    return F.regexp_replace(_c(lex), r'\\(["\\])', "$1")
