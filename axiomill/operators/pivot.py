"""Problem 3: attribute-value rows to one wide row per entity with typed columns.

The grid of entities and wanted attributes is completed by exploding a constant
list of positions on each entity (never a cross join), values are joined to it
from the left, each entity's cells are collected into an array sorted by the
attribute's position, and every column takes one fixed index of the array through
a try cast of its type. The array has exactly as many cells as there are columns,
however many rows an entity has, because the deciding value of each cell is
chosen by a pre-aggregated maximum before anything is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.functions.terms import unescaped


@dataclass(frozen=True)
class Attribute:
    predicate: str
    name: str
    cast: Callable[[Column], Column]


def as_text(lex: Column) -> Column:
    return unescaped(lex)


def as_integer(lex: Column) -> Column:
    # the pattern first: a cast alone would also take blanks
    return F.when(lex.rlike(r"\A[+-]?[0-9]+\z"), lex.try_cast("bigint"))


def as_thousandths(lex: Column) -> Column:
    """Decimal or exponent notation in thousandths, rounded half up; null outside bigint."""
    number = lex.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?\z")
    mantissa = F.regexp_extract(lex, r"\A([^eE]*)", 1).try_cast("decimal(38,12)")
    power = F.coalesce(F.nullif(F.regexp_extract(lex, r"[eE](.*)\z", 1), F.lit("")).try_cast("int"), F.lit(0))
    # powers of ten as exact decimals; a shift of more than 18 digits leaves bigint or vanishes
    shift = power + 3
    up = F.try_multiply(mantissa, F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(shift, F.lit(0)))).try_cast("decimal(19,0)"))
    down = (mantissa / F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(-shift, F.lit(0)))).try_cast("decimal(19,0)"))
    exact = F.when(shift >= 0, F.round(up, 0).try_cast("bigint")).when(shift < -18, F.lit(0).cast("bigint")).otherwise(F.round(down, 0).try_cast("bigint"))
    return F.when(number & (mantissa == 0), F.lit(0).cast("bigint")).when(number, exact)


def as_flag(lex: Column) -> Column:
    return F.when(lex.isin("true", "1"), F.lit(1)).when(lex.isin("false", "0"), F.lit(0)).cast("bigint")


def as_date(lex: Column) -> Column:
    shape = lex.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z)?\z")
    day = F.substring(lex, 1, 10)
    return F.when(shape & day.try_cast("date").isNotNull() & ~day.startswith("0000"), day)


def widen(rows: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(s, one column per attribute, n_attrs) from rows (s, p, lex, at).

    ``lex`` is the escaped lexical form. The latest ``at`` decides a cell; among
    equal times the value that is greatest in byte order does, and a null time is
    older than any. A row with a null s, p or lex is absent. A value that doesn't fit
    its column gives null there and still counts in n_attrs. An entity with none of
    the wanted attributes keeps its row. Repeated rows change nothing.
    """
    rows = rows.select("s", "p", "lex", "at").where("s is not null and p is not null and lex is not null")
    place = F.create_map(*[F.lit(x) for i, a in enumerate(attributes) for x in (a.predicate, i)])
    decided = rows.groupBy("s", "p").agg(F.max(F.struct("at", "lex")).alias("v"))
    # one row per (s, p): the count of attributes and the entities of the grid come from the same table
    spread = F.transform(F.array(*[F.lit(i) for i in range(len(attributes))]), lambda i: F.struct(i.alias("pos")))
    grid = decided.groupBy("s").agg(F.count("*").alias("n_attrs")).select("s", "n_attrs", F.inline(spread))
    values = decided.where(F.col("p").isin([a.predicate for a in attributes])).select(F.col("s").alias("vs"), F.element_at(place, F.col("p")).alias("vpos"), F.col("v.lex").alias("lex"))
    full = grid.join(values, (grid.s == values.vs) & (grid.pos == values.vpos), "left")
    cells = full.groupBy("s").agg(F.max("n_attrs").alias("n_attrs"), F.sort_array(F.collect_list(F.struct("pos", "lex"))).alias("cells"))
    cell = lambda i: F.col("cells")[i]["lex"]
    return cells.select("s", *[a.cast(cell(i)).alias(a.name) for i, a in enumerate(attributes)], F.col("n_attrs").cast("bigint").alias("n_attrs"))
