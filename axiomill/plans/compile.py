"""Compile rule bodies to joins over a closure and its newest part.

For every pattern of a body one variant of the rule is built in which that pattern
reads the newest triples and the others read all of them (semi-naive evaluation).
A variant is built only if each of its axiom patterns has rows, by the counts taken
each round, so a graph that uses five constructs plans five rules, not thirty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.plans.rules import AXIOM_CLASSES, AXIOM_PREDICATES, CLASH_CLASSES, CLASH_PREDICATES, Pattern, Rule
from axiomill.vocab import FIRST, MEMBER, REST, TYPE

BROADCAST_ROWS = 100_000  # an axiom table is sent to all tasks up to this many rows, by exact count


@dataclass
class Counts:
    """Exact row counts of axiom patterns: by predicate, and by class for types."""

    by: dict[tuple[str, str | None], int] = field(default_factory=dict)
    total: int = 0

    def of(self, p: Pattern) -> int | None:
        """Rows of a pattern, None where it isn't counted."""
        if p[1].startswith("?"):
            return None
        if p[1] == TYPE:
            return self.by.get((TYPE, p[2]), 0) if not p[2].startswith("?") and p[2] in (*AXIOM_CLASSES, *CLASH_CLASSES) else None
        return self.by.get((p[1], None), 0) if p[1] in COUNTED else None

    def add(self, other: Counts) -> Counts:
        keys = self.by.keys() | other.by.keys()
        return Counts({k: self.by.get(k, 0) + other.by.get(k, 0) for k in keys}, self.total + other.total)


COUNTED = frozenset({*AXIOM_PREDICATES, *CLASH_PREDICATES, MEMBER, FIRST, REST})


def count_axioms(t: DataFrame) -> Counts:
    """One pass over the triples, pre-aggregated; the result has one row per construct of the vocabulary."""
    kind = F.when(F.col("p") == TYPE, F.when(F.col("o").isin(*AXIOM_CLASSES, *CLASH_CLASSES), F.col("o")).otherwise(F.lit(""))).otherwise(F.lit(""))
    pred = F.when(F.col("p").isin(*COUNTED) | (F.col("p") == TYPE), F.col("p")).otherwise(F.lit(""))
    rows = t.groupBy(pred.alias("p"), kind.alias("k")).count().collect()
    out = Counts(total=sum(r["count"] for r in rows))
    for r in rows:
        if r["p"] == TYPE:
            if r["k"]:
                out.by[TYPE, r["k"]] = r["count"]
        elif r["p"]:
            out.by[r["p"], None] = r["count"]
    return out


Source = Callable[[Pattern], DataFrame]


def scan(t: DataFrame, p: Pattern) -> DataFrame:
    """The bindings of one pattern: constants become filters, repeated variables equalities."""
    cond: Column | None = None
    seen: dict[str, str] = {}
    for col, term in zip("spo", p):
        if not term.startswith("?"):
            c = F.col(col) == F.lit(term)
        elif term in seen:
            c = F.col(col) == F.col(seen[term])
        else:
            seen[term] = col
            continue
        cond = c if cond is None else cond & c
    t = t.where(cond) if cond is not None else t
    return t.select(*[F.col(col).alias(v[1:]) for v, col in seen.items()])


def join_body(body: list[tuple[Pattern, DataFrame, int | None]]) -> DataFrame:
    """Natural join of the patterns' bindings, axioms broadcast where their count allows it.

    Facts are joined by size of what they bind: from the pattern after which every
    next one shares a variable. The order only shapes the plan, not the result.
    """
    todo = list(body)
    first = min(range(len(todo)), key=lambda i: (todo[i][2] is None, i))
    p, t, n = todo.pop(first)
    out, bound, small = scan(t, p), {v for v in p if v.startswith("?")}, n is not None and n <= BROADCAST_ROWS
    while todo:
        i = next(i for i, (q, _, _) in enumerate(todo) if bound & set(q))
        q, t, n = todo.pop(i)
        right = scan(t, q)
        on = sorted(v[1:] for v in bound & set(q))
        if n is not None and n <= BROADCAST_ROWS:
            out = out.join(F.broadcast(right), on)
        elif small:
            out = right.join(F.broadcast(out), on)
            small = False
        else:
            out = out.join(right, on)
        bound |= {v for v in q if v.startswith("?")}
    return out


def project(df: DataFrame, head: Pattern) -> DataFrame:
    return df.select(*[(F.col(v[1:]) if v.startswith("?") else F.lit(v)).alias(c) for c, v in zip("spo", head)])


@dataclass(frozen=True)
class Relations:
    """What rules read in a round: all triples and the newest, the same of list members, and their counts."""

    all_: DataFrame
    new: DataFrame
    members: DataFrame
    new_members: DataFrame
    c_all: Counts
    c_new: Counts

    @property
    def everything(self) -> bool:
        """In the first round all is new: one variant of a rule says it all."""
        return self.all_ is self.new

    def read(self, body: tuple[Pattern, ...], newest: int | None) -> list[tuple[Pattern, DataFrame, int | None]] | None:
        """The body's patterns with what they read, pattern ``newest`` the newest; None if one has no rows."""
        out = []
        for i, p in enumerate(body):
            fresh = i == newest and not self.everything
            n = (self.c_new if fresh else self.c_all).of(p)
            if n == 0:
                return None
            t = (self.new_members if fresh else self.members) if p[1] == MEMBER else (self.new if fresh else self.all_)
            out.append((p, t, n))
        return out


def variants(rule: Rule, r: Relations) -> list[DataFrame]:
    """The plans of a rule that can give something new."""
    bodies = [r.read(rule.body, k) for k in range(1 if r.everything else len(rule.body))]
    return [project(join_body(b), rule.head) for b in bodies if b]


# --- rules of one fact ------------------------------------------------------------
#
# Many rules read a single fact, by its predicate or by the class of a type, and axioms
# that say what follows from it. The axioms of all of them make one small table, and
# one scan of the facts joined to it serves all these rules.

FORWARD, BACKWARD, SUBJECT, OBJECT, CLASS_OF = "forward", "backward", "subject", "object", "class"


def shape_of(rule: Rule) -> tuple[str, str, str] | None:
    """(shape, variable that meets the fact, variable that follows from it), None if the rule is of another kind."""
    *axioms, (s, p, o) = rule.body
    bound = {v for a in axioms for v in a if v.startswith("?")}
    if not axioms or s in bound or not s.startswith("?") or not o.startswith("?"):
        return None
    hs, hp, ho = rule.head
    if p == TYPE:
        return (CLASS_OF, o, ho) if o in bound and (hs, hp) == (s, TYPE) and ho in bound else None
    if p not in bound or o in bound or s == o:
        return None
    if (hs, ho) == (s, o) and hp in bound:
        return FORWARD, p, hp
    if (hs, ho) == (o, s) and hp in bound:
        return BACKWARD, p, hp
    if hp == TYPE and ho in bound and hs in (s, o):
        return SUBJECT if hs == s else OBJECT, p, ho
    return None


def axiom_rows(rules: list[Rule], r: Relations, newest: bool) -> DataFrame | None:
    """(shape, k, q): what follows from a fact that meets k, from all axioms or from those with something new."""
    out = []
    for rule in rules:
        shape, k, q = shape_of(rule)
        axioms = rule.body[:-1]
        bodies = [r.read(axioms, i) for i in range(len(axioms))] if newest and not r.everything else [r.read(axioms, None)]
        out += [join_body(b).select(F.lit(shape).alias("shape"), F.col(k[1:]).alias("k"), F.col(q[1:]).alias("q")) for b in bodies if b]
    if not out:
        return None
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.distinct()


def follow(facts: DataFrame, axioms: DataFrame, few_p: bool, few_c: bool) -> list[DataFrame]:
    """What the axioms say of the facts: one scan by predicate, one of the types by class; axioms of either kind are broadcast where they are few."""
    send = lambda df, few: F.broadcast(df) if few else df
    by_p, by_c = axioms.where(F.col("shape") != CLASS_OF), axioms.where(F.col("shape") == CLASS_OF)
    j = facts.join(send(by_p, few_p), F.col("p") == F.col("k"))
    shape = F.col("shape")
    said = j.select(
        F.when(shape.isin(BACKWARD, OBJECT), F.col("o")).otherwise(F.col("s")).alias("s"),
        F.when(shape.isin(FORWARD, BACKWARD), F.col("q")).otherwise(F.lit(TYPE)).alias("p"),
        F.when(shape == FORWARD, F.col("o")).when(shape == BACKWARD, F.col("s")).otherwise(F.col("q")).alias("o"),
    )
    types = facts.where(F.col("p") == TYPE).join(send(by_c, few_c), F.col("o") == F.col("k"))
    return [said, types.select("s", F.lit(TYPE).alias("p"), F.col("q").alias("o"))]
