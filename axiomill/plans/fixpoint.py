"""Least fixpoint of the rules: a driver loop around one Spark job a round."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators.bitset import bits_of, may_be_in
from axiomill.operators.components import components
from axiomill.plans.compile import BROADCAST_ROWS, CLASS_OF, Counts, Relations, axiom_rows, count_axioms, follow, shape_of, variants
from axiomill.plans.lists import list_members
from axiomill.plans.rules import AXIOM_CLASSES, AXIOM_PREDICATES, CLASH_CLASSES, CLASH_PREDICATES, EQUALITY, IFP_COMPAT, INT1, RULES
from axiomill.vocab import FIRST, MEMBER, NIL, RDF, REST, SAME, SEEDS, THING, TYPE, owl, rdf, rdfs
from axiomill.workspace import Workspace, list_names, read_text, write_text

TRIPLE = "s string, p string, o string"
INTERSECTION, UNION = owl("intersectionOf"), owl("unionOf")
FILTER_ROWS = 2_000_000  # a closure beyond this is filtered before it is joined with what was found
# terms that rules name; one of them always stands for its class of equal terms
NAMED = (*AXIOM_PREDICATES, *CLASH_PREDICATES, *AXIOM_CLASSES, *CLASH_CLASSES, TYPE, THING, FIRST, REST, NIL)


def triple_frame(spark, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), TRIPLE)


def container_axioms(t: DataFrame) -> DataFrame:
    """rdfs12: what every used container property ``rdf:_1``, ``rdf:_2``, … is."""
    number = F.regexp_extract("p", r"\A<" + RDF.replace(".", r"\.") + r"_([0-9]+)>\z", 1)
    used = t.select("p", number.alias("n")).where("n <> ''").where(F.col("n").try_cast("decimal(20,0)").between(F.lit(1), F.lit(str(2**64 - 1)).cast("decimal(20,0)"))).select("p").distinct()
    says = [(TYPE, rdf("Property")), (TYPE, rdfs("ContainerMembershipProperty")), (rdfs("subPropertyOf"), rdfs("member"))]
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in says])
    return used.select(F.col("p").alias("s"), F.inline(pairs))


def division(all_: DataFrame, new: DataFrame, members: DataFrame, lists_changed: bool, c_all: Counts) -> DataFrame | None:
    """cls-int1: an instance of every member of a list is an instance of its intersection.

    Only instances with a new type are looked at, unless a list or an axiom is new.
    """
    n = c_all.by.get((INTERSECTION, None), 0)
    if not n or not c_all.by.get((MEMBER, None), 0):
        return None
    heads = all_.where(F.col("p") == INTERSECTION).select(F.col("s").alias("c"), F.col("o").alias("l"))
    need = members.select(F.col("s").alias("l"), F.col("o").alias("m")).join(heads, "l").select("c", "l", "m").distinct()
    size = need.groupBy("c", "l").agg(F.count("*").alias("size"))
    types = all_.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("m"))
    if not lists_changed:
        touched = new.where(F.col("p") == TYPE).select(F.col("s").alias("x")).distinct()
        types = types.join(touched, "x", "left_semi")
    small = c_all.by[MEMBER, None] <= BROADCAST_ROWS
    has = types.join(F.broadcast(need) if small else need, "m")
    full = has.groupBy("x", "c", "l").agg(F.count_distinct("m").alias("have")).join(F.broadcast(size) if small else size, ["c", "l"]).where("have = size")
    return full.select(F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))


FUNCTIONAL = {"prp-fp": (owl("FunctionalProperty"), "s", "o"), "prp-ifp": (owl("InverseFunctionalProperty"), "o", "s")}


def functional_links(rule: str, rel: Relations, mode: str) -> DataFrame | None:
    """prp-fp and prp-ifp where classes hold equality: each value is linked to the least of its group.

    That is one row a value, where the rule gives a row for every two; the class is the
    same. Only groups with something new are looked at, unless a property is.
    """
    kind, key, value = FUNCTIONAL[rule]
    n = rel.c_all.by.get((TYPE, kind), 0)
    if not n:
        return None
    props = lambda t: t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("prop")).distinct()
    send = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    keys = ["p"] if mode == "compat" and rule == "prp-ifp" else ["p", key]
    facts = rel.all_.join(send(props(rel.all_)), F.col("p") == F.col("prop"), "left_semi")
    if not rel.everything:
        touched = rel.new.select(*keys).distinct()
        if rel.c_new.by.get((TYPE, kind)):
            touched = touched.unionByName(facts.join(send(props(rel.new)), F.col("p") == F.col("prop"), "left_semi").select(*keys)).distinct()
        facts = facts.join(touched, keys, "left_semi")
    least = facts.groupBy(*keys).agg(F.min(value).alias("least"))
    return facts.join(least, keys).select(F.col("least").alias("s"), F.lit(SAME).alias("p"), F.col(value).alias("o"))


class Closure:
    """The closure of what was added so far, as a table that grows by the triples of each round.

    ``equality`` says how equal terms are held. ``rules`` applies the eq- rules like any
    other, so a class of n equal terms has n x n pairs and n copies of its facts.
    ``classes`` keeps one term for each class, found by connected components, rewrites
    the triples to those terms whenever classes merge, and spells the copies out only
    in ``output``; ``compact`` gives the triples and classes without the copies. By default
    ``classes`` is taken where all eq- rules run, and given up for ``rules`` if two terms that
    the rules name turn out to be the same, which only those can hold.

    With a workspace that stays, ``commit`` writes down where the closure stands, and
    ``Closure.open`` goes on from there in another session.
    """

    def __init__(self, spark, rules: Iterable[str] | None = None, mode: str = "spec", ws: Workspace | None = None, max_rounds: int = 10_000, equality: str | None = None, filter_rows: int = FILTER_ROWS):
        self.filter_rows = filter_rows
        self.spark, self.mode, self.max_rounds = spark, mode, max_rounds
        self.ws = ws or Workspace(spark)
        self.names = None if rules is None else frozenset(rules)
        self.may_change = equality is None
        self._pick_rules(equality == "classes" or (equality is None and (self.names is None or self.names >= EQUALITY)))
        self.axioms: DataFrame | None = None  # see compile.axiom_rows
        self.counts = Counts()
        self.parts: list[str] = []
        self.saved = 0
        self.members = triple_frame(spark, [])
        self.classes: DataFrame | None = None  # (term, rep)
        self.rounds = 0
        self.tables: dict[str, str] = {}  # where members, axioms and classes stand
        self.marks: dict[str, int] = {}  # what a caller wants to find again
        self.committed = 0

    def _pick_rules(self, by_class: bool) -> None:
        pick = lambda r: self.names is None or r.name in self.names
        self.by_class = by_class
        self.rules = [IFP_COMPAT if self.mode == "compat" and r.name == "prp-ifp" else r for r in RULES if pick(r) and not (by_class and r.name in EQUALITY)]
        self.of_one_fact = [r for r in self.rules if shape_of(r)]
        self.of_more = [r for r in self.rules if not shape_of(r) and not (by_class and r.name in FUNCTIONAL)]

    def commit(self) -> None:
        """Writes down where the closure stands; the file is written last, so what was broken off before is as if it had not been."""
        counts = [[p, k, n] for (p, k), n in self.counts.by.items()]
        state = {"names": None if self.names is None else sorted(self.names), "mode": self.mode, "by_class": self.by_class, "may_change": self.may_change, "parts": self.parts, "saved": self.saved, "rounds": self.rounds, "tables": self.tables, "marks": self.marks, "counts": counts, "total": self.counts.total}
        old = [n for n in list_names(self.spark, self.ws.root) if n.startswith("closure-")]
        self.committed += 1
        write_text(self.spark, self.ws.path(f"closure-{self.committed:09}.json"), json.dumps(state))
        self.ws.drop(*old)

    @classmethod
    def open(cls, spark, root: str, **kw) -> Closure:
        """The closure that was last committed in a folder, or an empty one that will be; arguments are those of a new one."""
        ws = Workspace(spark, root, keep=True)
        c = cls(spark, ws=ws, **kw)
        saved = sorted(n for n in list_names(spark, root) if n.startswith("closure-"))
        if saved:
            state = json.loads(read_text(spark, ws.path(saved[-1])))
            c.committed = int(saved[-1][8:17])
            c.names = None if state["names"] is None else frozenset(state["names"])
            c.mode, c.may_change, c.parts, c.saved, c.rounds, c.tables, c.marks = (state[k] for k in ("mode", "may_change", "parts", "saved", "rounds", "tables", "marks"))
            c._pick_rules(state["by_class"])
            c.counts = Counts({(p, k): n for p, k, n in state["counts"]}, state["total"])
            read = lambda name, schema: ws.read(c.tables[name], schema) if name in c.tables else None
            c.axioms, c.classes = read("axioms", "shape string, k string, q string"), read("classes", "term string, rep string")
            c.members = read("members", TRIPLE) if "members" in c.tables else c.members
        return c

    def uses(self, name: str) -> bool:
        return self.names is None or name in self.names

    def _read_all(self) -> DataFrame:
        if not self.parts:
            return triple_frame(self.spark, [])
        return self.spark.read.schema(TRIPLE).parquet(*[self.ws.path(p) for p in self.parts])

    compact = _read_all

    def _save(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.saved += 1
        name = f"t{self.saved}"
        return self.ws.save(df.select("s", "p", "o"), name), name

    def _append(self, df: DataFrame) -> tuple[DataFrame, Counts]:
        part, name = self._save(df)
        counts = count_axioms(part)
        self.parts.append(name)
        self.counts = self.counts.add(counts)
        return part, counts

    def _rewrite(self, t: DataFrame) -> DataFrame:
        if self.classes is None:
            return t
        for c in "spo":
            side = self.classes.where("term <> rep").select(F.col("term").alias("__t"), F.col("rep").alias("__r"))
            t = t.join(side, t[c] == F.col("__t"), "left").withColumn(c, F.coalesce("__r", c)).select("s", "p", "o")
        return t.distinct()

    def _by_rules(self) -> tuple[DataFrame, Counts]:
        """Spells the classes out and lets the eq- rules hold equality from here on; all triples count as new to them."""
        whole, name = self._save(self.triples())
        self.parts, self.classes = [name], None
        self.tables.pop("classes", None)
        self._pick_rules(False)
        members = self.counts.by.get((MEMBER, None), 0)
        self.counts = count_axioms(whole)
        self.counts.by[MEMBER, None] = members
        return whole, count_axioms(whole)

    def _merge(self, all_: DataFrame, new: DataFrame, first: bool) -> tuple[DataFrame, Counts] | None:
        """Classes after new equalities, all triples rewritten to them; returns what rules have not seen yet, None if classes cannot hold them."""
        pairs = all_.where(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b"))
        if self.classes is not None:
            pairs = pairs.unionByName(self.classes.select(F.col("term").alias("a"), F.col("rep").alias("b")))
        found = components(pairs, "a", "b", Workspace(self.spark, self.ws.root))
        named = found.where(F.col("term").isin(*NAMED)).groupBy("root").agg(F.min("term").alias("named"), F.count("*").alias("n"))
        if not named.where("n > 1").isEmpty():
            if self.may_change:
                return None
            raise ValueError("two terms that the rules name are stated to be the same; equality by rules can hold that, classes cannot")
        self.saved += 1
        rep = found.join(named, "root", "left").select("term", F.coalesce("named", "root").alias("rep"))
        self.tables["classes"] = f"classes{self.saved}"
        self.classes = self.ws.save(rep, self.tables["classes"])
        whole, name = self._save(self._rewrite(all_))
        fresh = whole if first else self._save(self._rewrite(new).unionByName(whole.join(all_, ["s", "p", "o"], "left_anti")).distinct())[0]
        self.parts = [name]
        members = self.counts.by.get((MEMBER, None), 0)
        self.counts = count_axioms(whole)
        self.counts.by[MEMBER, None] = members
        return fresh, count_axioms(fresh)

    def _unknown(self, found: DataFrame, all_: DataFrame) -> DataFrame:
        """What was found and is not known yet. From a large closure only rows that may match are exchanged."""
        if self.counts.total > self.filter_rows:
            found = self._save(found)[0]
            mark = lambda: F.xxhash64("s", "p", "o")
            bits = self.ws.save(bits_of(found.select(mark())), f"bits{self.saved}")
            all_ = all_.where(may_be_in(mark(), bits))
        return found.join(all_, ["s", "p", "o"], "left_anti")

    def _one_fact(self, rel: Relations, anew: bool) -> list[DataFrame]:
        """What rules of one fact give: new facts by all axioms, all facts by new axioms."""
        found = axiom_rows(self.of_one_fact, rel, newest=not anew)
        fresh = None
        if found is not None:
            self.saved += 1
            fresh = self.ws.save(found, f"axioms{self.saved}")
            self.tables["axioms"] = f"axioms{self.saved}"
            if self.axioms is None or anew:
                self.axioms = fresh
            else:
                self.tables["axioms"] += "a"
                fresh = self.ws.save(fresh.join(self.axioms, ["shape", "k", "q"], "left_anti"), f"axioms{self.saved}n")
                self.axioms = self.ws.save(self.axioms.unionByName(fresh), f"axioms{self.saved}a")
        elif anew:
            self.axioms = None
            self.tables.pop("axioms", None)
        if self.axioms is None:
            return []
        n = {r["c"]: r["count"] for r in self.axioms.groupBy((F.col("shape") == CLASS_OF).alias("c")).count().collect()}
        few = [n.get(c, 0) <= BROADCAST_ROWS for c in (False, True)]
        heads = follow(rel.new, self.axioms, *few)
        if fresh is not None and not rel.everything and not fresh.isEmpty():
            heads += follow(rel.all_, fresh, *few)
        return heads

    def add(self, base: DataFrame) -> int:
        """Adds asserted triples and runs the rules to the fixpoint; returns the number of triples new to the table.

        Rows with a null are absent and repeats count once. The result does not depend on
        how the triples were parted over calls.
        """
        base = base.select("s", "p", "o").dropna().distinct()
        first = not self.parts
        if first:
            seeds = [t for t, n in zip(SEEDS, ("cls-thing", "cls-nothing1")) if self.uses(n)]
            base = base.unionByName(triple_frame(self.spark, seeds)).distinct()
        if self.uses("rdfs12"):
            base = base.unionByName(container_axioms(base)).distinct()
        base = self._rewrite(base)
        fresh = base if first else self._unknown(base, self._read_all())
        new, c_new = self._append(fresh)
        added, lists_once = c_new.total, True
        for _ in range(self.max_rounds):
            if not c_new.total:
                return added
            self.rounds += 1
            all_ = new if first else self._read_all()
            merged = False
            if self.by_class and c_new.by.get((SAME, None)) and not new.where((F.col("p") == SAME) & (F.col("s") != F.col("o"))).isEmpty():
                seen = self._merge(all_, new, first)
                first = first or seen is None
                new, c_new = seen or self._by_rules()
                all_, merged = (new if first else self._read_all()), True
            named = c_new.by.get((INTERSECTION, None)) or c_new.by.get((UNION, None))
            lists_changed = bool(c_new.by.get((FIRST, None)) or c_new.by.get((REST, None)) or merged) and (self.mode == "spec" or lists_once) or bool(named)
            new_members = triple_frame(self.spark, [])
            n_before = self.counts.by.get((MEMBER, None), 0)
            if lists_changed and {"cls-int2", "cls-uni", INT1} & (self.names if self.names is not None else {INT1}):
                heads = all_.where(F.col("p").isin(INTERSECTION, UNION)).select("o")
                self.tables["members"] = f"members{self.rounds}"
                now = list_members(all_, self.ws, self.mode, self.tables["members"], heads)
                new_members = now.join(self.members, ["s", "p", "o"], "left_anti") if n_before else now
                c_new.by[MEMBER, None] = new_members.count()
                self.members = now
                self.counts.by[MEMBER, None] = now.count()
            lists_once = False
            rel = Relations(all_, new, self.members, new_members, self.counts, c_new)
            heads = [v for r in self.of_more for v in variants(r, rel)] + self._one_fact(rel, merged)
            if self.by_class:
                links = [functional_links(n, rel, self.mode) for n in FUNCTIONAL if self.uses(n)]
                heads += [x for x in links if x is not None]
            if self.uses(INT1):
                grown = lists_changed or bool(c_new.by.get((INTERSECTION, None)))
                d = division(all_, new, self.members, first or grown, self.counts)
                heads += [d] if d is not None else []
            if not heads:
                return added
            out = heads[0]
            for h in heads[1:]:
                out = out.unionByName(h)
            new, c_new = self._append(self._unknown(self._rewrite(out.distinct()), all_))
            added += c_new.total
            first = False
        raise RuntimeError(f"no fixpoint after {self.max_rounds} rounds")

    def triples(self) -> DataFrame:
        """All triples, literal subjects included; see ``output``."""
        t = self._read_all()
        if self.classes is None:
            return t
        of = self.classes.select(F.col("rep").alias("__r"), F.col("term").alias("__t"))
        for c in "spo":
            t = t.join(of, t[c] == F.col("__r"), "left").withColumn(c, F.coalesce("__t", c)).select("s", "p", "o")
        return t.distinct()

    def output(self) -> DataFrame:
        """The closure without triples that RDF cannot hold: literal subjects, predicates that are no IRIs."""
        return self.triples().where(~F.col("s").startswith('"') & F.col("p").startswith("<"))


def closure(triples: DataFrame, rules: Iterable[str] | None = None, mode: str = "spec", equality: str | None = None) -> DataFrame:
    """(s, p, o): the deductive closure, under all rules or a subset of their names."""
    c = Closure(triples.sparkSession, rules, mode, equality=equality)
    c.add(triples)
    return c.output()
