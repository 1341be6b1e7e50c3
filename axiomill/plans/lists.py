"""Members of RDF lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from axiomill.operators.components import components
from axiomill.vocab import FIRST, MEMBER, NIL, REST
from axiomill.workspace import Workspace


def list_members(t: DataFrame, ws: Workspace, mode: str = "spec", name: str = "members", heads: DataFrame | None = None) -> DataFrame:
    """(s, p, o) = (head, MEMBER, member) of the lists that begin at ``heads`` (one column), or at every list node.

    In mode ``spec`` a node's list is what ``rdf:rest`` leads to from it, found by
    doubling the pointers: as many rounds as the logarithm of the longest list, and a row
    for each node and each member of a list. A list that runs into itself ends there. In mode ``compat`` all nodes joined by
    ``rdf:rest`` have one common, unordered list.
    """
    first = t.where(F.col("p") == FIRST).select(F.col("s").alias("n"), F.col("o").alias("m"))
    rest = t.where((F.col("p") == REST) & (F.col("o") != NIL)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    if mode == "compat":
        nodes = rest.union(first.select(F.col("n").alias("a"), F.col("n").alias("b")))
        comp = components(nodes, "a", "b", ws)
        of = comp.join(first, comp.term == first.n).select("root", "m").distinct()
        named = comp if heads is None else comp.join(heads.select(F.col(heads.columns[0]).alias("term")).distinct(), "term", "left_semi")
        out = named.select(F.col("term").alias("s"), "root").join(of, "root").select("s", F.lit(MEMBER).alias("p"), F.col("m").alias("o"))
        return ws.save(out.distinct(), name)
    jump = ws.save(rest.distinct(), f"{name}_jump0")
    nodes = first.select(F.col("n").alias("a")).union(jump.select("a")).distinct()
    if heads is not None:
        nodes = nodes.join(heads.select(F.col(heads.columns[0]).alias("a")).distinct(), "a", "left_semi")
    seen = Observation()
    reach = ws.save(nodes.select("a", F.col("a").alias("b")).observe(seen, F.count("*").alias("n")), f"{name}_0")
    size, k = seen.get["n"], 0
    while True:  # reach: nodes less than 2^k steps on; jump: the one 2^k steps on
        seen = Observation()
        far = reach.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        nxt = ws.save(reach.union(far).distinct().observe(seen, F.count("*").alias("n")), f"{name}_{k + 1}")
        if seen.get["n"] == size:
            break
        twice = jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        jump = ws.save(twice, f"{name}_jump{k + 1}")
        ws.drop(f"{name}_{k}", f"{name}_jump{k}")
        reach, size, k = nxt, seen.get["n"], k + 1
    out = reach.join(first, reach.b == first.n).select(F.col("a").alias("s"), F.lit(MEMBER).alias("p"), F.col("m").alias("o"))
    return ws.save(out.distinct(), name)
