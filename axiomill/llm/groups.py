"""Problem 1: consolidate pairwise matches into groups by seed-tree pruning.

Every round has two steps. In the first, each vertex tells its neighbourhood the
smallest vertex of it. In the second, each vertex connects all minima it was told
of to the smallest of them; a vertex that nobody takes for a minimum leaves the
graph and hangs below that smallest minimum in a forest. The graph shrinks to
nothing in a number of rounds that grows with the logarithm of the diameter; then
the seeds, the roots of the forest, flow down it, one round of the forest a step.

Vertices are ids that sort as their terms do, so the seed of a group is the term
that is smallest in byte order. No step collects the neighbourhood of a vertex:
minima are pre-aggregated before the exchange, and the join that hands them back
is between two exchanged tables, where the adaptive plan splits a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from axiomill.functions.terms import same_term
from axiomill.operators.encode import encode, ordered_ids
from axiomill.workspace import Workspace


def _both_ways(pairs: DataFrame) -> DataFrame:
    back = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return pairs.select("u", "v").union(back).distinct()


def prune(graph: DataFrame, ws: Workspace, max_rounds: int = 200) -> list[DataFrame]:
    """The forest, one table (child, parent) a round, of a symmetric graph (u, v), u <> v."""
    forest = []
    for k in range(max_rounds):
        near = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = graph.join(near, "u").select(F.col("v").alias("u"), "m").union(near.select("u", "m")).distinct()
        told = ws.save(told, f"told{k}")
        best = told.groupBy("u").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("u")).alias("kept"))
        best = ws.save(best, f"best{k}")
        forest.append(best.where("not kept").select(F.col("u").alias("child"), F.col("best").alias("parent")))
        links = told.join(best.select("u", "best"), "u").where("m <> best").select(F.col("m").alias("u"), F.col("best").alias("v"))
        left = Observation()
        graph = ws.save(_both_ways(links).observe(left, F.count("*").alias("n")), f"graph{k + 1}")
        ws.drop(f"told{k}", f"graph{k}")
        if not left.get["n"]:
            return forest
    raise RuntimeError(f"the graph still has edges after {max_rounds} rounds")


def flow_down(forest: list[DataFrame], ws: Workspace) -> DataFrame:
    """Table (u, seed) of all vertices that hang below a seed."""
    schema = "u bigint, seed bigint"
    for k, tree in enumerate(reversed(forest)):
        if k == 0:
            new = tree.select(F.col("child").alias("u"), F.col("parent").alias("seed"))
        else:
            above = ws.read("seeds", schema).select(F.col("u").alias("parent"), "seed")
            new = tree.join(above, "parent", "left").select(F.col("child").alias("u"), F.coalesce("seed", "parent").alias("seed"))
        new = ws.save(new, f"flow{k}")
        new.write.mode("append").parquet(ws.path("seeds"))
        ws.drop(f"flow{k}")
    return ws.read("seeds", schema)


def match_groups(pairs: DataFrame, left: str = "s", right: str = "o", ws: Workspace | None = None) -> DataFrame:
    """(term, group_id): every term met, with the smallest term linked to it.

    Terms are compared after ``same_term``. A pair with a missing side is absent; a
    pair of a term with itself makes a group of one; repeated pairs and either
    direction count once. No rows give no groups. Other columns are not read.
    """
    ws = ws or Workspace(pairs.sparkSession)
    clean = pairs.select(same_term(left).alias("a"), same_term(right).alias("b")).where("a is not null and b is not null")
    clean = ws.save(clean.distinct(), "pairs")
    terms = ordered_ids(clean.select("a").union(clean.select("b")), ws, "terms")
    edges = encode(encode(clean.where("a <> b"), "a", terms, "u"), "b", terms, "v")
    graph = ws.save(_both_ways(edges), "graph0")
    if graph.isEmpty():
        return terms.select("term", F.col("term").alias("group_id"))
    seeds = flow_down(prune(graph, ws), ws)
    ids = terms.join(seeds, terms.id == seeds.u, "left").select("term", F.coalesce("seed", "id").alias("seed"))
    names = terms.select(F.col("id").alias("seed"), F.col("term").alias("group_id"))
    return ids.join(names, "seed").select("term", "group_id")
