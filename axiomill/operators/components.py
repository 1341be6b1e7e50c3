"""Connected components by large-star / small-star over ordered ids.

Used where the engine itself needs components: equality classes of the rules and
the co-location of hierarchies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from axiomill.operators.encode import encode, ordered_ids
from axiomill.workspace import Workspace


def star_components(edges: DataFrame, ws: Workspace, max_rounds: int = 200) -> DataFrame:
    """(u, root) for a frame (u, v) of ids: every vertex of an edge with the smallest it reaches.

    Large-star links the larger neighbours of a vertex to the smallest one, small-star
    the smaller ones; when neither changes an edge, all that is left is stars. Both
    take only the minimum of a neighbourhood, pre-aggregated before the exchange.
    """
    edges = edges.select("u", "v")
    loops = edges.select("u").union(edges.select("v")).distinct()
    cur = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star0")
    before = None
    for k in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.save(large, f"large{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        told = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = told.union(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        cur = ws.save(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), f"star{k + 1}")
        ws.drop(f"large{k}", f"star{k}")
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return loops.join(cur, "u", "left").select("u", F.coalesce("v", "u").alias("root"))


def components(pairs: DataFrame, left: str, right: str, ws: Workspace | None = None) -> DataFrame:
    """(term, root) of a frame of string pairs; a pair with a null side is absent."""
    ws = ws or Workspace(pairs.sparkSession)
    clean = ws.save(pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null").distinct(), "cc_pairs")
    terms = ordered_ids(clean.select("a").union(clean.select("b")), ws, "cc_terms")
    roots = star_components(encode(encode(clean, "a", terms, "u"), "b", terms, "v"), ws)
    names = terms.select(F.col("id").alias("root"), F.col("term").alias("name"))
    return terms.join(roots, terms.id == roots.u).select("term", "root").join(names, "root").select("term", F.col("name").alias("root"))
