"""Problem 2: parent-child links to full hierarchies.

Components are found first and each is brought to one task, where an iterative
depth-first walk with node colours (white, grey, black) gives paths, depths and
descendant counts and finds back edges, which are the cycles. A component of more
than ``max_nodes`` nodes never goes to one task: it is resolved between tables, by
doubling the pointers to ancestors, in as many rounds as the logarithm of its
depth, each of as many rows as there are nodes. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators.components import star_components
from axiomill.operators.encode import encode, ordered_ids
from axiomill.workspace import Workspace

SCHEMA = "node string, node_state string, root_node string, node_depth bigint, node_path string, n_desc bigint"
WHITE, GREY, BLACK = 0, 1, 2
FLUSH_CHARS = 8_000_000  # paths are handed on in pieces: a deep tree's paths together are far longer than its rows


def walk(child: list[str], parent: list[str | None]) -> Iterator[tuple]:
    """Rows of SCHEMA for whole components given as node and parent (None: a root)."""
    up = dict(zip(child, parent))
    below: dict[str, list[str]] = {}
    for c, p in up.items():
        if p is not None:
            below.setdefault(p, []).append(c)
    colour = dict.fromkeys(up, WHITE)
    for start, above in up.items():
        if above is not None:
            continue
        # preorder down, counts of descendants on the way up
        order, path, count = [], [], {}
        stack = [(start, False)]
        while stack:
            node, done = stack.pop()
            if done:
                colour[node] = BLACK
                count[node] = sum(count[c] + 1 for c in below.get(node, ()))
                continue
            colour[node] = GREY
            order.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in below.get(node, ()))
        depth = {start: 0}
        for node in order:
            d = depth[node] if node == start else depth.setdefault(node, depth[up[node]] + 1)
            del path[d:]
            path.append(node)
            yield node, "tree", start, d, ">".join(path), count[node]
    # what no root reaches is on a cycle or hangs below one
    for start in up:
        if colour[start] != WHITE:
            continue
        trail, node = [], start
        while colour[node] == WHITE:
            colour[node] = GREY
            trail.append(node)
            node = up[node]
        if colour[node] == GREY:  # a back edge: from here on the trail is the cycle
            on = set(trail[trail.index(node):])
        else:
            on = set()
        for n in trail:
            colour[n] = BLACK
            yield n, "on_cycle" if n in on else "under_cycle", "", -1, "", -1


def _walk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def frames(rows) -> Iterator[pd.DataFrame]:
        out, chars = [], 0
        for r in rows:
            out.append(r)
            chars += len(r[4]) + 64
            if chars > FLUSH_CHARS:
                yield pd.DataFrame(out, columns=names)
                out, chars = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b["comp"].iloc[-1] if len(b) else None
        whole = b["comp"] != last
        rest = b[~whole]
        if whole.any():
            w = b[whole]
            yield from frames(walk(w["node"].tolist(), [None if pd.isna(x) else x for x in w["parent"]]))
    if rest is not None and len(rest):
        yield from frames(walk(rest["node"].tolist(), [None if pd.isna(x) else x for x in rest["parent"]]))


def _double(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of SCHEMA for nodes (id, pid, node) of any component, between tables only."""
    n = max(2, nodes.count())
    links = nodes.select("id", F.coalesce("pid", "id").alias("up"), F.col("pid").isNull().alias("top"))
    cur, names = ws.save(links, "ptr0"), nodes.select("id", "node")
    rounds = n.bit_length() + 1
    for k in range(rounds):  # pointers alone first: along a cycle, paths would grow without end
        far = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        moved = cur.where("not top").join(far, "up").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"))
        cur = ws.save(cur.where("top").unionByName(moved), f"ptr{k + 1}")
        ws.drop(f"ptr{k}")
        if cur.where("not top").isEmpty():
            break
    stuck = cur.where("not top")
    loop = stuck.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))
    bad = stuck.select("id").join(loop, "id", "left").join(names, "id")
    bad = bad.select("node", F.when(F.col("on"), "on_cycle").otherwise("under_cycle").alias("node_state"), F.lit("").alias("root_node"), F.lit(-1).cast("bigint").alias("node_depth"), F.lit("").alias("node_path"), F.lit(-1).cast("bigint").alias("n_desc"))

    # up: the ancestor 2^k steps up, null beyond the root; d nodes from seg's first to this one;
    # n: descendants less than 2^k steps below, itself among them. Each round doubles all three.
    good = nodes.join(cur.where("top").select("id"), "id", "left_semi")
    cur = ws.save(good.select("id", F.col("pid").alias("up"), F.col("id").alias("head"), F.col("node").alias("seg"), F.lit(1).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("n")), "seg0")
    for k in range(rounds):
        if cur.where("up is not null").isEmpty():
            break
        far = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"), F.col("seg").alias("seg2"), F.col("d").alias("d2"))
        # what hangs below is added up before it is exchanged, so a node with many below it is one row a task
        below = cur.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"))
        moved = cur.join(far, "up", "left").join(below, "id", "left").select(
            "id",
            F.col("up2").alias("up"),
            F.coalesce("head2", "head").alias("head"),
            F.when(F.col("seg2").isNull(), F.col("seg")).otherwise(F.concat_ws(">", "seg2", "seg")).alias("seg"),
            (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
        )
        cur = ws.save(moved, f"seg{k + 1}")
        ws.drop(f"seg{k}")
    roots = names.select(F.col("id").alias("head"), F.col("node").alias("root_node"))
    tree = cur.join(names, "id").join(roots, "head")
    tree = tree.select("node", F.lit("tree").alias("node_state"), "root_node", (F.col("d") - 1).alias("node_depth"), F.col("seg").alias("node_path"), (F.col("n") - 1).alias("n_desc"))
    return tree.unionByName(bad)


def parent_conflicts(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent, kept): the parents of every node that is given more than one, and which one ``hierarchy`` keeps.

    A link with a null side is absent, repeated links count once. No links, or none in
    conflict, give no rows. The parents of one node are combined before they are exchanged.
    """
    pairs = links.select(F.col(child).alias("node"), F.col(parent).alias("parent")).where("node is not null and parent is not null").distinct()
    kept = pairs.groupBy("node").agg(F.min("parent").alias("least"), F.max("parent").alias("most")).where("least < most")
    return pairs.join(kept.select("node", "least"), "node").select("node", "parent", (F.col("parent") == F.col("least")).alias("kept"))


def hierarchy(links: DataFrame, child: str, parent: str, max_nodes: int = 200_000, ws: Workspace | None = None) -> DataFrame:
    """One row of SCHEMA per node of the links (child, parent).

    A link with a null side is absent, repeated links count once. A node given
    several parents keeps the one that is smallest in byte order, for its path as for who
    it descends from (``parent_conflicts`` tells the others); a node that is its own parent is a cycle of one. Children are counted as descendants once each. No
    links give no rows; other columns are not read.
    """
    spark = links.sparkSession
    ws = ws or Workspace(spark)
    pairs = links.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null")
    pairs = ws.save(pairs.groupBy("c").agg(F.min("p").alias("p")), "links")
    ids = ordered_ids(pairs.select("c").union(pairs.select("p")), ws, "nodes")
    edges = ws.save(encode(encode(pairs, "c", ids, "u"), "p", ids, "v"), "edges")
    comp = ws.save(star_components(edges, ws), "comp")
    size = comp.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"))
    big = ws.save(size.where(F.col("n") > max_nodes).select("r"), "big")
    up = edges.select(F.col("u").alias("id"), F.col("v").alias("pid"))
    nodes = ids.select("id", F.col("term").alias("node")).join(up, "id", "left")
    nodes = nodes.join(comp.select(F.col("u").alias("id"), F.col("root").alias("comp")), "id")
    names = ids.select(F.col("id").alias("pid"), F.col("term").alias("parent"))
    # at most nodes / max_nodes components are big, a list small enough to send to all
    small = nodes.join(F.broadcast(big), nodes.comp == big.r, "left_anti").join(names, "pid", "left")
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = small.select("comp", "node", "parent").repartition(parts, "comp").sortWithinPartitions("comp")
    out = packed.mapInPandas(_walk_batches, SCHEMA)
    if big.isEmpty():
        return out
    large = ws.save(nodes.join(F.broadcast(big), nodes.comp == big.r, "left_semi").select("id", "pid", "node"), "large")
    return out.unionByName(_double(large, ws))
