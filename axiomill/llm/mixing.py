"""Problem 9: mix sources to target weights by balanced (cube) sampling.

Sizes are tokens of a public tokenizer, counted over whole texts. A source whose
target takes r copies of it gives every document floor(r) times and selects the
rest with probability r - floor(r). The selection is the cube method: a vector of
inclusion probabilities is moved at random through the null space of the balancing
constraints (number of documents, number of tokens) until almost all of them are 0
or 1, so both totals stay as expected while every document keeps its probability.

The flight runs in blocks of bounded size, spread by a hash of the document, so a
source with a third of all rows is as many tasks as it has blocks. A block leaves at
most two documents undecided; those of all blocks of a source meet in new blocks,
again and again, until one block is left, whose last two are the landing problem.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.workspace import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: how byte-level BPE of this vocabulary parts a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 2000  # documents in one flight
LONG = 100_000  # characters of a text encoded at once
EPS = 1e-9
STATE = "source string, doc_id bigint, n_tokens bigint, pi double"


def pieces(text: str) -> Iterator[str]:
    """A long text in parts whose tokens together are those of the whole: cut before a single blank between words."""
    while len(text) > LONG:
        at = LONG
        while at > LONG // 2 and not (text[at] == " " and text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at -= 1
        at = at if at > LONG // 2 else LONG
        yield text[:at]
        text = text[at:]
    yield text


def _sizes(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [sum(len(encode(p)) for p in pieces(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return run


def token_sizes(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens) of rows that have all of doc_id, source and text."""
    docs = documents.select("doc_id", "source", "text").where("doc_id is not null and source is not null and text is not null")
    return docs.mapInPandas(_sizes(path, pattern), "doc_id bigint, source string, n_tokens bigint")


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are neither 0 nor 1, with sum(pi) and sum(pi * x) kept."""
    pi = pi.astype(float).copy()
    todo = [int(k) for k in np.flatnonzero((pi > EPS) & (pi < 1 - EPS))]
    draw = iter(rng.random(2 * len(todo) + 8))
    todo.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 3 and not (len(active) == 2 and x[active[0]] == x[active[1]]):
            return pi
        if len(active) == 3:
            a, b, c = (float(x[k]) for k in active)
            # orthogonal to (1, 1, 1) and to the three sizes
            u = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
        else:
            u = [1.0, -1.0]
        up = min((1 - pi[k]) / v if v > 0 else -pi[k] / v for k, v in zip(active, u) if v)
        down = min(pi[k] / v if v > 0 else (pi[k] - 1) / v for k, v in zip(active, u) if v)
        step = up if next(draw) * (up + down) < down else -down
        for k, v in zip(active, u):
            p = pi[k] + step * v
            pi[k] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
        active = [k for k in active if EPS < pi[k] < 1 - EPS]


def landing(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last two: the number of documents is kept while it can be, then each is drawn."""
    left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if len(left) == 2:
        i, j = left
        total = pi[i] + pi[j]
        if total <= 1:  # one of the two at most
            first = rng.random() < pi[i] / total
            pi[i], pi[j] = (total, 0.0) if first else (0.0, total)
        else:  # one of the two at least
            first = rng.random() < (1 - pi[j]) / (2 - total)
            pi[i], pi[j] = (1.0, total - 1) if first else (total - 1, 1.0)
        # a probability moved to 0 or 1 is settled, the other keeps the sum
    for k in np.flatnonzero((pi > EPS) & (pi < 1 - EPS)):
        pi[k] = float(rng.random() < pi[k])
    return np.round(pi)


def _fly(seed: int, last: bool):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("doc_id", kind="stable").reset_index(drop=True)
        # the draw depends on the block alone: a task that runs again decides alike
        mark = int.from_bytes(str(key).encode(), "little") % (2**61)
        rng = np.random.default_rng([seed, mark])
        order = rng.permutation(len(b))
        pi = b["pi"].to_numpy()[order]
        pi = flight(pi, b["n_tokens"].to_numpy()[order], rng)
        if last:
            pi = landing(pi, rng)
        out = np.empty(len(b))
        out[order] = pi
        return pd.DataFrame({"source": b["source"], "doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "pi": out})

    return run


def cube_sample(units: DataFrame, ws: Workspace, seed: int = 1) -> DataFrame:
    """STATE rows with pi 0 or 1, balanced in number and tokens within each source."""
    done, level = None, 0
    left = units
    while True:
        sizes = left.groupBy("source").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if not most:
            return done if done is not None else units
        last = most <= BLOCK
        # as many blocks as hold BLOCK on average; all sources in one block each at the last level
        blocks = sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        placed = left.join(F.broadcast(blocks), F.col("source") == F.col("s")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id"), "blocks"))
        out = placed.select("source", "block", "doc_id", "n_tokens", "pi").groupBy("source", "block").applyInPandas(_fly(seed + level, last), STATE)
        out = ws.save(out, f"flight{level}")
        settled = out.where((F.col("pi") <= EPS) | (F.col("pi") >= 1 - EPS))
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        left, level = out.where((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)), level + 1


MAX_SOURCES = 10_000


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry per target: what the source has, and how many copies of it the mix takes.

    Without ``total_tokens`` the mix is the largest in which every source that has
    documents keeps its target in proportion to the others, none used more than
    ``max_repeats`` times. With it, a source that cannot fill its part gives all its
    repeats and is reported short. Targets are a stated list; more than MAX_SOURCES
    of them are an error rather than a surprise.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    keys = targets.select("source").distinct()
    have = {r["source"]: r for r in sizes.join(F.broadcast(keys), "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    out = [{"source": w["source"], "share": w["share"], "cap": int(w["cap"]), "n": have[w["source"]]["n"] if w["source"] in have else 0, "tokens": int(have[w["source"]]["tokens"] or 0) if w["source"] in have else 0} for w in wanted]
    able = [e for e in out if e["tokens"]]
    total = total_tokens if total_tokens is not None else min((e["cap"] * e["tokens"] / e["share"] for e in able), default=0)
    for e in out:
        e["wanted"] = total * e["share"]
        e["copies"] = min(float(e["cap"]), e["wanted"] / e["tokens"]) if e["tokens"] else 0.0
        if abs(e["copies"] - round(e["copies"])) < 1e-9:
            e["copies"] = float(round(e["copies"]))
    return sorted(out, key=lambda e: e["source"])


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, path: str = TOKENIZER, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): (doc_id, source, n_tokens, copies) of documents taken, and the report per target.

    Documents without a source, a target, an id or a text, and those of no tokens, stay
    out; a doc_id that comes twice counts once, with its longest text. A source named
    twice in the targets takes its larger share and cap; a null or non-positive share
    or cap is no target. A source without documents is reported with a share of 0.
    """
    spark = documents.sparkSession
    ws = ws or Workspace(spark)
    sizes = token_sizes(documents, path).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens").where("n_tokens > 0")
    sizes = ws.save(sizes, "sizes")
    entries = plan(sizes, targets, total_tokens)
    schema = "source string, base int, pi double, share double, cap int, wanted double"
    known = spark.createDataFrame([(e["source"], int(e["copies"]), e["copies"] - int(e["copies"]), e["share"], e["cap"], e["wanted"]) for e in entries], schema)
    units = sizes.join(F.broadcast(known.select("source", "base", "pi")), "source")
    picked = cube_sample(units.where(F.col("pi") > EPS).select("source", "doc_id", "n_tokens", "pi"), ws, seed)
    whole = units.where((F.col("pi") <= EPS) & (F.col("base") > 0)).select("source", "doc_id", "n_tokens", F.lit(0.0).alias("pi"))
    taken = picked.unionByName(whole).join(F.broadcast(known.select("source", "base")), "source")
    taken = taken.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("pi").cast("int")).alias("copies")).where("copies > 0")
    used = taken.groupBy("source").agg(F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    total = used.agg(F.sum("mix_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shares = known.join(used, "source", "left").join(F.broadcast(total), F.lit(True), "left").select(
        "source", F.col("share").alias("target_share"), F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.col("cap").alias("max_repeats"), zero("most_copies"), zero("docs_used"), zero("mix_tokens"),
        (F.coalesce("mix_tokens", F.lit(0)) < F.col("wanted") * 0.99).alias("short"),
    )
    return taken, shares
