"""Problem 7: check new batches for repeats against all history, without reprocessing it.

A store in a folder keeps, for everything accepted so far, the canonical form of each
statement, the winnowed fingerprints of its text, and Bloom filters of those
fingerprints, partitioned by hash. A batch is brought to canonical form and
fingerprinted once; the filters drop every fingerprint that history cannot hold; only
the positives are looked up; pairs that share enough of their fingerprints go on to an
exact check of the words; then the store takes in what is new.

The store is a list of segments, each with its own forms, fingerprints and filters in
buckets. A batch adds one segment and rewrites none; of the older ones only buckets that
are asked for are read. Four segments of about one size are merged to one, so a row is
rewritten a logarithmic number of times, and a filter has the size of what it lists.
What the store is at any time stands in one small file, written last: another session
opens the folder there, and a batch that was broken off leaves nothing behind.

Fingerprints are salted with entity, predicate and the numbers of the text, as any
other number makes another statement, so look-alikes of other entities or with
other numbers never meet. For that, numbers count as groups of three digits: "9 251"
may be one number or two, and has to meet both "9251" and "9, 251". Two texts made of known words
alone, compounds aside, say the same only if their words are the same, articles aside: one fingerprint of
those words tells that. So only texts with other words, which may be slips or short forms,
are looked up by all their fingerprints, and others only among those; of many look-alikes
of one entity nearly all are never paired.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from axiomill.functions.terms import is_literal, lexical, same_term, unescaped
from axiomill.llm.saying import ARTICLES, compounds, groups, same_saying, tokens
from axiomill.workspace import Workspace, list_names, read_text, write_text

GRAM, WINDOW = 4, 12  # characters of a gram; grams of a window: any shared run of 15 characters shares a fingerprint
COVERAGE = 0.2  # least share of the shorter text's fingerprints that a pair must have in common


# --- canonical form -----------------------------------------------------------


def _canon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ordered = [tokens(t) if lit else [t] for t, lit in zip(b["said"], b["is_text"])]
        spread = [[g for x in t for g in (groups(x) if lit and x[0].isdigit() else [x])] for t, lit in zip(ordered, b["is_text"])]
        b["text"] = [" ".join(t) if lit else None for t, lit in zip(spread, b["is_text"])]
        b["words"] = [" ".join(sorted(t)) for t in ordered]
        b["nums"] = [" ".join(sorted(x for x in t if x[0].isdigit())) if lit else t[0] for t, lit in zip(spread, b["is_text"])]
        yield b[["id", "batch", "entity", "p", "text", "words", "nums"]]


def canonical(df: DataFrame, id: str, s: str, p: str, o: str, batch: Column) -> DataFrame:
    """(id, batch, key, block, text, words): equal keys say the same up to order and marks.

    A row with a missing s, p or o is absent. A literal counts by its text alone; any
    other o, which has no text, must be the same term. Texts without a word all say the same: nothing.
    """
    rows = df.select(F.col(id).alias("id"), batch.cast("int").alias("batch"), F.lower(same_term(s)).alias("entity"), same_term(p).alias("p"), same_term(o).alias("o"))
    said = F.when(is_literal("o"), F.coalesce(unescaped(lexical("o")), F.col("o"))).otherwise(F.col("o"))
    rows = rows.select("id", "batch", "entity", "p", said.alias("said"), is_literal("o").alias("is_text"))
    rows = rows.where("id is not null and batch is not null and entity is not null and p is not null and said is not null")
    rows = rows.mapInPandas(_canon, "id bigint, batch int, entity string, p string, text string, words string, nums string")
    part = F.concat_ws("\u0001", "entity", "p")
    return rows.select("id", "batch", F.md5(F.concat_ws("\u0001", part, "words")).alias("key"), F.xxhash64(F.concat_ws("\u0001", part, "nums")).alias("block"), "text", "words")


# --- fingerprints -------------------------------------------------------------


def winnow(texts: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of many texts at once: in every window of grams the least hash is kept.

    A text shorter than a gram is one gram, padded. Texts are parted by more zero
    bytes than a window spans, so none depends on its neighbours.
    """
    pad = GRAM + WINDOW
    raw = [t.encode() + b"\x01" * max(0, GRAM - len(t.encode())) for t in texts]
    data = np.frombuffer((b"\0" * pad).join([b"", *raw, b""]), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    starts = pad + np.concatenate([[0], np.cumsum(sizes + pad)[:-1]])
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for k in range(GRAM):
        h = h * np.uint64(1_000_003) + data[k : k + n]
        whole &= data[k : k + n] != 0
    h = _mix(h)
    h[~whole] = np.iinfo(np.uint64).max
    m = n - WINDOW + 1
    win = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    best = np.argmin(win, axis=1)
    pos = np.unique(np.arange(m) + best)
    pos = pos[whole[pos]]
    row = np.searchsorted(starts, pos, side="right") - 1
    return row, _mix(h[pos] ^ salts.astype(np.uint64)[row])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FORM_COLS = "fid bigint, key string, block bigint, words string, open boolean, prints array<bigint>"


def _prints(known: frozenset[str], joined: frozenset[str]):
    """Adds to forms their distinct fingerprints, and whether they have words that may stand for others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                c = b.iloc[at : at + 2000]
                texts = c["text"].tolist()
                some = np.array([t is not None for t in texts])
                out = [np.empty(0, np.int64)] * len(c)
                if some.any():
                    row, fp = winnow([t for t in texts if t is not None], c["block"].to_numpy(np.int64).view(np.uint64)[some])
                    cuts = np.searchsorted(row, np.arange(1, some.sum()))
                    for k, part in zip(np.flatnonzero(some), np.split(fp.view(np.int64), cuts)):
                        out[k] = np.unique(part)
                strange = [t is not None and any((w not in known or w in joined) and not w[:1].isdigit() for w in ws.split(" ")) for t, ws in zip(texts, c["words"])]
                yield pd.DataFrame({"fid": c["fid"], "key": c["key"], "block": c["block"], "words": c["words"], "open": strange, "prints": out})

    return run


def _forms(rows: DataFrame, known: frozenset[str]) -> DataFrame:
    """FORM_COLS, whole: one row per canonical form, with its least id; pre-aggregated, so copies cost no more than one row a task."""
    forms = rows.groupBy("key").agg(F.min("id").alias("fid"), F.first("block").alias("block"), F.min("text").alias("text"), F.first("words").alias("words"))
    forms = forms.mapInPandas(_prints(known, compounds(known)), FORM_COLS)
    bag = F.filter(F.split("words", " "), lambda w: ~w.rlike("^[0-9]") & ~w.isin(*ARTICLES))
    return forms.withColumn("whole", F.xxhash64(F.lit("whole"), "block", F.array_join(bag, " ")))


def _marked(x: Column) -> Column:
    """A fingerprint of a text with strange words, under which texts of known words look it up."""
    return F.xxhash64(x, F.lit(1))


def _listed(forms: DataFrame, fps: Column) -> DataFrame:
    """(fp, fid, n): the fingerprints of forms, with the number a form has; 0 marks the one of all its words."""
    whole = F.array(F.struct(F.col("whole").alias("fp"), F.lit(0).alias("n")))
    parts = F.transform(fps, lambda x: F.struct(x.alias("fp"), F.size("prints").alias("n")))
    return forms.select("fid", F.inline(F.concat(whole, parts)))


def stored_prints(forms: DataFrame) -> DataFrame:
    """What the store lists of a form."""
    return _listed(forms, F.concat("prints", F.when(F.col("open"), F.transform("prints", _marked)).otherwise(F.array().cast("array<bigint>"))))


def asked_prints(forms: DataFrame) -> DataFrame:
    """What a form is looked up by."""
    return _listed(forms, F.when(F.col("open"), F.col("prints")).otherwise(F.transform("prints", _marked)))


# --- Bloom filters ------------------------------------------------------------

HASHES = 5
BITS_PER_PRINT = 12


def _bits(fp: np.ndarray, size: int) -> np.ndarray:
    x = _mix(fp.view(np.uint64))
    step = _mix(x ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) % np.uint64(size) for k in range(HASHES)])


def _set(size: int):
    """One row of bits a task and bucket, of rows that are stored bucket by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, fp in b.groupby("bucket")["fp"]:
                bits = kept.setdefault(bucket, np.zeros(size // 8, np.uint8))
                at = _bits(fp.to_numpy(np.int64), size).ravel()
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for bucket, bits in kept.items():
            yield pd.DataFrame({"bucket": [bucket], "bits": [bits.tobytes()]})

    return run


def _united(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts["bits"]])
    return pd.DataFrame({"bucket": [key[0]], "bits": [bits.tobytes()]})


ASKED = "seg int, bucket int, fp bigint, nid bigint, n int"


def _screen(sizes: list[int]):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return right.iloc[:0]
        bits = np.frombuffer(left["bits"].iloc[0], np.uint8)
        at = _bits(right["fp"].to_numpy(np.int64), sizes[int(key[0])])
        hit = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        return right[hit]

    return run


# --- the store ----------------------------------------------------------------

BUCKET_PRINTS = 1 << 18  # fingerprints of a bucket
BUCKET_FORMS = 1 << 14  # forms of a bucket
SEND_ROWS = 100_000  # a list of (fingerprint, id) or of pairs of ids is sent to all tasks up to this counted length
FAN = 4  # segments of one size that are merged
GROWTH = 1.5  # the vocabulary is learned anew whenever history has grown by this factor
JUMP = 3  # rounds of handing labels on from which pointers are doubled
FORMS = "fid bigint, first_id bigint, words string, bucket int"
PRINTS = "fp bigint, fid bigint, n int, bucket int"
BLOOM = "bucket int, bits binary"


def _power(rows: int, each: int) -> int:
    """Buckets, a power of two, so that a smaller number of them parts rows as a larger one does."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / each)))


@dataclass
class Segment:
    name: str
    prints: int
    forms: int

    @property
    def buckets(self) -> int:
        return _power(self.prints, BUCKET_PRINTS)

    @property
    def form_buckets(self) -> int:
        return _power(self.forms, BUCKET_FORMS)

    @property
    def bits(self) -> int:
        return -(-self.prints * BITS_PER_PRINT // self.buckets // 64) * 64 + 64

    @property
    def level(self) -> int:
        return int(math.log(max(1, self.prints), FAN))


@dataclass
class State:
    segments: list[Segment] = field(default_factory=list)
    known_share: float = 5e-4
    words: str = ""  # file of the vocabulary
    learned: int = 0  # forms when it was learned
    done: dict[str, str] = field(default_factory=dict)  # results by the name of their batch
    made: int = 0  # names given out

    @property
    def forms(self) -> int:
        return sum(s.forms for s in self.segments)


def _bucket(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), c), F.lit(n)).cast("int")


class HistoryStore:
    """Forms, fingerprints and filters of all that was accepted, in one folder.

    ``HistoryStore(spark, root)`` opens the folder where the last batch left it, or
    begins an empty store there. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, known_share: float = 5e-4):
        self.spark = spark
        self.ws = Workspace(spark, root, keep=True)
        saved = [n for n in list_names(spark, root) if n.startswith("state-")]
        self.state = State(known_share=known_share)
        if saved:
            said = json.loads(read_text(spark, f"{root}/{max(saved)}"))
            self.state = State(**{**said, "segments": [Segment(**s) for s in said["segments"]]})
        words = read_text(spark, f"{root}/{self.state.words}") if self.state.words else ""
        self.vocabulary = frozenset(words.split())

    # -- segments

    def _name(self, kind: str) -> str:
        self.state.made += 1
        return f"{kind}-{self.state.made:06}"

    def _commit(self, drop: Iterable[str] = ()) -> None:
        """The new state; what it no longer names is deleted after it stands."""
        name = self._name("state") + ".json"
        old = [n for n in list_names(self.spark, self.ws.root) if n.startswith("state-")]
        write_text(self.spark, f"{self.ws.root}/{name}", json.dumps(asdict(self.state)))
        self.ws.drop(*drop, *old)

    def _read(self, at: Iterable[tuple[int, int]], table: str, schema: str) -> DataFrame:
        """Rows of the buckets (segment, bucket) of a table, with their segment."""
        by: dict[int, list[int]] = {}
        for seg, bucket in at:
            by.setdefault(seg, []).append(bucket)
        out = self.spark.createDataFrame([], schema + ", seg int")
        for k, (seg, buckets) in enumerate(sorted(by.items())):
            t = self.ws.read(f"{self.state.segments[seg].name}/{table}", schema).where(F.col("bucket").isin(buckets)).withColumn("seg", F.lit(seg))
            out = t if k == 0 else out.unionByName(t)
        return out

    def _write_segment(self, name: str, prints: DataFrame, forms: DataFrame, n_prints: int, n_forms: int) -> Segment:
        """Both tables in buckets, then the filter of each bucket, read off the buckets without an exchange of fingerprints."""
        s = Segment(name, n_prints, n_forms)
        in_buckets = prints.select("fp", "fid", "n", _bucket("fp", s.buckets).alias("bucket")).repartition(s.buckets, "bucket").sortWithinPartitions("bucket", "fp")
        forms = forms.select("fid", "first_id", "words", _bucket("fid", s.form_buckets).alias("bucket")).repartition(s.form_buckets, "bucket")
        write = lambda df, t: df.write.mode("overwrite").partitionBy("bucket").parquet(self.ws.path(f"{name}/{t}"))
        with _beside(self.spark, lambda: write(forms, "forms")):
            write(in_buckets, "prints")
            bits = self.ws.read(f"{name}/prints", PRINTS).select("bucket", "fp").mapInPandas(_set(s.bits), BLOOM)
            bits.groupBy("bucket").applyInPandas(_united, BLOOM).write.mode("overwrite").parquet(self.ws.path(f"{name}/bloom"))
        return s

    def _merge(self) -> list[str]:
        """Merges the newest segments while FAN of them are of one size; returns the names of those merged."""
        gone = []
        while True:
            segs = self.state.segments
            n = 0
            while n < len(segs) and segs[-1 - n].level <= segs[-1].level:
                n += 1
            if n < FAN:
                return gone
            last = segs[-n:]
            read = lambda t, schema: self.spark.read.schema(schema).parquet(*[self.ws.path(f"{s.name}/{t}/bucket=*") for s in last])  # noqa: E731, B023
            one = self._write_segment(self._name("seg"), read("prints", "fp bigint, fid bigint, n int"), read("forms", "fid bigint, first_id bigint, words string"), sum(s.prints for s in last), sum(s.forms for s in last))
            self.state.segments = [*segs[:-n], one]
            gone += [s.name for s in last]

    def _learn(self, texts: DataFrame, n: int) -> None:
        """Adds to the vocabulary the words that at least ``known_share`` of n texts (words) have, and two of them.

        The share is tested by its lower confidence bound, so it does not move with the size
        of history. A word stays known: at most words-of-a-text / known_share are learned at a time.
        """
        words = texts.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).where("w rlike '^[^0-9]'")
        c, m, z2 = F.col("count"), float(max(n, 1)), 1.96**2
        lower = (c / m + z2 / (2 * m) - 1.96 * F.sqrt((c / m * (1 - c / m) + z2 / (4 * m)) / m)) / (1 + z2 / m)
        known = words.groupBy("w").count().where((c >= 2) & (lower >= self.state.known_share))
        self.vocabulary |= {r["w"] for r in known.select("w").collect()}
        self.state.learned = n
        self.state.words = self._name("words")
        write_text(self.spark, self.ws.path(self.state.words), "\n".join(sorted(self.vocabulary)))

    def _learn_again(self) -> None:
        """Once history has grown enough; texts that repeat others are not asked, as they hold the slips."""
        if self.state.forms >= max(1, self.state.learned * GROWTH):
            forms = self.spark.read.schema("fid bigint, first_id bigint, words string").parquet(*[self.ws.path(f"{s.name}/forms/bucket=*") for s in self.state.segments])
            self._learn(forms.where("fid = first_id"), self.state.forms)

    # -- batches

    def _save_forms(self, rows: DataFrame, name: str) -> tuple[DataFrame, dict]:
        seen = Observation()
        forms = _forms(rows, self.vocabulary).observe(seen, *_counts(F.lit(True)), _slices())
        return self.ws.save(forms, name), seen.get

    def accept(self, rows: DataFrame) -> None:
        """Takes in ``canonical`` rows that are free of repeats, unchecked."""
        tmp = self._name("tmp")
        self._learn(rows, rows.count())
        forms, seen = self._save_forms(rows, f"{tmp}/forms")
        if seen["forms"]:
            self.state.segments.append(self._write_segment(self._name("seg"), stored_prints(forms), forms.withColumn("first_id", F.col("fid")), seen["prints"], seen["forms"]))
        self._commit([tmp, *self._merge()])

    def _positives(self, asked: DataFrame, slices: int, tmp: str) -> tuple[DataFrame, list, int]:
        """What is asked and passes the filters, with the buckets it may be in and its number of rows."""
        segs = self.state.segments
        most = max(s.buckets for s in segs)
        wanted = [b for b in range(SLICES) if slices >> b & 1]
        filters = self._read({(k, x) for k, s in enumerate(segs) for b in wanted for x in range(b % s.buckets, s.buckets, SLICES)}, "bloom", BLOOM)
        sizes = F.array(*[F.struct(F.lit(k).alias("seg"), F.lit(s.buckets).alias("m")) for k, s in enumerate(segs)])
        each = asked.select(F.col("fid").alias("nid"), "fp", "n", _bucket("fp", most).alias("b"), F.explode(sizes).alias("at"))
        each = each.select(F.col("at.seg").alias("seg"), F.pmod("b", "at.m").alias("bucket"), "fp", "nid", "n")
        seen = Observation()
        passed = filters.groupBy("seg", "bucket").cogroup(each.groupBy("seg", "bucket")).applyInPandas(_screen([s.bits for s in segs]), ASKED)
        passed = passed.observe(seen, F.collect_set(F.struct("seg", "bucket")).alias("at"), F.count("*").alias("n"))
        positives = self.ws.save(passed, f"{tmp}/positives")
        return positives, [(r["seg"], r["bucket"]) for r in seen.get["at"]], seen.get["n"]

    def _pairs(self, forms: DataFrame, slices: int, tmp: str) -> tuple[DataFrame, list, int]:
        """(nid, oid, seg): forms of the batch with forms that may say the same, of the store or (seg -1) of the batch."""
        asked, own = asked_prints(forms), stored_prints(forms)
        mine = asked.select("fp", F.col("fid").alias("nid"), F.col("n").alias("nn"))
        met = mine.join(own.select("fp", F.col("fid").alias("oid"), F.col("n").alias("on")), "fp").where("oid <> nid and (nn > 0) = (on > 0)").select("nid", "oid", F.lit(-1).alias("seg"), "nn", "on")
        if self.state.segments:
            positives, at, n = self._positives(asked, slices, tmp)
            side = positives.select("seg", "fp", "nid", F.col("n").alias("nn"))
            stored = self._read(at, "prints", PRINTS).select("seg", "fp", F.col("fid").alias("oid"), F.col("n").alias("on"))
            old = stored.join(F.broadcast(side) if n <= SEND_ROWS else side, ["seg", "fp"]).where("(nn > 0) = (on > 0)")
            met = met.unionByName(old.select("nid", "oid", "seg", "nn", "on"))
        shared = met.groupBy("nid", "oid", "seg").agg(F.sum(F.when(F.col("nn") > 0, 1).otherwise(0)).alias("k"), F.max("nn").alias("nn"), F.max("on").alias("on"), F.max(F.col("nn") == 0).alias("all"))
        may = shared.where(F.col("all") | (F.col("k") >= F.least("nn", "on") * COVERAGE)).select("nid", "oid", "seg")
        parts = F.array(*[F.lit(s.form_buckets) for s in self.state.segments], F.lit(1))
        bucket = F.when(F.col("seg") >= 0, F.pmod(F.xxhash64(F.lit("bucket"), "oid"), F.get(parts, F.greatest("seg", F.lit(0)))).cast("int"))
        seen = Observation()
        may = may.observe(seen, F.collect_set(F.when(F.col("seg") >= 0, F.struct("seg", bucket.alias("bucket")))).alias("at"), F.count("*").alias("n"))
        pairs = self.ws.save(may, f"{tmp}/pairs")
        return pairs, [(r["seg"], r["bucket"]) for r in seen.get["at"]], seen.get["n"]

    def _edges(self, forms: DataFrame, slices: int, tmp: str) -> tuple[DataFrame, int]:
        """(nid, to, exact, own): forms of the batch with the label of a form of the store, or with another of the batch, that says the same."""
        pairs, at, n = self._pairs(forms, slices, tmp)
        side = pairs.select("nid", "oid", "seg")
        stored = self._read(at, "forms", FORMS).select("seg", F.col("fid").alias("oid"), F.when(_two_ways("words"), F.col("fid")).otherwise(F.col("first_id")).alias("to"), F.col("words").alias("ow"))
        of_store = stored.join(F.broadcast(side) if n <= SEND_ROWS else side, ["seg", "oid"])
        of_batch = side.where("seg < 0").join(forms.select(F.col("fid").alias("oid"), F.col("words").alias("ow")), "oid").withColumn("to", F.col("oid"))
        both = of_store.select("nid", "to", "ow", "seg").unionByName(of_batch.select("nid", "to", "ow", "seg")).join(forms.select(F.col("fid").alias("nid"), F.col("words").alias("nw")), "nid")
        vocabulary = self.vocabulary

        @F.pandas_udf("boolean")
        def same(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([x == y or same_saying(x, y, vocabulary) for x, y in zip(a, b)], dtype=bool)

        seen = Observation()
        edges = both.where(same("nw", "ow")).select("nid", "to", (F.col("nw") == F.col("ow")).alias("exact"), (F.col("seg") < 0).alias("own"))
        edges = edges.observe(seen, F.coalesce(F.sum(F.col("own").cast("int")), F.lit(0)).alias("own"))
        return self.ws.save(edges, f"{tmp}/edges"), seen.get["own"]

    def _labels(self, forms: DataFrame, slices: int, tmp: str) -> DataFrame:
        """(nid, first_id, exact): the least id of what says the same as a form, handed on until nothing changes, but not by texts that can be read two ways."""
        edges, own = self._edges(forms, slices, tmp)
        of_store = F.col("exact") & ~F.col("own")
        least = edges.groupBy("nid").agg(F.min("to").alias("near"), F.min(F.when(of_store, F.col("to"))).alias("same"))
        # what the store has word for word belongs where that belongs, and links nothing else
        label = least.select("nid", F.coalesce("same", F.least("nid", "near")).alias("first_id"), F.col("same").isNotNull().alias("exact"))
        if not own:
            return self.ws.save(label, f"{tmp}/labels")
        both = edges.where("own").select("nid", "to")
        both = both.union(both.select("to", "nid")).distinct()
        nodes = forms.select(F.col("fid").alias("nid"), _two_ways("words").alias("two"))
        linked = both.select("nid").distinct().join(label, "nid", "full").join(nodes, "nid")
        labels = linked.select("nid", "two", F.coalesce("first_id", "nid").alias("first_id"), F.coalesce("exact", F.lit(False)).alias("exact"))
        for k in count(1):
            known = labels.where("not two and not exact").select(F.col("nid").alias("to"), F.col("first_id").alias("via"))
            best = both.join(known, "to", "left").groupBy("nid").agg(F.min(F.least(F.coalesce("via", "to"), "to")).alias("b"))
            nxt = labels.join(best, "nid", "left").select("nid", "two", "exact", F.when(F.col("exact") | F.col("b").isNull(), F.col("first_id")).otherwise(F.least("b", "first_id")).alias("first_id"), F.col("first_id").alias("was"))
            if k > JUMP:  # a long chain: the label of the label too, so what a round gains doubles
                far = known.select(F.col("to").alias("first_id"), F.col("via").alias("far"))
                nxt = nxt.join(far, "first_id", "left").select("nid", "two", "exact", F.when(F.col("exact"), F.col("first_id")).otherwise(F.least("first_id", "far")).alias("first_id"), "was")
            seen = Observation()
            nxt = nxt.observe(seen, F.coalesce(F.sum((F.col("first_id") < F.col("was")).cast("int")), F.lit(0)).alias("moved"))
            labels = self.ws.save(nxt.select("nid", "two", "exact", "first_id"), f"{tmp}/label{k}")
            if not seen.get["moved"]:
                return labels.select("nid", "first_id", "exact")

    def check(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """(first_id, stmt_id) of the batch's rows (of ``canonical``) that repeat an earlier row; then takes in the batch.

        The result is a table of the store. A batch of a ``name`` that was checked before is not taken in again: its result is read.
        """
        if name is not None and name in self.state.done:
            return self.ws.read(self.state.done[name], "first_id bigint, stmt_id bigint")
        tmp, result = self._name("tmp"), self._name("found")
        forms, seen = self._save_forms(batch, f"{tmp}/forms")
        labels = self._labels(forms, seen["slices"], tmp) if seen["forms"] else forms.select(F.col("fid").alias("nid"), F.col("fid").alias("first_id"), F.col("open").alias("exact"))
        firsts = forms.join(labels.withColumnRenamed("nid", "fid"), "fid", "left")
        firsts = firsts.withColumns({"first_id": F.coalesce("first_id", "fid"), "exact": F.coalesce("exact", F.lit(False))})
        new = Observation()
        firsts = self.ws.save(firsts.observe(new, *_counts(~F.col("exact"))), f"{tmp}/firsts")
        found = batch.select("id", "key").join(firsts.select("key", "first_id"), "key").where("first_id < id")
        segment, gone = self._name("seg"), []
        with _beside(self.spark, lambda: self.ws.save(found.select("first_id", F.col("id").alias("stmt_id")), result)):
            if seen["forms"] and new.get["forms"]:
                kept = firsts.where("not exact")
                self.state.segments.append(self._write_segment(segment, stored_prints(kept), kept, new.get["prints"], new.get["forms"]))
                gone = self._merge()
                self._learn_again()
        self.state.done[name or result] = result
        self._commit([tmp, *gone])
        return self.ws.read(result, "first_id bigint, stmt_id bigint")


SLICES = 64  # what a batch asks for is told by slices of the buckets, one bit each


def _slices() -> Column:
    """Bits of the slices in which forms are looked up."""
    asked = F.concat(F.array("whole"), F.when(F.col("open"), F.col("prints")).otherwise(F.transform("prints", _marked)))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit("bucket"), x), F.lit(SLICES)).cast("int"))
    return F.coalesce(F.bit_or(F.aggregate(asked, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(one(x)))), F.lit(0).cast("bigint")).alias("slices")


def _counts(which: Column) -> tuple[Column, Column]:
    """Number of forms and of the fingerprints that the store lists of them."""
    size = F.when(which, F.size("prints") * F.when(F.col("open"), 2).otherwise(1) + 1)
    return F.count(size).alias("forms"), F.coalesce(F.sum(size), F.lit(0)).alias("prints")


@contextmanager
def _beside(spark: SparkSession, job: Callable[[], object]) -> Iterator[None]:
    """Runs a job on another thread while the body runs; its error, if any, is raised at the end."""
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(inheritable_thread_target(spark)(job))
        yield
    other.result()


def _two_ways(words: str) -> Column:
    """Whether a text has groups of digits that may be one number or several."""
    return F.col(words).rlike(r"\d_\d")


def repeats(accepted: DataFrame, arrivals: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(first_id, stmt_id) of the arrivals that repeat an earlier row, batch after batch.

    Both frames have stmt_id, s, p, o; arrivals have batch_no. Rows that lack s, p, o,
    an id or a batch are absent. Copies within a batch repeat the one with the least id.
    An empty history or no arrivals give what is left to compare.
    """
    spark = accepted.sparkSession
    ws = ws or Workspace(spark)
    store = HistoryStore(spark, ws.path("store"))
    store.accept(ws.save(canonical(accepted, "stmt_id", "s", "p", "o", F.lit(0)), "accepted"))
    ws.drop("accepted")
    columns = "id bigint, key string, block bigint, text string, words string, batch int"
    canonical(arrivals, "stmt_id", "s", "p", "o", F.col("batch_no")).write.partitionBy("batch").parquet(ws.path("arrivals"))
    rows = ws.read("arrivals", columns)
    found = None
    for n in sorted(r["batch"] for r in rows.select("batch").distinct().collect()):
        part = store.check(rows.where(F.col("batch") == n), str(n))
        found = part if found is None else found.unionByName(part)
    ws.drop("arrivals")
    return found if found is not None else spark.createDataFrame([], "first_id bigint, stmt_id bigint")
