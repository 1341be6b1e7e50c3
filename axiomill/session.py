"""A session: asserted triples, their closure, and what is wrong with it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.plans import diagnostics as D
from axiomill.plans.fixpoint import TRIPLE, Closure, triple_frame
from axiomill.sources import read_triples
from axiomill.sources.ntriples import write_ntriples
from axiomill.terms import from_canonical, is_iri, to_canonical
from axiomill.workspace import Workspace, join_files, list_names, read_text, write_text


@dataclass(frozen=True)
class Options:
    collect_diagnostics: bool = True
    max_diagnostics: int | None = None
    dedupe: bool = True


class Reasoner:
    """Loads triples, materialises their closure in full or by what was added, and reports clashes.

    Asserted triples and the closure are kept apart, as tables in the shared folder.
    Additions extend the closure; a removal drops it, and the next ``reason`` starts
    from the asserted triples alone. Triples that were loaded but not yet reasoned
    over belong to the asserted ones. With a ``folder`` the session stays there, and another
    one on the same folder goes on where it was left.
    """

    def __init__(self, spark: SparkSession, rules: Iterable[str] | None = None, mode: str = "spec", options: Options | None = None, equality: str | None = None, folder: str | None = None):
        self.spark, self.rules, self.mode, self.equality = spark, rules, mode, equality
        self.options = options or Options()
        self.folder = folder
        self.ws = Workspace(spark, folder, keep=folder is not None)
        self.skipped = 0
        self._base_parts: list[str] = []
        self._pending_parts: list[str] = []
        self._closure: Closure | None = None
        self._diagnostics: DataFrame | None = None
        self._saves = self._closures = 0
        saved = sorted(n for n in list_names(spark, folder) if n.startswith("session-")) if folder else []
        if saved:
            state = json.loads(read_text(spark, self.ws.path(saved[-1])))
            self._base_parts, self._pending_parts, self._saves, self._closures = (state[k] for k in ("base", "pending", "saves", "closures"))
            if state["reasoned"]:
                self._closure = self._new_closure()

    def _commit(self) -> None:
        """Writes down where a session with a folder stands."""
        if self.folder:
            old = [n for n in list_names(self.spark, self.folder) if n.startswith("session-")]
            state = {"base": self._base_parts, "pending": self._pending_parts, "saves": self._saves, "closures": self._closures, "reasoned": self._closure is not None}
            number = max((int(n[8:17]) for n in old), default=0) + 1
            write_text(self.spark, self.ws.path(f"session-{number:09}.json"), json.dumps(state))
            self.ws.drop(*old)

    def _new_closure(self) -> Closure:
        kw = {"rules": self.rules, "mode": self.mode, "equality": self.equality}
        return Closure.open(self.spark, self.ws.path(f"closure{self._closures}"), **kw) if self.folder else Closure(self.spark, **kw)

    def _tables(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(TRIPLE).parquet(*[self.ws.path(n) for n in names]) if names else triple_frame(self.spark, [])

    @property
    def _base(self) -> DataFrame:
        return self._tables(self._base_parts)

    @classmethod
    def build(cls, spark: SparkSession, files: Iterable[str] = (), triples: DataFrame | None = None, strings: Iterable[tuple[str, str, str]] = (), **kw) -> Reasoner:
        """A session with what it starts from: files, a frame of canonical terms, tuples of IRIs."""
        r = cls(spark, **kw)
        for f in files:
            r.load_file(f)
        if triples is not None:
            r.load_triples(triples)
        strings = list(strings)
        if strings:
            r.load_triples_str(strings)
        return r

    def set_options(self, options: Options) -> None:
        if options.dedupe != self.options.dedupe:
            self._diagnostics = None
        self.options = options

    # -- loading

    def _save(self, df: DataFrame) -> str:
        self._saves += 1
        self.ws.save(df, f"base{self._saves}")
        return f"base{self._saves}"

    def _asserted(self, name: str) -> None:
        self._base_parts.append(name)
        self._pending_parts.append(name)
        self._commit()

    def load_triples(self, triples: DataFrame) -> None:
        """A frame (s, p, o) of canonical terms; rows with a null are absent."""
        new = triples.select("s", "p", "o").dropna()
        self._asserted(self._save(new.distinct().join(self._base, ["s", "p", "o"], "left_anti")))

    def load_file(self, path: str) -> None:
        self.load_triples(read_triples(self.spark, path, scope=self.mode == "spec"))

    def load_triples_str(self, rows: Iterable[tuple[str, str, str]]) -> None:
        """Triples of IRIs; a row with a term that is none is skipped and counted in ``skipped``."""
        bare = [tuple(t[1:-1] if t.startswith("<") and t.endswith(">") else t for t in r) for r in rows]
        good = [r for r in bare if all(is_iri(t) for t in r)]
        self.skipped += len(bare) - len(good)
        self.load_triples(triple_frame(self.spark, [tuple(f"<{t}>" for t in r) for r in good]))

    def from_graph(self, graph: Iterable[tuple]) -> None:
        """Any iterable of triples of term objects."""
        self.load_triples(self._frame(graph))

    def _frame(self, graph: Iterable[tuple] | DataFrame) -> DataFrame:
        if isinstance(graph, DataFrame):
            return graph.select("s", "p", "o").dropna().distinct()
        rows = []
        for t in graph:
            if len(t) != 3:
                raise ValueError(f"not a triple: {t!r}")
            rows.append(tuple(to_canonical(x) for x in t))
        return triple_frame(self.spark, rows).distinct()

    def set_base_triples(self, triples: Iterable[tuple] | DataFrame) -> bool:
        """Replaces the asserted triples; True if some were removed, so that all is derived anew."""
        name = self._save(self._frame(triples))
        new = self._tables([name])
        removed = not self._base.join(new, ["s", "p", "o"], "left_anti").isEmpty()
        if removed:
            self._base_parts = [name]
            self.clear()
        else:
            self._asserted(self._save(new.join(self._base, ["s", "p", "o"], "left_anti")))
        return removed

    update_graph = set_base_triples

    # -- reasoning

    def clear(self) -> None:
        """Drops everything derived, and the diagnostics; what is asserted stays."""
        self._closure, self._diagnostics = None, None
        self._pending_parts = list(self._base_parts)
        self._closures += 1
        self._commit()

    def reason(self) -> DataFrame:
        """The closure of the asserted triples, extended by what was loaded since the last call."""
        first = self._closure is None
        if first:
            self._closure = self._new_closure()
            self._pending_parts = list(self._base_parts)
        added = self._closure.add(self._tables(self._pending_parts))
        if self.folder:
            self._closure.commit()
        self._pending_parts = []
        self._commit()
        if first or added:
            self._diagnostics = None
        return self.get_triples()

    def reason_full(self) -> DataFrame:
        self.clear()
        return self.reason()

    # -- results

    def get_triples(self) -> DataFrame:
        return self._closure.output() if self._closure else triple_frame(self.spark, [])

    view_output = get_triples

    def get_triples_string(self) -> list[tuple[str, str, str]]:
        return [tuple(r) for r in self.get_triples().collect()]

    def get_triples_python(self) -> list[tuple]:
        return [tuple(from_canonical(x) for x in r) for r in self.get_triples().toLocalIterator()]

    def get_base_triples(self) -> DataFrame:
        return self._base

    get_input = get_base_triples

    def diagnostics(self) -> DataFrame:
        """Clashes in the closure, once per code and message unless options say otherwise."""
        if not self.options.collect_diagnostics or self._closure is None:
            return self.spark.createDataFrame([], D.SCHEMA)
        if self._diagnostics is None:
            self._diagnostics = D.diagnostics(self._closure.triples(), self.rules, self.mode, None if self._closure.by_class else self._closure.counts, self.options.dedupe)
        out = self._diagnostics
        if self.options.max_diagnostics is not None:
            out = out.orderBy("code", "message").limit(self.options.max_diagnostics)
        return out

    errors = diagnostics

    def dump_file(self, path: str) -> None:
        """The closure as N-Triples, written side by side: a folder, or with a suffix ``.ttl``, ``.nt`` or ``.n3`` one local file, to which the parts are copied as bytes."""
        if path.endswith((".ttl", ".nt", ".n3")):
            write_ntriples(self.get_triples(), self.ws.path("dump"))
            join_files(self.spark, self.ws.path("dump"), os.path.abspath(path))
            self.ws.drop("dump")
        else:
            write_ntriples(self.get_triples(), path)


def class_histogram(triples: DataFrame, type_iri: str) -> DataFrame:
    """(class, n_instances) of a closure."""
    return triples.where(F.col("p") == type_iri).groupBy(F.col("o").alias("class")).agg(F.count_distinct("s").alias("n_instances"))
