"""Tables that cut lineage, written to the folder shared by all executors.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only a
local session that names none gets a folder of its own; a cluster without one is
an error, because a folder on one machine cannot be read from another.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("axiomill.shared.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="axiomill-")
    spark.conf.set("axiomill.shared.dir", own)
    return own


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, as the driver keeps its state in."""
    fs, p = _at(spark, path)
    f = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that stands whole or not at all: it is written under another name first."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    f = fs.create(part, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder one after another in a local file; bytes are streamed, no row passes through Python."""
    jvm = spark.sparkContext._jvm
    out = jvm.java.io.FileOutputStream(path)
    try:
        for name in sorted(n for n in list_names(spark, folder) if n.startswith("part-")):
            fs, p = _at(spark, f"{folder}/{name}")
            part = fs.open(p)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
            finally:
                part.close()
    finally:
        out.close()


class Workspace:
    """Named Parquet tables of one operator run; ``drop`` frees those no longer read.

    A table survives the loss of any executor: a lost task reads the files again
    instead of recomputing what led to them.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, keep: bool = False):
        """A folder of its own below ``root``, which is deleted when the driver ends, or with ``keep`` the folder ``root`` itself."""
        self.spark = spark
        self.root = root if keep else f"{root or shared_dir(spark)}/axm-{uuid.uuid4().hex}"
        if not keep:
            fs, p = _at(spark, self.root)
            fs.deleteOnExit(p)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def close(self) -> None:
        """Deletes all tables of the run; results that read them must have been written by then."""
        self.drop("")

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = _at(self.spark, self.path(name) if name else self.root)
            fs.delete(p, True)
