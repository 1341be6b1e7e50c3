"""Problem 5: what changed between consecutive full snapshots of a table.

All snapshots are sorted by key over common ranges and cut into chunks where the
hash of a key says so: the cuts depend on content, so an inserted or removed
record moves no cut but its own. Chunks are reduced to digests; chunks with equal
digests in consecutive snapshots hold the same records and are dropped, and only
rows of the others are joined to tell added, removed and changed records apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.workspace import Workspace


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk number to rows sorted by snapshot and key within a partition."""
    last, number = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        snap = b.column("snap").to_numpy(zero_copy_only=False)
        cut = b.column("cut").to_numpy(zero_copy_only=False).astype(np.int64)
        cut[1:] |= snap[1:] != snap[:-1]
        cut[0] |= last is None or snap[0] != last
        chunk = number + np.cumsum(cut)
        last, number = snap[-1], int(chunk[-1])
        keep = [n for n in b.schema.names if n != "cut"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(chunk)], names=[*keep, "chunk"])


def _records(df: DataFrame, snap: str, keys: tuple[str, str], value: str) -> DataFrame:
    """One row per snapshot and key, with a digest of the distinct values stated for it."""
    k1, k2 = keys
    rows = df.select(F.col(snap).cast("bigint").alias("snap"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(value).alias("val"))
    rows = rows.where("snap is not null and k1 is not null and k2 is not null")
    # repeats vanish before the exchange; a null is hashed apart from every string
    rows = rows.distinct()
    mark = F.concat(F.when(F.col("val").isNull(), "n").otherwise("v"), F.coalesce("val", F.lit("")))
    one = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), mark))
    return rows.groupBy("snap", "k1", "k2").agg(one(1).alias("v1"), one(2).alias("v2"), F.count("*").alias("nv"))


def chunked(df: DataFrame, snap: str, keys: tuple[str, str], value: str, ws: Workspace, chunk_rows: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest): records with their chunk, and the digest of every chunk."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rec = _records(df, snap, keys, value)
    rec = ws.save(rec, "records")
    cut = F.pmod(F.xxhash64("k1", "k2"), F.lit(chunk_rows)) == 0
    ranged = rec.repartitionByRange(parts, "k1", "k2").sortWithinPartitions("snap", "k1", "k2").withColumn("part", F.spark_partition_id()).withColumn("cut", cut)
    schema = "snap bigint, k1 string, k2 string, v1 bigint, v2 bigint, nv bigint, part int, chunk bigint"
    rows = ws.save(ranged.mapInArrow(_chunk, schema), "rows")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "k1", "k2", "v1", "v2", "nv").cast("decimal(38,0)"))
    manifest = rows.groupBy("snap", "part", "chunk").agg(F.count("*").alias("n"), total(1).alias("d1"), total(2).alias("d2"))
    return rows, ws.save(manifest, "manifest")


def snapshot_changes(df: DataFrame, snap: str, keys: tuple[str, str], value: str, ws: Workspace | None = None, chunk_rows: int = 16) -> DataFrame:
    """(snap, k1, k2, change_kind) against the snapshot before: added, removed or changed.

    A row with a null snapshot number or key is absent. A null value is a value like
    any other. Repeated rows count once; where a snapshot states several values for a
    key, the record changes when their set does. Numbers may skip: the one before is
    the next smaller number present. One snapshot, or none, gives no changes. Columns
    other than those named are not read, whatever their names.
    """
    ws = ws or Workspace(df.sparkSession)
    rows, manifest = chunked(df, snap, keys, value, ws, chunk_rows)
    # one row per snapshot: their number does not grow with the records
    order = Window.orderBy("snap")
    around = manifest.select("snap").distinct().select("snap", F.lag("snap").over(order).alias("prev"), F.lead("snap").over(order).alias("next"))
    around = ws.save(around, "order")
    chunks = manifest.join(F.broadcast(around), "snap")
    # a digest is looked for in the same key range of both neighbours
    seen = manifest.select(F.col("snap").alias("at"), F.col("part").alias("sp"), F.col("n").alias("sn"), F.col("d1").alias("s1"), F.col("d2").alias("s2"))
    same = (F.col("part") == F.col("sp")) & (F.col("n") == F.col("sn")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))
    new = chunks.where("prev is not null").join(seen, same & (F.col("prev") == F.col("at")), "left_anti").select("part", "chunk", F.col("snap").alias("pair"), F.lit(True).alias("is_new"))
    old = chunks.where("next is not null").join(seen, same & (F.col("next") == F.col("at")), "left_anti").select("part", "chunk", F.col("next").alias("pair"), F.lit(False).alias("is_new"))
    unmatched = ws.save(new.unionByName(old), "unmatched")
    left = rows.join(unmatched, ["part", "chunk"])
    sides = ws.save(left.select("pair", "is_new", "k1", "k2", "v1", "v2", "nv"), "sides")
    after = sides.where("is_new").select("pair", "k1", "k2", F.struct("v1", "v2", "nv").alias("after"))
    before = sides.where("not is_new").select("pair", "k1", "k2", F.struct("v1", "v2", "nv").alias("before"))
    both = after.join(before, ["pair", "k1", "k2"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select(F.col("pair").alias("snap"), "k1", "k2", kind.alias("change_kind")).where("change_kind is not null")
