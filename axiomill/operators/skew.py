"""Problem 6: per-key results where a few keys hold most rows.

Heavy keys are found with a mergeable sketch of frequent items, one small map a
partition, merged at the driver: at most ``1 / share`` keys can hold ``share`` of
the rows, so the list has a proven bound and can be broadcast. Rows of heavy keys
meet that list in a broadcast join and are spread by key, entity and value, combined
before every exchange; the remaining keys take an ordinary exchange; the union of both
is the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _frequent(capacity: int):
    """Misra-Gries summary of the keys of a partition, merged batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        total = 0
        for b in batches:
            total += b.num_rows
            c = pc.value_counts(b.column(0).drop_null())
            kept.update(dict(zip(c.field("values").to_pylist(), c.field("counts").to_pylist())))
            if len(kept) > capacity:
                # what every key loses is the count of the first that doesn't fit
                cut = kept.most_common(capacity + 1)[-1][1]
                kept = Counter({k: n - cut for k, n in kept.items() if n > cut})
        rows = [*kept.items(), (None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["key", "n"])

    return run


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> dict[str, float]:
    """Keys that may hold at least ``share`` of all rows, with their share.

    Every key that does is in the list (the sketch under-counts by less than half of
    ``share``, and the list takes from half of it on); it holds at most ``2 / share``
    keys. Null keys are never heavy. An empty frame has none.
    """
    capacity = int(4 / share)
    parts = df.select(F.col(key).cast("string").alias("key")).mapInArrow(_frequent(capacity), "key string, n bigint")
    # the row of the null key is the total, never below any key; at most 2 / share keys can follow that matter
    merged = parts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(capacity + 1).collect()
    total = next((r["n"] for r in merged if r["key"] is None), 0)
    return {r["key"]: r["n"] / total for r in merged if r["key"] is not None and r["n"] >= total * share / 2}


def count_per_key(df: DataFrame, key: str, entity: str, value: str, share: float | None = None) -> DataFrame:
    """(key, n_rows, n_entities, n_pairs): rows, distinct entities, distinct (entity, value) of each key.

    A row with a null key, entity or value is absent. No rows give no keys; other columns
    are not read. The sketch reads the key alone; heavy and light keys are then read once each.
    """
    named = df.select(F.col(key).alias("k"), F.col(entity).alias("e"), F.col(value).alias("v"))
    rows = named.where("k is not null and e is not null and v is not null")
    spark = df.sparkSession
    parts = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a key is heavy where it would fill half of a partition: at most 4 keys a partition are listed
    heavy = heavy_keys(named, "k", share or min(0.01, 1 / (2 * parts)))
    listed = spark.createDataFrame([(k,) for k in heavy], "hk string")
    hot = rows.join(F.broadcast(listed), F.col("k") == F.col("hk"), "left_semi")
    cold = rows.join(F.broadcast(listed), F.col("k") == F.col("hk"), "left_anti")
    # a light key is settled in one partition, by one exchange, whose partitions the adaptive plan sizes
    return _counted(pairs_of(hot)).unionByName(_counted(pairs_of(cold.repartition("k")))).select(F.col("k").alias(key), "n_rows", "n_entities", "n_pairs")


def pairs_of(rows: DataFrame) -> DataFrame:
    """(k, e, v, n) of rows, combined before they are exchanged, unless they are by key already.

    Rows of heavy keys are spread by key, entity and value together: neither a key nor an entity of it
    that holds most rows gathers in a task, and repeats of one triple are one row a task.
    """
    return rows.groupBy("k", "e", "v").agg(F.count("*").alias("n"))


def _counted(pairs: DataFrame) -> DataFrame:
    """What is left of a key or of one of its entities is again combined before each exchange, to a row a task."""
    entities = pairs.groupBy("k", "e").agg(F.sum("n").alias("n"), F.count("*").alias("np"))
    return entities.groupBy("k").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.sum("np").alias("n_pairs"))
