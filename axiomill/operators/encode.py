"""Order-preserving dictionary: strings to 64-bit ids that sort as the strings do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.workspace import Workspace


def ordered_ids(values: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Table (term, id) of the distinct non-null values of a one-column frame.

    A range exchange sorts the values over all partitions, so partition number and
    row number within it, as the high and low bits of ``id``, keep the byte order.
    The table is written before it is used: the ids are drawn only once.
    """
    term = F.col(values.columns[0]).alias("term")
    terms = values.select(term).where("term is not null").distinct()
    return ws.save(terms.sort("term").select("term", F.monotonically_increasing_id().alias("id")), name)


def encode(df: DataFrame, column: str, ids: DataFrame, to: str) -> DataFrame:
    """``column`` replaced by its id under the name ``to``.

    Both sides are exchanged, so the adaptive plan splits the partition of a value
    that most rows share.
    """
    side = ids.select(F.col("term").alias("__term"), F.col("id").alias(to))
    return df.join(side, df[column] == F.col("__term")).drop("__term", column)
