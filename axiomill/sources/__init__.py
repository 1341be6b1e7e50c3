"""Readers and writers of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axiomill.sources.ntriples import TripleSyntaxError, read_ntriples, write_ntriples
from axiomill.sources.turtle import read_turtle

__all__ = ["TripleSyntaxError", "read_ntriples", "read_triples", "read_turtle", "write_ntriples"]


def read_triples(spark: SparkSession, path: str, scope: bool = True) -> DataFrame:
    """By suffix: ``.ttl`` is Turtle, ``.n3`` and ``.nt`` are N-Triples; another suffix is a ValueError.

    A path that does not exist is an OSError, as for any file.
    """
    if path.endswith(".ttl"):
        read = read_turtle
    elif path.endswith((".n3", ".nt")):
        read = read_ntriples
    else:
        raise ValueError(f"unrecognised file extension: {path}")
    try:
        return read(spark, path, scope)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
