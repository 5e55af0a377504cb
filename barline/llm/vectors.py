"""Vectors as Spark rows: which take part, bounded samples, dense blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(id, x array<double>) of the vectors that take part.

    Null and empty vectors and vectors with null or non-finite components take none, nor do zero vectors if
    ``nonzero``. A null id takes none.
    """
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad & (F.size("x") > 0))
    return rows.where(F.exists("x", lambda v: v != 0)) if nonzero else rows


def by_length(rows: DataFrame, search, schema: str) -> DataFrame:
    """``search`` over the vectors of each number of components: only those can be compared with each other."""
    out = None
    for r in rows.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():  # one row per number of components
        found = search(rows.where(F.size("x") == r["d"]), r["count"], r["d"])
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def asking(rows: DataFrame, is_query, *more: str) -> DataFrame:
    """The queries: an id asks once, whatever its number of rows, by the least of its vectors."""
    return rows.where(is_query).groupBy("id").agg(F.min(F.struct("x", *more)).alias("q")).select("id", "q.*")


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, least hash of the id first."""
    return np.array([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(n).select("x").collect()], float)


def dense(batch, name: str = "x") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    col = batch.column(name)
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))
