"""Connected components of links that may outgrow the driver: local contraction, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, parts_for

#: Links that a task contracts together.
HELD = 500_000


def named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, above = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = above[u], above[v]
        if (x == y).all():
            break
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while (above != above[above]).any():
            above = above[above]
    return nodes, nodes[above]


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links between the same components: from each node but the least to the least."""
    nodes, least = named(a, b)
    low = nodes != least
    return nodes[low], least[low]


def _contract(batches):
    held, n = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= HELD:
            held = [contracted(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) * 2 > HELD:  # little to gain from more
                yield _links(*held[0])
                held = []
            n = sum(len(x[0]) for x in held)
    if held:
        yield _links(*contracted(*(np.concatenate(x) for x in zip(*held))))


def _name(batches):
    """All links in one task: every node with its component."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    nodes, least = named(*(np.concatenate(x) for x in zip(*held))) if held else (np.empty(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])


def _links(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Re-hang each neighbourhood below its least member; the lower half of it only in a small star."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    hung = around.join(least.hint("merge"), "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return out.where("a != b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node hangs below one head at most, and no head below another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR (low = 1 AND high = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b, long); a component is its least node.

    Links to oneself and repeated links are harmless. Tasks contract HELD links each. Where that leaves several tasks, rounds of
    stars and contraction end when every component is one star, after a number that grows with the logarithm of
    the longest chain of tasks.
    """
    links = links.where("a != b").select("a", "b")
    tasks = parts_for(links.count(), HELD)
    if tasks == 1:
        return kept(links.coalesce(1).mapInArrow(_name, "node long, component long"), "classes")
    edges = kept(links.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "stars")
    while not _is_forest(edges):
        edges = kept(_stars(_stars(edges, True), False).mapInArrow(_contract, "a long, b long"), "stars")
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return kept(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads), "classes")
