"""Exact top-k by inner product, as a Voronoi join.

1. Pivots are the centres of a bounded sample. Every vector belongs to the cell of its nearest pivot;
   candidates of a cell are cut into blocks of bounded size and queries of a cell into groups.
2. A block is summarised by its centroid, radius and number of rows, a group of queries by its rows. For a query q
   and a block around c of radius r, every inner product lies within q.c -+ |q| r: the blocks with the
   greatest lower ends that together hold k rows and one bound the query's k-th score from below, and a block
   whose upper end is below that bound for every query of a group is not sent to it.
3. The remaining (group, block) pairs are solved locally as matrix products, exactly, and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, parts_for
from .vectors import asking, by_length, dense, sample, usable

SAMPLE, PIVOTS, BLOCK, GROUP = 8192, 512, 4096, 1024


def pivots(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``n`` groups of the points by Lloyd's rounds from evenly spaced points; fewer if there are fewer."""
    if not len(points):
        return points
    centres = np.unique(points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        near = nearest(points, centres)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def _matrix(b: bytes, d: int) -> np.ndarray:
    return np.frombuffer(b, np.int64).reshape(-1, d)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if top < 2**53 else q @ x.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _gather(table: pa.Table) -> pa.Table:
    """The rows of a block or group as one row: ids, matrix, centroid, radius."""
    ids, x = table["id"].to_numpy(), dense(table)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order].astype(np.int64)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()], "x": [x.tobytes()], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})


_GATHERED = "cell int, part long, n long, ids binary, x binary, centre array<double>, radius double"


def _solve(k: int, d: int):
    def solve(batches):
        for b in batches:
            for qi, qx, bi, bx in zip(*(b.column(n).to_pylist() for n in ("q_ids", "q_x", "ids", "x"))):
                q_ids, ids = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                scores = products(_matrix(qx, d), _matrix(bx, d))
                rows = []
                for q, s in zip(q_ids, scores):
                    other = ids != q
                    at = best(ids[other], s[other], k)
                    rows.append((np.full(len(at), q), ids[other][at], s[other][at]))
                cols = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return solve


def _reach(summaries: np.ndarray, radii: np.ndarray, counts: np.ndarray, keys: np.ndarray, k: int, d: int):
    """For each group of queries: the blocks it must see."""

    def reach(batches):
        for b in batches:
            cells, parts, blocks = [], [], []
            for cell, part, x in zip(*(b.column(n).to_pylist() for n in ("cell", "part", "x"))):
                q = _matrix(x, d).astype(float)
                norm = np.sqrt((q * q).sum(axis=1))[:, None]
                centre = q @ summaries.T
                slack = norm * radii * (1 + 1e-9) + 1e-6
                order = np.argsort(-(centre - slack), axis=1)
                low = np.take_along_axis(centre - slack, order, axis=1)
                enough = (np.cumsum(counts[order], axis=1) >= k + 1).argmax(axis=1)
                whole = counts.sum() < k + 1
                bound = np.full(len(q), -np.inf) if whole else low[np.arange(len(q)), enough]
                need = np.flatnonzero(((centre + slack) >= bound[:, None]).any(axis=0))
                cells += [cell] * len(need)
                parts += [part] * len(need)
                blocks += keys[need].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int64()), pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.int64())], names=["q_cell", "q_part", "cell", "part"])

    return reach


def top_k(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of floor(scale * x), ties to smaller ids.

    ``is_query`` is a condition on the column id; an id asks once, by the least of its vectors, and candidates are all
    rows but those with the query's own id. Which vectors take part: see :func:`vectors.usable`; a query among the
    others has no rows. Vectors of different numbers of components are searched apart. Rows of equal id, or equal rows, are candidates
    each; a null id takes no part. Fewer candidates than ``k`` are all returned. Other columns, whatever their
    names, are ignored. An empty table gives no rows. Block summaries (one row per BLOCK vectors of a cell) are read by every task.
    """
    rows = kept(usable(df, key, vector).select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x")), "vectors")
    return by_length(rows, lambda some, total, d: _top_k(some, total, d, is_query, k, n_pivots), "query_id long, rank int, vec_id long, score long")


def _top_k(rows: DataFrame, total: int, d: int, is_query, k: int, n_pivots: int) -> DataFrame:
    points = sample(rows, SAMPLE)
    centres = pivots(points, min(n_pivots, parts_for(total, BLOCK)))

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(dense(b).astype(float), centres), pa.int32())], names=["id", "x", "cell"])

    celled = kept(rows.mapInArrow(assign, "id long, x array<bigint>, cell int"), "cells")
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m"))
    cut = celled.join(F.broadcast(sizes), "cell")  # one row per pivot
    part = F.pmod(F.xxhash64("id", "x"), F.ceil(F.col("n") / BLOCK).cast("long")).alias("part")
    blocks = kept(cut.select("cell", part, "id", "x").groupBy("cell", "part").applyInArrow(_gather, _GATHERED), "blocks")
    q_part = F.pmod(F.xxhash64("id", "x"), F.ceil(F.col("m") / GROUP).cast("long")).alias("part")
    groups = kept(asking(celled, is_query, "cell").join(F.broadcast(sizes), "cell").select("cell", q_part, "id", "x").groupBy("cell", "part").applyInArrow(_gather, _GATHERED), "groups")
    seen = blocks.select("cell", "part", "n", "centre", "radius").collect()  # a row for BLOCK vectors
    reach = _reach(np.array([r.centre for r in seen]), np.array([r.radius for r in seen]), np.array([r.n for r in seen]), np.array([(r.cell, r.part) for r in seen]), k, d)
    pairs = groups.select("cell", "part", "x").mapInArrow(reach, "q_cell int, q_part long, cell int, part long")
    sent = pairs.join(blocks.select("cell", "part", "ids", "x"), ["cell", "part"]).join(
        groups.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x")), ["q_cell", "q_part"]
    )
    found = sent.repartition(F.xxhash64("q_cell", "q_part", "cell", "part")).mapInArrow(_solve(k, d), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
