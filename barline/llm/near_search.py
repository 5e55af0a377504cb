"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

1. A rotation is learned from a bounded sample: principal directions, then alternating the signs of the
   rotated sample and the orthogonal map that fits them best. A code is the signs of a rotated vector.
2. All rows are dealt to shards of bounded size by a hash of the id. A shard indexes the codes of its
   rows by each of SUBSTRINGS substrings.
3. A query, in blocks of all queries against every shard, finds all codes within Hamming radius R: at least
   one substring of such a code lies within floor(R / SUBSTRINGS) of the query's (pigeonhole), so the index
   entries that near are probed and their rows filtered by whole codes. The rows found are ranked by exact
   distance of the original vectors; shards keep ``k`` each and are merged.

R is learned too: the least radius within which the sample's own queries find RECALL of their neighbours. Queries that
find fewer than ``k`` rows, though there are more, are searched again within twice the radius, until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, parts_for
from .vectors import asking, by_length, dense, sample, usable

SAMPLE, TRIALS, RECALL = 16_384, 256, 0.98
#: Substrings of 16 bits in a code.
SUBSTRINGS = 4
SHARD, QUERY_BLOCK = 16_384, 256
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


class Codes:
    """Signs after a learned rotation of centred vectors; as many bits as components, 64 at most."""

    def __init__(self, points: np.ndarray, rounds: int = 30, seed: int = 5):
        self.mean = points.mean(axis=0)
        x = points - self.mean
        bits = min(64, x.shape[1])
        _, _, axes = np.linalg.svd(x.T @ x)
        self.map = axes[:bits].T
        v = x @ self.map
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        self.map = self.map @ turn
        self.bits = bits

    def of(self, x: np.ndarray) -> np.ndarray:
        on = np.zeros((len(x), 64), np.uint8)
        on[:, : self.bits] = (x - self.mean) @ self.map >= 0
        return np.packbits(on, axis=1).view(np.uint64).ravel()


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def radius(codes: Codes, points: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The least radius that holds ``recall`` of the k nearest of the sample's first ``trials`` points."""
    if len(points) < 2:
        return 64
    own, far = codes.of(points), []
    for i in range(min(trials, len(points))):
        d = distances(points, points[i])
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        far.append(ones(own[near] ^ own[i]))
    return int(np.quantile(np.concatenate(far), recall, method="higher"))


class Index:
    """Codes by substring: for each, its distinct values and the rows of each value."""

    def __init__(self, codes: np.ndarray):
        self.codes, parts = codes, codes.view(np.uint16).reshape(-1, SUBSTRINGS)
        self.tables = []
        for s in range(SUBSTRINGS):
            order = np.argsort(parts[:, s], kind="stable")
            values, first = np.unique(parts[order, s], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def within(self, code: np.uint64, r: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``r`` bits, all of them."""
        own = np.array([code]).view(np.uint16)
        found = []
        for s, (values, first, order) in enumerate(self.tables):
            near = np.flatnonzero(_ONES[values ^ own[s]] <= r // SUBSTRINGS)
            if len(near):
                sizes = first[near + 1] - first[near]
                at = np.repeat(first[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                found.append(order[at])
        rows = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return rows[ones(self.codes[rows] ^ code) <= r]


def _blocks(table: pa.Table) -> pa.Table:
    ids, x = table["id"].to_numpy(), dense(table)
    return pa.table({"part": table["part"][:1], "ids": [ids.tobytes()], "x": [np.ascontiguousarray(x).tobytes()]})


def _search(codes: Codes, r: int, k: int, d: int):
    def search(batches):
        last, index = None, None
        for b in batches:
            for part, bi, bx, qi, qx in zip(*(b.column(n).to_pylist() for n in ("part", "ids", "x", "q_ids", "q_x"))):
                ids, x = np.frombuffer(bi, np.int64), np.frombuffer(bx).reshape(-1, d)
                if part != last:
                    last, index = part, Index(codes.of(x))
                q_ids, q = np.frombuffer(qi, np.int64), np.frombuffer(qx).reshape(-1, d)
                out = []
                for q_id, vector, code in zip(q_ids, q, codes.of(q)):
                    rows = index.within(code, r)
                    rows = rows[ids[rows] != q_id]
                    far = distances(x[rows], vector)
                    at = np.lexsort((ids[rows], far))[:k]
                    out.append((np.full(len(at), q_id), ids[rows][at], far[at]))
                a, c, e = (np.concatenate(o) for o in zip(*out)) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(e, pa.float64())], names=["query_id", "vec_id", "score"])

    return search


def nearest_neighbours(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", within: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found by Euclidean distance, ties to smaller ids.

    ``is_query`` is a condition on the column id; an id asks once, by the least of its vectors, and candidates are all rows
    but those with the query's own id; every query gets ``k`` rows, all candidates if there are fewer. Zero vectors and those
    that :func:`vectors.usable` names take no part; vectors of different numbers of components are searched apart. ``within`` sets the
    first radius; as many rows as a result holds are searched completely. An empty table gives no rows; equal vectors and
    repeated ids are rows like others; other columns, whatever their names, are ignored.
    """
    rows = kept(usable(df, key, vector, nonzero=True), "vectors")
    return by_length(rows, lambda some, total, d: _search_all(some, total, d, is_query, k, within), "query_id long, rank int, vec_id long, score double")


def _search_all(rows: DataFrame, total: int, d: int, is_query, k: int, within: int | None) -> DataFrame:
    points = sample(rows, SAMPLE)
    codes = Codes(points)
    r = within if within is not None else 64 if total <= k + 1 else radius(codes, points, k)
    part = F.pmod(F.xxhash64("id", "x"), F.lit(parts_for(total, SHARD))).cast("int").alias("part")
    data = rows.select(part, "id", "x").groupBy("part").applyInArrow(_blocks, "part int, ids binary, x binary")
    queries, full = kept(asking(rows, is_query), "queries"), None
    while True:
        found = kept(_nearest(data, queries, codes, r, k, d), "found")
        full = found if full is None else full.unionByName(found)
        if r >= 64:
            return full
        own = rows.join(queries.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
        wanted = own.select("id", F.least(F.lit(k), F.lit(total) - F.col("own")).alias("wanted"))
        held = found.groupBy("query_id").agg(F.count("*").alias("held"))
        few = kept(wanted.join(held, wanted["id"] == held["query_id"], "left").where("coalesce(held, 0) < wanted").select("id"), "few")
        if few.isEmpty():
            return full
        full = full.join(few, full["query_id"] == few["id"], "left_anti")
        queries, r = queries.join(few, "id", "left_semi"), min(64, max(1, 2 * r))


def _nearest(data: DataFrame, queries: DataFrame, codes: Codes, r: int, k: int, d: int) -> DataFrame:
    """The result's rows of ``queries``, as far as their codes lie within ``r``; data: packed shards."""
    q_blocks = parts_for(queries.count(), QUERY_BLOCK)
    q_part = F.pmod(F.xxhash64("id", "x"), F.lit(q_blocks)).cast("int").alias("part")
    asked = queries.select(q_part, "id", "x").groupBy("part").applyInArrow(_blocks, "part int, ids binary, x binary")
    asked = asked.select(F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    # each block of queries meets each shard
    pairs = data.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).join(asked, "q_part")
    found = pairs.repartition(F.xxhash64("part", "q_part")).mapInArrow(_search(codes, r, k, d), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
