"""Mixing sources to target weights by a tree of multivariate hypergeometric splits.

Documents are cut into blocks of words. A source's target fixes how many of its blocks the mix takes: whole
passes over the source, and of the last pass the first blocks of a random permutation. These exact quotas
are split among output shards: a node of a binary tree over the shards draws how many blocks of each
source go left, from the multivariate hypergeometric distribution, so each shard is a random sample of the
whole mix and all quotas are met exactly. A source's draws are numbered along its permutation and a shard
takes a range of the numbers, so shards are disjoint; inside a shard blocks are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, n_words, parts_for, releasing

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS, SHARD_WORDS, SLOT_BLOCKS = 256, 8_000_000, 20_000
#: One row per source is brought to the driver: a mix has named parts, not millions of them.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights=WEIGHTS, most: float = MOST) -> list[float]:
    """Words that the mix takes of each source: the total shared by weight, no more than ``most`` times a size.

    What a source can't take is shared again among the others by weight until none is above.
    """
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = np.array(sizes, float) * most
    left, out, open_ = float(sum(sizes)), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        want = np.where(open_, left * w / w[open_].sum(), 0)
        full = open_ & (want > cap)
        if not full.any():
            out[open_] = want[open_]
            break
        out[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    return out.tolist()


def _draw(g: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; beyond the generator's range its normal approximation, held inside the support."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    if total < 1_000_000_000:
        return int(g.hypergeometric(good, bad, n))
    mean = n * good / total
    spread = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return int(min(max(round(g.normal(mean, spread)), low), high))


class Splits:
    """The tree over ``shards`` shards; a node is (first shard, shard after the last, quotas, first draws)."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.root = (0, shards, tuple(quotas), (0,) * len(quotas))
        self.seed = seed
        self.known: dict[tuple[int, int], tuple] = {}

    def children(self, node: tuple) -> tuple[tuple, tuple]:
        a, b, quotas, first = node
        if (a, b) not in self.known:
            middle, total = (a + b) // 2, sum(quotas)
            g = np.random.default_rng([self.seed, a, b])
            n, rest, left = total * (middle - a) // (b - a), total, []
            for q in quotas:  # marginals one after another make the multivariate draw
                rest -= q
                k = _draw(g, q, rest, n)
                left.append(k)
                n -= k
            right = tuple(q - k for q, k in zip(quotas, left))
            self.known[a, b] = (a, middle, tuple(left), first), (middle, b, right, tuple(f + k for f, k in zip(first, left)))
        return self.known[a, b]

    def shards_of(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(draw), np.int64)
        todo = [(self.root, np.arange(len(draw)))]
        while todo:
            node, rows = todo.pop()
            if node[1] - node[0] == 1:
                out[rows] = node[0]
                continue
            left, right = self.children(node)
            ends = np.array([f + q for f, q in zip(left[3], left[2])], np.int64)
            goes_left = draw[rows] < ends[source[rows]]
            todo += [(n, r) for n, r in ((left, rows[goes_left]), (right, rows[~goes_left])) if len(r)]
        return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key, size in words of every row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("row_key"), n_words(F.col("text")).alias("size"))


def plan(rows: DataFrame) -> list[dict]:
    """Per source, by code point and null last: index, source, size, target, whole passes, words of the last pass."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them before mixing")
    out = []
    for i, (row, target) in enumerate(zip(found, targets([r["size"] for r in found]))):
        passes = int(target // row["size"]) if row["size"] else 0
        out.append({"i": i, "source": row["source"], "source_size": row["size"], "target": target, "passes": passes, "rest": target - passes * row["size"]})
    return out


_PLAN = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("passes", T.IntegerType()), T.StructField("rest", T.DoubleType())])


def mix(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: one row per input row, doc_id, source, row_key, copy (0, 1, ... among rows of equal id and
    text), size, source_size, target. draws: one row per block taken, doc_id, row_key, copy, block, pass,
    words, shard, position (in the shard, from 1). Null text has no words; null is a source, the last one.
    Documents without words are never drawn; very long ones are as many blocks as they need. An empty table gives none of
    either; other columns, whatever their names, are ignored. Reruns agree: order comes from hashes of id, text and ``seed``.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    # equal id and text under several sources stay apart
    repeats = rows.groupBy("row_key", "source").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("size").alias("size"))
    each = repeats.select("doc_id", "source", "row_key", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"), "size")
    each = kept(each, "sizes")
    by_source = plan(each)
    table = spark.createDataFrame([tuple(p[f.name] for f in _PLAN) for p in by_source], _PLAN)
    documents = each.join(F.broadcast(table), each["source"].eqNullSafe(table["source"])).drop(table["source"])

    cuts = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((size - 1) DIV {block_words} AS INT)"))))
    cuts = cuts.withColumns({"words": F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words), "h": F.xxhash64(F.lit(seed), "row_key", "source", "copy", "block")})
    slots = parts_for(cuts.count(), SLOT_BLOCKS)
    cuts = cuts.withColumn("slot", F.shiftrightunsigned("h", 1) % F.lit(slots)).select("i", "slot", "h", "doc_id", "row_key", "copy", "block", "words", "passes", "rest")
    earlier = W.partitionBy("i").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    groups = cuts.groupBy("i", "slot").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = groups.select("i", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.sum("n").over(W.partitionBy("i")).alias("all"))
    inside = W.partitionBy("i", "slot").orderBy("h", "row_key", "copy", "block")
    ranked = cuts.join(before, ["i", "slot"]).withColumns(
        {
            "rank": F.col("n0") + F.row_number().over(inside) - 1,
            "done": F.col("w0") + F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    # the last pass takes blocks until its rest is used up, of the last block the first words
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.floor(F.col("rest") - F.col("done"))))
    ranked = ranked.withColumn("last", last).withColumn("times", F.col("passes") + (F.col("last") > 0).cast("int")).where("times > 0")
    ranked = kept(ranked.select("i", "rank", "all", "doc_id", "row_key", "copy", "block", "words", "last", "passes", "times"), "blocks")
    quotas = {r["i"]: r["n"] for r in ranked.groupBy("i").agg(F.sum("times").cast("long").alias("n")).collect()}
    shards = parts_for(sum(p["source_size"] for p in by_source), shard_words)
    quota = [quotas.get(p["i"], 0) for p in by_source]
    drawn = ranked.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("draw", F.col("pass") * F.col("all") + F.col("rank"))
    drawn = drawn.withColumn("words", F.when(F.col("pass") == F.col("passes"), F.col("last")).otherwise(F.col("words")))
    drawn = drawn.select("i", "draw", "doc_id", "row_key", "copy", "block", "pass", "words")

    def place(batches):
        tree = Splits(quota, shards, seed)
        for b in batches:
            to = tree.shards_of(b.column("i").to_numpy(), b.column("draw").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int64())], names=[*b.schema.names, "shard"])

    placed = drawn.mapInArrow(releasing(place), T.StructType([*drawn.schema.fields, T.StructField("shard", T.LongType())]))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "i", "draw", "shard"), "i", "draw")
    draws = placed.withColumn("position", F.row_number().over(order)).select("doc_id", "row_key", "copy", "block", "pass", "words", "shard", "position", "i")
    return documents.select("doc_id", "source", "row_key", "copy", "size", "source_size", "target", "i"), draws


def taken(documents: DataFrame, draws: DataFrame) -> DataFrame:
    """documents with ``taken``, the words the mix takes of each row, repeats counted, and the output ``shard`` and ``position``
    in it of the first of its blocks (null where none is taken)."""
    words = draws.groupBy("row_key", "i", "copy").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "position")).alias("p"))
    words = words.select("row_key", "i", "copy", "taken", "p.*")
    return documents.join(words, ["row_key", "i", "copy"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
