"""Ranked lexical search by NRA: sorted reads only, with score intervals, over shards of all documents.

1. Documents are read once per block of items: for each its number of terms and the occurrences of the items' terms. Corpus
   size, total length and document frequencies are exact aggregates of these rows.
2. A shard is a bounded run of these rows. In it every term's postings are sorted by impact, and for an item the lists are
   read in parallel, in steps that double. A document's score lies between what has been read of it and
   that plus the next impacts of the lists in which it has not been seen. Reading goes on until no unseen document can
   enter the best ``k`` and each document that can is known in full, ties included.
3. The best scores of a bounded sample of documents bound every item's k-th score from below, so that other shards stop
   early and return few rows. The bound changes what is read, never a result. The shards' best are merged.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, parts_for, texts

#: Entries (item, term) of a block of items, which every task holds; documents and postings of a shard; sampled documents.
ITEM_TERMS, SHARD, POSTINGS, SAMPLE = 2_000_000, 32_768, 8_000_000, 20_000
STEP = 256
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Longest runs of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_LETTERS).split()


def _bags(batches):
    for b in batches:
        rows = [(i, w.decode(), n) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for w, n in Counter(terms(t)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field("item_id").type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "term", "n"])


def _occurrences(number: dict[bytes, int]):
    """Per document: its number of terms; of the items' terms the numbers and occurrences."""

    def occurrences(batches):
        for b in batches:
            sizes, which, many = [], [], []
            for t in b.column("text").to_pylist():
                words = terms(t)
                held = [(number[w], n) for w, n in Counter(words).items() if w in number]
                sizes.append(len(words))
                which.append([x for x, _ in held])
                many.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return occurrences


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents whose score is among the ``k`` highest, above 0 and at least ``floor``.

    lists: documents and their parts of the score, highest first. All ties at the k-th score are returned.
    """
    lower, seen = np.zeros(n_docs, np.int64), np.zeros((len(lists), n_docs), bool)
    at, step, reading = [0] * len(lists), STEP, range(len(lists))
    while True:
        for t in reading:
            docs, parts = lists[t]
            read = docs[at[t] : at[t] + step]
            lower[read] += parts[at[t] : at[t] + step]
            seen[t, read] = True
            at[t] += len(read)
        step *= 2
        bounds = np.array([parts[i] if i < len(parts) else 0 for i, (_, parts) in zip(at, lists)], np.int64)
        unseen = int(bounds.sum())
        met = np.flatnonzero(lower)
        kth = max(1, floor, int(np.partition(lower[met], len(met) - k)[len(met) - k]) if len(met) >= k else 0)
        met = met[lower[met] + unseen >= kth]
        upper = lower[met] + bounds @ ~seen[:, met]
        met, upper = met[upper >= kth], upper[upper >= kth]
        open_ = met[upper > lower[met]]
        if unseen >= kth:
            reading = np.flatnonzero(bounds).tolist()
        elif len(open_):  # nothing new can enter: only lists that can change a score that is still open
            reading = np.flatnonzero((bounds > 0) & ~seen[:, open_].all(axis=1)).tolist()
        else:
            return met, lower[met]


def _ranked(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, length: int, k: int, floors: np.ndarray):
    """Best documents of each item, shard by shard; items: numbers of terms and how often the item holds them."""

    def shard(ids, n, size, which, tf):
        lengths, of_doc = np.unique(n, return_inverse=True)
        m = np.array([100 - 75 + 75 * x * n_docs // length for x in lengths.tolist()], np.int64)[of_doc]  # whole numbers of any size
        doc = np.repeat(np.arange(len(n)), size)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, which))
        doc, impact = doc[order], impact[order]
        ends = np.searchsorted(which[order], np.arange(len(weights) + 1))
        rows = []
        for i, (own, times) in enumerate(items):
            lists = [(doc[ends[t] : ends[t + 1]], impact[ends[t] : ends[t + 1]] * (weights[t] * c)) for t, c in zip(own.tolist(), times.tolist()) if ends[t] < ends[t + 1]]
            if lists and sum(int(x[1][0]) for x in lists) >= max(1, floors[i]):
                found, scores = nra(lists, len(n), k, int(floors[i]))
                best = np.lexsort((ids[0][found], ids[1][found], -scores))[:k]
                rows += [(i, None if u else d, s) for d, u, s in zip(ids[0][found[best]].tolist(), ids[1][found[best]].tolist(), scores[best].tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    def whole(parts):
        ids, unknown, n, size, which, tf = (np.concatenate(x) for x in zip(*parts))
        return shard((ids, unknown), n, size, which, tf)

    def ranked(batches):
        parts, docs, postings = [], 0, 0
        for b in batches:
            keys, lists, tf = b.column("doc_id"), b.column("terms"), b.column("tf")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), b.column("n").to_numpy(), size, lists.flatten().to_numpy(), tf.flatten().to_numpy()))
            docs, postings = docs + b.num_rows, postings + int(size.sum())
            if docs >= SHARD or postings >= POSTINGS:
                yield whole(parts)
                parts, docs, postings = [], 0, 0
        if docs:
            yield whole(parts)

    return ranked


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 of each item.

    Score: the sum over the item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)), with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L over the documents that hold a term.
    Equal scores by doc_id, a null one last; rows of equal doc_id are documents of their own. Rows that share an item_id, null
    included, are one item that holds the terms of its distinct texts. Null and empty texts have no terms: such documents
    are never found and such items find none. Texts are read whole, whatever their length. Empty tables give no rows;
    other columns are ignored. Items are worked through in blocks of about ``item_terms`` distinct terms, each a pass over ``docs``.
    """
    spark, key = docs.sparkSession, items.schema["item_id"].dataType
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    bags = asked.mapInArrow(_bags, f"item_id {key.simpleString()}, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    bags = kept(bags, "items")
    blocks = parts_for(bags.count(), item_terms)
    out = [_block(docs, bags.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = [x for x in out if x is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {key.simpleString()}, rank int, doc_id long, score long")
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole


def _block(docs: DataFrame, bags: DataFrame, k: int) -> DataFrame | None:
    spark, rows = docs.sparkSession, bags.collect()  # bounded by the size of a block
    words = sorted({r.term for r in rows})
    number = {w.encode(): i for i, w in enumerate(words)}
    of_item: dict = {}
    for r in rows:
        of_item.setdefault(r.item_id, []).append((number[r.term.encode()], r.n))
    names = sorted(of_item, key=lambda x: (x is None, x or 0) if not isinstance(x, str) else (False, x))
    items = [tuple(np.array(x, np.int64) for x in zip(*sorted(of_item[name]))) for name in names]

    plain = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    postings = kept(plain.mapInArrow(_occurrences(number), "doc_id long, n long, terms array<int>, tf array<bigint>").where("n > 0"), "postings")
    n_docs, length = postings.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not items:
        return None
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per term of the block
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)

    def best(some: DataFrame, floors: np.ndarray) -> DataFrame:
        merged = some.mapInArrow(_ranked(items, weights, n_docs, length, k, floors), "item int, doc_id long, score long")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floors = np.zeros(len(items), np.int64)
    sampled = postings.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts_for(n_docs, SAMPLE))) == 0)
    for r in best(sampled, floors).where(F.col("rank") == k).collect():  # one row per item of the block
        floors[r["item"]] = r["score"]
    named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {bags.schema['item_id'].dataType.simpleString()}")
    return best(postings, floors).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # one row per item of the block
