"""Exact corpus-wide counts of hashed items, returned to the chunks that hold them.

A chunk sends each of its distinct items once, with its own count: sorted, cut into buckets by hash
range, packed. So the commonest item costs one entry a chunk, and a bucket's size follows the number
of distinct items alone. A bucket adds up and answers each chunk with those of its items that the corpus
holds more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import grouped, release

#: Items that a bucket adds up at once: bounds the working arrays, no result.
MERGED = 500_000
PACKS = "chunk int, bucket int, n int, items binary, counts binary"
ANSWERS = "chunk int, bucket int, items binary, totals binary"
_PACKS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("items", pa.binary()), ("totals", pa.binary())])


def planes(a: np.ndarray) -> bytes:
    """Little-endian bytes by place, so that the high zero bytes lie together and compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def deltas(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def bounds(items: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted items of ``bits`` bits."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(items, edges), [len(items)]]).astype(np.int64)


def packs(chunk: int, items: np.ndarray, counts: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """items: sorted and distinct."""
    at = bounds(items, buckets, bits)
    rows = [(chunk, b, int(j - i), planes(deltas(items[i:j])), planes(counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKS)], schema=_PACKS) if rows else _PACKS.empty_table()


def _merge(table: pa.Table) -> pa.Table:
    """Adds up by ranges of MERGED items or so, as each chunk's items are sorted."""
    release()  # what earlier buckets took
    bucket = table["bucket"][0].as_py()
    items = [np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table["items"]]
    own = [unplanes(x.as_py(), np.uint32) for x in table["counts"]]
    least, most = min(int(x[0]) for x in items), max(int(x[-1]) for x in items)
    parts = -(-sum(map(len, items)) // MERGED)
    edges = np.array([least + (most - least + 1) * i // parts for i in range(1, parts)], np.uint64)
    at = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in items]
    found = [([], []) for _ in items]
    for r in range(parts):
        ends = np.cumsum([0, *(int(p[r + 1] - p[r]) for p in at)])
        if not ends[-1]:
            continue
        here = np.concatenate([x[p[r] : p[r + 1]] for x, p in zip(items, at)])
        order, first, _ = grouped(here)
        sums = np.add.reduceat(np.concatenate([x[p[r] : p[r + 1]] for x, p in zip(own, at)])[order], first, dtype=np.uint64)
        totals = np.empty(len(here), np.uint64)
        totals[order] = np.repeat(sums, np.diff(np.append(first, len(here))))
        for i, (kept_items, kept_totals) in enumerate(found):
            t = totals[ends[i] : ends[i + 1]]
            again = np.flatnonzero(t > 1)
            if len(again):
                kept_items.append(here[ends[i] : ends[i + 1]][again])
                kept_totals.append(t[again])
    rows = [(c, bucket, planes(deltas(np.concatenate(i))), planes(np.concatenate(t))) for c, (i, t) in zip(table["chunk"].to_pylist(), found) if i]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWERS)], schema=_ANSWERS) if rows else _ANSWERS.empty_table()


def answers(packed: DataFrame) -> DataFrame:
    """One row per chunk and bucket in which an item of the chunk is held more than once."""
    return packed.groupBy("bucket").applyInArrow(_merge, ANSWERS)


def totals(table: pa.Table, items: np.ndarray) -> np.ndarray:
    """Corpus counts of a chunk's items, in any order, from the answers to the chunk."""
    out = np.ones(len(items), np.uint64)
    rows = sorted(zip(table["bucket"].to_pylist(), table["items"].to_pylist(), table["totals"].to_pylist()))
    if rows:
        known = np.concatenate([np.cumsum(unplanes(i, np.uint64), dtype=np.uint64) for _, i, _ in rows])
        many = np.concatenate([unplanes(t, np.uint64) for *_, t in rows])
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        hit = known[at] == items
        out[hit] = many[at[hit]]
    return out
