"""Rolling medians and ranks whose cost does not grow with the window.

Each ticker's sessions are cut into blocks that overlap by a window; a block's values become ranks in a wavelet
matrix, which answers "how many of these sessions lie below" and "the k-th smallest of these sessions" for all
windows of a block at once, a few array operations per bit of the ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elementwise import window_size
from .timeseries import TICKER

#: Sessions of a block; longer windows make longer blocks.
BLOCK_SESSIONS = 4096
LEAST = {"median": 1, "rank": 2}  # fixed values: the shortest windows


class Wavelet:
    """A sequence of whole numbers from 0, sorted bit by bit from the highest."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.before = [], []
        for b in range(self.bits - 1, -1, -1):
            on = (values >> b & 1).astype(bool)
            self.before.append(np.concatenate([[0], np.cumsum(~on)]))
            self.zeros.append(int((~on).sum()))
            values = np.concatenate([values[~on], values[on]])

    def below(self, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the places from ``start`` to before ``stop`` hold less than ``value``, and how many hold it."""
        less = np.zeros(len(start), np.int64)
        for level, (zeros, before) in enumerate(zip(self.zeros, self.before)):
            a, z = before[start], before[stop]
            on = (value >> (self.bits - 1 - level) & 1).astype(bool)
            less += np.where(on, z - a, 0)
            start, stop = np.where(on, zeros + start - a, a), np.where(on, zeros + stop - z, z)
        return less, stop - start

    def smallest(self, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        """The value with ``k`` values before it in order, of each range of places."""
        k, out = np.full(len(start), k), np.zeros(len(start), np.int64)
        for zeros, before in zip(self.zeros, self.before):
            a, z = before[start], before[stop]
            on = k >= z - a
            out = out * 2 + on
            k = np.where(on, k - (z - a), k)
            start, stop = np.where(on, zeros + start - a, a), np.where(on, zeros + stop - z, z)
        return out


def slide(x: np.ndarray, kind: str, n: int) -> np.ndarray:
    """The statistic of each value's last ``n``, itself included; NaN unless all are present."""
    present = np.isfinite(x)
    many = np.cumsum(present)
    many[n:] -= many[:-n].copy()
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(many[n - 1 :] == n) + n - 1
    if len(at):
        known, rank = np.unique(np.where(present, x, 0.0), return_inverse=True)
        tree = Wavelet(rank)
        if kind == "median":
            low, high = (known[tree.smallest(at - n + 1, at + 1, k)] for k in ((n - 1) // 2, n // 2))
            out[at] = low + (high - low) * 0.5
        else:
            less, same = tree.below(at - n + 1, at + 1, rank[at])
            out[at] = (less + 0.5 * same + 0.5) / n
    return out


def with_order_statistics(df: DataFrame, columns: Mapping[str, tuple[str, str, int]], by: Sequence[str] = TICKER) -> DataFrame:
    """``df`` with, for each name of ``columns``, (``"median"`` or ``"rank"``, column, window) down the dense session grid.

    The same as ``timeseries.ts_median`` and ``ts_rank``, for windows of any length. Null unless all sessions of the window
    have a value. A block goes to one task with the sessions before it that its windows reach.
    """
    for kind, _, n in columns.values():
        if kind not in LEAST:
            raise ValueError(f"unknown statistic {kind!r}")
        window_size(n, LEAST[kind])
    reach = max(n for *_, n in columns.values()) - 1
    size = max(BLOCK_SESSIONS, reach)
    own = F.expr(f"CAST(pos DIV {size} AS INT)")
    # a row goes to its own block and, within reach of the end, to the next one
    blocks = F.when((F.col("pos") + reach) >= (own + 1) * size, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("_block", F.explode(blocks))
    names = df.columns

    def one_block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        first = table["_block"][0].as_py() * size
        pos = table["pos"].to_numpy()
        keep = np.flatnonzero(pos >= first)
        made = {}
        for name, (kind, column, n) in columns.items():
            values = table[column].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            made[name] = pa.array(slide(values, kind, n)[keep], pa.float64(), from_pandas=True)
        out = table.select(names).take(pa.array(keep))
        for name, values in made.items():
            out = out.append_column(name, values)
        return out

    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in columns]])
    return rows.groupBy(*by, "_block").applyInArrow(one_block, schema)
