"""Semi, anti and look-up joins between the canonical tables. Spark picks broadcast or shuffle from
the sizes it measures; nothing here is hinted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_GROUP = "__none__"  # fixed value: bucket of tickers without a label


def keep_listed(bars: DataFrame, reference: DataFrame, exchanges: list[str] | None = None) -> DataFrame:
    """Bars of tickers on the reference list (optionally only some exchanges)."""
    listed = reference if not exchanges else reference.where(F.col("primary_exchange").isin(exchanges))
    return bars.join(listed.select("ticker").distinct(), "ticker", "left_semi")


def attach_group(rows: DataFrame, meta: DataFrame, group: str = "sector", fill: bool = False) -> DataFrame:
    out = rows.join(meta.select("ticker", group), "ticker", "left")
    return out.withColumn(group, F.coalesce(group, F.lit(NO_GROUP))) if fill else out


def carry_sectors(new_meta: DataFrame, old_meta: DataFrame) -> DataFrame:
    """Keep a sector known earlier, else take the new one."""
    old = old_meta.select("ticker", F.col("sector").alias("_old"))
    out = new_meta.join(old, "ticker", "left").withColumn("sector", F.coalesce("_old", "sector"))
    return out.select(*new_meta.columns)


def meta_for_priced(prices: DataFrame, meta: DataFrame) -> DataFrame:
    """One meta row per priced ticker, blank where the reference list does not know it."""
    return prices.select("ticker").distinct().join(meta, "ticker", "left").select(*meta.columns)


def without_prices(membership: DataFrame, prices: DataFrame) -> DataFrame:
    """Constituents that have no price row."""
    return membership.select("ticker").distinct().join(prices.select("ticker").distinct(), "ticker", "left_anti")


def difference(left: DataFrame, right: DataFrame, column: str = "ticker") -> DataFrame:
    """Distinct values of ``column`` in left that right lacks."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def index_union(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every key of any frame once, with a flag per frame: which of them hold it. Null is a key value like any other."""
    names = list(frames)
    sides = [df.select(*keys, *[F.lit(n == name).alias(n) for n in names]) for name, df in frames.items()]
    together = reduce(DataFrame.unionByName, sides)
    return together.groupBy(*keys).agg(*[F.bool_or(n).alias(n) for n in names])
