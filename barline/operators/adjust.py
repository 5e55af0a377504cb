"""Split adjustment: every price row takes the product of the splits executed after its date.

Splits and prices of a ticker go on one timeline, newest first; a running product over it is the
factor. No range join, no broadcast of the split table, and one exchange by ticker that later
per-ticker work reuses. Splits of one day net out because they are all part of the product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_ratios(splits: DataFrame) -> DataFrame:
    """(ticker, date, ratio) of the usable splits: price before = price after / ratio."""
    return splits.where((F.col("split_from") > 0) & (F.col("split_to") > 0)).select(
        F.col("ticker").cast("string").alias("ticker"),
        F.col("execution_date").cast("date").alias("date"),
        (F.col("split_from").cast("double") / F.col("split_to").cast("double")).alias("ratio"),
    ).where(F.col("date").isNotNull())


def net_ratios(splits: DataFrame) -> DataFrame:
    """One ratio per (ticker, day)."""
    return split_ratios(splits).groupBy("ticker", "date").agg(F.product("ratio").alias("ratio"))


def cumulative_ratios(splits: DataFrame) -> DataFrame:
    """Per (ticker, day): product of this day's splits and every later one."""
    later = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return net_ratios(splits).withColumn("cum", F.product("ratio").over(later))


def with_split_factor(prices: DataFrame, splits: DataFrame, factor: str = "factor") -> DataFrame:
    """prices + product of ratios of all splits with execution date strictly after the row's date."""
    rows = prices.withColumn("_kind", F.lit(0))
    events = net_ratios(splits).withColumn("_kind", F.lit(1))
    line = rows.unionByName(events, allowMissingColumns=True)
    # newest first, and on one day prices before splits, so a split is not part of its own day
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc(), "_kind")
    running = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn(factor, F.coalesce(F.product("ratio").over(running), F.lit(1.0)))
    return line.where(F.col("_kind") == 0).drop("_kind", "ratio")


def apply_splits(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """adj_close = close x split factor (also the rebuild of a whole stored table)."""
    out = with_split_factor(prices, splits, "_factor")
    return out.withColumn("adj_close", F.col("close") * F.col("_factor")).drop("_factor")


def readjust_history(prices: DataFrame, splits: DataFrame, since: str) -> DataFrame:
    """Fold splits executed on or after ``since`` into rows stored for earlier dates."""
    cut = F.lit(since).cast("date")
    out = with_split_factor(prices, splits.where(F.col("execution_date").cast("date") >= cut), "_factor")
    rebased = F.when(F.col("date") < cut, F.col("adj_close") * F.col("_factor")).otherwise(F.col("adj_close"))
    return out.withColumn("adj_close", rebased).drop("_factor")


def readjust_touched(prices: DataFrame, splits: DataFrame, since: str) -> DataFrame:
    """Only the rows a refresh has to rewrite: tickers split on or after ``since``, dates before it."""
    cut = F.lit(since).cast("date")
    touched = split_ratios(splits).where(F.col("date") >= cut).select("ticker").distinct()
    old = prices.where(F.col("date") < cut).join(touched, "ticker", "left_semi")
    return readjust_history(old, splits, since)
