"""Membership intervals: from prices, snapshots or daily flags, and periodic reconstitution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import down
from ..schema import MEMBERSHIP


def intervals_from_prices(prices: DataFrame, meta: DataFrame, universe: str) -> DataFrame:
    """First bar to delisting date (open if the ticker has none)."""
    first = prices.groupBy("ticker").agg(F.min("date").alias("start_date"))
    ends = meta.select("ticker", F.col("delisted_date").alias("end_date"))
    return first.join(ends, "ticker", "left").select(
        F.lit(universe).alias("universe"), "ticker", "start_date", "end_date"
    )


def intervals_from_snapshots(snapshots: DataFrame, universe: str) -> DataFrame:
    """Member from the first snapshot that lists it to the day before the next one that does not.

    The list of snapshot dates has at most one row per calendar day and is broadcast; each ticker's
    consecutive snapshots form an island.
    """
    rows = snapshots.select("date", "ticker").distinct()
    order = Window.orderBy("date")
    dates = rows.select("date").distinct().withColumns(
        {"nth": F.row_number().over(order), "gone": F.date_sub(F.lead("date").over(order), 1)}
    )
    rows = rows.join(F.broadcast(dates), "date")
    rows = rows.withColumn("island", F.col("nth") - F.row_number().over(Window.partitionBy("ticker").orderBy("nth")))
    spans = rows.groupBy("ticker", "island").agg(
        F.min("date").alias("start_date"), F.max_by("gone", "nth").alias("end_date")
    )
    return spans.select(F.lit(universe).alias("universe"), "ticker", "start_date", "end_date")


def intervals_from_flags(panel: DataFrame, flag: str, universe: str) -> DataFrame:
    """Runs of a daily flag; a run that reaches the last session stays open. Needs ``n_sessions``."""
    on = panel.where(F.col(flag))
    on = on.withColumn("island", F.col("pos") - F.row_number().over(down()))
    spans = on.groupBy("ticker", "island").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("_last"),
        (F.max("pos") == F.max("n_sessions") - 1).alias("_open"),
    )
    return spans.select(
        F.lit(universe).alias("universe"),
        "ticker",
        "start_date",
        F.when(~F.col("_open"), F.col("_last")).alias("end_date"),
    )


def reconstituted(panel: DataFrame, size: str, top: int, every: int = 63, listed: str = "mask") -> DataFrame:
    """panel + ``member``: the ``top`` largest by ``size`` every ``every`` sessions, held in between.

    Only the rows of reconstitution sessions are ranked, and the limit right above the ranking lets Spark
    keep just ``top`` rows per date and task before their shuffle. Equal sizes go in ticker order.
    """
    out = panel.withColumn("_block", F.floor(F.col("pos") / every))
    chosen = out.where(F.col("pos") == F.col("_block") * every)
    best = Window.partitionBy("date").orderBy(F.col(size).desc_nulls_last(), "ticker")
    picks = chosen.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top)
    picks = picks.select("ticker", "_block", F.lit(True).alias("_pick"))
    out = out.join(picks, ["ticker", "_block"], "left")
    return out.withColumn("member", F.coalesce("_pick", F.lit(False)) & F.col(listed)).drop("_block", "_pick")


def concat_memberships(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*MEMBERSHIP.fieldNames())
    for p in parts[1:]:
        out = out.unionByName(p.select(*MEMBERSHIP.fieldNames()))
    return out
