"""Latest targets -> whole shares -> order lists, for many books at once (keyed by trial)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import as_column, div
from .book import TRIAL


def latest_decision(targets: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, date, ticker, weight): non-zero targets of the last flagged session that has any."""
    return _latest(_decided(targets, by), by)


def _decided(targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The targets of flagged sessions: (by, pos, date, ticker, weight)."""
    return targets.where(F.col("flag") & F.col("weight").isNotNull()).select(*by, "pos", "date", "ticker", "weight")


def _latest(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    last = decided.groupBy(*by).agg(F.max("pos").alias("pos"))
    rows = decided.join(last, [*by, "pos"], "left_semi")
    return rows.where(F.col("weight") != 0).select(*by, "date", "ticker", "weight")


def last_prices(panel: DataFrame, price: str | None = None) -> DataFrame:
    """(ticker, price): the last known traded price (adjusted if there is no traded one)."""
    column = price or ("raw_close" if "raw_close" in panel.columns else "close")
    known = panel.where(F.col(column).isNotNull())
    return known.groupBy("ticker").agg(F.max_by(column, "pos").alias("price"))


def _names_and_prices(panel: DataFrame) -> DataFrame:
    """:func:`last_prices` of every ticker of the panel, null where it never had one."""
    column = "raw_close" if "raw_close" in panel.columns else "close"
    return panel.groupBy("ticker").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("pos"))).alias("price"))


def final_scale(daily: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, scale): overlay scale of the last session, 0 while the breaker is on."""
    now = F.when(F.col("breaker"), 0.0).otherwise(F.col("scale"))
    return daily.groupBy(*by).agg(F.max_by(now, "pos").alias("scale"))


def target_shares(weights: DataFrame, prices: DataFrame, capital, by: Sequence[str] = TRIAL, scale: DataFrame | None = None) -> DataFrame:
    """(by, ticker, shares): whole shares, truncated toward zero; unpriced and zero positions drop out."""
    rows = weights if scale is None else weights.join(scale, list(by))
    factor = F.lit(1.0) if scale is None else F.col("scale")
    rows = rows.join(prices, "ticker", "left")
    shares = div(F.col("weight") * factor * as_column(capital), F.col("price")).cast("bigint")
    return rows.select(*by, "ticker", shares.alias("shares")).where(F.col("shares").isNotNull() & (F.col("shares") != 0))


def unpriced_targets(weights: DataFrame, prices: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    priced = prices.where(F.col("price").isNotNull()).select("ticker")
    return weights.where(F.col("weight") != 0).select(*by, "ticker").distinct().join(priced, "ticker", "left_anti")


def outside_data(holdings: DataFrame, panel: DataFrame) -> DataFrame:
    """Holdings in tickers the data does not know: reported and left alone."""
    return holdings.join(panel.select("ticker").distinct(), "ticker", "left_anti")


def managed_holdings(holdings: DataFrame, panel: DataFrame) -> DataFrame:
    return holdings.join(panel.select("ticker").distinct(), "ticker", "left_semi")


def diff_orders(current: DataFrame, target: DataFrame, prices: DataFrame, min_notional=0.0, by: Sequence[str] = TRIAL) -> DataFrame:
    """Orders that move ``current`` to ``target`` shares: (by, side, ticker, quantity, est_price, est_notional, nth).

    Full outer join of the two books; unpriced names, unchanged ones and trades below the minimum drop
    out. ``nth`` numbers each book's orders with sells first, so buys are funded.
    """
    keys = [*by, "ticker"]
    have = current.select(*keys, F.col("shares").cast("bigint").alias("_have"))
    want = target.select(*keys, F.col("shares").cast("bigint").alias("_want"))
    moves = have.join(want, keys, "full_outer")
    delta = F.coalesce("_want", F.lit(0)) - F.coalesce("_have", F.lit(0))
    moves = moves.withColumn("_delta", delta).where(F.col("_delta") != 0)
    moves = moves.join(prices, "ticker").where(F.col("price").isNotNull())
    quantity: Column = F.abs("_delta")
    orders = moves.select(
        *by,
        F.when(F.col("_delta") > 0, "BUY").otherwise("SELL").alias("side"),
        "ticker",
        quantity.alias("quantity"),
        F.col("price").alias("est_price"),
        (quantity * F.col("price")).alias("est_notional"),
    ).where(F.col("est_notional") >= min_notional)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("side"), "ticker"))
    return orders.withColumn("nth", nth)


def plan_orders(
    targets: DataFrame,
    panel: DataFrame,
    daily: DataFrame,
    current: DataFrame,
    capital: float,
    by: Sequence[str] = TRIAL,
    min_notional: float = 200.0,
) -> DataFrame:
    """Latest decision, scaled by the overlay, sized to capital, as orders against managed holdings.

    Targets and panel stand for long plans and are worked out once each: their decided rows and last prices, which are
    read several times, are kept.
    """
    names = _names_and_prices(panel).persist(StorageLevel.MEMORY_AND_DISK)
    made = _decided(targets, by).persist(StorageLevel.MEMORY_AND_DISK)
    prices = names.where(F.col("price").isNotNull())
    want = target_shares(_latest(made, by), prices, capital, by, final_scale(daily, by))
    # a book without a decision is left as it is
    have = managed_holdings(current, names).join(made.select(*by).distinct(), list(by), "left_semi")
    return diff_orders(have, want, prices, min_notional, by)


def undecided(targets: DataFrame, current: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """Books (by) that hold something and whose targets hold no decision: no orders are planned for them."""
    decided = targets.where(F.col("flag") & F.col("weight").isNotNull()).select(*by)
    return current.select(*by).distinct().join(decided, list(by), "left_anti")


@dataclass(frozen=True)
class OrderPlan:
    """Orders with what a reader of them should know."""

    orders: DataFrame
    decisions: DataFrame
    scale: DataFrame
    unpriced: DataFrame
    foreign: DataFrame
    undecided: DataFrame


def order_plan(
    targets: DataFrame, panel: DataFrame, daily: DataFrame, current: DataFrame, capital: float, by: Sequence[str] = TRIAL, min_notional: float = 200.0
) -> OrderPlan:
    """Orders of all books, the date each was decided, its overlay scale, and notes on unpriced targets, holdings
    the data does not know, and books without a decision. Refused if no book has a decision."""
    weights = latest_decision(targets, by)
    dates = targets.where(F.col("flag") & F.col("weight").isNotNull()).groupBy(*by).agg(F.max("date").alias("decided_on"))
    if not dates.head(1):
        raise ValueError("no decision in the targets: nothing to trade towards")
    prices = last_prices(panel)
    orders = plan_orders(targets, panel, daily, current, capital, by, min_notional)
    return OrderPlan(orders, dates, final_scale(daily, by), unpriced_targets(weights, prices, by), outside_data(current, panel), undecided(targets, current, by))
