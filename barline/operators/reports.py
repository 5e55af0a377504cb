"""Tables behind the reports, per trial, and catalogue queries over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import down
from .book import TRIAL
from .metrics import with_drawdown


def monthly_returns(daily: DataFrame, r: str = "net", by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, year, m1..m12, total): compounded by month, with the year's total.

    The month is the pivot, so its twelve values are known and no extra job looks for them.
    """
    parts = daily.select(*by, F.year("date").alias("year"), F.month("date").alias("month"), F.col(r).alias("r"))
    cells = [(F.product(F.when(F.col("month") == m, 1 + F.col("r"))) - 1).alias(f"m{m}") for m in range(1, 13)]
    return parts.groupBy(*by, "year").agg(*cells, (F.product(1 + F.col("r")) - 1).alias("total"))


def rolling_sharpe(daily: DataFrame, r: str = "net", n: int = 126, ppy: int = 252, by: Sequence[str] = TRIAL) -> DataFrame:
    w = down(by).rowsBetween(-(n - 1), Window.currentRow)
    sd = F.stddev_samp(r).over(w)
    value = F.try_divide(F.avg(r).over(w), F.when(sd > 0, sd)) * float(ppy) ** 0.5
    return daily.withColumn("rolling_sharpe", F.when(F.count(r).over(w) == n, value))


def growth_paths(daily: DataFrame, r: str = "net", by: Sequence[str] = TRIAL) -> DataFrame:
    """+ growth, benchmark_growth, drawdown."""
    w = down(by)
    out = daily.withColumns(
        {
            "growth": F.product(1 + F.col(r)).over(w),
            "benchmark_growth": F.product(1 + F.coalesce("benchmark", F.lit(0.0))).over(w),
        }
    )
    return with_drawdown(out, r, by)


def gross_exposure(daily: DataFrame) -> DataFrame:
    """+ exposure: gross weight after the overlay."""
    return daily.withColumn("exposure", F.col("gross") * F.col("scale"))


def top_rows(table: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    return table.orderBy(F.desc_nulls_last(column), *ties).limit(k)


def survivorship(prices: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """One row: tickers, ended early (10 days before the last date), years, and the two warnings.

    Tickers are reduced to their first and last date first; the overall range comes from those rows.
    """
    each = prices.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    whole = Window.partitionBy()
    # one row per ticker and calendar day pair: fold to last dates before looking at all of them
    by_last = each.groupBy("last").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    by_last = by_last.withColumn("end", F.max("last").over(whole))
    out = by_last.agg(
        F.sum("n").alias("n_tickers"),
        F.sum(F.when(F.col("last") < F.date_sub("end", 10), F.col("n")).otherwise(0)).alias("n_delisted"),
        (F.datediff(F.max("last"), F.min("first")) / 365.25).alias("years"),
    )
    has = F.lit(membership is not None and bool(membership.head(1)))
    return out.withColumns(
        {
            "has_membership": has,
            "warn_survivors": (F.col("years") >= 3) & (F.col("n_delisted") == 0),
            "warn_no_membership": ~has,
        }
    )


def refresh_start(prices: DataFrame) -> DataFrame:
    """One row: the day after the last stored date."""
    return prices.agg(F.date_add(F.max("date"), 1).alias("start"))
