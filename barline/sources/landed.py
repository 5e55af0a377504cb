"""Market data landed as JSON pages: bars, splits, ticker reference, financial statements.

A page is one document with a ``results`` array. Reading is Spark's JSON source with a fixed schema;
the functions below turn pages into the canonical tables and take any DataFrame of that shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import finite
from ..operators.adjust import apply_splits
from ..schema import PRICES

# Bar keys differ only by case (t is the time, T the ticker), so a bar is read as a map.
BAR_PAGES = "status string, ticker string, results array<map<string,string>>"
SPLIT_PAGES = (
    "status string, results array<struct<ticker:string, execution_date:string, split_from:double, "
    "split_to:double, adjustment_type:string>>"
)
TICKER_PAGES = (
    "status string, results array<struct<ticker:string, name:string, primary_exchange:string, type:string, "
    "active:boolean, delisted_utc:string>>"
)

FILING_LAG_CAP_DAYS = 90  # fixed value: a figure counts as known at the latest this long after its period

# fixed values: statement keys and the field each becomes
INCOME_FIELDS = {
    "revenue": "revenue",
    "consolidated_net_income_loss": "net_income",
    "basic_earnings_per_share": "eps",
    "diluted_earnings_per_share": "eps_diluted",
    "diluted_shares_outstanding": "shares_outstanding",
}
BALANCE_FIELDS = {
    "total_equity": "total_equity",
    "total_assets": "total_assets",
    "total_liabilities": "total_liabilities",
    "cash_and_equivalents": "cash",
}


def _statement_pages(keys) -> str:
    figures = ", ".join(f"{k}:double" for k in keys)
    return f"status string, results array<struct<tickers:array<string>, filing_date:string, period_end:string, {figures}>>"


INCOME_PAGES = _statement_pages(INCOME_FIELDS)
BALANCE_PAGES = _statement_pages(BALANCE_FIELDS)


def read_pages(spark: SparkSession, path: str, layout: str, one_per_line: bool = True) -> DataFrame:
    return spark.read.schema(layout).option("multiLine", not one_per_line).json(path)


def bars(pages: DataFrame) -> DataFrame:
    """(date, ticker, open, high, low, close, volume); bars without a close are dropped."""
    request = F.col("ticker") if "ticker" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(request.alias("asked"), F.explode("results").alias("r"))
    figure = {name: finite(F.col("r")[key].try_cast("double")) for name, key in
              (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    at = F.timestamp_millis(F.col("r")["t"].try_cast("double").cast("bigint"))
    # dates are UTC days whatever the session's zone
    day = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")))
    return rows.where(F.col("r")["c"].isNotNull()).select(
        day.alias("date"),
        F.coalesce(F.col("asked"), F.col("r")["T"]).alias("ticker"),
        *[v.alias(k) for k, v in figure.items()],
    )


def splits(pages: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    rows = pages.select(F.inline("results"))
    if tickers:
        rows = rows.where(F.col("ticker").isin(list(tickers)))
    return rows.withColumn("execution_date", F.to_date("execution_date"))


def adjusted_bars(bar_pages: DataFrame, split_pages: DataFrame) -> DataFrame:
    """Canonical price rows: traded close kept, adj_close rebuilt from the splits."""
    return apply_splits(bars(bar_pages), splits(split_pages)).select(*PRICES.fieldNames())


def ticker_reference(pages: DataFrame, seq: Sequence[str] = ()) -> DataFrame:
    """One row per ticker (upper case) in meta's columns plus exchange and type.

    An active listing beats an inactive one, an earlier page (``seq`` columns) a later one.
    """
    rows = pages.select(*seq, F.posexplode("results").alias("nth", "r"))
    place = F.struct((~F.coalesce(F.col("r.active"), F.lit(True))).alias("retired"), *seq, "nth")
    best = rows.groupBy(F.upper("r.ticker").alias("ticker")).agg(F.min_by("r", place).alias("r"))
    delisted = F.try_to_timestamp(F.regexp_replace("r.delisted_utc", "[TZ]", " ")).cast("date")
    return best.select(
        "ticker",
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.lit(None).cast("string").alias("sector"),
        delisted.alias("delisted_date"),
        F.lit(None).cast("double").alias("delisting_return"),
        F.col("r.primary_exchange").alias("primary_exchange"),
        F.col("r.type").alias("type"),
    )


def _statement_rows(pages: DataFrame, names: dict[str, str], tickers: Sequence[str] | None) -> DataFrame:
    records = pages.select(F.explode("results").alias("r")).where(F.col("r.filing_date").isNotNull())
    records = records.select(F.explode("r.tickers").alias("ticker"), "r")
    if tickers:
        records = records.where(F.col("ticker").isin(list(tickers)))
    figures = F.array(*[F.struct(F.lit(name).alias("field"), F.col("r")[key].alias("value")) for key, name in names.items()])
    rows = records.select("ticker", "r.period_end", "r.filing_date", F.inline(figures))
    return rows.where(F.col("value").isNotNull())


def available(period_end: Column, filing_date: Column) -> Column:
    """A restated filing date never moves a figure later than the cap after its period."""
    return F.least(filing_date, F.date_add(period_end, FILING_LAG_CAP_DAYS))


def fundamentals(income: DataFrame, balance: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    rows = _statement_rows(income, INCOME_FIELDS, tickers).unionByName(_statement_rows(balance, BALANCE_FIELDS, tickers))
    rows = rows.withColumn("period_end", F.to_date("period_end"))
    rows = rows.withColumn("available_date", available(F.col("period_end"), F.to_date("filing_date")))
    # of several values under one key any single one may stay; the smallest keeps reruns identical
    return rows.groupBy("ticker", "field", "period_end", "available_date").agg(F.min("value").alias("value"))
