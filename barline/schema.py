"""The four canonical tables: column types, keys, and the column each is stored by."""

from __future__ import annotations

from pyspark.sql import types as T

PRICES = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")]
)
MEMBERSHIP = T.StructType(
    [
        T.StructField("universe", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)
FUNDAMENTALS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("period_end", T.DateType()),
        T.StructField("available_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)
META = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("delisted_date", T.DateType()),
        T.StructField("delisting_return", T.DoubleType()),
    ]
)

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")

TABLES = {"prices": PRICES, "membership": MEMBERSHIP, "fundamentals": FUNDAMENTALS, "meta": META}

KEYS = {
    "prices": ("date", "ticker"),
    "membership": ("universe", "ticker", "start_date"),
    "fundamentals": ("ticker", "field", "period_end", "available_date"),
    "meta": ("ticker",),
}

# Storage partition of each table. Every one is a function of the table's key, so a row and the
# row it replaces always land in the same partition and only touched partitions are rewritten.
PARTITIONS = {
    "prices": ("year", "year(date)"),
    "membership": ("universe_part", "universe"),
    "fundamentals": ("field_part", "field"),
    "meta": ("initial", "upper(substr(ticker, 1, 1))"),
}
