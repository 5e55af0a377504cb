"""Raw price files: read, work out which column is what, reshape to the canonical price columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import finite
from ..operators.cleaning import as_prices, clean_prices, cleaning_report
from ..schema import PRICE_FIELDS

ORDER = ("_file", "_block", "_row")  # where a row stood in its input

# fixed values: column names (after normalising) that mark each role, in order of preference
SYNONYMS = {
    "date": ["date", "datetime", "timestamp", "time", "day", "trade_date", "tradedate", "dt", "asof"],
    "ticker": ["ticker", "symbol", "sym", "ric", "code", "instrument", "security", "stock", "tic", "bbg", "isin"],
    "open": ["open", "o", "px_open", "open_price"],
    "high": ["high", "h", "px_high", "high_price"],
    "low": ["low", "l", "px_low", "low_price"],
    "close": ["close", "c", "px_last", "last", "price", "close_price", "prc", "px_close", "settle"],
    "adj_close": ["adj_close", "adjclose", "adj", "adjusted_close", "close_adj", "adj_price", "adjusted"],
    "volume": ["volume", "vol", "v", "px_volume", "shares_traded", "qty"],
}

# fixed values: date layouts tried in turn when a mapping names none; a file keeps to one order of day and month
PLAIN_DATES = ["yyyy-M-d", "yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss", "yyyy/M/d", "yyyyMMdd"]
NAMED_MONTHS = ["d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy"]
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy", "M.d.yyyy"]


@dataclass(frozen=True)
class Mapping:
    """Which source column plays which role. ``wide`` files hold one ticker per column."""

    date: str
    ticker: str | None = None
    ticker_value: str | None = None
    open: str | None = None
    high: str | None = None
    low: str | None = None
    close: str | None = None
    adj_close: str | None = None
    volume: str | None = None
    wide: bool = False
    wide_field: str = "adj_close"
    date_format: str | None = None
    day_first: bool | None = None  # None: the order that reads more of a file's dates
    price_scale: float = 1.0

    def with_(self, **changes) -> "Mapping":
        return replace(self, **changes)


def normalise(name: str) -> str:
    """A column name as its lower-case words."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def header_separator(header: str) -> str:
    """The delimiter among , ; tab | that occurs most often in the header line."""
    counts = {sep: header.count(sep) for sep in (",", ";", "\t", "|")}
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


def _is_parquet(path: str) -> bool:
    return bool(re.search(r"\.(parquet|pq)/?$", path.lower()))


def text_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> the files that begin with it. One row per file comes to the driver, as its listing does."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    first = lines.where("b = 0").groupBy("f").agg(F.min_by("value", "i").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("f").collect():
        found.setdefault(row["header"].lstrip("\ufeff"), []).append(row["f"])
    return found


def read_raw_groups(spark: SparkSession, path: str) -> list[DataFrame]:
    """One frame per header among the files of ``path`` (see :func:`read_raw` for its columns)."""
    if _is_parquet(path):
        return [_placed(spark.read.parquet(path))]
    groups = text_headers(spark, path) or {"": [path]}
    return [_placed(spark.read.option("header", True).option("sep", header_separator(h)).csv(files)) for h, files in groups.items()]


def _placed(df: DataFrame) -> DataFrame:
    df = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or delimited text with a header (all columns as text), plus the ORDER columns.

    All files must share one header. Row numbers restart in every input split, and the split's offset
    orders the splits of a file.
    """
    groups = read_raw_groups(spark, path)
    if len(groups) > 1:
        raise ValueError(f"the files of {path} have {len(groups)} different headers; read them with read_raw_groups")
    return groups[0]


def source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ORDER]


def infer_mapping(df: DataFrame) -> Mapping:
    """Roles from column names; failing a price column, a wide file if all other columns are numeric."""
    columns = source_columns(df)
    known = {normalise(c): c for c in columns}
    found = {role: next((known[n] for n in names if n in known), None) for role, names in SYNONYMS.items()}
    if found["date"] is None:
        raise ValueError(f"could not find a date column among {columns}; pass a Mapping")
    if found["close"] or found["adj_close"]:
        return Mapping(**found)
    others = [c for c in columns if c != found["date"]]
    if found["ticker"] is None and len(others) >= 2:
        # one pass over the file for all columns at once
        shares = df.agg(*[F.avg(as_number(F.col(f"`{c}`")).isNotNull().cast("double")).alias(c) for c in others]).head()
        if all((share or 0.0) > 0.5 for share in shares):
            return Mapping(date=found["date"], wide=True)
    raise ValueError(f"could not find a close/price column among {columns}; pass a Mapping")


def as_number(c: Column, strip_commas: bool = False) -> Column:
    """Text to double, null when unreadable (Java would also read a trailing d or f as a number)."""
    text = F.trim(c.cast("string"))
    if strip_commas:
        text = F.regexp_replace(text, ",", "")
    return finite(F.when(~text.rlike("[dDfF]$"), text.try_cast("double")))


def _may_fit(text: Column, layout: str) -> Column:
    """What a text must have for one of the usual layouts to fit. A layout that doesn't fit costs a Java exception per text."""
    letters = text.rlike("[A-Za-z]")
    need = [letters if "MMM" in layout or "'T'" in layout else ~letters]
    need += [F.contains(text, F.lit(mark)) for mark in "-/.,:" if mark in layout]
    if layout[:5] in ("yyyy-", "yyyy/"):
        need.append(F.locate(layout[4], text, 2) > 4)  # a sign may come first
    return reduce(and_, need)


def _read_date(c: Column, layouts: list[str], usual: bool = True) -> Column:
    """Text to date by the first layout that fits; time of day and zone are dropped."""
    plain = F.trim(c.cast("string"))
    time = r"(\d{1,2}:\d{2}(:\d{2})?)(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    text = F.when(F.contains(plain, F.lit(":")), F.regexp_replace(plain, time, "$1")).otherwise(plain)
    read = lambda f: F.try_to_timestamp(text, F.lit(f))
    return F.coalesce(*(F.when(_may_fit(text, f), read(f)) if usual else read(f) for f in layouts)).cast("date")


def as_date(c: Column, date_format: str | None, day_first: bool | Column) -> Column:
    """Text to date by one format or the usual layouts; ``day_first`` says how a column of numbers reads."""
    if date_format:
        return _read_date(c, [date_format], usual=False)
    by_day, by_month = _read_date(c, DAY_FIRST), _read_date(c, MONTH_FIRST)
    if isinstance(day_first, Column):
        numeric = F.when(day_first, by_day).otherwise(by_month)
    else:
        numeric = by_day if day_first else by_month
    return F.coalesce(_read_date(c, PLAIN_DATES), numeric, _read_date(c, NAMED_MONTHS))


def with_day_first(df: DataFrame, column: str) -> DataFrame:
    """+ ``_day_first``: whether day/month/year reads more of the column's texts in the row's file than
    month/day/year does. Files in which both read alike are taken month first."""
    c = F.col(f"`{column}`")
    more = F.count(_read_date(c, DAY_FIRST)) > F.count(_read_date(c, MONTH_FIRST))
    if "_file" in df.columns:
        orders = df.groupBy(F.col("_file").alias("_f")).agg(more.alias("_day_first"))
        return df.join(orders, F.col("_file") == F.col("_f")).drop("_f")
    return df.withColumn("_day_first", F.lit(df.agg(more).head()[0]))


def unreadable_dates(raw: DataFrame, m: Mapping) -> DataFrame:
    """(_file, n_rows, n_unreadable): texts of the date column that no layout of their file reads."""
    rows = _dated(raw, m)
    stated = F.col(f"`{m.date}`").isNotNull() & (F.trim(F.col(f"`{m.date}`").cast("string")) != "")
    name = F.col("_file") if "_file" in raw.columns else F.lit("")
    return rows.groupBy(name.alias("_file")).agg(F.count("*").alias("n_rows"), F.count(F.when(stated & F.col("_date").isNull(), 1)).alias("n_unreadable"))


def _dated(df: DataFrame, m: Mapping) -> DataFrame:
    """+ ``_date``."""
    raw = F.col(f"`{m.date}`")
    if dict(df.dtypes)[m.date] in ("date", "timestamp", "timestamp_ntz"):
        return df.withColumn("_date", raw.cast("date"))
    if m.date_format or m.day_first is not None:
        return df.withColumn("_date", as_date(raw, m.date_format, bool(m.day_first)))
    return with_day_first(df, m.date).withColumn("_date", as_date(raw, None, F.col("_day_first"))).drop("_day_first")


def apply_mapping(df: DataFrame, m: Mapping, default_ticker: str | Column | None = None) -> DataFrame:
    """Canonical price columns (not cleaned yet) plus the ORDER columns the input has."""
    keep = [c for c in ORDER if c in df.columns]
    names = [c for c in source_columns(df) if c != m.date]
    df, date = _dated(df, m), F.col("_date")
    if m.wide:
        body = df.select(date.alias("date"), *keep, *[(as_number(F.col(f"`{c}`")) * m.price_scale).alias(c) for c in names])
        return as_prices(body.unpivot(["date", *keep], [f"`{c}`" for c in names], "ticker", m.wide_field))
    if m.ticker:
        ticker = F.col(f"`{m.ticker}`").cast("string")
    else:
        ticker = m.ticker_value or default_ticker
        if ticker is None:
            raise ValueError("file has no ticker column; set Mapping.ticker_value")
        ticker = ticker if isinstance(ticker, Column) else F.lit(ticker)
    fields = []
    for f in PRICE_FIELDS:
        source = getattr(m, f)
        if source:
            value = as_number(F.col(f"`{source}`"), strip_commas=True)
            fields.append((value if f == "volume" else value * m.price_scale).alias(f))
    return as_prices(df.select(date.alias("date"), ticker.alias("ticker"), *fields, *keep))


def file_stem() -> Column:
    """Name of the row's file without folder and extension."""
    return F.regexp_extract(F.col("_file"), r"([^/]+?)(\.[^./]*)?$", 1)


def ingest_prices(
    spark: SparkSession, path: str, mapping: Mapping | None = None, spike: float = 0.5
) -> tuple[DataFrame, Mapping | list[Mapping], DataFrame]:
    """Raw file or folder -> (clean canonical prices, mapping used, cleaning report).

    Files of different headers are mapped apart (the mappings then come as a list) and cleaned together.
    """
    groups = read_raw_groups(spark, path)
    used = [mapping or infer_mapping(raw) for raw in groups]
    parts = [apply_mapping(raw, m, default_ticker=file_stem()) for raw, m in zip(groups, used)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return clean_prices(rows, ORDER, spike), used[0] if len(used) == 1 else used, cleaning_report(rows, ORDER, spike)
