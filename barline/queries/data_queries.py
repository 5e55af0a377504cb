"""Scans, landed pages, raw-file mapping, cleaning, split adjustment, membership and joins."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..operators import adjust, cleaning, intervals, relate
from ..operators import panel as P
from ..schema import FUNDAMENTALS, MEMBERSHIP, PRICES
from ..sources import constituents, files, landed
from ..sources.warehouse import Warehouse, canonical, merge_upsert, read_or_empty
from . import market as mk
from .registry import d, emit, n, query, r

KEY = f"{d('date')}, ticker"
BARS = ("open", "high", "low", "close", "adj_close", "volume")
BAR_SQL = ", ".join(r(c) for c in BARS)


# -- scans -------------------------------------------------------------------------------
@query(
    "s01_scan_with_projection_and_filter",
    mk.sql(mk.with_tables("prices"), f"SELECT {KEY}, {r('close')} FROM prices WHERE date >= DATE '1999-01-01' AND volume > 10"),
)
def scan(spark, sf):
    """Prices stored by year, read back with columns and a row filter."""
    wh = Warehouse(spark, mk.folder(spark))
    wh.write("prices", mk.prices(spark, sf), "lines")
    recent = (F.col("date") >= F.lit("1999-01-01").cast("date")) & (F.col("volume") > 10)
    return emit(wh.read("prices", ["date", "ticker", "close"], recent))


@query(
    "s03_text_files_of_two_headers",
    mk.sql(
        mk.with_tables("prices"),
        f"SELECT {KEY}, {r('close')}, {r('CASE WHEN volume >= 20 THEN volume END', 'volume')} FROM prices",
    ),
)
def text_files(spark, sf):
    """One folder, two kinds of files: month-name dates with commas, month-first dates with semicolons."""
    rows = mk.prices(spark, sf)
    root = mk.folder(spark)
    busy, quiet = rows.where("volume >= 20"), rows.where("NOT coalesce(volume >= 20, false)")
    busy.select(F.date_format("date", "d-MMM-yyyy").alias("Trade Date"), F.col("ticker").alias("Symbol"), F.col("close").alias("PX_LAST"), F.col("volume").alias("Vol")).write.option("header", True).csv(f"{root}/a")
    quiet.select(F.col("ticker").alias("sym"), F.date_format("date", "MM/dd/yyyy").alias("day"), F.col("close").alias("price")).write.option("header", True).option("sep", ";").csv(f"{root}/b")
    groups = files.read_raw_groups(spark, f"{root}/*")
    parts = [files.apply_mapping(g, files.infer_mapping(g)) for g in groups]
    return emit(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], "date", "ticker", "close", "volume")


@query(
    "s02_absent_table_is_empty",
    mk.sql(mk.with_tables("prices"), "SELECT DISTINCT ticker FROM prices"),
)
def absent_table(spark, sf):
    members = read_or_empty(spark, f"{sf}/membership.parquet", MEMBERSHIP)
    return relate.difference(mk.prices(spark, sf), members)


# -- landed JSON pages ---------------------------------------------------------------------
def _text(c):
    return F.col(c).cast("string")


def _parsed(pages, layout):
    """Pages as they land: JSON text, parsed with the source's schema."""
    return pages.select(F.from_json("value", layout).alias("p")).select("p.*")


def bar_pages(spark, sf):
    bars = mk.prices(spark, sf)
    at = (F.unix_millis(F.col("date").cast("timestamp")) + 57_600_000).cast("string")
    bar = F.create_map(
        F.lit("T"), F.col("ticker"), F.lit("t"), at, F.lit("o"), _text("open"), F.lit("h"), _text("high"),
        F.lit("l"), _text("low"), F.lit("c"), _text("close"), F.lit("v"), _text("volume"),
    )
    no_close = F.create_map(F.lit("T"), F.col("ticker"), F.lit("t"), at, F.lit("o"), _text("open"))
    page = F.struct(F.lit("OK").alias("status"), F.array(bar, no_close).alias("results"))
    return _parsed(bars.select(F.to_json(page).alias("value")), landed.BAR_PAGES)


@query(
    "s05_bars_from_pages",
    mk.sql(
        mk.with_tables("prices"),
        f"SELECT {KEY}, {', '.join(r(c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM prices",
    ),
)
def bars_from_pages(spark, sf):
    return emit(landed.bars(bar_pages(spark, sf)), "date", "ticker", "open", "high", "low", "close", "volume")


def ticker_pages(spark, sf):
    """Every supplier on the active list but the indebted; the indebted and the richest on the retired one."""
    who = mk.table(spark, sf, "supplier").select(
        F.lower(mk.ticker("s_suppkey")).alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") < 12, "XNYS").otherwise("XNAS").alias("primary_exchange"),
        "s_acctbal",
    )
    listed = lambda active, gone: F.struct(
        "ticker", "name", "primary_exchange", F.lit("CS").alias("type"), F.lit(active).alias("active"), F.lit(gone).alias("delisted_utc")
    )
    rows = F.array_compact(
        F.array(
            F.when((F.col("s_acctbal") < 0) | (F.col("s_acctbal") > 8000), listed(False, "1999-12-31T00:00:00Z")),
            F.when(F.col("s_acctbal") >= 0, listed(True, None)),
        )
    )
    page = F.struct(F.lit("OK").alias("status"), rows.alias("results"))
    return _parsed(who.select(F.to_json(page).alias("value")), landed.TICKER_PAGES)


REFERENCE = [
    f"reference AS (SELECT {mk.TICKER.format('s_suppkey')} AS ticker, s_name AS name, "
    "CASE WHEN s_nationkey < 12 THEN 'XNYS' ELSE 'XNAS' END AS primary_exchange, 'CS' AS type, "
    "CASE WHEN s_acctbal < 0 THEN DATE '1999-12-31' END AS delisted_date FROM supplier)"
]


@query(
    "s06_keep_listed_bars",
    mk.sql(
        mk.with_tables("prices") + REFERENCE,
        f"SELECT {KEY}, {r('close')} FROM prices WHERE ticker IN (SELECT ticker FROM reference WHERE primary_exchange = 'XNYS')",
    ),
)
def keep_listed(spark, sf):
    reference = landed.ticker_reference(ticker_pages(spark, sf))
    return emit(relate.keep_listed(mk.prices(spark, sf), reference, ["XNYS"]), "date", "ticker", "close")


def split_pages(spark, sf):
    rows = mk.splits(spark, sf)
    event = F.struct("ticker", _text("execution_date").alias("execution_date"), "split_from", "split_to", F.lit("forward").alias("adjustment_type"))
    page = F.struct(F.lit("OK").alias("status"), F.array(event).alias("results"))
    return _parsed(rows.select(F.to_json(page).alias("value")), landed.SPLIT_PAGES)


@query(
    "s07_splits_from_pages",
    mk.sql(
        mk.with_tables("splits"),
        f"SELECT ticker, {d('execution_date')}, {r('split_from')}, {r('split_to')} FROM splits",
    ),
)
def splits_from_pages(spark, sf):
    return emit(landed.splits(split_pages(spark, sf)), "ticker", "execution_date", "split_from", "split_to")


@query(
    "s08_ticker_reference",
    mk.sql(REFERENCE, f"SELECT ticker, name, primary_exchange, type, {d('delisted_date')} FROM reference"),
)
def ticker_reference(spark, sf):
    rows = landed.ticker_reference(ticker_pages(spark, sf))
    return emit(rows, "ticker", "name", "primary_exchange", "type", "delisted_date")


def statement_pages(spark, sf):
    line = mk.table(spark, sf, "lineitem")
    figures = line.groupBy(F.date_trunc("quarter", "l_shipdate").alias("q"), F.col("l_suppkey").alias("k")).agg(
        F.sum("l_extendedprice").alias("sales"), F.max("l_quantity").alias("size"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    who = mk.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    rows = figures.join(who, "k").withColumn("end", F.last_day(F.add_months(F.to_date("q"), 2)))
    filed = F.when(F.col("size") < 50, F.date_add("end", F.lit(30) + 5 * F.col("s_nationkey")).cast("string"))
    common = [F.array(mk.ticker("k"), F.concat(mk.ticker("k"), F.lit(".B"))).alias("tickers"), filed.alias("filing_date"), F.col("end").cast("string").alias("period_end")]
    page = lambda *f: F.to_json(F.struct(F.lit("OK").alias("status"), F.array(F.struct(*common, *f)).alias("results"))).alias("value")
    income = rows.select(page(F.col("sales").alias("revenue"), F.when(F.col("lines") > 20, F.col("size")).alias("basic_earnings_per_share")))
    balance = rows.select(page(F.col("lines").alias("total_equity")))
    return _parsed(income, landed.INCOME_PAGES), _parsed(balance, landed.BALANCE_PAGES)


@query(
    "s09_fundamentals_from_statements",
    mk.sql(
        [
            "f AS (SELECT date_trunc('quarter', l_shipdate)::DATE AS q, l_suppkey AS k, sum(l_extendedprice) AS sales, "
            "max(l_quantity) AS size, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1, 2)",
            "g AS (SELECT f.*, last_day((q + INTERVAL 2 MONTH)::DATE) AS period_end, s_nationkey AS nk FROM f JOIN supplier ON s_suppkey = k)",
            "h AS (SELECT *, least(period_end + (30 + 5 * nk)::INT, period_end + 90) AS available_date FROM g WHERE size < 50)",
            "u AS (SELECT k, 'revenue' AS field, period_end, available_date, sales AS value FROM h UNION ALL "
            "SELECT k, 'eps', period_end, available_date, size FROM h WHERE lines > 20 UNION ALL "
            "SELECT k, 'total_equity', period_end, available_date, lines FROM h)",
        ],
        f"SELECT {mk.TICKER.format('k')} || suffix AS ticker, field, {d('period_end')}, {d('available_date')}, {r('value', digits=2)} "
        "FROM u CROSS JOIN (VALUES (''), ('.B')) v(suffix)",
    ),
)
def fundamentals_from_statements(spark, sf):
    income, balance = statement_pages(spark, sf)
    return emit(landed.fundamentals(income, balance), "ticker", "field", "period_end", "available_date", "value", value=2)


# -- constituent lists ----------------------------------------------------------------------
@query(
    "s10_interval_list",
    mk.sql(
        mk.with_tables("membership"),
        f"SELECT 'u' AS universe, ticker, {d('start_date')}, {d('end_date')} FROM membership",
    ),
)
def interval_list(spark, sf):
    rows = mk.membership(spark, sf).select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("Symbol"),
        _text("start_date").alias("Start Date"),
        _text("end_date").alias("End Date"),
    )
    rows = rows.unionByName(rows.withColumn("Start Date", F.lit("unknown")))
    return emit(constituents.membership_rows(constituents.tidy_columns(rows), "u"))


@query(
    "s11_ticker_only_list",
    f"SELECT 'u' AS universe, {mk.TICKER.format('s_suppkey')} AS ticker, CAST(current_date AS VARCHAR) AS start_date, "
    "NULL::VARCHAR AS end_date FROM supplier",
)
def ticker_only_list(spark, sf):
    rows = mk.table(spark, sf, "supplier").select(mk.ticker("s_suppkey").alias("name"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return emit(constituents.membership_rows(constituents.tidy_columns(rows), "u"))


# -- sinks: the rows they would store ----------------------------------------------------------
@query("k01_canonical_rows", mk.sql(mk.with_tables("prices"), f"SELECT {KEY}, {BAR_SQL} FROM prices"))
def canonical_rows(spark, sf):
    extra = mk.prices(spark, sf).withColumns({"note": F.lit("x"), "date": F.col("date").cast("timestamp_ntz")})
    return emit(canonical("prices", extra), "date", "ticker", *BARS)


@query(
    "k02_k04_keyed_upsert",
    mk.sql(
        mk.with_tables("fundamentals"),
        f"SELECT ticker, field, {d('period_end')}, {d('available_date')}, "
        + r("CASE WHEN period_end >= DATE '1999-01-01' THEN value * 1.1 ELSE value END", "value", 4)
        + " FROM fundamentals",
    ),
)
def keyed_upsert(spark, sf):
    old = mk.fundamentals(spark, sf)
    late = old.where(F.col("period_end") >= F.lit("1999-01-01").cast("date"))
    first = late.withColumns({"value": F.lit(0.0), "seq": F.lit(1)})
    last = late.withColumns({"value": F.col("value") * 1.1, "seq": F.lit(2)})
    merged = merge_upsert(old, first.unionByName(last), ["ticker", "field", "period_end", "available_date"], ["seq"])
    return emit(merged, *FUNDAMENTALS.fieldNames(), value=4)


@query(
    "k03_touched_years",
    mk.sql(
        mk.with_tables("prices"),
        f"SELECT {KEY}, {r('CASE WHEN year(date) IN (1998, 1999) THEN close * 2 ELSE close END', 'close')} FROM prices",
    ),
)
def touched_years(spark, sf):
    """New rows replace their keys inside the years they touch; other years' rows stay as stored."""
    wh = Warehouse(spark, mk.folder(spark))
    wh.write("prices", mk.prices(spark, sf), "first")
    new = mk.prices(spark, sf).where(F.year("date").isin(1998, 1999)).withColumn("close", F.col("close") * 2)
    wh.write("prices", new, "correction")
    return emit(wh.read("prices", ["date", "ticker", "close"]))


@query(
    "k02_null_keys_are_kept",
    mk.sql(
        mk.with_tables("meta"),
        "SELECT CASE WHEN ends_with(ticker, '1') THEN NULL ELSE sector END AS universe, ticker, "
        "CASE WHEN ends_with(ticker, '2') THEN '2001-01-01' END AS end_date FROM meta",
    ),
)
def null_keys(spark, sf):
    """Membership rows of a null universe survive the writing of others; null matches null."""
    wh = Warehouse(spark, mk.folder(spark))
    start, none = F.lit("1995-01-06").cast("date"), F.lit(None).cast("date")
    universe = F.when(~F.endswith(F.col("ticker"), F.lit("1")), F.col("sector"))
    rows = mk.meta(spark, sf).select(universe.alias("universe"), "ticker", start.alias("start_date"), none.alias("end_date"))
    wh.write("membership", rows, "first")
    ended = rows.where(F.endswith(F.col("ticker"), F.lit("2")) | F.endswith(F.col("ticker"), F.lit("1")))
    end = F.when(F.endswith(F.col("ticker"), F.lit("2")), F.lit("2001-01-01").cast("date"))
    wh.write("membership", ended.withColumn("end_date", end), "second")
    return emit(wh.read("membership"), "universe", "ticker", "end_date")


@query(
    "k05_ingest_log",
    mk.sql(
        mk.with_tables("meta", "fundamentals"),
        "SELECT 'meta' AS table, count(*)::BIGINT AS rows, 'one' AS source FROM meta UNION ALL SELECT 'fundamentals', count(*)::BIGINT, 'two' FROM fundamentals",
    ),
)
def ingest_log(spark, sf):
    wh = Warehouse(spark, mk.folder(spark))
    wh.write("meta", mk.meta(spark, sf), "one")
    wh.write("fundamentals", mk.fundamentals(spark, sf), "two")
    return wh.ingest_log().select("table", "rows", "source")


# -- mapping raw files --------------------------------------------------------------------------
def long_file(spark, sf):
    """The lines as a text file would hold them: day-first dates, thousands commas, unreadable cells."""
    line = mk.table(spark, sf, "lineitem")
    return line.select(
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("Trade Date"),
        F.concat(F.lit(" s"), _text("l_suppkey"), F.lit(" ")).alias("Symbol"),
        F.when(F.col("l_quantity") == 1, "-").otherwise(F.format_number("l_extendedprice", 2)).alias("PX_LAST"),
        F.format_number("l_quantity", 0).alias("Vol"),
    )


@query(
    "q01_q03_long_mapping",
    "SELECT CASE WHEN l_linenumber <> 7 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS date, "
    "'S' || l_suppkey::VARCHAR AS ticker, "
    + r("CASE WHEN l_quantity <> 1 THEN l_extendedprice * 0.01::DOUBLE END", "close")
    + ", "
    + r("l_quantity", "volume")
    + " FROM lineitem",
)
def long_mapping(spark, sf):
    raw = long_file(spark, sf)
    mapping = files.infer_mapping(raw).with_(day_first=True, price_scale=0.01)
    return emit(files.apply_mapping(raw, mapping), "date", "ticker", "close", "volume")


@query(
    "q02_s04_wide_mapping",
    "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_returnflag AS ticker, "
    + r("max(l_extendedprice) * 0.01::DOUBLE", "close")
    + ", "
    + r("max(l_extendedprice) * 0.01::DOUBLE", "adj_close")
    + " FROM lineitem GROUP BY 1, 2",
)
def wide_mapping(spark, sf):
    line = mk.table(spark, sf, "lineitem").withColumn("Date", F.to_date("l_shipdate"))
    wide = line.groupBy("Date").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_extendedprice").cast("string"))
    mapping = files.infer_mapping(wide).with_(price_scale=0.01)
    rows = files.apply_mapping(wide, mapping).where(F.col("close").isNotNull())
    return emit(rows, "date", "ticker", "close", "adj_close")


# -- cleaning -----------------------------------------------------------------------------------
ORDER_SQL = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_quantity DESC"
RULE_SQL = (
    "CASE WHEN date IS NULL OR ticker IN ('', 'NAN', 'NONE') THEN 'unparseable date/ticker' "
    "WHEN close IS NULL OR close <= 0 THEN 'missing/non-positive close' "
    "WHEN isodow(date) >= 6 THEN 'weekend date' END"
)
CLEAN = mk.with_tables("raw_rows") + [
    f"tagged AS (SELECT *, {RULE_SQL} AS rule FROM raw_rows)",
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY {ORDER_SQL}) AS back, "
    "count(*) OVER (PARTITION BY date, ticker) AS copies FROM tagged WHERE rule IS NULL)",
    "uniq AS (SELECT date, ticker, CASE WHEN open > 0 THEN open END AS open, CASE WHEN high > 0 THEN high END AS high, "
    "CASE WHEN low > 0 THEN low END AS low, close, adj_close, CASE WHEN volume >= 0 THEN volume END AS volume, copies "
    "FROM ranked WHERE back = 1)",
    "swp AS (SELECT * REPLACE (CASE WHEN high < low THEN low ELSE high END AS high, CASE WHEN high < low THEN high ELSE low END AS low), "
    "coalesce(high < low, false) AS swapped FROM uniq)",
    "tck AS (SELECT *, coalesce(abs(px / nullif(lag(px) OVER w, 0) - 1) > 0.5 AND abs(lead(px) OVER w / nullif(lag(px) OVER w, 0) - 1) < 0.1, false) "
    "AS bad_tick FROM (SELECT *, coalesce(adj_close, close) AS px FROM swp) WINDOW w AS (PARTITION BY ticker ORDER BY date))",
    "clean AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS ratio FROM tck WHERE NOT bad_tick)",
    "spl AS (SELECT *, adj_close IS NULL AND coalesce(list_min(list_transform([0.5, 1/3, 0.25, 0.2, 0.1, 2, 3, 4, 5, 10]::DOUBLE[], "
    "lambda k: abs(ratio / k - 1))) < 0.03, false) AS split_like FROM clean)",
]
COUNTS = [
    "counts AS (SELECT 'rows' AS kind, 'in' AS rule, count(*) AS n FROM tagged UNION ALL "
    "SELECT 'dropped', rule, count(*) FROM tagged WHERE rule IS NOT NULL GROUP BY rule UNION ALL "
    "SELECT 'dropped', 'duplicate (date, ticker)', sum(copies - 1) FROM uniq UNION ALL "
    "SELECT 'flagged', 'high < low (swapped)', sum(swapped::INT) FROM tck UNION ALL "
    "SELECT 'dropped', 'bad tick (spike that reverses next day)', sum(bad_tick::INT) FROM tck UNION ALL "
    "SELECT 'rows', 'out', count(*) FROM clean UNION ALL "
    "SELECT 'flagged', 'possible unadjusted split (no adj_close)', sum(split_like::INT) FROM spl)",
]
ROW_COLUMNS = ", ".join(f"x.{c}" for c in mk.RAW_ORDER)
EXAMPLES = [
    "lines AS (SELECT rule, ticker || ' ' || date::VARCHAR AS label, "
    f"row_number() OVER (PARTITION BY rule ORDER BY {ORDER_SQL.replace(' DESC', '')}) AS nth FROM tagged "
    "WHERE rule IN ('missing/non-positive close', 'weekend date') UNION ALL "
    "SELECT 'duplicate (date, ticker)', ticker || ' ' || date::VARCHAR, "
    f"row_number() OVER (ORDER BY {ORDER_SQL.replace(' DESC', '')}) FROM ranked WHERE back > 1 UNION ALL "
    "SELECT 'high < low (swapped)', ticker || ' ' || date::VARCHAR, row_number() OVER (ORDER BY ticker, date) FROM tck WHERE swapped UNION ALL "
    "SELECT 'bad tick (spike that reverses next day)', ticker || ' ' || date::VARCHAR, row_number() OVER (ORDER BY ticker, date) FROM tck WHERE bad_tick UNION ALL "
    "SELECT 'possible unadjusted split (no adj_close)', ticker || ' ' || date::VARCHAR, row_number() OVER (ORDER BY ticker, date) FROM spl WHERE split_like)",
    "examples AS (SELECT rule, string_agg(label, ', ' ORDER BY nth) AS examples FROM lines WHERE nth <= 5 GROUP BY rule)",
]


def _row_filter(name, fn, where):
    @query(
        name,
        mk.sql(mk.with_tables("raw_rows"), f"SELECT {KEY}, {r('close', digits=8)}, {n('l_orderkey')}, {n('l_linenumber')} FROM raw_rows WHERE {where}"),
    )
    def run(spark, sf):
        return emit(fn(mk.raw_rows(spark, sf)), "date", "ticker", "close", "l_orderkey", "l_linenumber", digits=8)


_row_filter("q04_drop_unparseable", cleaning.drop_unparseable, "date IS NOT NULL AND ticker NOT IN ('', 'NAN', 'NONE')")
_row_filter("q05_drop_bad_close", cleaning.drop_bad_close, "close > 0")
_row_filter("q06_drop_weekends", lambda x: cleaning.drop_weekends(x.where("date IS NOT NULL")), "date IS NOT NULL AND isodow(date) < 6")


@query(
    "q07_dedupe_keep_last",
    mk.sql(CLEAN, f"SELECT {KEY}, {r('close', digits=8)}, {n('l_orderkey')}, {n('copies')} FROM ranked WHERE back = 1"),
)
def dedupe(spark, sf):
    rows = mk.raw_rows(spark, sf).where(cleaning.first_broken_rule().isNull())
    last = cleaning.keep_last(rows, ["date", "ticker"], mk.RAW_ORDER, count="copies")
    return emit(last, "date", "ticker", "close", "l_orderkey", "copies", digits=8)


@query(
    "q08_q09_sides",
    mk.sql(CLEAN, f"SELECT {KEY}, {r('open')}, {r('high')}, {r('low')}, {r('volume')}, {n('swapped')} FROM swp"),
)
def sides(spark, sf):
    staged = cleaning.staged(mk.raw_rows(spark, sf), mk.RAW_ORDER)
    return emit(staged, "date", "ticker", "open", "high", "low", "volume", "swapped")


@query("q10_bad_ticks", mk.sql(CLEAN, f"SELECT {KEY}, {r('close', digits=8)}, {n('bad_tick')} FROM tck"))
def bad_ticks(spark, sf):
    return emit(cleaning.staged(mk.raw_rows(spark, sf), mk.RAW_ORDER), "date", "ticker", "close", "bad_tick", digits=8)


@query("q11_unadjusted_splits", mk.sql(CLEAN, f"SELECT {KEY}, {r('close', digits=8)}, {n('split_like')} FROM spl"))
def unadjusted_splits(spark, sf):
    kept = cleaning.staged(mk.raw_rows(spark, sf), mk.RAW_ORDER).where(~F.col("bad_tick"))
    return emit(cleaning.mark_unadjusted_splits(kept), "date", "ticker", "close", "split_like", digits=8)


@query(
    "q12_cleaning_report",
    mk.sql(
        CLEAN + COUNTS + EXAMPLES,
        f"SELECT kind, c.rule, {n('n')}, examples FROM counts c LEFT JOIN examples e ON e.rule = c.rule WHERE n > 0 OR kind = 'rows'",
    ),
)
def cleaning_report(spark, sf):
    return emit(cleaning.cleaning_report(mk.raw_rows(spark, sf), mk.RAW_ORDER), "kind", "rule", "n", "examples")


@query("q13_clean_prices", mk.sql(CLEAN, f"SELECT {KEY}, {', '.join(r(c, digits=8) for c in BARS)} FROM clean"))
def clean_prices(spark, sf):
    return emit(cleaning.clean_prices(mk.raw_rows(spark, sf), mk.RAW_ORDER), *PRICES.fieldNames(), digits=8)


# -- splits ---------------------------------------------------------------------------------------
NETTED = mk.with_tables("prices", "splits") + [
    "ratios AS (SELECT ticker, execution_date AS day, product(split_from / split_to) AS ratio FROM splits "
    "WHERE split_from > 0 AND split_to > 0 GROUP BY 1, 2)",
]
FACTORED = NETTED + [
    "factored AS (SELECT p.*, coalesce((SELECT product(ratio) FROM ratios s WHERE s.ticker = p.ticker AND s.day > p.date), 1) AS factor FROM prices p)"
]


@query(
    "j01_split_factor",
    mk.sql(FACTORED, f"SELECT {KEY}, {r('factor')} FROM factored"),
)
def split_factor(spark, sf):
    return emit(adjust.with_split_factor(mk.prices(spark, sf), mk.splits(spark, sf)), "date", "ticker", "factor")


@query(
    "j02_j03_netted_and_cumulative_ratios",
    mk.sql(
        NETTED,
        f"SELECT ticker, {d('day', 'date')}, {r('ratio')}, {r('product(ratio) OVER (PARTITION BY ticker ORDER BY day DESC)', 'cum')} FROM ratios",
    ),
)
def cumulative_ratios(spark, sf):
    return emit(adjust.cumulative_ratios(mk.splits(spark, sf)), "ticker", "date", "ratio", "cum")


@query(
    "j04_j06_apply_splits",
    mk.sql(FACTORED, f"SELECT {KEY}, {r('close * factor', 'adj_close')} FROM factored"),
)
def apply_splits(spark, sf):
    return emit(adjust.apply_splits(mk.prices(spark, sf), mk.splits(spark, sf)), "date", "ticker", "adj_close")


@query(
    "j05_rebase_history",
    mk.sql(
        NETTED,
        f"SELECT {KEY}, "
        + r(
            "CASE WHEN date < DATE '1998-01-02' THEN adj_close * coalesce((SELECT product(ratio) FROM ratios s "
            "WHERE s.ticker = p.ticker AND s.day > p.date AND s.day >= DATE '1998-01-02'), 1) ELSE adj_close END",
            "adj_close",
        )
        + " FROM prices p",
    ),
)
def rebase_history(spark, sf):
    rows = adjust.readjust_history(mk.prices(spark, sf), mk.splits(spark, sf), "1998-01-02")
    return emit(rows, "date", "ticker", "adj_close")


# -- joins ------------------------------------------------------------------------------------------
@query(
    "j10_universe_restriction",
    mk.sql(
        mk.with_tables("prices", "membership"),
        f"SELECT {KEY}, {r('close')} FROM prices WHERE ticker IN (SELECT ticker FROM membership WHERE universe = 'idx')",
    ),
)
def universe_restriction(spark, sf):
    return emit(P.ever_members(mk.prices(spark, sf), mk.membership(spark, sf), "idx"), "date", "ticker", "close")


@query(
    "j11_ticker_list",
    mk.sql(mk.with_tables("prices"), f"SELECT {KEY}, {r('close')} FROM prices WHERE ticker IN ('S000001', 'S000004', 'S000007')"),
)
def ticker_list(spark, sf):
    return emit(P.restrict_tickers(mk.prices(spark, sf), ["S000001", "S000004", "S000007"]), "date", "ticker", "close")


@query(
    "j12_group_label",
    mk.sql(
        mk.with_tables("prices", "meta"),
        f"SELECT {KEY.replace('ticker', 'p.ticker')}, coalesce(sector, '__none__') AS sector FROM prices p LEFT JOIN meta m ON m.ticker = p.ticker",
    ),
)
def group_label(spark, sf):
    return emit(relate.attach_group(mk.prices(spark, sf), mk.meta(spark, sf), fill=True), "date", "ticker", "sector")


@query(
    "j13_sector_carry_over",
    mk.sql(mk.with_tables("meta"), "SELECT ticker, name, coalesce(sector, name) AS sector FROM meta"),
)
def sector_carry_over(spark, sf):
    old = mk.meta(spark, sf)
    return emit(relate.carry_sectors(old.withColumn("sector", F.col("name")), old), "ticker", "name", "sector")


@query(
    "j14_meta_for_priced",
    mk.sql(
        mk.with_tables("prices", "meta"),
        "SELECT t.ticker, m.name, m.sector FROM (SELECT DISTINCT ticker FROM prices) t LEFT JOIN (SELECT * FROM meta WHERE sector IS NOT NULL) m ON m.ticker = t.ticker",
    ),
)
def meta_for_priced(spark, sf):
    known = mk.meta(spark, sf).where(F.col("sector").isNotNull())
    return emit(relate.meta_for_priced(mk.prices(spark, sf), known), "ticker", "name", "sector")


@query(
    "j15_constituents_without_prices",
    mk.sql(mk.with_tables("snapshots", "prices"), "SELECT DISTINCT ticker FROM snapshots WHERE ticker NOT IN (SELECT ticker FROM prices)"),
)
def constituents_without_prices(spark, sf):
    return relate.without_prices(mk.snapshots(spark, sf), mk.prices(spark, sf))


@query(
    "x01_union",
    mk.sql(mk.with_tables("prices", "rough"), f"SELECT {KEY}, {r('close')} FROM prices UNION ALL SELECT {KEY}, {r('close')} FROM rough"),
)
def union(spark, sf):
    return emit(relate.union_all(mk.prices(spark, sf), mk.rough_prices(spark, sf)), "date", "ticker", "close")


@query(
    "x02_difference",
    mk.sql(
        mk.with_tables("prices", "membership"),
        "SELECT DISTINCT ticker FROM prices WHERE ticker NOT IN (SELECT ticker FROM membership WHERE start_date < DATE '1998-01-01')",
    ),
)
def difference(spark, sf):
    early = mk.membership(spark, sf).where(F.col("start_date") < F.lit("1998-01-01").cast("date"))
    return relate.difference(mk.prices(spark, sf), early)


@query(
    "x03_index_union",
    mk.sql(
        mk.with_tables("prices", "fundamentals"),
        f"SELECT ticker, {d('day', 'date')}, {n('max(traded)', 'traded')}, {n('max(published)', 'published')} FROM "
        "(SELECT ticker, date AS day, 1 AS traded, 0 AS published FROM prices UNION ALL SELECT ticker, available_date, 0, 1 FROM fundamentals) GROUP BY ticker, day",
    ),
)
def index_union(spark, sf):
    """The days on which anything is known of a ticker: traded sessions and days of publication."""
    published = mk.fundamentals(spark, sf).select("ticker", F.col("available_date").alias("date"))
    return emit(relate.index_union({"traded": mk.prices(spark, sf), "published": published}, ["ticker", "date"]), "ticker", "date", "traded", "published")


@query(
    "x04_distinct",
    mk.sql(mk.with_tables("fundamentals"), "SELECT DISTINCT ticker, field FROM fundamentals"),
)
def distinct(spark, sf):
    return mk.fundamentals(spark, sf).select("ticker", "field").distinct()


# -- membership intervals ------------------------------------------------------------------------------
SPANS = f"universe, ticker, {d('start_date')}, {d('end_date')}"


@query(
    "u01_first_bar_to_delisting",
    mk.sql(
        mk.with_tables("prices", "meta"),
        f"SELECT 'all' AS universe, p.ticker, {d('min(date)', 'start_date')}, {d('any_value(delisted_date)', 'end_date')} "
        "FROM prices p LEFT JOIN meta m ON m.ticker = p.ticker GROUP BY p.ticker",
    ),
)
def first_bar_to_delisting(spark, sf):
    return emit(intervals.intervals_from_prices(mk.prices(spark, sf), mk.meta(spark, sf), "all"))


@query(
    "u02_snapshots_to_intervals",
    mk.sql(
        mk.with_tables("snapshots")
        + [
            "dates AS (SELECT date, row_number() OVER (ORDER BY date) AS nth, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM snapshots))",
            "islands AS (SELECT ticker, s.date, nth, nxt, nth - row_number() OVER (PARTITION BY ticker ORDER BY nth) AS island "
            "FROM snapshots s JOIN dates USING (date))",
            "spans AS (SELECT 'snap' AS universe, ticker, min(date) AS start_date, (arg_max(nxt, nth) - 1)::DATE AS end_date FROM islands GROUP BY ticker, island)",
        ],
        # arg_max skips nulls, so the open interval is told by the last snapshot of all
        "SELECT universe, ticker, CAST(min(i.date) AS VARCHAR) AS start_date, "
        "CASE WHEN max(nth) < (SELECT max(nth) FROM dates) THEN CAST(CAST(arg_max(nxt, nth) - 1 AS DATE) AS VARCHAR) END AS end_date "
        "FROM (SELECT 'snap' AS universe, * FROM islands) i GROUP BY universe, ticker, island",
    ),
)
def snapshots_to_intervals(spark, sf):
    return emit(intervals.intervals_from_snapshots(mk.snapshots(spark, sf), "snap"))


@query(
    "u03_flags_to_intervals",
    mk.sql(
        mk.panel_ctes()
        + [
            "on_days AS (SELECT *, pos - row_number() OVER (PARTITION BY ticker ORDER BY pos) AS island FROM panel WHERE mask)",
            "spans AS (SELECT 'flag' AS universe, ticker, min(date) AS start_date, CASE WHEN max(pos) < max(n_sessions) - 1 THEN max(date) END AS end_date "
            "FROM on_days GROUP BY ticker, island)",
        ],
        f"SELECT {SPANS} FROM spans",
    ),
)
def flags_to_intervals(spark, sf):
    grid = mk.panel(spark, sf)
    days = P.panel_calendar(grid).select("pos", "n_sessions")
    return emit(intervals.intervals_from_flags(grid.join(F.broadcast(days), "pos"), "mask", "flag"))


@query(
    "u04_top_n_reconstitution",
    mk.sql(
        mk.panel_ctes()
        + [
            "k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY dollar_volume DESC NULLS LAST, ticker) AS place, pos // 13 AS block FROM panel)",
            "h AS (SELECT *, first_value(place <= 30) OVER (PARTITION BY ticker, block ORDER BY pos) AS held FROM k)",
        ],
        f"SELECT {KEY}, {n('held AND mask', 'member')} FROM h",
    ),
)
def top_n_reconstitution(spark, sf):
    return emit(intervals.reconstituted(mk.panel(spark, sf), "dollar_volume", 30, 13), "date", "ticker", "member")
