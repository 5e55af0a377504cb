"""Panel construction, calendar and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import reports
from ..operators.sessions import rebalance_flags, session_calendar
from ..sources.warehouse import Warehouse
from . import market as mk
from .registry import d, emit, n, query, r

PANEL = mk.panel_ctes()
KEY = f"{d('date')}, ticker"


@query(
    "p01_end_cut",
    mk.sql(mk.with_tables("prices"), f"SELECT {KEY}, {r('close')} FROM prices WHERE date <= DATE '1998-12-31'"),
)
def end_cut(spark, sf):
    return emit(P.select_prices(mk.prices(spark, sf), end="1998-12-31"), "date", "ticker", "close")


@query(
    "p02_liquidity_prefilter",
    mk.sql(
        mk.with_tables("prices"),
        f"SELECT {KEY}, {r('close')} FROM prices WHERE ticker IN "
        "(SELECT ticker FROM prices GROUP BY ticker HAVING max(close * volume) >= 36000)",
    ),
)
def liquidity_prefilter(spark, sf):
    return emit(P.ever_liquid(mk.prices(spark, sf), 36000), "date", "ticker", "close")


@query(
    "p03_session_grid",
    mk.sql(PANEL, f"SELECT {KEY}, {n('pos')}, {r('raw_close')} FROM panel"),
)
def session_grid(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "pos", "raw_close")


@query(
    "p04_adjusted_close",
    mk.sql(PANEL, f"SELECT {KEY}, {r('close')}, {r('raw_close')} FROM panel WHERE close IS NOT NULL"),
)
def adjusted_close(spark, sf):
    return emit(mk.panel(spark, sf).where(F.col("close").isNotNull()), "date", "ticker", "close", "raw_close")


@query("p05_p06_returns_through_halts", mk.sql(PANEL, f"SELECT {KEY}, {r('returns')} FROM panel"))
def returns_through_halts(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "returns")


@query(
    "p07_gap_break",
    mk.sql(mk.panel_ctes(universe=None, gap=2), f"SELECT {KEY}, {r('returns')} FROM panel"),
)
def gap_break(spark, sf):
    return emit(mk.panel(spark, sf, universe="all", max_gap_sessions=2), "date", "ticker", "returns")


@query(
    "p08_jump_break",
    mk.sql(mk.panel_ctes(source="rough", universe=None, with_meta=False), f"SELECT {KEY}, {r('returns')} FROM panel"),
)
def jump_break(spark, sf):
    return emit(P.build_panel(mk.rough_prices(spark, sf)), "date", "ticker", "returns")


@query(
    "p09_delisting_return",
    mk.sql(
        mk.panel_ctes(universe=None),
        f"SELECT {KEY}, {r('returns')}, {n('last_pos')} FROM panel WHERE pos > last_pos",
    ),
)
def delisting_return(spark, sf):
    grid = mk.panel(spark, sf, universe="all").where(F.col("pos") > F.col("last_pos"))
    return emit(grid, "date", "ticker", "returns", "last_pos")


@query(
    "p10_adjusted_sides",
    mk.sql(PANEL, f"SELECT {KEY}, {r('open')}, {r('high')}, {r('low')} FROM panel"),
)
def adjusted_sides(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "open", "high", "low")


@query("p11_vwap", mk.sql(PANEL, f"SELECT {KEY}, {r('vwap')} FROM panel"))
def vwap(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "vwap")


@query("p12_adv20", mk.sql(PANEL, f"SELECT {KEY}, {r('dollar_volume')}, {r('adv20')} FROM panel"))
def adv20(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "dollar_volume", "adv20")


FIELDS = ("sales", "order_size")


@query(
    "p13_j07_point_in_time_fields",
    mk.sql(
        mk.panel_ctes(fields=FIELDS),
        f"SELECT {KEY}, {r('sales', digits=2)}, {r('order_size')} FROM panel",
    ),
)
def point_in_time_fields(spark, sf):
    return emit(mk.panel(spark, sf, fields=FIELDS), "date", "ticker", "sales", "order_size", sales=2)


@query(
    "j08_staleness_limit",
    mk.sql(
        mk.panel_ctes(fields=FIELDS, stale=60),
        f"SELECT {KEY}, {r('sales', digits=2)}, {r('order_size')} FROM panel",
    ),
)
def staleness_limit(spark, sf):
    grid = mk.panel(spark, sf, fields=FIELDS, max_staleness_days=60)
    return emit(grid, "date", "ticker", "sales", "order_size", sales=2)


@query("p14_j09_tradable_mask", mk.sql(PANEL, f"SELECT {KEY}, {n('mask')} FROM panel"))
def tradable_mask(spark, sf):
    return emit(mk.panel(spark, sf), "date", "ticker", "mask")


@query(
    "p15_date_slice",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {n('pos - min(pos) OVER ()', 'pos')}, {r('returns')}, {r('adv20')} FROM panel "
        "WHERE date BETWEEN DATE '1997-02-03' AND DATE '1999-06-30'",
    ),
)
def date_slice(spark, sf):
    cut = P.slice_panel(mk.panel(spark, sf), "1997-02-03", "1999-06-30")
    return emit(cut, "date", "ticker", "pos", "returns", "adv20", adv20=6)


@query(
    "p15_start_is_cut_last",
    mk.sql(
        mk.panel_ctes(fields=FIELDS, universe=None),
        f"SELECT {KEY}, {n('pos - min(pos) OVER ()', 'pos')}, {r('returns')}, {r('order_size')}, {r('adv20')} "
        "FROM panel WHERE date >= DATE '1997-02-03'",
    ),
)
def start_is_cut_last(spark, sf):
    grid = mk.panel(spark, sf, universe="all", fields=FIELDS, start="1997-02-03")
    return emit(grid, "date", "ticker", "pos", "returns", "order_size", "adv20", adv20=6)


@query(
    "p16_liquidity_floor",
    mk.sql(PANEL, f"SELECT {KEY}, {n('mask AND coalesce(adv20 >= 9000, false)', 'mask')} FROM panel"),
)
def liquidity_floor(spark, sf):
    return emit(P.liquid_mask(mk.panel(spark, sf), 9000), "date", "ticker", "mask")


@query(
    "p17_catalogue",
    mk.sql(
        mk.with_tables("membership", "fundamentals", "meta"),
        "SELECT 'universe' AS kind, universe AS name FROM membership GROUP BY universe UNION ALL SELECT 'universe', 'all' "
        "UNION ALL SELECT 'field', field FROM fundamentals GROUP BY field "
        "UNION ALL SELECT 'field', unnest(['open', 'high', 'low', 'close', 'volume', 'returns', 'vwap', 'dollar_volume', 'adv20']) "
        "UNION ALL SELECT 'group', 'sector' WHERE (SELECT count(sector) FROM meta) > 0",
    ),
)
def catalogue(spark, sf):
    wh = Warehouse(spark, mk.folder(spark))
    wh.write("membership", mk.membership(spark, sf))
    wh.write("fundamentals", mk.fundamentals(spark, sf))
    wh.write("meta", mk.meta(spark, sf))
    return wh.catalogue()


@query(
    "p18_survivorship",
    mk.sql(
        mk.with_tables("prices")
        + [
            "each AS (SELECT ticker, min(date) AS a, max(date) AS b FROM prices GROUP BY ticker)",
            "one AS (SELECT count(*) AS n_tickers, sum((b < (SELECT max(b) FROM each) - 10)::INT) AS n_delisted, "
            "(max(b) - min(a)) / 365.25::DOUBLE AS years FROM each)",
        ],
        f"SELECT {n('n_tickers')}, {n('n_delisted')}, {r('years')}, {n('1', 'has_membership')}, "
        f"{n('years >= 3 AND n_delisted = 0', 'warn_survivors')}, {n('0', 'warn_no_membership')} FROM one",
    ),
)
def survivorship(spark, sf):
    return emit(reports.survivorship(mk.prices(spark, sf), mk.membership(spark, sf)))


@query(
    "p19_refresh_start",
    mk.sql(mk.with_tables("prices"), f"SELECT {d('max(date) + 1', 'start')} FROM prices"),
)
def refresh_start(spark, sf):
    return emit(reports.refresh_start(mk.prices(spark, sf)))


FLAGS_SQL = """flags AS (SELECT date, n_sessions, pos, true AS daily,
  date_trunc('week', nxt + 2) <> date_trunc('week', date + 2) AS weekly,
  date_trunc('month', nxt) <> date_trunc('month', date) AS monthly
  FROM (SELECT *, coalesce(lead(date) OVER (ORDER BY date),
    date + (CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INT) AS nxt FROM cal))"""


@query(
    "a01_rebalance_flags",
    mk.sql(
        [
            "cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS pos, count(*) OVER () AS n_sessions "
            "FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem))",
            FLAGS_SQL,
        ],
        f"SELECT {d('date')}, {n('daily')}, {n('weekly')}, {n('monthly')} FROM flags",
    ),
)
def flags(spark, sf):
    days = mk.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return emit(rebalance_flags(session_calendar(days)), "date", "daily", "weekly", "monthly")
