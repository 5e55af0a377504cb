"""Rolling, cross-sectional and element-wise functions over the dense panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crosssection as xs
from ..functions import elementwise as el
from ..functions import recursive, sliding
from ..functions import timeseries as ts
from . import market as mk
from .registry import d, emit, n, query, r

PANEL = mk.panel_ctes()
KEY = f"{d('date')}, ticker"
W = "(PARTITION BY ticker ORDER BY pos ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def whole(expr: str, x: str, size: int) -> str:
    """expr over full windows of x only; {w} stands for the frame."""
    w = W.format(size - 1)
    return f"CASE WHEN count({x}) OVER {w} = {size} THEN {expr.format(w=w)} END"


def rolling(name: str, fn, sql_expr: str, out: str = "value"):
    """Register a function of the panel's columns that yields one value per row."""

    @query(name, mk.sql(PANEL, f"SELECT {KEY}, {r(sql_expr, out)} FROM panel"))
    def run(spark, sf):
        return emit(mk.panel(spark, sf).withColumn(out, fn()), "date", "ticker", out)

    return run


RET, CLOSE = "returns", "close"
# windows of returns are filled through halts; windows of close need every session printed
rolling("w01_ts_mean", lambda: ts.ts_mean(F.col(RET), 5), whole("avg(returns) OVER {w}", RET, 5))
rolling("w02_ts_std", lambda: ts.ts_std(F.col(RET), 6), whole("stddev_samp(returns) OVER {w}", RET, 6))
rolling("w03_ts_sum", lambda: ts.ts_sum(F.col("volume"), 4), whole("sum(volume) OVER {w}", "volume", 4))
rolling("w04_ts_min", lambda: ts.ts_min(F.col(CLOSE), 5), whole("min(close) OVER {w}", CLOSE, 5))
rolling("w05_ts_max", lambda: ts.ts_max(F.col(CLOSE), 5), whole("max(close) OVER {w}", CLOSE, 5))


def ordered(name: str, kind: str, column: str, size: int, sql_expr: str):
    """Register a sliding order statistic of one column."""

    @query(name, mk.sql(PANEL, f"SELECT {KEY}, {r(whole(sql_expr, column, size), 'value')} FROM panel"))
    def run(spark, sf):
        grid = mk.panel(spark, sf).select("date", "pos", "ticker", column)
        return emit(sliding.with_order_statistics(grid, {"value": (kind, column, size)}), "date", "ticker", "value")

    return run


def placed(column: str, size: int) -> str:
    return (
        f"(len(list_filter(list({column}) OVER {{w}}, lambda y: y < {column})) + "
        f"(len(list_filter(list({column}) OVER {{w}}, lambda y: y = {column})) + 1) / 2) / {size}.0::DOUBLE"
    )


ordered("w06_ts_median", "median", RET, 8, "quantile_cont(returns, 0.5) OVER {w}")
ordered("w06_ts_median_long_window", "median", RET, 104, "quantile_cont(returns, 0.5) OVER {w}")
ordered("w07_ts_rank", "rank", CLOSE, 5, placed(CLOSE, 5))
ordered("w07_ts_rank_of_returns_long_window", "rank", RET, 52, placed(RET, 52))
rolling(
    "w08_ts_zscore",
    lambda: ts.ts_zscore(F.col(CLOSE), 6),
    f"({whole('close - avg(close) OVER {w}', CLOSE, 6)}) / nullif({whole('stddev_samp(close) OVER {w}', CLOSE, 6)}, 0)",
)
LAG = "lag({0}, {1}) OVER (PARTITION BY ticker ORDER BY pos)"
rolling("w09_ts_delay", lambda: ts.ts_delay(F.col(CLOSE), 4), LAG.format(CLOSE, 4))
rolling("w10_ts_delta", lambda: ts.ts_delta(F.col(CLOSE), 3), f"close - {LAG.format(CLOSE, 3)}")
rolling("w11_ts_return", lambda: ts.ts_return(F.col(CLOSE), 12), f"close / nullif({LAG.format(CLOSE, 12)}, 0) - 1")


@query(
    "w12_ts_corr",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, "
        + r(
            whole(
                "covar_samp(returns, volume) OVER {w} / nullif(stddev_samp(returns) OVER {w} * stddev_samp(volume) OVER {w}, 0)",
                "CASE WHEN returns IS NOT NULL AND volume IS NOT NULL THEN 1 END",
                6,
            ),
            "value",
        )
        + " FROM panel",
    ),
)
def ts_corr(spark, sf):
    grid = mk.panel(spark, sf).withColumn("value", ts.ts_corr(F.col("returns"), F.col("volume"), 6))
    return emit(grid, "date", "ticker", "value")


rolling(
    "w13_ts_skew",
    lambda: ts.ts_skew(F.col(RET), 10),
    whole("CASE WHEN min(returns) OVER {w} = max(returns) OVER {w} THEN 0 ELSE skewness(returns) OVER {w} END", RET, 10),
)
rolling(
    "w14_ts_decay_linear",
    lambda: ts.ts_decay_linear(F.col(CLOSE), 5),
    "(" + " + ".join([f"{5 - i} * " + (LAG.format(CLOSE, i) if i else "close") for i in range(5)]) + ") / 15",
)


# An exponential average with gaps: the old value decays over every session, then both weights are normalised.
def _ewm_sql(source: str, x: str, alpha: float, out: str) -> str:
    return (
        f"{out}_o AS (SELECT ticker, pos, {x} AS x, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS k, "
        f"pos - lag(pos) OVER (PARTITION BY ticker ORDER BY pos) AS g FROM {source} WHERE {x} IS NOT NULL),\n"
        f"{out} AS (SELECT ticker, pos, k, x AS y FROM {out}_o WHERE k = 1 UNION ALL "
        f"SELECT o.ticker, o.pos, o.k, (pow(1 - {alpha!r}, o.g) * e.y + {alpha!r} * o.x) / (pow(1 - {alpha!r}, o.g) + {alpha!r}) "
        f"FROM {out} e JOIN {out}_o o ON o.ticker = e.ticker AND o.k = e.k + 1)"
    )


def _carried(cte: str, size: int, alias: str) -> str:
    """The average at every session: last value so far once ``size`` observations are in."""
    over = "OVER (PARTITION BY p.ticker ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({cte}.y) {over} >= {size} THEN last_value({cte}.y IGNORE NULLS) {over} END AS {alias}"


def _recursive(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


@query(
    "w15_ema",
    _recursive(
        PANEL + [_ewm_sql("panel", "close", 2 / (6 + 1), "e")],
        f"SELECT {KEY}, {r('v', 'value')} FROM (SELECT p.date, p.ticker, {_carried('e', 6, 'v')} "
        "FROM panel p LEFT JOIN e ON e.ticker = p.ticker AND e.pos = p.pos)",
    ),
)
def ema(spark, sf):
    grid = mk.panel(spark, sf).select("date", "pos", "ticker", "close")
    return emit(recursive.with_averages(grid, {"value": ("ema", "close", 6)}), "date", "ticker", "value")


def rsi_ctes(window: int = 5) -> list[str]:
    """both_sides(date, ticker, a, b): the averages of rises and falls that make the RSI of ``panel``."""
    return [
        "moves AS (SELECT date, ticker, pos, close - lag(close) OVER (PARTITION BY ticker ORDER BY pos) AS m FROM panel)",
        "ups AS (SELECT *, greatest(m, 0) AS up, greatest(-m, 0) AS dn FROM moves WHERE m IS NOT NULL)",
        _ewm_sql("ups", "up", 1 / window, "u"),
        _ewm_sql("ups", "dn", 1 / window, "v"),
        f"both_sides AS (SELECT p.date, p.ticker, {_carried('u', window, 'a')}, {_carried('v', window, 'b')} FROM panel p "
        "LEFT JOIN u ON u.ticker = p.ticker AND u.pos = p.pos LEFT JOIN v ON v.ticker = p.ticker AND v.pos = p.pos)",
    ]


@query("w16_rsi", _recursive(PANEL + rsi_ctes(), f"SELECT {KEY}, {r('100 - 100 / (1 + a / nullif(b, 0))', 'value')} FROM both_sides"))
def rsi(spark, sf):
    grid = mk.panel(spark, sf).select("date", "pos", "ticker", "close")
    return emit(recursive.with_averages(grid, {"value": ("rsi", "close", 5)}), "date", "ticker", "value")


# -- across the members of a date --------------------------------------------------------
MEMBERS = PANEL + [
    "m AS (SELECT *, CASE WHEN mask THEN close END AS x, CASE WHEN mask THEN returns END AS rx FROM panel)"
]


def crossed(name: str, fn, sql_expr: str):
    @query(name, mk.sql(MEMBERS, f"SELECT {KEY}, {r(sql_expr, 'value')} FROM m"))
    def run(spark, sf):
        return emit(mk.panel(spark, sf).withColumn("value", fn()), "date", "ticker", "value")

    return run


crossed(
    "c01_rank",
    lambda: xs.rank(F.col("volume")),
    "CASE WHEN mask AND volume IS NOT NULL THEN (rank() OVER (PARTITION BY date, mask ORDER BY volume) + "
    "(count(*) OVER (PARTITION BY date, mask, volume) - 1) / 2) / (count(volume) OVER (PARTITION BY date, mask))::DOUBLE END",
)
crossed(
    "c02_zscore",
    lambda: xs.zscore(F.col("close")),
    "(x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0)",
)
crossed("c03_demean", lambda: xs.demean(F.col("close")), "x - avg(x) OVER (PARTITION BY date)")
crossed("c04_scale", lambda: xs.scale(F.col("returns")), "rx / nullif(sum(abs(rx)) OVER (PARTITION BY date), 0)")
crossed(
    "c05_winsorize",
    lambda: xs.winsorize(F.col("returns"), 1.0),
    "CASE WHEN rx IS NULL THEN NULL WHEN stddev_samp(rx) OVER (PARTITION BY date) IS NULL THEN rx ELSE "
    "greatest(least(rx, avg(rx) OVER (PARTITION BY date) + stddev_samp(rx) OVER (PARTITION BY date)), "
    "avg(rx) OVER (PARTITION BY date) - stddev_samp(rx) OVER (PARTITION BY date)) END",
)
crossed(
    "c06_group_neutralize",
    lambda: xs.group_neutralize(F.col("close"), "sector"),
    "x - avg(x) OVER (PARTITION BY date, coalesce(sector, '__none__'))",
)


@query(
    "c01_rank_of_rolling_return",
    mk.sql(
        PANEL
        + [
            f"s AS (SELECT *, close / nullif({LAG.format('close', 6)}, 0) - 1 AS mom FROM panel)",
            "k AS (SELECT *, CASE WHEN mask THEN mom END AS x FROM s)",
        ],
        f"SELECT {KEY}, "
        + r(
            "CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + "
            "(count(x) OVER (PARTITION BY date, x) - 1) / 2) / (count(x) OVER (PARTITION BY date))::DOUBLE END",
            "value",
        )
        + " FROM k",
    ),
)
def rank_of_rolling_return(spark, sf):
    grid = mk.panel(spark, sf).withColumn("mom", ts.ts_return(F.col("close"), 6))
    return emit(grid.withColumn("value", xs.rank(F.col("mom"))), "date", "ticker", "value")


# -- row by row -------------------------------------------------------------------------
X, Y = "returns", "(close - 100)"
RX, RY = F.col, lambda: F.col("close") - 100


@query(
    "e01_e04_abs_sign_log_sqrt",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {r('abs(returns)', 'a')}, {r('sign(returns)', 's')}, "
        f"{r('CASE WHEN returns > 0 THEN ln(returns) END', 'l')}, {r('CASE WHEN returns >= 0 THEN sqrt(returns) END', 'q')} FROM panel",
    ),
)
def unary(spark, sf):
    x = F.col("returns")
    grid = mk.panel(spark, sf).withColumns({"a": el.absolute(x), "s": el.sign(x), "l": el.log(x), "q": el.sqrt(x)})
    return emit(grid, "date", "ticker", "a", "s", "l", "q")


@query(
    "e05_e07_max_min_clip",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {r('greatest(returns, adv20)', 'hi')}, {r('least(returns, close)', 'lo')}, "
        f"{r('CASE WHEN returns IS NOT NULL THEN greatest(least(returns, 0.02), -0.01) END', 'c')} FROM panel",
    ),
)
def binary(spark, sf):
    x = F.col("returns")
    grid = mk.panel(spark, sf).withColumns(
        {"hi": el.larger(x, F.col("adv20")), "lo": el.smaller(x, F.col("close")), "c": el.clip(x, -0.01, 0.02)}
    )
    return emit(grid, "date", "ticker", "hi", "lo", "c")


@query(
    "e08_e10_where_missing",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {r('CASE WHEN coalesce(close > 101, false) THEN returns ELSE volume END', 'w')}, "
        f"{n('close IS NULL', 'm')}, {r('coalesce(returns, 7)', 'f')} FROM panel",
    ),
)
def selection(spark, sf):
    grid = mk.panel(spark, sf).withColumns(
        {
            "w": el.choose(el.gt(F.col("close"), 101), F.col("returns"), F.col("volume")),
            "m": el.is_missing(F.col("close")),
            "f": el.fill_missing(F.col("returns"), 7),
        }
    )
    return emit(grid, "date", "ticker", "w", "m", "f")


@query(
    "e11_e12_arithmetic",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {r('close + volume', 'a')}, {r('close - volume', 's')}, {r('close * returns', 'm')}, "
        f"{r('close / nullif(returns, 0)', 'q', 3)}, "
        f"{r('CASE WHEN returns > 0 THEN pow(returns, 0.5) WHEN returns = 0 THEN 0 END', 'p')}, "
        f"{r('-close', 'g')}, {r('coalesce(close > 100, false)::INT + 1', 'b')} FROM panel",
    ),
)
def arithmetic(spark, sf):
    c, v, x = F.col("close"), F.col("volume"), F.col("returns")
    grid = mk.panel(spark, sf).withColumns(
        {
            "a": el.add(c, v),
            "s": el.sub(c, v),
            "m": el.mul(c, x),
            "q": el.div(c, x),
            "p": el.power(x, 0.5),
            "g": el.neg(c),
            "b": el.add(el.gt(c, 100), 1),
        }
    )
    return emit(grid, "date", "ticker", "a", "s", "m", "q", "p", "g", "b", q=3)


@query(
    "e13_e14_comparison_and_logic",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {n('coalesce(close < 100, false)', 'lt')}, {n('coalesce(close <= raw_close, false)', 'le')}, "
        f"{n('coalesce(close > 100, false)', 'gt')}, {n('coalesce(close >= raw_close, false)', 'ge')}, "
        f"{n('coalesce(close = raw_close, false)', 'eq')}, {n('coalesce(close <> raw_close, true)', 'ne')}, "
        f"{n('coalesce(99 < close, false) AND coalesce(close < 101, false)', 'chained')}, "
        f"{n('coalesce(returns <> 0, false) AND NOT coalesce(adv20 > 5000, false)', 'an')}, "
        f"{n('coalesce(returns <> 0, false) OR mask', 'ob')} FROM panel",
    ),
)
def comparison(spark, sf):
    c, raw = F.col("close"), F.col("raw_close")
    grid = mk.panel(spark, sf).withColumns(
        {
            "lt": el.lt(c, 100),
            "le": el.le(c, raw),
            "gt": el.gt(c, 100),
            "ge": el.ge(c, raw),
            "eq": el.eq(c, raw),
            "ne": el.ne(c, raw),
            "chained": el.both(el.lt(F.lit(99), c), el.lt(c, 101)),
            "an": el.both(F.col("returns"), el.negate(el.gt(F.col("adv20"), 5000))),
            "ob": el.either(F.col("returns"), F.col("mask")),
        }
    )
    return emit(grid, "date", "ticker", "lt", "le", "gt", "ge", "eq", "ne", "chained", "an", "ob")


@query(
    "e15_e16_score_and_condition",
    mk.sql(
        PANEL,
        f"SELECT {KEY}, {r('CASE WHEN mask THEN close / nullif(returns, 0) END', 'score', 3)}, "
        f"{n('mask AND coalesce(returns > 0, false)', 'up')}, {n('mask', 'always')} FROM panel",
    ),
)
def outputs(spark, sf):
    grid = mk.panel(spark, sf).withColumns(
        {
            "score": el.score(el.div(F.col("close"), F.col("returns"))),
            "up": el.condition(el.gt(F.col("returns"), 0)),
            "always": el.condition(F.lit(1)),
        }
    )
    return emit(grid, "date", "ticker", "score", "up", "always", score=3)
