"""Construction, book accounting, overlay and the composed backtest.

The checking SQL walks the sessions one by one with the whole book as a list, which is an independent
way to the same numbers: the Spark side never walks sessions over tickers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elementwise as el
from ..functions import timeseries as ts
from ..operators import book as bk
from ..operators import construct, overlay, reports
from ..plans.backtest import run_backtest
from ..plans.strategy import dip_buyer, momentum
from . import market as mk
from .panel_queries import FLAGS_SQL
from .registry import d, emit, n, query, r
from .signal_queries import rsi_ctes

KEY = f"{d('date')}, ticker"
LAG = "lag(close, {0}) OVER (PARTITION BY ticker ORDER BY pos)"


# -- scores ---------------------------------------------------------------------------------
def scored(spark, sf):
    """The panel with a six-session return as score, and the deviation of six returns."""
    grid = mk.panel(spark, sf).withColumns(
        {"_mom": ts.ts_return(F.col("close"), 6), "inverse_vol": construct.inverse_vol(F.col("returns"), 6)}
    )
    return grid.withColumn("score", el.score(F.col("_mom"))).drop("_mom")


SCORED = mk.panel_ctes() + [
    f"s0 AS (SELECT *, close / nullif({LAG.format(6)}, 0) - 1 AS mom, "
    "CASE WHEN count(returns) OVER w = 6 THEN 1 / nullif(stddev_samp(returns) OVER w, 0) END AS inverse_vol FROM panel "
    "WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))",
    "scored AS (SELECT *, CASE WHEN mask THEN mom END AS score FROM s0)",
]


def leg_ctes(source: str, q: str = "0.2::DOUBLE", by: str = "date", keep: str = "leg") -> list[str]:
    return [
        f"placed AS (SELECT *, count(score) OVER (PARTITION BY {by}) AS n, "
        f"CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY score NULLS LAST) + "
        f"(count(*) OVER (PARTITION BY {by}, score) - 1) / 2) / (count(score) OVER (PARTITION BY {by}))::DOUBLE END AS pct FROM {source})",
        f"legs0 AS (SELECT *, CASE WHEN pct > 1 - greatest({q}, 1 / greatest(n, 1)::DOUBLE) THEN 1 "
        f"WHEN pct <= greatest({q}, 1 / greatest(n, 1)::DOUBLE) THEN -1 END AS leg FROM placed)",
        f"legs AS (SELECT * REPLACE ({keep} AS leg) FROM legs0)",
    ]


def weight_ctes(raw: str, share: float, cap: float, by: str = "date", rounds: int = 8, decided: str = "max(leg IS NOT NULL)") -> list[str]:
    """legs -> weighted(weight): normalise each leg, pass excess on, clip."""
    leg = f"(PARTITION BY {by}, leg)"
    ctes = [
        f"rw AS (SELECT *, CASE WHEN leg IS NOT NULL THEN {raw} END AS raw FROM legs)",
        f"w0 AS (SELECT *, raw / nullif(sum(raw) OVER {leg}, 0) * {share}::DOUBLE AS w FROM rw)",
    ]
    for i in range(rounds):
        ctes.append(
            f"w{i + 1} AS (SELECT * REPLACE (CASE WHEN coalesce(w > {cap}::DOUBLE, false) THEN {cap}::DOUBLE ELSE "
            f"w / nullif(sum(CASE WHEN w <= {cap}::DOUBLE THEN w END) OVER {leg}, 0) * "
            f"greatest({share}::DOUBLE - count(CASE WHEN w > {cap}::DOUBLE THEN 1 END) OVER {leg} * {cap}::DOUBLE, 0) END AS w) FROM w{i})"
        )
    ctes.append(
        f"weighted AS (SELECT *, CASE WHEN {decided} OVER (PARTITION BY {by}) THEN "
        f"CASE WHEN leg IS NOT NULL AND w IS NOT NULL THEN leg * least(w, {cap}::DOUBLE) ELSE 0 END END AS weight FROM w{rounds})"
    )
    return ctes


@query("b01_quantile_legs", mk.sql(SCORED + leg_ctes("scored"), f"SELECT {KEY}, {r('score')}, {n('coalesce(leg, 0)', 'leg')} FROM legs"))
def quantile_legs(spark, sf):
    out = construct.with_quantile_legs(scored(spark, sf), 0.2, 0.2)
    return emit(out.withColumn("leg", F.coalesce("leg", F.lit(0))), "date", "ticker", "score", "leg")


def weights_query(name, *, direction="long_short", weighting="equal", raw="1::DOUBLE", cap=0.1, keep="leg", q=0.2):
    share = 0.5 if direction == "long_short" else 1.0
    ctes = SCORED + leg_ctes("scored", f"{q}::DOUBLE", keep=keep) + weight_ctes(raw, share, cap)

    @query(name, mk.sql(ctes, f"SELECT {KEY}, {r('weight')} FROM weighted"))
    def run(spark, sf):
        out = construct.target_weights(
            scored(spark, sf), direction=direction, weighting=weighting, long_q=q, short_q=q, max_weight=cap
        )
        return emit(out, "date", "ticker", "weight")

    return run


MEDIAN = "abs(score - median(score) OVER (PARTITION BY date)) + 1e-12"
weights_query("b02_long_only", direction="long_only", keep="CASE WHEN leg > 0 THEN leg END")
weights_query("b02_short_only", direction="short_only", keep="CASE WHEN leg < 0 THEN leg END")
weights_query("b03_b06_b09_equal_weights")
weights_query("b04_b07_signal_weights_capped", weighting="signal", raw=MEDIAN, cap=0.06)
weights_query("b05_b07_inverse_vol_capped", weighting="inverse_vol", raw="inverse_vol", cap=0.05, q=0.4)


# -- rules ----------------------------------------------------------------------------------
def ruled(spark, sf):
    grid = scored(spark, sf)
    x = F.col("returns")
    return grid.withColumns(
        {
            "enter_long": el.condition(el.gt(x, 0.05)),
            "exit_long": el.condition(el.lt(x, -0.02)),
            "enter_short": el.condition(el.lt(x, -0.05)),
            "exit_short": el.condition(el.gt(x, 0.02)),
        }
    )


RULED = SCORED + [
    "ruled AS (SELECT *, mask AND coalesce(returns > 0.05, false) AS enter_long, mask AND coalesce(returns < -0.02, false) AS exit_long, "
    "mask AND coalesce(returns < -0.05, false) AS enter_short, mask AND coalesce(returns > 0.02, false) AS exit_short FROM scored)"
]
ONE_SIDED = RULED + [
    "sided AS (SELECT *, coalesce(last_value(CASE WHEN NOT mask THEN 0 WHEN enter_long THEN 1 WHEN exit_long THEN 0 END IGNORE NULLS) "
    "OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS side FROM ruled)"
]


@query("b10_one_sided_positions", mk.sql(ONE_SIDED, f"SELECT {KEY}, {n('side')} FROM sided"))
def one_sided(spark, sf):
    out = construct.one_sided_positions(ruled(spark, sf), F.col("enter_long"), F.col("exit_long"))
    return emit(out, "date", "ticker", "side")


@query(
    "b10_two_sided_positions",
    "WITH RECURSIVE "
    + ",\n".join(
        RULED
        + [
            "steps AS (SELECT ticker, -1 AS pos, 0 AS side, NULL::DATE AS date FROM (SELECT DISTINCT ticker FROM ruled) UNION ALL "
            "SELECT u.ticker, u.pos, CASE WHEN p.side = 1 AND mask AND NOT exit_long THEN 1 WHEN p.side = -1 AND mask AND NOT exit_short THEN -1 "
            "WHEN enter_long THEN 1 WHEN enter_short THEN -1 ELSE 0 END, u.date FROM steps p JOIN ruled u ON u.ticker = p.ticker AND u.pos = p.pos + 1)"
        ]
    )
    + f"\nSELECT {KEY}, {n('side')} FROM steps WHERE pos >= 0",
)
def two_sided(spark, sf):
    out = construct.two_sided_positions(
        ruled(spark, sf).select("date", "pos", "ticker", "mask", "enter_long", "exit_long", "enter_short", "exit_short"),
        "enter_long",
        "exit_long",
        "enter_short",
        "exit_short",
    )
    return emit(out, "date", "ticker", "side")


@query(
    "b08_rules_weights",
    mk.sql(
        ONE_SIDED
        + ["legs AS (SELECT *, CASE WHEN side <> 0 THEN side END AS leg FROM sided)"]
        + weight_ctes("1::DOUBLE", 1.0, 0.05, rounds=0, decided="max(score IS NOT NULL)"),
        f"SELECT {KEY}, {r('weight')} FROM weighted",
    ),
)
def rules_weights(spark, sf):
    held = construct.one_sided_positions(ruled(spark, sf), F.col("enter_long"), F.col("exit_long"))
    out = construct.target_weights(held, mode="rules", direction="long_only", max_weight=0.05)
    return emit(out, "date", "ticker", "weight")


# -- book ---------------------------------------------------------------------------------------
CONFIG = bk.BookConfig(commission_bps=2, slippage_bps=8, borrow_bps_annual=100, periods_per_year=52, ic_horizon=3)


def targets(spark, sf):
    rows = construct.target_weights(scored(spark, sf)).withColumn("trial", F.lit(0).cast("bigint"))
    return bk.with_flags(rows, "monthly")


def book(spark, sf, **changes):
    return bk.run_book(targets(spark, sf), bk.BookConfig(**{**CONFIG.__dict__, **changes}))


def walk_ctes(lag: int = 1) -> list[str]:
    """weighted(trial, pos, ticker, weight, go, ...) -> walk(trial, pos, w, pnl, turnover): a day-by-day book of lists."""
    at = "list_transform(range(1, len({0}) + 1), lambda i: {1})"
    drift = at.format("w", "CASE WHEN dead[i] THEN 0 WHEN pnl > -1 THEN w[i] * (1 + ret[i]) / (1 + pnl) ELSE w[i] END")
    fill = at.format("v", "CASE WHEN tgt IS NOT NULL AND tr[i] THEN tgt[i] ELSE v[i] END")
    moved = f"list_sum({at.format('v', 'abs(x[i] - v[i])')})"
    return [
        "days AS (SELECT trial, pos, any_value(date) AS date, list(coalesce(returns, 0) ORDER BY ticker) AS ret, "
        "list(close IS NOT NULL ORDER BY ticker) AS tr, list(pos > last_pos ORDER BY ticker) AS dead FROM weighted GROUP BY trial, pos)",
        f"goals AS (SELECT trial, pos + {lag} AS pos, list(weight ORDER BY ticker) AS tgt FROM weighted WHERE go AND weight IS NOT NULL GROUP BY trial, pos)",
        "walk AS (SELECT trial, -1 AS pos, list_transform(ret, lambda q: 0::DOUBLE) AS w, 0::DOUBLE AS pnl, 0::DOUBLE AS turnover, NULL::DATE AS date FROM days WHERE pos = 0 "
        f"UNION ALL SELECT trial, pos, x AS w, pnl, {moved} AS turnover, date FROM (SELECT *, {fill} AS x FROM (SELECT *, {drift} AS v FROM "
        "(SELECT k.trial, dd.pos, dd.date, k.w, ret, tr, dead, tgt, list_dot_product(k.w, ret) AS pnl FROM walk k JOIN days dd ON dd.trial = k.trial AND dd.pos = k.pos + 1 "
        "LEFT JOIN goals g ON g.trial = dd.trial AND g.pos = dd.pos)))) ",
    ]


def recursive(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def flagged(source: str, freq: str) -> str:
    return f"go AS (SELECT t.*, f.{freq} AS go FROM {source} t JOIN flags f ON f.date = t.date)"


# the strategy of the book queries: equal weights, monthly decisions
def book_ctes(lag: int = 1, lever: int = 1, base: list[str] | None = None, freq: str = "monthly") -> list[str]:
    """``base`` are the tables up to ``weighted``, those of the plain strategy if none are given."""
    base = base or SCORED + leg_ctes("scored") + weight_ctes("1::DOUBLE", 0.5, 0.1)
    base = [c.replace("weighted AS", "unflagged AS", 1) if c.startswith("weighted AS") else c for c in base]
    return base + [
        FLAGS_SQL,
        f"weighted AS (SELECT u.* REPLACE (u.weight * {lever} AS weight), 0 AS trial, f.{freq} AS go FROM unflagged u JOIN flags f ON f.date = u.date)",
    ] + walk_ctes(lag) + [
        "gross AS (SELECT trial, pos, date, w, pnl, turnover, list_sum(list_transform(w, lambda q: abs(q))) AS gross, "
        "list_sum(list_transform(w, lambda q: greatest(-q, 0))) AS short FROM walk WHERE pos >= 0)",
        "base AS (SELECT *, pnl - costs AS base FROM (SELECT *, turnover * 0.001::DOUBLE + 0.01::DOUBLE / 52 * "
        "coalesce(lag(short) OVER (PARTITION BY trial ORDER BY pos), 0) AS costs FROM gross))",
    ]


@query(
    "a02_equal_weight_benchmark",
    mk.sql(
        mk.panel_ctes() + ["y AS (SELECT *, lag(mask) OVER (PARTITION BY ticker ORDER BY pos) AS was FROM panel)"],
        f"SELECT {d('date')}, {r('coalesce(avg(CASE WHEN was THEN returns END), 0)', 'benchmark')} FROM y GROUP BY date",
    ),
)
def benchmark(spark, sf):
    return emit(bk.equal_weight_benchmark(mk.panel(spark, sf)), "date", "benchmark")


@query(
    "a03_a08_book_accounting",
    recursive(book_ctes(), f"SELECT {d('date')}, {r('pnl')}, {r('turnover')}, {r('gross')}, {r('short')} FROM gross"),
)
def book_accounting(spark, sf):
    return emit(book(spark, sf).daily, "date", "pnl", "turnover", "gross", "short")


LEVER = 40  # so much that the worst sessions of the test tables lose more than the book


@query(
    "a07_ruin_guard",
    recursive(book_ctes(lever=LEVER), f"SELECT {d('date')}, {r('pnl')}, {r('turnover')}, {r('gross')}, {n('pnl <= -1', 'ruined')} FROM gross"),
)
def ruin_guard(spark, sf):
    levered = targets(spark, sf).withColumn("weight", F.col("weight") * LEVER)
    return emit(bk.run_book(levered, CONFIG).daily, "date", "pnl", "turnover", "gross", "ruined")


@query(
    "a03_same_close_fill",
    recursive(book_ctes(0), f"SELECT {d('date')}, {r('pnl')}, {r('turnover')}, {r('gross')}, {r('short')} FROM gross"),
)
def same_close_fill(spark, sf):
    return emit(book(spark, sf, execution_lag=0).daily, "date", "pnl", "turnover", "gross", "short")


@query(
    "a04_held_weights",
    recursive(
        book_ctes()
        + [
            "names AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM (SELECT DISTINCT ticker FROM panel))",
            "held AS (SELECT date, ticker, w[i] AS weight FROM gross CROSS JOIN names)",
        ],
        f"SELECT {KEY}, {r('weight')} FROM held WHERE weight <> 0",
    ),
)
def held_weights(spark, sf):
    return emit(book(spark, sf).weights, "date", "ticker", "weight")


@query("a09_costs_and_base_return", recursive(book_ctes(), f"SELECT {d('date')}, {r('costs', digits=8)}, {r('base')} FROM base"))
def costs(spark, sf):
    return emit(book(spark, sf).daily, "date", "costs", "base", costs=8)


VOL = [
    "asked AS (SELECT *, coalesce(CASE WHEN count(*) OVER w = 20 AND count(nullif(base, 0)) OVER w >= 10 AND "
    "stddev_samp(nullif(base, 0)) OVER w > 0 THEN least(2.0::DOUBLE, 0.1::DOUBLE / (stddev_samp(nullif(base, 0)) OVER w * sqrt(52))) END, 1) "
    "AS want FROM base WINDOW w AS (PARTITION BY trial ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), "
    "vol AS (SELECT *, coalesce(lag(want) OVER (PARTITION BY trial ORDER BY pos), 1) AS scale FROM asked)",
    "net AS (SELECT *, scale * base - cost AS net FROM (SELECT *, abs(scale - coalesce(lag(scale) OVER (PARTITION BY trial ORDER BY pos), 1)) * "
    "coalesce(lag(gross) OVER (PARTITION BY trial ORDER BY pos), 0) * 0.001::DOUBLE AS cost FROM vol))",
]


def targeted(spark, sf, **limits):
    config = bk.BookConfig(**{**CONFIG.__dict__, "vol_target": 0.10, "vol_lookback": 20, **limits})
    return overlay.apply_overlay(book(spark, sf).daily, config)


@query(
    "a10_volatility_target",
    recursive(book_ctes() + VOL, f"SELECT {d('date')}, {r('scale')}, {r('net')} FROM net"),
)
def volatility_target(spark, sf):
    return emit(targeted(spark, sf), "date", "scale", "net")


BREAKER = [
    "wanted AS (SELECT * FROM vol)",
    "brk AS (SELECT trial, -1 AS pos, NULL::DATE AS date, 1::DOUBLE AS scale, 1::DOUBLE AS nxt, 0::DOUBLE AS net, 1::DOUBLE AS equity, "
    "1::DOUBLE AS peak, 0 AS cool, 0::DOUBLE AS gross, 0::DOUBLE AS cost FROM wanted WHERE pos = 0 UNION ALL "
    "SELECT trial, pos, date, s, CASE WHEN cool2 > 0 THEN 0 ELSE want END, net, eq, CASE WHEN cool > 0 AND cool2 = 0 THEN eq ELSE pk END, cool2, g, cost FROM ("
    "SELECT *, CASE WHEN cool > 0 THEN cool - 1 WHEN eq / pk - 1 <= -0.04::DOUBLE THEN 5 ELSE 0 END AS cool2 FROM ("
    "SELECT *, greatest(peak, eq) AS pk FROM (SELECT *, equity * (1 + net) AS eq FROM (SELECT *, s * base - cost AS net FROM ("
    "SELECT v.trial, v.pos, v.date, b.nxt AS s, abs(b.nxt - b.scale) * b.gross * 0.001::DOUBLE AS cost, v.base, v.gross AS g, v.want, b.equity, b.peak, b.cool "
    "FROM brk b JOIN wanted v ON v.trial = b.trial AND v.pos = b.pos + 1))))))",
]


@query(
    "a11_a12_drawdown_breaker",
    recursive(
        book_ctes() + VOL[:1] + BREAKER,
        f"SELECT {d('date')}, {r('scale')}, {r('net')}, {r('cost', 'overlay_cost', 8)}, {n('cool > 0', 'breaker')} FROM brk WHERE pos >= 0",
    ),
)
def drawdown_breaker(spark, sf):
    out = targeted(spark, sf, dd_limit=0.04, dd_cooldown_days=5)
    return emit(out, "date", "scale", "net", "overlay_cost", "breaker", overlay_cost=8)


@query(
    "a13_equity_curve",
    recursive(
        book_ctes(),
        f"SELECT {d('date')}, {r('1000000 * product(1 + base) OVER (PARTITION BY trial ORDER BY pos)', 'equity_value', 4)} FROM base",
    ),
)
def equity_curve(spark, sf):
    daily = overlay.apply_overlay(book(spark, sf).daily, CONFIG)
    return emit(overlay.equity_curve(daily), "date", "equity_value", equity_value=4)


@query(
    "a14_first_live_session",
    recursive(book_ctes(), f"SELECT {n('coalesce(min(CASE WHEN gross > 0 THEN pos END), min(pos))', 'live_pos')} FROM base GROUP BY trial"),
)
def first_live_session(spark, sf):
    return emit(overlay.live_from(book(spark, sf).daily), "live_pos")


# -- composed backtests -----------------------------------------------------------------------------
MOMENTUM = momentum(lookback=12, skip=1, top_quantile=0.2, rebalance="monthly")


def momentum_ctes(q: str = "0.2::DOUBLE", share: float = 0.5, near: int = 1, far: int = 13) -> list[str]:
    """Backtest of the momentum strategy up to ``live``: base return, benchmark and turnover from the first holding on."""
    scored_sql = mk.panel_ctes() + [
        f"s0 AS (SELECT *, {LAG.format(near)} / nullif({LAG.format(far)}, 0) - 1 AS mom, "
        "CASE WHEN count(lr) OVER f = 3 THEN exp(sum(lr) OVER f) - 1 END AS forward FROM "
        "(SELECT *, CASE WHEN returns IS NOT NULL THEN ln(1 + greatest(returns, -0.999)) END AS lr FROM panel) "
        "WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))",
        "s1 AS (SELECT *, CASE WHEN mask THEN mom END AS x FROM s0)",
        "scored AS (SELECT *, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + "
        "(count(*) OVER (PARTITION BY date, x) - 1) / 2) / (count(x) OVER (PARTITION BY date))::DOUBLE END AS score FROM s1)",
    ]
    tail = book_ctes()[len(SCORED + leg_ctes("scored") + weight_ctes("1::DOUBLE", 0.5, 0.1)) :]
    weights = leg_ctes("scored", q) + weight_ctes("1::DOUBLE", share, 0.1)
    weights = [c.replace("weighted AS", "unflagged AS", 1) if c.startswith("weighted AS") else c for c in weights]
    return scored_sql + weights + tail + [
        "bench AS (SELECT pos, coalesce(avg(CASE WHEN was THEN returns END), 0) AS benchmark FROM "
        "(SELECT *, lag(mask) OVER (PARTITION BY ticker ORDER BY pos) AS was FROM panel) GROUP BY pos)",
        "live AS (SELECT b.*, b.base AS net, benchmark FROM base b JOIN bench USING (pos) WHERE pos >= (SELECT min(pos) FROM base WHERE gross > 0))",
    ]


def measure_sql(ppy: int = 52) -> dict[str, str]:
    g = "product(1 + net)"
    b = "product(1 + benchmark)"
    return {
        "sharpe": f"avg(net) / nullif(stddev_samp(net), 0) * sqrt({ppy})",
        "max_drawdown": "min(drawdown)",
        "cumulative_return": f"{g} - 1",
        "annualised_return": f"CASE WHEN {g} > 0 THEN pow({g}, {ppy} / count(*)::DOUBLE) - 1 ELSE -1 END",
        "annualised_vol": f"stddev_samp(net) * sqrt({ppy})",
        "sortino": f"avg(net) / nullif(sqrt(avg(pow(least(net, 0), 2))), 0) * sqrt({ppy})",
        "hit_rate": "avg((net > 0)::INT)",
        "information_ratio": f"avg(net - benchmark) / nullif(stddev_samp(net - benchmark), 0) * sqrt({ppy})",
        "benchmark_annualised_return": f"CASE WHEN {b} > 0 THEN pow({b}, {ppy} / count(*)::DOUBLE) - 1 ELSE -1 END",
        "annual_turnover": f"avg(turnover) * {ppy}",
    }


def drawdown_cte(source: str = "live", by: str = "trial") -> list[str]:
    return [
        f"eq AS (SELECT *, product(1 + net) OVER (PARTITION BY {by} ORDER BY pos) AS eqv FROM {source})",
        f"dd AS (SELECT *, eqv / greatest(max(eqv) OVER (PARTITION BY {by} ORDER BY pos), 1) - 1 AS drawdown FROM eq)",
    ]


MEASURES = measure_sql()


def momentum_result(spark, sf):
    return run_backtest(mk.panel(spark, sf), MOMENTUM, CONFIG)


def flagship(spark, sf):
    """Metrics of the momentum backtest, one row."""
    return emit(momentum_result(spark, sf).metrics().drop("n_returns"))


@query(
    "a15_momentum_backtest",
    recursive(
        momentum_ctes() + drawdown_cte(),
        "SELECT " + ", ".join(r(e, k) for k, e in MEASURES.items()) + " FROM dd",
    ),
)
def momentum_backtest(spark, sf):
    return emit(momentum_result(spark, sf).metrics(), *MEASURES)


@query(
    "a15_momentum_daily",
    recursive(
        momentum_ctes() + ["out_days AS (SELECT b.*, benchmark FROM base b JOIN bench USING (pos))"],
        f"SELECT {d('date')}, {r('base', 'net')}, {r('benchmark')}, {r('turnover')}, {r('gross')} FROM out_days",
    ),
)
def momentum_daily(spark, sf):
    return emit(momentum_result(spark, sf).daily, "date", "net", "benchmark", "turnover", "gross")


def dip_ctes() -> list[str]:
    """The dip buyer up to its weights: oversold by RSI inside a rising trend, held until recovered."""
    over = "OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return mk.panel_ctes() + rsi_ctes() + [
        "trended AS (SELECT p.*, 100 - 100 / (1 + a / nullif(b, 0)) AS rsi FROM panel p JOIN both_sides s ON s.ticker = p.ticker AND s.date = p.date)",
        f"ruled AS (SELECT *, CASE WHEN mask THEN -rsi END AS score, mask AND coalesce(rsi < 45 AND close > CASE WHEN count(close) {over} = 3 THEN avg(close) {over} END, false) AS enter_long, "
        "mask AND coalesce(rsi > 55, false) AS exit_long FROM trended)",
        ONE_SIDED[-1],
        "legs AS (SELECT *, CASE WHEN side <> 0 THEN side END AS leg FROM sided)",
        *weight_ctes("1::DOUBLE", 1.0, 0.05, rounds=0, decided="max(score IS NOT NULL)"),
    ]


@query(
    "a15_dip_buyer_daily",
    recursive(book_ctes(base=dip_ctes(), freq="daily"), f"SELECT {d('date')}, {r('base', 'net')}, {r('turnover')}, {r('gross')}, {r('short')} FROM base"),
)
def dip_buyer_daily(spark, sf):
    """Rules mode on RSI."""
    plan = dip_buyer(rsi_window=5, oversold=45, recovered=55, trend_window=3, position_cap=0.05)
    return emit(run_backtest(mk.panel(spark, sf), plan, CONFIG).daily, "date", "net", "turnover", "gross", "short")


@query(
    "r04_gross_exposure",
    recursive(book_ctes() + VOL, f"SELECT {d('date')}, {r('gross * scale', 'exposure')} FROM net"),
)
def gross_exposure(spark, sf):
    return emit(reports.gross_exposure(targeted(spark, sf)), "date", "exposure")
