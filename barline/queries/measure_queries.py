"""Metrics, tuning, walk-forward, report tables and orders.

Measures of return series run over every ticker's own returns: a ticker is a trial, so the number of
trials grows with the data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import book as bk
from ..operators import metrics, orders, reports, tuning
from ..plans.backtest import run_backtest, run_sweep
from ..sources import runs
from . import market as mk
from .book_queries import (
    CONFIG,
    MEASURES,
    MOMENTUM,
    book_ctes,
    drawdown_cte,
    momentum_ctes,
    recursive,
    scored,
    targets,
)
from .registry import d, emit, n, query, r

PPY = 52


# -- one return series per ticker ----------------------------------------------------------
def series(spark, sf):
    """(trial, date, pos, net, benchmark, turnover, gross): a ticker's returns as a book of its own."""
    grid = mk.panel(spark, sf, universe="all")
    rows = grid.where(F.col("returns").isNotNull()).select(
        F.col("ticker").alias("trial"),
        "date",
        "pos",
        F.col("returns").alias("net"),
        F.abs("returns").alias("turnover"),
        F.col("mask").cast("double").alias("gross"),
    )
    return rows.join(F.broadcast(bk.equal_weight_benchmark(grid).select("pos", "benchmark")), "pos")


SERIES = mk.panel_ctes(universe=None) + [
    "bench AS (SELECT pos, coalesce(avg(CASE WHEN was THEN returns END), 0) AS benchmark FROM "
    "(SELECT *, lag(mask) OVER (PARTITION BY ticker ORDER BY pos) AS was FROM panel) GROUP BY pos)",
    "live AS (SELECT ticker AS trial, p.date, p.pos, returns AS net, abs(returns) AS turnover, mask::INT::DOUBLE AS gross, benchmark "
    "FROM panel p JOIN bench b ON b.pos = p.pos WHERE returns IS NOT NULL)",
] + drawdown_cte()


def measure(name, column, expr=None):
    @query(name, mk.sql(SERIES, f"SELECT trial, {r(expr or MEASURES[column], column)} FROM dd GROUP BY trial"))
    def run(spark, sf):
        return emit(metrics.return_measures(series(spark, sf), ppy=PPY), "trial", column)

    return run


measure("m01_cumulative_return", "cumulative_return")
measure("m02_annualised_return", "annualised_return")
measure("m03_annualised_vol", "annualised_vol")
measure("m04_sharpe_ratio", "sharpe")
measure("m05_sortino_ratio", "sortino")
measure("m07_max_drawdown", "max_drawdown")
measure(
    "m08_calmar", "calmar", f"CASE WHEN min(drawdown) < 0 THEN ({MEASURES['annualised_return']}) / abs(min(drawdown)) END"
)
measure("m09_hit_rate", "hit_rate")
measure("m10_information_ratio", "information_ratio")
measure("m11_benchmark_return", "benchmark_annualised_return")
measure("m15_annual_turnover", "annual_turnover")


@query("m06_drawdown_series", mk.sql(SERIES, f"SELECT trial, {d('date')}, {r('drawdown', digits=8)} FROM dd"))
def drawdown_series(spark, sf):
    return emit(metrics.with_drawdown(series(spark, sf)), "trial", "date", "drawdown", drawdown=8)


# -- rank correlation -------------------------------------------------------------------------
HORIZON = 3
FORWARD = mk.panel_ctes() + [
    "logs AS (SELECT *, CASE WHEN returns IS NOT NULL THEN ln(1 + greatest(returns, -0.999)) END AS lr FROM panel)",
    "fwd AS (SELECT *, round(CASE WHEN count(lr) OVER f = 3 THEN exp(sum(lr) OVER f) - 1 END, 9) AS forward, "
    "CASE WHEN mask THEN close / nullif(lag(close, 6) OVER (PARTITION BY ticker ORDER BY pos), 0) - 1 END AS score FROM logs "
    "WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))",
]
IC = FORWARD + [
    "both_known AS (SELECT * FROM fwd WHERE score IS NOT NULL AND forward IS NOT NULL)",
    "places AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2 AS a, "
    "rank() OVER (PARTITION BY date ORDER BY forward) + (count(*) OVER (PARTITION BY date, forward) - 1) / 2 AS b FROM both_known)",
    "ic AS (SELECT * FROM (SELECT date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic, count(*) AS names FROM places GROUP BY date) "
    "WHERE names >= 5 AND ic IS NOT NULL)",
    "apart AS (SELECT *, CASE WHEN (row_number() OVER (ORDER BY date) - 1) % 3 = 0 THEN ic END AS ap FROM ic)",
]


def forward_rows(spark, sf):
    """Score and forward return; the latter rounded so that equal paths tie in every engine."""
    ahead = F.round(metrics.forward_return("returns", HORIZON), 9)
    return scored(spark, sf).withColumns({"forward": ahead, "trial": F.lit(0)})


@query("m12_forward_returns", mk.sql(FORWARD, f"SELECT {d('date')}, ticker, {r('forward')} FROM fwd"))
def forward_returns(spark, sf):
    return emit(forward_rows(spark, sf), "date", "ticker", "forward")


@query("m13_daily_rank_correlation", mk.sql(IC, f"SELECT {d('date')}, {r('ic')} FROM ic"))
def daily_ic(spark, sf):
    return emit(metrics.daily_ic(forward_rows(spark, sf)), "date", "ic")


@query(
    "m13_m14_information_coefficient",
    mk.sql(
        IC,
        f"SELECT {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'ic_ir')}, "
        f"{r('avg(ap) / nullif(stddev_samp(ap), 0) * sqrt(count(ap))', 'ic_tstat')}, {r('avg((ic > 0)::INT)', 'ic_hit_rate')} FROM apart",
    ),
)
def information_coefficient(spark, sf):
    ic = metrics.daily_ic(forward_rows(spark, sf))
    return emit(metrics.ic_measures(ic, HORIZON).drop("trial"))


# -- selection bias -----------------------------------------------------------------------------
# normal distribution by its series: 0.5 + pdf(x) * sum x^(2k+1) / (1 * 3 * ... * (2k+1))
def cdf_sql(x: str) -> str:
    return (
        f"CASE WHEN ({x}) IS NOT NULL THEN 0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), "
        f"lambda k: pow(({x}), 2 * k + 1) * sqrt(pi()) / (pow(2.0::DOUBLE, k + 1) * gamma(k + 1.5)))) END"
    )


def quantile_sql(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


MOMENTS = SERIES + [
    "mom AS (SELECT trial, count(*) AS n, avg(net) / nullif(stddev_samp(net), 0) AS sr, CASE WHEN stddev_samp(net) > 0 THEN skewness(net) END AS sk, "
    "CASE WHEN stddev_samp(net) > 0 THEN kurtosis(net) + 3 END AS ku FROM live GROUP BY trial)",
    "spread AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM mom)",
]


def psr_sql(benchmark: str = "0") -> str:
    return cdf_sql(f"CASE WHEN n >= 3 AND v > 0 THEN (sr - {benchmark}) * sqrt(n - 1) / sqrt(v) END")


def z_sql(trials: int) -> float:
    import math

    g = metrics.EULER_GAMMA
    return (1 - g) * quantile_sql(1 - 1 / trials) + g * quantile_sql(1 - 1 / (trials * math.e))


@query("m16_probabilistic_sharpe", mk.sql(MOMENTS, f"SELECT trial, {r(psr_sql(), 'psr')} FROM spread"))
def probabilistic_sharpe(spark, sf):
    out = metrics.moments(series(spark, sf)).withColumn("psr", metrics.probabilistic_sharpe())
    return emit(out, "trial", "psr")


@query(
    "m17_expected_max_sharpe",
    mk.sql(MOMENTS, f"SELECT trial, {r(f'sqrt(abs(sr)) * {z_sql(25)!r}', 'expected')}, {r('0', 'alone')} FROM spread"),
)
def expected_max_sharpe(spark, sf):
    """Treats each ticker's own Sharpe size as the variance across 25 trials, and a lone trial."""
    out = metrics.moments(series(spark, sf)).withColumns(
        {
            "expected": metrics.expected_max_sharpe(25, F.abs("period_sharpe")),
            "alone": metrics.expected_max_sharpe(1, F.abs("period_sharpe")),
        }
    )
    return emit(out, "trial", "expected", "alone")


@query(
    "m18_deflated_sharpe",
    mk.sql(MOMENTS, f"SELECT trial, {r(psr_sql(f'{(0.0005**0.5 * z_sql(25))!r}'), 'deflated_sharpe')} FROM spread"),
)
def deflated_sharpe(spark, sf):
    out = metrics.moments(series(spark, sf)).withColumn("deflated_sharpe", metrics.deflated_sharpe(25, 0.0005))
    return emit(out, "trial", "deflated_sharpe")


@query(
    "m19_summary",
    mk.sql(
        MOMENTS,
        "SELECT a.*, "
        + r(psr_sql(), "psr")
        + ", "
        + r(psr_sql(), "deflated_sharpe")
        + ", "
        + n("1", "n_trials")
        + " FROM (SELECT trial, "
        + ", ".join(r(e, k) for k, e in MEASURES.items())
        + " FROM dd GROUP BY trial) a JOIN spread ON spread.trial = a.trial",
    ),
)
def summary(spark, sf):
    out = metrics.summarize(series(spark, sf), ppy=PPY)
    return emit(out, "trial", *MEASURES, "psr", "deflated_sharpe", "n_trials")


# -- grids ------------------------------------------------------------------------------------------
KNOBS = mk.with_tables("prices") + [
    "ranges AS (SELECT ticker, min(close) AS low, max(close) AS high, arg_max(close, date) AS value FROM prices GROUP BY ticker)"
]


def ranges(spark, sf):
    """A knob per ticker: the range of its closes and the latest one."""
    return mk.prices(spark, sf).groupBy("ticker").agg(
        F.min("close").alias("low"), F.max("close").alias("high"), F.max_by("close", "date").alias("value")
    )


@query(
    "t01_grid_expansion",
    mk.sql(
        KNOBS + ["opts AS (SELECT ticker, [low, value, high] AS a, [1, 5] AS b FROM ranges)"],
        "SELECT ticker, CAST((i - 1) * 2 + (j - 1) AS BIGINT) AS trial, "
        + r("a[i]", "level")
        + ", CAST(b[j] AS BIGINT) AS lag FROM opts CROSS JOIN range(1, 4) x(i) CROSS JOIN range(1, 3) y(j)",
    ),
)
def grid_expansion(spark, sf):
    levels = F.array("low", "value", "high")
    out = tuning.expand(ranges(spark, sf), {"level": levels, "lag": F.array(F.lit(1), F.lit(5))})
    return emit(out, "ticker", "trial", "level", "lag")


@query(
    "t02_trial_sampling",
    "SELECT s_suppkey AS trial, " + r("s_acctbal", "knob", 2) + " FROM supplier ORDER BY md5('7:' || s_suppkey::VARCHAR) LIMIT 12",
)
def trial_sampling(spark, sf):
    trials = mk.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("trial"), F.col("s_acctbal").alias("knob"))
    return emit(tuning.sample_trials(trials, 12, seed=7), "trial", "knob", knob=2)


LARGE = {"nation": "SELECT s_nationkey AS v FROM supplier", "supplier": "SELECT l_suppkey AS v FROM lineitem", "quantity": "SELECT l_quantity AS v FROM lineitem", "line": "SELECT l_linenumber AS v FROM lineitem", "key": "SELECT o_orderkey AS v FROM orders"}


def _large_sql(k: int, seed: int) -> str:
    """A sample of the grid of all values of five columns, by the same permutation one round a step."""
    lists = ", ".join(f"(SELECT list(DISTINCT v::BIGINT ORDER BY v::BIGINT) FROM ({q})) AS {n}" for n, q in LARGE.items())
    total = " * ".join(f"len({n})::BIGINT" for n in LARGE)
    stride, digits = "1", {}
    for name in reversed(LARGE):
        digits[name] = f"{name}[(trial // ({stride})) % len({name}) + 1]"
        stride += f" * len({name})"
    keys = ", ".join(f"{x}::BIGINT" for x in tuning.round_keys(seed))
    done = f"step > 0 AND step % {tuning.ROUNDS} = 0 AND ((l << half) | r) < total"
    return (
        f"WITH RECURSIVE lists AS (SELECT {lists}), sized AS (SELECT *, {total} AS total FROM lists), "
        "geo AS (SELECT *, greatest(1, (len(trim(LEADING '0' FROM bin(total - 1))) + 1) // 2)::INTEGER AS half FROM sized), "
        f"walk AS (SELECT i, i >> half AS l, i & ((1::BIGINT << half) - 1) AS r, 0 AS step FROM range(0::BIGINT, {k}::BIGINT) t(i), geo UNION ALL "
        f"SELECT i, r, xor(l, ((r * 2654435761 + ([{keys}])[step % {tuning.ROUNDS} + 1]) % 4294967291) & ((1::BIGINT << half) - 1)), step + 1 FROM walk, geo WHERE NOT ({done})), "
        f"picked AS (SELECT (l << half) | r AS trial FROM walk, geo WHERE {done}) "
        f"SELECT trial, {', '.join(f'{digits[n]} AS {n}' for n in LARGE)} FROM picked, geo"
    )


@query("t02_sampled_large_grid", _large_sql(60, 5))
def sampled_large_grid(spark, sf):
    """60 trials of a grid of billions of combinations."""
    column = {"nation": ("supplier", "s_nationkey"), "supplier": ("lineitem", "l_suppkey"), "quantity": ("lineitem", "l_quantity"), "line": ("lineitem", "l_linenumber"), "key": ("orders", "o_orderkey")}
    rows = None
    for name, (table, c) in column.items():
        values = mk.table(spark, sf, table).agg(F.sort_array(F.collect_set(F.col(c).cast("bigint"))).alias(f"all_{name}"))
        rows = values if rows is None else rows.crossJoin(values)  # one row each
    return tuning.sample_expand(rows, {n: F.col(f"all_{n}") for n in column}, 60, seed=5).select("trial", *column)


@query(
    "t03_default_grid",
    mk.sql(
        KNOBS
        + [
            "pts AS (SELECT ticker, 'level' AS name, unnest([low, low + (high - low) / 2, low + 2 * (high - low) / 2, value]) AS p FROM ranges WHERE low < high "
            "UNION ALL SELECT ticker, 'count', round_even(unnest([low, low + (high - low) / 2, low + 2 * (high - low) / 2, value]), 0) FROM ranges WHERE low < high)"
        ],
        f"SELECT DISTINCT ticker, name, {r('p', 'point')} FROM pts",
    ),
)
def default_grid(spark, sf):
    knobs = ranges(spark, sf).where(F.col("low") < F.col("high"))
    both = F.explode(F.array(F.struct(F.lit("level").alias("name"), F.lit("float").alias("kind")), F.struct(F.lit("count").alias("name"), F.lit("int").alias("kind"))))
    out = tuning.default_grid(knobs.withColumn("k", both).select("ticker", "k.name", "value", "low", "high", "k.kind"))
    return emit(out, "ticker", "name", "point").distinct()


# -- sweeps -------------------------------------------------------------------------------------------
GRID = [{"lookback": 12, "top_quantile": 0.2}, {"lookback": 12, "top_quantile": 0.4}, {"lookback": 4, "top_quantile": 0.2}]


def sweep_ctes() -> list[str]:
    """One chain of tables per trial (names suffixed), united into ``sweep``."""
    shared = len(mk.panel_ctes())
    out = list(mk.panel_ctes())
    names = []
    for i, knobs in enumerate(GRID):
        chain = momentum_ctes(f"{knobs['top_quantile']}::DOUBLE", 0.5, 1, 1 + knobs["lookback"])[shared:] + drawdown_cte()
        local = [c.split(" AS ", 1)[0].strip() for c in chain]
        for c in chain:
            for name in local:
                c = _renamed(c, name, f"{name}_t{i}")
            out.append(c)
        names.append(f"SELECT {i} AS knob_trial, * FROM dd_t{i}")
    out.append("sweep AS (" + " UNION ALL ".join(names) + ")")
    return out


def _renamed(text: str, name: str, new: str) -> str:
    """Rename a table where it is defined or read (its name may also be a column's)."""
    import re

    text = re.sub(rf"^{name} AS \(", f"{new} AS (", text)
    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {new}", text)


SWEEP = sweep_ctes() + [
    "table_ AS (SELECT knob_trial AS trial, " + ", ".join(f"{e} AS {k}" for k, e in MEASURES.items()) + " FROM sweep GROUP BY knob_trial)"
]


def sweep(spark, sf):
    return run_sweep(mk.panel(spark, sf), MOMENTUM, GRID, CONFIG)


@query(
    "t04_t05_sweep_table",
    recursive(SWEEP, f"SELECT CAST(trial AS BIGINT) AS trial, {', '.join(r(k) for k in MEASURES)} FROM table_"),
)
def sweep_table(spark, sf):
    return emit(sweep(spark, sf)[1], "trial", *MEASURES)


@query(
    "t06_trial_sharpe_variance",
    recursive(SWEEP, f"SELECT {r('var_samp(sharpe / sqrt(52))', 'variance', 9)}, {n('count(*)', 'n_trials')} FROM table_"),
)
def trial_sharpe_variance(spark, sf):
    return emit(tuning.trial_sharpe_variance(sweep(spark, sf)[1], PPY), digits=9)


WINNER = [
    "spread AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM (SELECT knob_trial AS trial, count(*) AS n, "
    "avg(net) / nullif(stddev_samp(net), 0) AS sr, skewness(net) AS sk, kurtosis(net) + 3 AS ku FROM sweep GROUP BY knob_trial))",
    "best AS (SELECT s.*, t.sharpe, (SELECT var_samp(sharpe / sqrt(52)) FROM table_) AS var FROM spread s JOIN table_ t ON t.trial = s.trial ORDER BY sharpe DESC LIMIT 1)",
]


@query(
    "t07_deflated_winner",
    recursive(
        SWEEP + WINNER,
        f"SELECT CAST(trial AS BIGINT) AS trial, {r('sharpe')}, {r(psr_sql(), 'psr')}, {n('3', 'n_trials')}, "
        f"{r(psr_sql(f'sqrt(var) * {z_sql(3)!r}'), 'deflated_sharpe')} FROM best",
    ),
)
def deflated_winner(spark, sf):
    return emit(sweep(spark, sf)[2], "trial", "sharpe", "psr", "n_trials", "deflated_sharpe")


# -- walk-forward over every ticker's series ---------------------------------------------------------------
TRAIN, TEST = 104, 26


def full_series(spark, sf):
    """Every session of every ticker, missing returns as 0, so all trials span the same sessions."""
    grid = mk.panel(spark, sf, universe="all")
    rows = grid.select(
        F.col("ticker").alias("trial"), "date", "pos", F.coalesce("returns", F.lit(0.0)).alias("net"), F.col("mask").cast("double").alias("gross")
    )
    return rows.persist()  # read for the fold geometry, the training scores and the test windows


FULL = mk.panel_ctes(universe=None) + [
    "live AS (SELECT ticker AS trial, date, pos, coalesce(returns, 0) AS net, mask::INT::DOUBLE AS gross FROM panel)",
    "start AS (SELECT max(lp) AS first, (SELECT max(pos) + 1 FROM live) AS sessions FROM "
    "(SELECT coalesce(min(CASE WHEN gross > 0 THEN pos END), min(pos)) AS lp FROM live GROUP BY trial))",
]


def folds_ctes(expanding: bool = False, score: str | None = None) -> list[str]:
    low = "first" if expanding else f"test_start - {TRAIN}"
    score = score or "CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(52) END"
    return FULL + [
        f"f0 AS (SELECT fold, first, first + {TRAIN} + fold * {TEST} AS test_start, sessions FROM start, range(0, 1000) x(fold) WHERE first + {TRAIN} + fold * {TEST} < sessions)",
        f"folds AS (SELECT fold, {low} AS train_start, test_start, least(test_start + {TEST}, sessions) AS test_end FROM f0)",
        f"ins AS (SELECT fold, trial, {score} AS sc FROM folds JOIN live ON pos >= train_start AND pos < test_start GROUP BY fold, trial)",
        "pick AS (SELECT fold, trial, sc FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(sc, 12) DESC NULLS LAST, trial) AS k FROM ins) WHERE k = 1 AND sc IS NOT NULL)",
        "oos AS (SELECT fold, l.* FROM pick JOIN folds USING (fold) JOIN live l ON l.trial = pick.trial AND l.pos >= test_start AND l.pos < test_end)",
        f"tested AS (SELECT fold, {score} AS sc FROM oos GROUP BY fold)",
        "result AS (SELECT f.*, p.trial, p.sc AS is_score, t.sc AS oos_score FROM folds f JOIN pick p USING (fold) LEFT JOIN tested t USING (fold))",
    ]


def span_of(daily, expanding=False):
    live = daily.groupBy("trial").agg(
        F.coalesce(F.min(F.when(F.col("gross") > 0, F.col("pos"))), F.min("pos")).alias("live_pos")
    )
    first, sessions = tuning.common_start(live, daily)
    return tuning.Span(first, sessions, TRAIN, TEST, expanding)


FOLD_COLUMNS = ("fold", "train_start", "test_start", "test_end")


@query("t08_common_start", mk.sql(FULL, f"SELECT {n('first')}, {n('sessions')} FROM start"))
def common_start(spark, sf):
    daily = full_series(spark, sf)
    live = daily.groupBy("trial").agg(
        F.coalesce(F.min(F.when(F.col("gross") > 0, F.col("pos"))), F.min("pos")).alias("live_pos")
    )
    first = live.agg(F.max("live_pos").alias("first"))
    return emit(first.withColumn("k", F.lit(1)).join(daily.agg((F.max("pos") + 1).alias("sessions")).withColumn("k", F.lit(1)), "k").drop("k"))


@query(
    "t09_fold_windows",
    mk.sql(folds_ctes(), "SELECT trial, " + n("fold") + ", " + n("count(*)", "days") + ", " + r("sum(net)", "total")
           + " FROM folds JOIN live ON pos >= train_start AND pos < test_start GROUP BY trial, fold"),
)
def fold_windows(spark, sf):
    daily = full_series(spark, sf)
    rows = tuning.training_rows(daily, span_of(daily))
    return emit(rows.groupBy("trial", "fold").agg(F.count(F.lit(1)).alias("days"), F.sum("net").alias("total")))


def walk(name, expanding=False, objective="sharpe", score=None):
    columns = ", ".join(n(c) for c in FOLD_COLUMNS)

    @query(name, mk.sql(folds_ctes(expanding, score), f"SELECT {columns}, trial, {r('is_score')}, {r('oos_score')} FROM result"))
    def run(spark, sf):
        daily = full_series(spark, sf)
        folds, _ = tuning.walk_forward(daily, span_of(daily, expanding), objective, PPY)
        return emit(folds, *FOLD_COLUMNS, "trial", "is_score", "oos_score")

    return run


GROWTH = "CASE WHEN product(1 + net) > 0 THEN pow(product(1 + net), 52 / count(*)::DOUBLE) - 1 ELSE -1 END"
walk("t10_walk_forward")
walk("t10_walk_forward_expanding", expanding=True)
walk("t13_objective_sortino", objective="sortino", score="avg(net) / nullif(sqrt(avg(pow(least(net, 0), 2))), 0) * sqrt(52)")
walk("t13_objective_annualised_return", objective="annualised_return", score=GROWTH)


@query(
    "t13_objective_calmar",
    mk.sql(
        folds_ctes()
        + [
            "tr AS (SELECT fold, l.* FROM folds JOIN live l ON pos >= train_start AND pos < test_start)",
            "te AS (SELECT *, product(1 + net) OVER (PARTITION BY fold, trial ORDER BY pos) AS eqv FROM tr)",
            "td AS (SELECT *, eqv / greatest(max(eqv) OVER (PARTITION BY fold, trial ORDER BY pos), 1) - 1 AS drawdown FROM te)",
        ],
        f"SELECT {n('fold')}, trial, {r(f'CASE WHEN min(drawdown) < 0 THEN ({GROWTH}) / abs(min(drawdown)) END', 'score')} FROM td GROUP BY fold, trial",
    ),
)
def calmar_scores(spark, sf):
    daily = full_series(spark, sf)
    return emit(tuning.fold_scores(daily, span_of(daily), "calmar", PPY), "fold", "trial", "score")


@query("t11_stitched_series", mk.sql(folds_ctes(), f"SELECT {n('fold')}, trial, {d('date')}, {r('net')} FROM oos"))
def stitched_series(spark, sf):
    daily = full_series(spark, sf)
    _, oos = tuning.walk_forward(daily, span_of(daily), "sharpe", PPY)
    return emit(oos, "fold", "trial", "date", "net")


@query("t12_degradation", mk.sql(folds_ctes(), f"SELECT {r('avg(oos_score - is_score)', 'degradation')} FROM result"))
def degradation(spark, sf):
    daily = full_series(spark, sf)
    folds, _ = tuning.walk_forward(daily, span_of(daily), "sharpe", PPY)
    return emit(tuning.degradation(folds))


# -- report tables ------------------------------------------------------------------------------------------
MONTHS = ", ".join(
    r(f"product(CASE WHEN month(date) = {m} THEN 1 + net END) - 1", f"m{m}") for m in range(1, 13)
)


@query(
    "r01_monthly_and_yearly_returns",
    mk.sql(SERIES, f"SELECT trial, {n('year(date)', 'year')}, {MONTHS}, {r('product(1 + net) - 1', 'total')} FROM live GROUP BY trial, year(date)"),
)
def monthly_returns(spark, sf):
    return emit(reports.monthly_returns(series(spark, sf)))


@query(
    "r02_rolling_sharpe",
    mk.sql(
        SERIES,
        f"SELECT trial, {d('date')}, "
        + r("CASE WHEN count(net) OVER w = 26 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(52) END", "rolling_sharpe")
        + " FROM live WINDOW w AS (PARTITION BY trial ORDER BY pos ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)",
    ),
)
def rolling_sharpe(spark, sf):
    return emit(reports.rolling_sharpe(series(spark, sf), n=26, ppy=PPY), "trial", "date", "rolling_sharpe")


@query(
    "r03_growth_paths",
    mk.sql(
        SERIES,
        f"SELECT trial, {d('date')}, {r('product(1 + net) OVER w', 'growth')}, {r('product(1 + benchmark) OVER w', 'benchmark_growth')}, {r('drawdown', digits=8)} "
        "FROM dd WINDOW w AS (PARTITION BY trial ORDER BY pos)",
    ),
)
def growth_paths(spark, sf):
    return emit(reports.growth_paths(series(spark, sf)), "trial", "date", "growth", "benchmark_growth", "drawdown", drawdown=8)


@query(
    "r05_top_trials",
    mk.sql(SERIES, f"SELECT trial, {r('x', 'sharpe')} FROM (SELECT trial, {MEASURES['sharpe']} AS x FROM dd GROUP BY trial) ORDER BY x DESC NULLS LAST, trial LIMIT 10"),
)
def top_trials(spark, sf):
    return emit(reports.top_rows(metrics.return_measures(series(spark, sf), ppy=PPY), "sharpe", 10, "trial"), "trial", "sharpe")


RUN_OF = "CASE (substr(trial, 2)::BIGINT) % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'swept' ELSE 'walked' END"


@query(
    "s12_k06_stored_runs",
    mk.sql(
        SERIES
        + [
            f"runs AS (SELECT {RUN_OF} AS run, substr(trial, 2)::BIGINT AS trial, {MEASURES['sharpe']} AS sharpe, {MEASURES['hit_rate']} AS hit_rate, "
            "max(date) AS ended, arg_max(eqv, pos) AS stored FROM dd GROUP BY dd.trial)",
            "grown AS (SELECT product(1 + benchmark) AS g FROM bench)",
        ],
        f"SELECT run, {n('trial')}, CASE run WHEN 'plain' THEN 'backtest' WHEN 'swept' THEN 'sweep' ELSE 'walk-forward' END AS kind, "
        f"{r('sharpe')}, {r('hit_rate')}, {d('ended', 'end')}, {r('CASE WHEN run = $$walked$$ THEN g ELSE stored END', 'last_equity')} FROM runs, grown",
    ),
)
def stored_runs(spark, sf):
    """Tickers as trials of three runs that are stored and listed: a plain one, a swept one, a walked one."""
    root = mk.folder(spark)
    # read by every run that is stored: worked out once
    each = series(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    measures = metrics.return_measures(each, ppy=PPY).withColumn("number", F.substring("trial", 2, 20).cast("bigint")).persist(StorageLevel.MEMORY_AND_DISK)
    rows = reports.growth_paths(each).withColumns(
        {"equity_value": F.col("growth"), "base": F.col("net"), "scale": F.lit(1.0), "number": F.substring("trial", 2, 20).cast("bigint")}
    )
    bench = bk.equal_weight_benchmark(mk.panel(spark, sf, universe="all")).select("date", "pos", F.col("benchmark").alias("net"))
    for i, run in enumerate(("plain", "swept", "walked")):
        mine = F.col("number") % 3 == i
        table = measures.where(mine).drop("trial").withColumnRenamed("number", "trial")
        runs.save_run(root, run, rows.where(mine).drop("trial").withColumnRenamed("number", "trial"), table, {"part": i, "limit": None})
        if run == "swept":
            runs.save_sweep(root, run, table.select("trial", "sharpe"))
        if run == "walked":
            runs.save_folds(root, run, table.select("trial"), bench)
    measures.unpersist()
    each.unpersist()
    return emit(runs.stored_runs(spark, root), "run", "trial", "kind", "sharpe", "hit_rate", "end", "last_equity")


# -- orders ---------------------------------------------------------------------------------------------
CAPITAL = 2_000_000.0
DECISION = book_ctes()[: -5] + [
    "lastgo AS (SELECT max(pos) AS pos FROM weighted WHERE go AND weight IS NOT NULL)",
    "want AS (SELECT date, ticker, weight FROM weighted WHERE pos = (SELECT pos FROM lastgo) AND weight <> 0)",
    "last_px AS (SELECT ticker, arg_max(raw_close, pos) AS price FROM panel WHERE raw_close IS NOT NULL GROUP BY ticker)",
    "shares AS (SELECT w.ticker, trunc(weight * 2000000 / price)::BIGINT AS shares FROM want w JOIN last_px p ON p.ticker = w.ticker)",
]


@query("o03_latest_decision", mk.sql(DECISION, f"SELECT {d('date')}, ticker, {r('weight')} FROM want"))
def latest_decision(spark, sf):
    return emit(orders.latest_decision(targets(spark, sf)), "date", "ticker", "weight")


@query("o04_last_known_price", mk.sql(DECISION, f"SELECT ticker, {r('price')} FROM last_px"))
def last_known_price(spark, sf):
    return emit(orders.last_prices(mk.panel(spark, sf)))


@query("o01_target_shares", mk.sql(DECISION, f"SELECT ticker, {n('shares')} FROM shares WHERE shares <> 0"))
def target_shares(spark, sf):
    want = orders.latest_decision(targets(spark, sf))
    return emit(orders.target_shares(want, orders.last_prices(mk.panel(spark, sf)), CAPITAL), "ticker", "shares")


@query(
    "o05_final_scale",
    mk.sql(
        SERIES,
        f"SELECT trial, {r('arg_max(CASE WHEN net < 0 THEN 0 ELSE turnover END, pos)', 'scale')} FROM live GROUP BY trial",
    ),
)
def final_scale(spark, sf):
    """Each ticker as a book: size of the last move as its scale, breaker on after a loss."""
    rows = series(spark, sf).withColumns({"scale": F.col("turnover"), "breaker": F.col("net") < 0})
    return emit(orders.final_scale(rows), "trial", "scale")


HELD = DECISION + mk.with_tables("holdings") + [
    "mine AS (SELECT h.* FROM holdings h WHERE ticker IN (SELECT ticker FROM panel))",
    "moves AS (SELECT coalesce(m.ticker, s.ticker) AS ticker, coalesce(s.shares, 0) - coalesce(m.shares, 0) AS delta FROM mine m FULL OUTER JOIN shares s ON s.ticker = m.ticker)",
    "ord AS (SELECT CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, m.ticker, abs(delta) AS quantity, price AS est_price, abs(delta) * price AS est_notional "
    "FROM moves m JOIN last_px p ON p.ticker = m.ticker WHERE delta <> 0 AND abs(delta) * price >= 200)",
]


@query(
    "o02_j17_order_list",
    mk.sql(
        HELD,
        f"SELECT side, ticker, {n('quantity')}, {r('est_price')}, {r('est_notional', digits=4)}, "
        f"{n('row_number() OVER (ORDER BY side DESC, ticker)', 'nth')} FROM ord",
    ),
)
def order_list(spark, sf):
    daily = full_series(spark, sf).groupBy(F.lit(0).cast("bigint").alias("trial")).agg(F.max("pos").alias("pos"))
    daily = daily.withColumns({"scale": F.lit(1.0), "breaker": F.lit(False)})
    mine = mk.holdings(spark, sf).withColumn("trial", F.lit(0).cast("bigint"))
    out = orders.plan_orders(targets(spark, sf), mk.panel(spark, sf), daily, mine, CAPITAL)
    return emit(out, "side", "ticker", "quantity", "est_price", "est_notional", "nth", est_notional=4)


@query("j16_holdings_outside_the_data", mk.sql(HELD, f"SELECT ticker, {n('shares')} FROM holdings WHERE ticker NOT IN (SELECT ticker FROM panel)"))
def holdings_outside(spark, sf):
    return emit(orders.outside_data(mk.holdings(spark, sf), mk.panel(spark, sf)), "ticker", "shares")


@query(
    "o06_unpriced_targets",
    mk.sql(
        DECISION,
        "SELECT DISTINCT ticker FROM weighted WHERE weight <> 0 AND ticker NOT IN (SELECT ticker FROM last_px WHERE price > 100)",
    ),
)
def unpriced_targets(spark, sf):
    """Every name ever targeted whose last price is not above 100, taken as having none."""
    prices = orders.last_prices(mk.panel(spark, sf)).where(F.col("price") > 100)
    return orders.unpriced_targets(targets(spark, sf), prices).select("ticker")


WALKED = SWEEP + [
    "live AS (SELECT knob_trial AS trial, date, pos, net FROM sweep)",
    "start AS (SELECT max(a) AS first, max(z) + 1 AS sessions FROM (SELECT min(pos) AS a, max(pos) AS z FROM live GROUP BY trial))",
    *folds_ctes()[len(FULL) :],
]


@query(
    "a15_walk_forward_backtest",
    recursive(WALKED, f"SELECT {', '.join(n(c) for c in FOLD_COLUMNS)}, {n('trial')}, {r('is_score')}, {r('oos_score')} FROM result"),
)
def walk_forward_backtest(spark, sf):
    """Momentum variants simulated once, re-picked on each training window, stitched out of sample."""
    bt = run_backtest(mk.panel(spark, sf), MOMENTUM, CONFIG, GRID)
    first, sessions = tuning.common_start(bt.live.groupBy("trial").agg(F.min("pos").alias("live_pos")), bt.daily)
    span = tuning.Span(first, sessions, TRAIN, TEST)
    folds, _ = tuning.walk_forward(bt.daily, span, "sharpe", PPY)
    return emit(folds, *FOLD_COLUMNS, "trial", "is_score", "oos_score")


@query(
    "k07_stored_folds",
    mk.sql(
        folds_ctes() + ["grown AS (SELECT fold, count(*) AS sessions, product(1 + net) AS growth FROM oos GROUP BY fold)"],
        f"SELECT 'walked' AS run, {', '.join(n(c) for c in FOLD_COLUMNS)}, trial, {r('is_score')}, {n('sessions')}, {r('growth')} "
        "FROM result JOIN grown USING (fold)",
    ),
)
def stored_folds(spark, sf):
    """A walk-forward's folds and out-of-sample rows, stored and read back."""
    root = mk.folder(spark)
    daily = full_series(spark, sf)
    folds, oos = tuning.walk_forward(daily, span_of(daily), "sharpe", PPY)
    runs.save_folds(root, "walked", folds, oos)
    return emit(runs.stored_folds(spark, root), "run", *FOLD_COLUMNS, "trial", "is_score", "sessions", "growth")


@query(
    "k07_stored_sweeps",
    mk.sql(
        SERIES
        + [f"each_ AS (SELECT substr(trial, 2)::BIGINT AS trial, {MEASURES['sharpe']} AS sharpe, {MEASURES['hit_rate']} AS hit_rate, min(date) AS a FROM dd GROUP BY dd.trial)"],
        f"SELECT 'first' AS run, trial, {r('sharpe')}, NULL::DOUBLE AS hit_rate, {n('trial * 10', 'lookback')}, NULL::BIGINT AS skip, {d('a', 'start')} FROM each_ WHERE trial % 2 = 0 "
        f"UNION ALL SELECT 'second', trial, NULL, {r('hit_rate')}, NULL, {n('trial + 1', 'skip')}, {d('a', 'start')} FROM each_ WHERE trial % 2 = 1",
    ),
)
def stored_sweeps(spark, sf):
    """Two sweeps over different knobs, stored one after the other and read back as one table."""
    root = mk.folder(spark)
    number = F.substring("trial", 2, 20).cast("bigint")
    each = series(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    measures = metrics.return_measures(each, ppy=PPY).withColumn("trial", number).persist(StorageLevel.MEMORY_AND_DISK)
    rows = reports.growth_paths(each).withColumns({"equity_value": F.col("growth"), "base": F.col("net"), "scale": F.lit(1.0)}).withColumn("trial", number)
    for i, (run, knob, value, kept) in enumerate((("first", "lookback", F.col("trial") * 10, "sharpe"), ("second", "skip", F.col("trial") + 1, "hit_rate"))):
        mine = F.col("trial") % 2 == i
        runs.save_run(root, run, rows.where(mine), measures.where(mine), {})
        runs.save_sweep(root, run, measures.where(mine).select("trial", value.alias(knob), kept))
    measures.unpersist()
    each.unpersist()
    return emit(runs.stored_sweep(spark, root), "run", "trial", "sharpe", "hit_rate", "lookback", "skip", "start")
