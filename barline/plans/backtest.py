"""Panel + strategy (+ trials) -> targets, book, risk overlay, benchmark, metrics.

Exchanges of the price-sized rows: by ticker (panel and signal), by (trial, date) (ranks and weights),
by (trial, ticker) (holdings). Everything after the holdings works on one row per trial and session.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as el
from ..functions.timeseries import down
from ..operators import construct, metrics, overlay, tuning
from ..operators import panel as P
from ..operators.book import Book, BookConfig, book_benchmark, equal_weight_benchmark, knob, run_book, with_flags
from ..session import checkpointed
from .strategy import Strategy

@dataclass(frozen=True)
class Backtest:
    targets: DataFrame
    book: Book
    daily: DataFrame
    trials: DataFrame
    config: BookConfig
    parts: tuple["Backtest", ...] = ()  # trials that share the settings a window or a formula needs as a number

    @property
    def live(self) -> DataFrame:
        return overlay.from_live(self.daily)

    @property
    def ic(self) -> DataFrame:
        """Daily rank correlation from each trial's first live session on."""
        start = overlay.live_from(self.daily)
        rows = self.book.holdings.select("trial", "date", "pos", "score", "forward")
        rows = rows.join(start, "trial").where(F.col("pos") >= F.col("live_pos"))
        return metrics.daily_ic(rows)

    def metrics(self, n_trials: int = 1, variance: float = 0.0) -> DataFrame:
        if self.parts:
            return _union([p.metrics(n_trials, variance) for p in self.parts])
        c = self.config
        return metrics.summarize(
            self.live, ("trial",), c.periods_per_year, self.ic, c.ic_horizon, n_trials, variance
        )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def narrow(panel: DataFrame, strategy: Strategy) -> DataFrame:
    """The strategy's own universe: ticker list and liquidity floor."""
    if strategy.tickers:
        panel = P.restrict_tickers(panel, strategy.tickers)
    return P.liquid_mask(panel, strategy.min_adv)


def trial_rows(
    strategy: Strategy, overrides: Sequence[Mapping[str, object]], config: BookConfig = BookConfig()
) -> list[dict]:
    """Complete knob values of every trial; unknown names are refused.

    A book setting that only some trials change keeps its configured value in the others.
    """
    extra = {"rebalance", *BookConfig.__dataclass_fields__}
    changed = {name for change in overrides for name in change if name in BookConfig.__dataclass_fields__}
    settings = {name: getattr(config, name) for name in changed}
    rows = []
    for i, change in enumerate(overrides):
        unknown = set(change) - set(strategy.knobs) - extra
        if unknown:
            raise KeyError(f"unknown knobs {sorted(unknown)}; known: {sorted(strategy.knobs)}")
        rows.append({"trial": i, "rebalance": strategy.rebalance, **strategy.knobs, **settings, **change})
    return rows


def trial_frame(panel: DataFrame, rows: list[dict]) -> DataFrame:
    names = sorted(set().union(*rows) - {"trial", "rebalance"})
    layout = "trial bigint, rebalance string, " + ", ".join(f"`{n}` double" for n in names)
    data = [
        (r["trial"], r["rebalance"], *[None if r.get(n) is None else float(r[n]) for n in names]) for r in rows
    ]
    return panel.sparkSession.createDataFrame(data, layout)


#: So many signal settings are columns side by side; beyond, they are read from one array of a column's past.
SIDE_BY_SIDE = 8


def _from_history(panel: DataFrame, strategy: Strategy, rows: list[dict], keep: Sequence[str]) -> DataFrame:
    """The trials' signals as one transformation over a constant array of settings: the plan doesn't grow with them."""
    h = strategy.history
    reach = max(h.reach(r) for r in rows)
    past = F.collect_list(F.struct(F.col(h.column).cast("double").alias("x"))).over(down(("ticker",)).rowsBetween(-reach, 0))
    knobs = list(strategy.signal_knobs)
    kind = "array<struct<trial:bigint," + ",".join(f"`{n}`:double" for n in knobs) + ">>"
    settings = F.from_json(F.lit(json.dumps([{"trial": r["trial"], **{n: float(r[n]) for n in knobs}} for r in rows])), kind)
    ago = lambda n: F.try_element_at(F.col("_past"), -(n + 1))["x"]
    trial = lambda s: F.struct(s["trial"].alias("trial"), h.value(ago, s).alias("raw"))
    return panel.withColumn("_past", past).select(*keep, F.inline(F.transform(settings, trial)))


def fan_out_trials(panel: DataFrame, strategy: Strategy, rows: list[dict], keep: Sequence[str]) -> DataFrame:
    """One row per (panel row, trial) with the trial's raw signal and rule conditions.

    Windows are evaluated once per distinct signal setting, side by side; the trials are then unfolded
    from an array, so the panel is scanned once however many trials there are. Many settings of a signal
    that is known as a function of one column's past are read from an array of that past.
    """
    setting = lambda r: tuple(r[k] for k in strategy.signal_knobs)
    variants = {setting(r): r for r in rows}
    if strategy.history is not None and strategy.rules is None and len(variants) > SIDE_BY_SIDE:
        return _from_history(panel, strategy, rows, keep)
    if strategy.prepare is not None:
        panel = strategy.prepare(panel, list(variants.values()))
    columns: dict[str, Column] = {}
    names: dict[tuple, dict[str, str]] = {}
    for i, (key, knobs) in enumerate(variants.items()):
        parts = {"raw": strategy.raw(knobs)}
        for side in ("enter_long", "exit_long", "enter_short", "exit_short"):
            rule = getattr(strategy.rules, side) if strategy.rules else None
            if rule is not None:
                parts[side] = el.condition(rule(knobs))
        names[key] = {p: f"_{p}_{i}" for p in parts}
        columns.update({names[key][p]: c for p, c in parts.items()})
    wide = panel.withColumns(columns)
    unfold = F.array(
        *[
            F.struct(
                F.lit(r["trial"]).cast("bigint").alias("trial"),
                *[F.col(c).alias(p) for p, c in names[setting(r)].items()],
            )
            for r in rows
        ]
    )
    return wide.select(*keep, F.inline(unfold))


def _knob(strategy_value, trials: DataFrame) -> Column:
    return F.col(strategy_value) if isinstance(strategy_value, str) else F.lit(float(strategy_value))


def build_targets(
    panel: DataFrame, strategy: Strategy, rows: list[dict], trials: DataFrame, ic_horizon: int = 5
) -> DataFrame:
    """(trial, date, pos, ticker, score, weight, returns, close, forward, ...) for every trial."""
    keep = ["date", "pos", "ticker", "mask", "close", "returns", "forward"]
    panel = panel.withColumn("forward", metrics.forward_return("returns", ic_horizon))
    if strategy.weighting == "inverse_vol":
        panel = panel.withColumn("inverse_vol", construct.inverse_vol(F.col("returns"), strategy.vol_lookback))
        keep.append("inverse_vol")
    out = fan_out_trials(panel, strategy, rows, keep)
    needed = [n for n in (strategy.long_quantile, strategy.short_quantile, strategy.max_weight, strategy.gross_exposure) if isinstance(n, str)]
    # broadcast: a shuffle by trial would put all rows of a trial, windows included, into one task
    out = out.join(F.broadcast(trials.select("trial", "rebalance", *dict.fromkeys(needed))), "trial")
    if strategy.rules is not None:
        out = _positions(out, strategy)
    cross = ("trial", "date")
    out = out.withColumn("score", el.score(strategy.finish(F.col("raw"), cross)))
    return construct.target_weights(
        out,
        by=cross,
        mode=strategy.mode,
        direction=strategy.direction,
        weighting=strategy.weighting,
        long_q=_knob(strategy.long_quantile, trials),
        short_q=_knob(strategy.short_quantile, trials),
        max_weight=_knob(strategy.max_weight, trials),
        gross=_knob(strategy.gross_exposure, trials),
    )


def _positions(df: DataFrame, strategy: Strategy) -> DataFrame:
    key, rules = ("trial", "ticker"), strategy.rules
    if rules.enter_short is None:
        leave = F.col("exit_long") if rules.exit_long is not None else F.lit(False)
        return construct.one_sided_positions(df, F.col("enter_long"), leave, key)
    if rules.enter_long is None:
        leave = F.col("exit_short") if rules.exit_short is not None else F.lit(False)
        out = construct.one_sided_positions(df, F.col("enter_short"), leave, key)
        return out.withColumn("side", -F.col("side"))
    missing = [c for c in ("exit_long", "exit_short") if getattr(rules, c) is None]
    df = df.withColumns({c: F.lit(False) for c in missing})
    return construct.two_sided_positions(df, "enter_long", "exit_long", "enter_short", "exit_short", key)


def run_backtest(
    panel: DataFrame,
    strategy: Strategy,
    config: BookConfig = BookConfig(),
    overrides: Sequence[Mapping[str, object]] = ({},),
) -> Backtest:
    """Backtest one strategy, or every variant in ``overrides`` (knobs, rebalance, config names) at once."""
    rows = trial_rows(strategy, overrides, config)
    panel = narrow(panel, strategy)
    apart: dict[tuple, list[dict]] = {}
    for r in rows:
        apart.setdefault(tuple(int(r.get(k, getattr(config, k))) for k in APART), []).append(r)
    parts = [_run(panel, strategy, replace(config, **dict(zip(APART, values))), some) for values, some in apart.items()]
    if len(parts) == 1:
        return parts[0]
    book = Book(*(_union([getattr(p.book, f) for p in parts]) for f in ("holdings", "path", "daily")), parts[0].book.by)
    return Backtest(_union([p.targets for p in parts]), book, _union([p.daily for p in parts]), _union([p.trials for p in parts]), config, tuple(parts))


#: Settings that are window offsets or formula constants: trials that differ in them are computed side by side.
APART = ("execution_lag", "ic_horizon", "periods_per_year")


def _run(panel: DataFrame, strategy: Strategy, config: BookConfig, rows: list[dict]) -> Backtest:
    trials = trial_frame(panel, rows)
    targets = build_targets(panel, strategy, rows, trials, config.ic_horizon)
    knobs = [c for c in trials.columns if c in BookConfig.__dataclass_fields__]
    targets = with_flags(targets, F.col("rebalance"))
    book = run_book(targets, config, knobs=trials.select("trial", *knobs) if knobs else None)
    daily = overlay.apply_overlay(book.daily, config)
    daily = daily.join(book_benchmark(book.holdings), ["trial", "pos"])
    # a row per trial and session, read by every report: written once, so later plans start from it
    daily = checkpointed(overlay.equity_curve(daily, knob(daily, "initial_capital", config)))
    return Backtest(targets, book, daily, trials, config)


def grid_overrides(strategy: Strategy, grid: Mapping[str, Sequence] | None = None, max_trials: int | None = None, seed: int = 0, n: int = 3) -> list[dict]:
    """Knob settings of a sweep: every combination of ``grid``, or of ``n`` points of each knob's range.

    Knobs without a range (``strategy.ranges``) stay as they are. Beyond ``max_trials`` a sample by
    ``tuning.permuted`` is taken, in order of their number; the other combinations are never made.
    """
    if grid is None:
        grid = {}
        for name, (low, high) in strategy.ranges.items():
            now = strategy.knobs[name]
            whole = isinstance(now, int)
            points = {now, *((low + i * (high - low) / (n - 1)) for i in range(n) if n > 1 and low != high)}
            grid[name] = sorted({round(p) if whole else float(p) for p in points})
    if not all(len(v) for v in grid.values()):
        raise ValueError("a knob of the grid has no values")
    total, values = math.prod(len(v) for v in grid.values()), list(grid.values())
    if max_trials is None or total <= max_trials:
        numbers = range(total)
    else:
        numbers = sorted(tuning.permuted(i, total, seed) for i in range(max_trials))
    return [dict(zip(grid, tuning.combination(n, values))) for n in numbers]


def _overrides(strategy: Strategy, given, max_trials: int | None, seed: int) -> list[Mapping[str, object]]:
    if given is None or isinstance(given, Mapping):
        return grid_overrides(strategy, given, max_trials, seed)
    return list(given)


def run_sweep(
    panel: DataFrame,
    strategy: Strategy,
    overrides: Sequence[Mapping[str, object]] | Mapping[str, Sequence] | None = None,
    config: BookConfig = BookConfig(),
    objective: str = "sharpe",
    max_trials: int | None = None,
    seed: int = 0,
) -> tuple[Backtest, DataFrame, DataFrame]:
    """(backtest of all trials, trials with their metrics best first, winner with its deflated Sharpe).

    ``overrides`` lists the trials, or is a grid of values by knob; None is the strategy's default grid.
    """
    overrides = _overrides(strategy, overrides, max_trials, seed)
    bt = run_backtest(panel, strategy, config, overrides)
    table = bt.trials.join(bt.metrics(), "trial")
    ranked = tuning.rank_trials(table, objective)
    return bt, ranked, tuning.deflated_winner(table, objective, config.periods_per_year)


def run_walk_forward(
    panel: DataFrame,
    strategy: Strategy,
    overrides: Sequence[Mapping[str, object]] | Mapping[str, Sequence] | None = None,
    config: BookConfig = BookConfig(),
    train: int = 756,
    test: int = 252,
    expanding: bool = False,
    objective: str = "sharpe",
    max_trials: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, stitched out-of-sample rows, their metrics). The benchmark is the un-narrowed panel's."""
    overrides = _overrides(strategy, overrides, max_trials, seed)
    bt = run_backtest(panel, strategy, config, overrides)
    first, sessions = tuning.common_start(overlay.live_from(bt.daily), bt.daily)
    span = tuning.Span(first, sessions, train, test, expanding)
    ppy = config.periods_per_year
    folds, oos = tuning.walk_forward(bt.daily, span, objective, ppy)
    oos = oos.drop("benchmark").join(equal_weight_benchmark(panel).select("pos", "benchmark"), "pos")
    record = metrics.summarize(oos.withColumn("path", F.lit("oos")).drop("turnover"), ("path",), ppy)
    return folds, oos, record.drop("deflated_sharpe", "path").withColumn("n_trials", F.lit(len(overrides)).cast("bigint"))
