"""A strategy as data plus the few functions that turn its knobs into Column expressions.

``raw(knobs)`` is evaluated down each ticker, ``finish(column, by)`` across each date. Splitting the
signal there lets every variant of a sweep share one scan and one ticker exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crosssection as xs
from ..functions import elementwise as el
from ..functions import recursive
from ..functions import timeseries as ts

Knobs = Mapping[str, float]


@dataclass(frozen=True)
class Rules:
    """Entry and exit conditions; a side left out is never traded."""

    enter_long: Callable[[Knobs], Column] | None = None
    exit_long: Callable[[Knobs], Column] | None = None
    enter_short: Callable[[Knobs], Column] | None = None
    exit_short: Callable[[Knobs], Column] | None = None

    def __post_init__(self):
        if self.enter_long is None and self.enter_short is None:
            raise ValueError("rules need an entry for at least one side")


@dataclass(frozen=True)
class History:
    """A signal as a function of one column's past, for any number of settings: an array read per row, not a column each.

    ``value(ago, knobs)`` builds the signal from ``ago(n)``, the column ``n`` sessions back, and a struct of knobs;
    ``reach`` says how many sessions back a setting looks.
    """

    column: str
    reach: Callable[[Knobs], int]
    value: Callable[[Callable[[Column], Column], Column], Column]


@dataclass(frozen=True)
class Strategy:
    name: str
    knobs: Knobs
    raw: Callable[[Knobs], Column]
    signal_knobs: Sequence[str] = ()
    finish: Callable[[Column, Sequence[str]], Column] = lambda x, by: x
    prepare: Callable[[DataFrame, Sequence[Knobs]], DataFrame] | None = None
    history: History | None = None  # the same signal as ``raw``
    rules: Rules | None = None
    direction: str = "long_short"
    weighting: str = "equal"
    long_quantile: float | str = 0.2  # a number or the name of a knob
    short_quantile: float | str = 0.2
    max_weight: float | str = 0.1
    gross_exposure: float | str = 1.0
    vol_lookback: int = 60
    rebalance: str = "weekly"
    min_adv: float | None = None
    tickers: Sequence[str] = field(default_factory=tuple)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)  # of knobs, for a default grid

    @property
    def mode(self) -> str:
        return "quantile" if self.rules is None else "rules"


def momentum(lookback: int = 120, skip: int = 5, top_quantile: float = 0.2, **changes) -> Strategy:
    """Rank by the return over ``lookback`` sessions, leaving out the latest ``skip``."""

    def raw(k: Knobs) -> Column:
        near, far = int(round(k["skip"])), int(round(k["skip"] + k["lookback"]))
        return el.div(ts.ts_delay(F.col("close"), near), ts.ts_delay(F.col("close"), far)) - 1.0

    def from_history(ago, k: Column) -> Column:
        near, far = (F.bround(n, 0).cast("int") for n in (k["skip"], k["skip"] + k["lookback"]))
        return el.div(ago(near), ago(far)) - 1.0

    settings = dict(
        name="trailing_return_rank",
        knobs={"lookback": lookback, "skip": skip, "top_quantile": top_quantile},
        raw=raw,
        history=History("close", lambda k: max(el.window_size(k["skip"]), el.window_size(k["skip"] + k["lookback"])), from_history),
        signal_knobs=("lookback", "skip"),
        finish=lambda x, by: xs.rank(x, by),
        long_quantile="top_quantile",
        short_quantile="top_quantile",
        ranges={"lookback": (40, 260), "skip": (0, 20)},
    )
    return Strategy(**{**settings, **changes})


def dip_buyer(
    rsi_window: int = 14, oversold: float = 30, recovered: float = 55, trend_window: int = 200, position_cap: float = 0.05, **changes
) -> Strategy:
    """Buy what is oversold inside an uptrend, sell when it has recovered."""

    def prepare(panel: DataFrame, variants: Sequence[Knobs]) -> DataFrame:
        lengths = sorted({int(round(k["rsi_window"])) for k in variants})
        return recursive.with_averages(panel, {f"rsi_{n}": ("rsi", "close", n) for n in lengths})

    rsi = lambda k: F.col(f"rsi_{int(round(k['rsi_window']))}")
    trend = lambda k: ts.ts_mean(F.col("close"), k["trend_window"])
    settings = dict(
        name="oversold_in_uptrend",
        knobs={
            "rsi_window": rsi_window,
            "oversold": oversold,
            "recovered": recovered,
            "trend_window": trend_window,
            "position_cap": position_cap,
        },
        raw=lambda k: -rsi(k),
        signal_knobs=("rsi_window", "oversold", "recovered", "trend_window"),
        prepare=prepare,
        rules=Rules(
            enter_long=lambda k: el.both(el.lt(rsi(k), k["oversold"]), el.gt(F.col("close"), trend(k))),
            exit_long=lambda k: el.gt(rsi(k), k["recovered"]),
        ),
        direction="long_only",
        max_weight="position_cap",
        rebalance="daily",
        ranges={"rsi_window": (5, 25), "oversold": (15, 40), "trend_window": (50, 250)},
    )
    return Strategy(**{**settings, **changes})
