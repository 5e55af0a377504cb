"""Risk controls above the book: volatility target and drawdown breaker.

The volatility target alone is a window expression. With a breaker, or with settings that differ between
trials, each trial's sessions (one row each) are one group of arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .book import TRIAL, BookConfig, knob


def vol_scale(base: Column, target: float, lookback: int, max_leverage: float, ppy: int, by: Sequence[str] = TRIAL) -> Column:
    """Multiplier of each session from base returns up to the session before; 1 until there are enough.

    Sessions with a base return of exactly 0 are left out: the book was not invested.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    look = w.rowsBetween(-(lookback - 1), Window.currentRow)
    moved = F.when(base != 0, base)
    enough = (F.count(F.lit(1)).over(look) == lookback) & (F.count(moved).over(look) >= max(10, lookback // 2))
    sd = F.stddev_samp(moved).over(look)
    wanted = F.when(enough & (sd > 0), F.least(F.lit(float(max_leverage)), F.try_divide(F.lit(float(target)), sd * float(ppy) ** 0.5)))
    return F.coalesce(F.lag(F.coalesce(wanted, F.lit(1.0))).over(w), F.lit(1.0))


def _wanted_leverage(base: np.ndarray, target: float, lookback: int, cap: float, ppy: int) -> np.ndarray:
    """Leverage asked for at the close of each session."""
    wanted = np.ones(len(base))
    if np.isnan(target) or len(base) < lookback:
        return wanted
    recent = np.lib.stride_tricks.sliding_window_view(np.where(base != 0, base, np.nan), lookback)
    seen = np.isfinite(recent).sum(axis=1)
    usable = np.flatnonzero(seen >= max(10, lookback // 2))
    sd = np.nanstd(recent[usable], axis=1, ddof=1)
    usable, sd = usable[sd > 0], sd[sd > 0]
    wanted[usable + lookback - 1] = np.minimum(cap, target / (sd * np.sqrt(ppy)))
    return wanted


def _breaker(base, gross, wanted, limit, cooldown, rate):
    """(scale in force, net return, whether the breaker is on, resizing cost) of each session.

    Between two trips the path is a running product, so the next trip is found by an array search over the
    rest of the path and the sessions up to the restart are filled at once.
    """
    days = len(base)
    scale = np.concatenate([[1.0], wanted[:-1]])[:days]
    held = np.concatenate([[0.0], gross[:-1]])[:days]  # gross exposure that a resize applies to
    active = np.zeros(days, dtype=bool)
    cost = np.abs(np.diff(scale, prepend=1.0)) * held * rate
    net = scale * base - cost
    start, value, peak = 0, 1.0, 1.0
    while not np.isnan(limit) and cooldown > 0 and start < days:
        path = value * np.cumprod(1.0 + net[start:])
        high = np.maximum.accumulate(np.maximum(path, peak))
        trips = np.flatnonzero(path / high - 1.0 <= -limit)
        if not len(trips):
            break
        trip = start + int(trips[0])
        restart = trip + cooldown + 1
        flat = slice(trip + 1, restart)
        value = path[trip - start]
        resized = np.zeros(len(scale[flat]))
        resized[:1] = np.abs(scale[trip]) * held[flat][:1] * rate
        scale[flat], cost[flat], net[flat] = 0.0, resized, -resized
        active[trip : restart - 1] = True
        if restart < days:  # back from nothing to what is wanted then
            cost[restart] = np.abs(scale[restart]) * held[restart] * rate
            net[restart] = scale[restart] * base[restart] - cost[restart]
        value = peak = value * float(np.prod(1.0 + net[flat]))
        start = restart
    return scale, net, active, cost


KNOBS = ("vol_target", "vol_lookback", "max_leverage", "dd_limit", "dd_cooldown_days", "periods_per_year")


def apply_overlay(daily: DataFrame, config: BookConfig = BookConfig(), by: Sequence[str] = TRIAL) -> DataFrame:
    """daily + scale, breaker, overlay_cost, net. Knobs come from columns of ``daily`` or the config."""
    keys = list(by)
    per_trial = any(k in daily.columns for k in KNOBS)
    if not per_trial and config.vol_target is None and config.dd_limit is None:
        return daily.withColumns(
            {"scale": F.lit(1.0), "breaker": F.lit(False), "overlay_cost": F.lit(0.0), "net": F.col("base")}
        )
    if not per_trial and config.dd_limit is None:
        w = Window.partitionBy(*keys).orderBy("pos")
        scale = vol_scale(
            F.col("base"), config.vol_target, config.vol_lookback, config.max_leverage, config.periods_per_year, keys
        )
        out = daily.withColumn("scale", scale)
        step = F.abs(F.col("scale") - F.coalesce(F.lag("scale").over(w), F.lit(1.0)))
        resized = step * F.coalesce(F.lag("gross").over(w), F.lit(0.0)) * F.col("cost_rate")
        out = out.withColumns({"breaker": F.lit(False), "overlay_cost": resized})
        return out.withColumn("net", F.col("scale") * F.col("base") - F.col("overlay_cost"))

    rows = daily
    for name in KNOBS:
        rows = rows.withColumn(f"_{name}", knob(daily, name, config).cast("double"))
    added = [T.StructField(c, T.DoubleType()) for c in ("scale", "overlay_cost", "net")]
    schema = T.StructType(list(daily.schema.fields) + added + [T.StructField("breaker", T.BooleanType())])
    columns = daily.columns

    def one_trial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        first = pdf.iloc[0]
        base = pdf["base"].to_numpy(dtype=float)
        out = pdf[columns].copy()
        if pd.isna(first["_vol_target"]) and pd.isna(first["_dd_limit"]):
            return out.assign(scale=1.0, overlay_cost=0.0, net=base, breaker=False)
        wanted = _wanted_leverage(
            base,
            float(first["_vol_target"]) if pd.notna(first["_vol_target"]) else np.nan,
            int(first["_vol_lookback"]),
            float(first["_max_leverage"]),
            int(first["_periods_per_year"]),
        )
        limit = float(first["_dd_limit"]) if pd.notna(first["_dd_limit"]) else np.nan
        scale, net, active, cost = _breaker(
            base, pdf["gross"].to_numpy(dtype=float), wanted, limit, int(first["_dd_cooldown_days"]), float(first["cost_rate"])
        )
        return out.assign(scale=scale, overlay_cost=cost, net=net, breaker=active)

    return rows.groupBy(*keys).applyInPandas(one_trial, schema)


def equity_curve(daily: DataFrame, capital: float | Column = 1_000_000.0, by: Sequence[str] = TRIAL) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pos")
    return daily.withColumn("equity_value", capital * F.product(1 + F.col("net")).over(w))


def live_from(daily: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, live_pos): the first session with any holding, else the first session."""
    held = F.min(F.when(F.col("gross") > 0, F.col("pos")))
    return daily.groupBy(*by).agg(F.coalesce(held, F.min("pos")).alias("live_pos"))


def from_live(daily: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """Sessions from the first holding on, by a window on the small daily table."""
    trial = Window.partitionBy(*by)
    held = F.min(F.when(F.col("gross") > 0, F.col("pos"))).over(trial)
    first = F.coalesce(held, F.min("pos").over(trial))
    return daily.withColumn("live_pos", first).where(F.col("pos") >= F.col("live_pos"))
