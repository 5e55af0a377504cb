"""Performance, rank-correlation and selection-bias measures per trial.

Return-series measures are one aggregate over (trial, session) rows; drawdown needs a running window
inside the trial. The normal distribution is the only thing Spark lacks: it is applied by a scalar
pandas function to one row per trial.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crosssection import average_rank
from ..functions.elementwise import div
from ..functions.timeseries import down
from .book import TRIAL

EULER_GAMMA = 0.5772156649015329  # fixed value: Euler's constant


# -- aggregates over one return series ---------------------------------------------------
def growth(r) -> Column:
    return F.coalesce(F.product(1 + F.col(r)), F.lit(1.0))


def cumulative_return(r="net") -> Column:
    return growth(r) - 1


def annualised_return(r="net", ppy: int = 252) -> Column:
    n = F.count(F.lit(1))
    return F.when(growth(r) > 0, F.pow(growth(r), F.lit(float(ppy)) / n) - 1).otherwise(-1.0)


def annualised_vol(r="net", ppy: int = 252) -> Column:
    return F.stddev_samp(r) * math.sqrt(ppy)


def _mean_over(mean: Column, spread: Column, ppy: int) -> Column:
    return F.when(spread > 0, F.try_divide(mean, spread) * math.sqrt(ppy))


def sharpe_ratio(r="net", ppy: int = 252, rf: float = 0.0) -> Column:
    excess = F.col(r) - rf / ppy
    return _mean_over(F.avg(excess), F.stddev_samp(excess), ppy)


def downside(r="net") -> Column:
    return F.sqrt(F.avg(F.pow(F.when(F.col(r) < 0, F.col(r)).otherwise(F.when(F.col(r).isNotNull(), 0.0)), F.lit(2.0))))


def sortino_ratio(r="net", ppy: int = 252) -> Column:
    return _mean_over(F.avg(r), downside(r), ppy)


def hit_rate(r="net") -> Column:
    return F.avg(F.coalesce(F.col(r) > 0, F.lit(False)).cast("double"))


def information_ratio(r="net", benchmark="benchmark", ppy: int = 252) -> Column:
    active = F.col(r) - F.coalesce(F.col(benchmark), F.lit(0.0))
    return _mean_over(F.avg(active), F.stddev_samp(active), ppy)


def benchmark_return(benchmark="benchmark", ppy: int = 252) -> Column:
    n = F.count(F.lit(1))
    total = F.coalesce(F.product(1 + F.coalesce(F.col(benchmark), F.lit(0.0))), F.lit(1.0))
    return F.when(total > 0, F.pow(total, F.lit(float(ppy)) / n) - 1).otherwise(-1.0)


def annual_turnover(turnover="turnover", ppy: int = 252) -> Column:
    return F.avg(turnover) * ppy


def with_drawdown(df: DataFrame, r: str = "net", by: Sequence[str] = TRIAL, out: str = "drawdown") -> DataFrame:
    """Loss from the highest equity so far; the starting capital counts as a high."""
    so_far = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_equity", F.product(1 + F.col(r)).over(so_far))
    high = F.greatest(F.max("_equity").over(so_far), F.lit(1.0))
    return df.withColumn(out, F.col("_equity") / high - 1).drop("_equity")


def calmar(annual: Column, worst: Column) -> Column:
    return F.when(worst < 0, annual / F.abs(worst))


def return_measures(df: DataFrame, by: Sequence[str] = TRIAL, ppy: int = 252, r: str = "net") -> DataFrame:
    """One row per trial of everything that needs only returns, benchmark and turnover columns."""
    rows = with_drawdown(df, r, by)
    aggs = [
        sharpe_ratio(r, ppy).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        cumulative_return(r).alias("cumulative_return"),
        annualised_return(r, ppy).alias("annualised_return"),
        annualised_vol(r, ppy).alias("annualised_vol"),
        sortino_ratio(r, ppy).alias("sortino"),
        hit_rate(r).alias("hit_rate"),
        *_moments(r),
    ]
    if "benchmark" in df.columns:
        aggs += [
            information_ratio(r, "benchmark", ppy).alias("information_ratio"),
            benchmark_return("benchmark", ppy).alias("benchmark_annualised_return"),
        ]
    if "turnover" in df.columns:
        aggs.append(annual_turnover("turnover", ppy).alias("annual_turnover"))
    out = rows.groupBy(*by).agg(*aggs)
    return out.withColumn("calmar", calmar(F.col("annualised_return"), F.col("max_drawdown")))


# -- rank correlation with later returns -----------------------------------------------------
def forward_return(returns, horizon: int, by: Sequence[str] = ("ticker",)) -> Column:
    """Return over the ``horizon`` sessions after each row; null unless all are present."""
    r = F.col(returns) if isinstance(returns, str) else returns
    ahead = down(by).rowsBetween(1, horizon)
    step = F.when(r.isNotNull(), F.log1p(F.greatest(r, F.lit(-0.999))))
    return F.when(F.count(step).over(ahead) == horizon, F.expm1(F.sum(step).over(ahead)))


def daily_ic(df: DataFrame, by: Sequence[str] = TRIAL, score: str = "score", forward: str = "forward", least: int = 5) -> DataFrame:
    """(by, date, ic): Pearson correlation of average ranks over complete names, dates with at least ``least``."""
    key = (*by, "date")
    rows = df.where(F.col(score).isNotNull() & F.col(forward).isNotNull()).select(*key, score, forward)
    rows = rows.withColumns(
        {"_a": average_rank(F.col(score), key), "_b": average_rank(F.col(forward), key)}
    )
    ic = div(F.covar_samp("_a", "_b"), F.stddev_samp("_a") * F.stddev_samp("_b"))
    return (
        rows.groupBy(*key)
        .agg(ic.alias("ic"), F.count(F.lit(1)).alias("names"))
        .where((F.col("names") >= least) & F.col("ic").isNotNull())
        .drop("names")
    )


def ic_measures(ic: DataFrame, horizon: int = 5, by: Sequence[str] = TRIAL) -> DataFrame:
    """Mean, deviation, their ratio, hit rate, and a t-statistic on every ``horizon``-th surviving date."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("date"))
    rows = ic.withColumn("_apart", F.when((nth - 1) % horizon == 0, F.col("ic")))
    sd, apart_sd = F.stddev_samp("ic"), F.stddev_samp("_apart")
    out = rows.groupBy(*by).agg(
        F.count("ic").alias("_n"),
        F.avg("ic").alias("ic_mean"),
        sd.alias("ic_std"),
        F.when(sd > 0, F.try_divide(F.avg("ic"), sd)).alias("ic_ir"),
        F.when(apart_sd > 0, F.try_divide(F.avg("_apart"), apart_sd) * F.sqrt(F.count("_apart"))).alias("ic_tstat"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_hit_rate"),
    )
    names = ("ic_mean", "ic_std", "ic_ir", "ic_tstat", "ic_hit_rate")
    return out.withColumns({c: F.when(F.col("_n") >= 2, F.col(c)) for c in names}).drop("_n")


# -- selection bias ---------------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(NormalDist().cdf, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf, na_action="ignore").astype("float64")


def _moments(r: str) -> list[Column]:
    """Per-period Sharpe, bias-corrected skew and kurtosis (normal = 3), and the number of returns."""
    n, sd = F.count(r), F.stddev_samp(r)
    skew = F.when((n > 2) & (sd > 0), F.skewness(r) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
    kurt = F.when((n > 3) & (sd > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(r) + 6) + 3)
    return [
        n.alias("n_returns"),
        F.when(sd > 0, F.try_divide(F.avg(r), sd)).alias("period_sharpe"),
        skew.alias("skew"),
        kurt.alias("kurt"),
    ]


def moments(df: DataFrame, r: str = "net", by: Sequence[str] = TRIAL) -> DataFrame:
    return df.groupBy(*by).agg(*_moments(r))


def probabilistic_sharpe(benchmark=0.0) -> Column:
    """Chance that the true per-period Sharpe exceeds ``benchmark``; needs the ``moments`` columns."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    sr, skew, kurt, n = (F.col(c) for c in ("period_sharpe", "skew", "kurt", "n_returns"))
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    z = F.when((n >= 3) & (spread > 0), (sr - b) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread)))
    return normal_cdf(z)


def expected_max_sharpe(n_trials, variance) -> Column:
    """Best per-period Sharpe to expect from ``n_trials`` strategies without skill."""
    n = (n_trials if isinstance(n_trials, Column) else F.lit(n_trials)).cast("double")
    v = variance if isinstance(variance, Column) else F.lit(float(variance))
    usable = (n >= 2) & (v > 0)
    many = F.when(usable, n)
    z = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / many) + EULER_GAMMA * normal_quantile(1 - 1 / (many * math.e))
    return F.when(usable, F.sqrt(F.when(v > 0, v)) * z).otherwise(0.0)


def deflated_sharpe(n_trials, variance) -> Column:
    return probabilistic_sharpe(expected_max_sharpe(n_trials, variance))


def summarize(
    df: DataFrame,
    by: Sequence[str] = TRIAL,
    ppy: int = 252,
    ic: DataFrame | None = None,
    ic_horizon: int = 5,
    n_trials: int = 1,
    variance: float = 0.0,
    r: str = "net",
) -> DataFrame:
    """One record per trial: return measures, rank correlation, Sharpe corrected for selection."""
    out = return_measures(df, by, ppy, r)
    out = out.withColumn("psr", probabilistic_sharpe())
    out = out.withColumn("n_trials", F.lit(n_trials).cast("bigint"))
    out = out.withColumn("deflated_sharpe", deflated_sharpe(n_trials, variance))
    if ic is not None:
        out = out.join(ic_measures(ic, ic_horizon, by), list(by), "left")
    return out


OBJECTIVES = ("sharpe", "sortino", "annualised_return", "calmar")  # fixed values


def objective_scores(df: DataFrame, objective: str, by: Sequence[str], ppy: int = 252, r: str = "net") -> DataFrame:
    """(by, objective score); only calmar needs the drawdown window."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {sorted(OBJECTIVES)}")
    if objective == "calmar":
        rows = with_drawdown(df, r, by)
        out = rows.groupBy(*by).agg(annualised_return(r, ppy).alias("_annual"), F.min("drawdown").alias("_worst"))
        return out.select(*by, calmar(F.col("_annual"), F.col("_worst")).alias("score"))
    expr = {"sharpe": sharpe_ratio, "sortino": sortino_ratio, "annualised_return": annualised_return}[objective]
    return df.groupBy(*by).agg(expr(r, ppy).alias("score"))


# -- objectives from parts ------------------------------------------------------------------------
#: What is known of a stretch of sessions: rows, returns, their mean and squared deviations, squares of losses, growth;
#: of its equity path the highest and lowest value, start included, and the worst drawdown.
SUMMARY = ("rows", "n", "mean", "m2", "loss2", "growth", "high", "low", "worst")


def block_summary(r: str) -> Column:
    """An aggregate: all of a summary but the path."""
    n = F.count(r)
    return F.struct(
        F.count(F.lit(1)).alias("rows"),
        n.alias("n"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(r) * n, F.lit(0.0)).alias("m2"),
        F.coalesce(F.sum(F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0))), F.lit(0.0)).alias("loss2"),
        growth(r).alias("growth"),
    )


def with_path(summary: Column, returns: Column) -> Column:
    """The summary with the extremes of the path of ``returns``, in their order."""
    start = F.struct(*[F.lit(1.0).alias(c) for c in ("value", "high", "low")], F.lit(0.0).alias("worst"))

    def step(s: Column, x: Column) -> Column:
        value = s["value"] * (1 + F.coalesce(x, F.lit(0.0)))
        high = F.greatest(s["high"], value)
        return F.struct(value.alias("value"), high.alias("high"), F.least(s["low"], value).alias("low"), F.least(s["worst"], value / high - 1).alias("worst"))

    parts = lambda s: F.struct(*[summary[c].alias(c) for c in SUMMARY[:6]], *[s[c].alias(c) for c in SUMMARY[6:]])
    return F.aggregate(returns, start, step, parts)


def merged_summary(a: Column, b: Column) -> Column:
    """The summary of a stretch followed by another: an associative operation."""
    n = a["n"] + b["n"]
    share = F.coalesce(F.try_divide(b["n"].cast("double"), n.cast("double")), F.lit(0.0))
    apart = b["mean"] - a["mean"]
    return F.struct(
        (a["rows"] + b["rows"]).alias("rows"),
        n.alias("n"),
        (a["mean"] + apart * share).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * share * a["n"]).alias("m2"),
        (a["loss2"] + b["loss2"]).alias("loss2"),
        (a["growth"] * b["growth"]).alias("growth"),
        F.greatest(a["high"], a["growth"] * b["high"]).alias("high"),
        F.least(a["low"], a["growth"] * b["low"]).alias("low"),
        # x / max(p, q) is the lesser of x / p and x / q
        F.least(a["worst"], b["worst"], a["growth"] * b["low"] / a["high"] - 1).alias("worst"),
    )


def _nothing() -> Column:
    zero = {"rows": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint"), "growth": F.lit(1.0), "high": F.lit(1.0), "low": F.lit(1.0)}
    return F.struct(*[zero.get(c, F.lit(0.0)).alias(c) for c in SUMMARY])


def merged_summaries(summaries: Column) -> Column:
    return F.aggregate(summaries, _nothing(), merged_summary)


def running_summaries(summaries: Column) -> Column:
    """The summaries of all beginnings of a history."""
    add = lambda done, s: F.concat(done, F.array(merged_summary(F.coalesce(F.try_element_at(done, F.lit(-1)), _nothing()), s)))
    kinds = ",".join(f"{c}:{'bigint' if c in ('rows', 'n') else 'double'}" for c in SUMMARY)
    return F.aggregate(summaries, F.array().cast(f"array<struct<{kinds}>>"), add)


def summary_objective(s: Column, objective: str, ppy: int = 252) -> Column:
    """An objective of the stretch that ``s`` sums up; null where it is undefined."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {sorted(OBJECTIVES)}")
    n = s["n"].cast("double")
    mean = F.when(s["n"] > 0, s["mean"])
    if objective == "sharpe":
        return _mean_over(mean, F.when(s["n"] > 1, F.sqrt(F.try_divide(s["m2"], n - 1))), ppy)
    if objective == "sortino":
        return _mean_over(mean, F.sqrt(F.try_divide(s["loss2"], n)), ppy)
    annual = F.when(s["rows"] > 0, F.when(s["growth"] > 0, F.pow(s["growth"], F.try_divide(F.lit(float(ppy)), s["rows"].cast("double"))) - 1).otherwise(-1.0))
    return annual if objective == "annualised_return" else calmar(annual, s["worst"])
