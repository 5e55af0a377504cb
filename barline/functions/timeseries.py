"""Rolling functions down each ticker's dense session grid.

Every function looks back only, and a window of n sessions yields null unless all n cells are
present. All of them share one partitioning (ticker) and one order (pos), so any number of them
in a plan costs a single exchange and a single sort. A partition is one ticker's sessions; the
panel holds one row per (ticker, session), so its size is bounded by the length of the calendar.

Arguments that are themselves window expressions are better staged with ``withColumn`` first:
some functions mention their argument more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .elementwise import div, number, window_size

TICKER: tuple[str, ...] = ("ticker",)


def down(by: Sequence[str] = TICKER) -> WindowSpec:
    """One ticker's sessions in order."""
    return Window.partitionBy(*by).orderBy("pos")


def trailing(n: int, by: Sequence[str] = TICKER) -> WindowSpec:
    return down(by).rowsBetween(-(n - 1), Window.currentRow)


def _whole(value: Column, x: Column, n: int, by: Sequence[str]) -> Column:
    w = trailing(n, by)
    return F.when(F.count(x).over(w) == n, value)


def ts_mean(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n)
    return _whole(F.avg(x).over(trailing(n, by)), x, n, by)


def ts_std(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n, 2)
    return _whole(F.stddev_samp(x).over(trailing(n, by)), x, n, by)


def ts_sum(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n)
    return _whole(F.sum(x).over(trailing(n, by)), x, n, by)


def ts_min(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n)
    return _whole(F.min(x).over(trailing(n, by)), x, n, by)


def ts_max(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n)
    return _whole(F.max(x).over(trailing(n, by)), x, n, by)


def ts_median(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n)
    return _whole(F.percentile(x, F.lit(0.5)).over(trailing(n, by)), x, n, by)


def ts_rank(x, n, by=TICKER) -> Column:
    """Average-tie percentile of today's value among its own last n."""
    x, n = number(x), window_size(n, 2)
    values = F.collect_list(x).over(trailing(n, by))
    # the pair (values below, values equal) in one pass over an array of at most MAX_WINDOW items
    place = F.aggregate(
        values,
        F.lit(0.0),
        lambda acc, y: acc + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0),
        lambda acc: (acc + 0.5) / n,
    )
    return _whole(place, x, n, by)


def ts_zscore(x, n, by=TICKER) -> Column:
    x, n = number(x), window_size(n, 2)
    return div(x - ts_mean(x, n, by), ts_std(x, n, by))


def ts_delay(x, n, by=TICKER) -> Column:
    return F.lag(number(x), window_size(n)).over(down(by))


def ts_delta(x, n, by=TICKER) -> Column:
    x = number(x)
    return x - ts_delay(x, n, by)


def ts_return(x, n, by=TICKER) -> Column:
    x = number(x)
    return div(x, ts_delay(x, n, by)) - 1.0


def ts_corr(x, y, n, by=TICKER) -> Column:
    """Pearson correlation over complete windows; null where a side does not vary."""
    n = window_size(n, 3)
    x, y = number(x), number(y)
    w = trailing(n, by)
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    pairs = F.when(x.isNotNull() & y.isNotNull(), 1.0)
    return _whole(div(F.covar_samp(x, y).over(w), spread), pairs, n, by)


def corrected_skew(population_skew: Column, n) -> Column:
    """Bias-corrected skewness from Spark's population value."""
    n = number(n)
    return population_skew * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(population_excess: Column, n) -> Column:
    """Bias-corrected excess kurtosis from Spark's population value."""
    n = number(n)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_excess + 6)


def ts_skew(x, n, by=TICKER) -> Column:
    """Bias-corrected skewness; a window without variation has none (0.0)."""
    x, n = number(x), window_size(n, 3)
    w = trailing(n, by)
    flat = F.min(x).over(w) == F.max(x).over(w)
    skew = F.when(flat, 0.0).otherwise(corrected_skew(F.skewness(x).over(w), F.lit(n)))
    return _whole(skew, x, n, by)


def ts_decay_linear(x, n, by=TICKER) -> Column:
    """Weighted mean with weights n (today) down to 1.

    sum((pos - start) * x) splits into two plain rolling sums, so no array of lags is built.
    """
    x, n = number(x), window_size(n, 1, 512)
    w = trailing(n, by)
    pos = F.col("pos").cast("double")
    weighted = F.sum(pos * x).over(w) - (pos - n) * F.sum(x).over(w)
    return _whole(weighted / (n * (n + 1) / 2), x, n, by)
