"""Functions across the universe members of one date.

All are windows over the date (with ``trial`` or a group prepended where needed), so they share
one exchange with each other and with the portfolio construction that follows. A partition is one
date: at most one row per ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .elementwise import div, number

DATE: tuple[str, ...] = ("date",)


def across(by: Sequence[str] = DATE) -> WindowSpec:
    return Window.partitionBy(*by)


def members(x, mask="mask") -> Column:
    """x inside the universe, null outside; a ``mask`` of None takes every row."""
    return number(x) if mask is None else F.when(F.col(mask), number(x))


def counted(x: Column, by: Sequence[str] = DATE) -> Column:
    """How many values there are, in the order of :func:`average_rank`, so that one pass serves both."""
    return F.count(x).over(across(by).orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def average_rank(x: Column, by: Sequence[str] = DATE) -> Column:
    """1-based rank, ties sharing the mean of their places; null stays null.

    With nulls last, ``rank`` is the first place of a tie and the running count up to and including
    the current value is its last, so one sort serves both.
    """
    w = across(by).orderBy(x.asc_nulls_last())
    first = F.rank().over(w)
    last = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (first + last) / 2.0)


def rank(x, by=DATE, mask="mask") -> Column:
    """Average-tie percentile in (0, 1]."""
    x = members(x, mask)
    return average_rank(x, by) / counted(x, by)


def zscore(x, by=DATE, mask="mask") -> Column:
    x = members(x, mask)
    w = across(by)
    return div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def demean(x, by=DATE, mask="mask") -> Column:
    x = members(x, mask)
    return x - F.avg(x).over(across(by))


def scale(x, by=DATE, mask="mask") -> Column:
    """x divided by the sum of absolute values."""
    x = members(x, mask)
    return div(x, F.sum(F.abs(x)).over(across(by)))


def winsorize(x, k: float, by=DATE, mask="mask") -> Column:
    """Clip to k sample deviations around the mean; a lone member has no bounds and is kept."""
    x = members(x, mask)
    w = across(by)
    mu, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
    clipped = F.greatest(F.least(x, mu + float(k) * sd), mu - float(k) * sd)
    return F.when(x.isNotNull(), F.when(sd.isNull(), x).otherwise(clipped))


def group_neutralize(x, group: str, by=DATE, mask="mask") -> Column:
    """x minus the mean of its group on the date; tickers without a label form one group."""
    x = members(x, mask)
    w = Window.partitionBy(*by, F.coalesce(F.col(group), F.lit("__none__")))
    return x - F.avg(x).over(w)


def median(x: Column, by: Sequence[str] = DATE) -> Column:
    """Exact median from the date's sorted rows (no per-date value list is built)."""
    w = across(by)
    place = F.row_number().over(w.orderBy(x.asc_nulls_last()))
    n = F.count(x).over(w)
    middle = (place == F.floor((n + 1) / 2)) | (place == F.ceil((n + 1) / 2))
    return F.avg(F.when(middle & x.isNotNull(), x)).over(w)
