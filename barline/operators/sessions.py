"""The session calendar, its index, and the maps from calendar days to sessions.

Every frame built here has at most one row per calendar day. DateType bounds that (about 3.7
million days in total, some 20,000 per lifetime of data), which is why these frames may be
broadcast and numbered in one partition whatever the size of the price table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARLIEST = "1800-01-01"  # fixed value: days before it count as "before the first session"


def session_calendar(rows: DataFrame, start: str | None = None) -> DataFrame:
    """(date, pos, n_sessions) of the distinct dates; ``pos`` counts from the first date >= start."""
    order = Window.orderBy("date")
    days = rows.select("date").where(F.col("date").isNotNull()).distinct()
    days = days.withColumn("pos", F.row_number().over(order) - 1)
    days = days.withColumn("n_sessions", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))
    if start is not None:
        first = F.min(F.when(F.col("date") >= F.lit(start).cast("date"), F.col("pos")))
        days = days.withColumn("cut_pos", F.col("pos") - first.over(Window.partitionBy()))
    return days


def session_of_day(calendar: DataFrame) -> DataFrame:
    """(day, eff_pos, n_sessions): the first session on or after each day; days after the last are absent."""
    previous = F.coalesce(F.date_add(F.lag("date").over(Window.orderBy("date")), 1), F.lit(EARLIEST).cast("date"))
    return (
        calendar.withColumn("first_day", F.least(previous, F.col("date")))
        .select(F.explode(F.sequence("first_day", "date")).alias("day"), F.col("pos").alias("eff_pos"), "n_sessions")
    )


def next_weekday(date: Column) -> Column:
    """The next Monday-to-Friday day after ``date``."""
    return F.date_add(date, F.when(F.weekday(date) == 4, 3).when(F.weekday(date) == 5, 2).otherwise(1))


def week_key(date: Column) -> Column:
    """Weeks run Saturday to Friday."""
    return F.to_date(F.date_trunc("week", F.date_add(date, 2)))


def month_key(date: Column) -> Column:
    return F.to_date(F.date_trunc("month", date))


def period_end(date: Column, following: Column, freq) -> Column:
    """Does the next session belong to another period? ``freq``: daily, weekly, monthly, or a column of them."""
    if not isinstance(freq, Column):
        if freq not in ("daily", "weekly", "monthly"):
            raise ValueError(f"unknown rebalance frequency {freq!r}")
        freq = F.lit(freq)
    return (
        F.when(freq == "daily", F.lit(True))
        .when(freq == "weekly", week_key(following) != week_key(date))
        .otherwise(month_key(following) != month_key(date))
    )


def rebalance_flags(calendar: DataFrame) -> DataFrame:
    """calendar + (daily, weekly, monthly): is this session the last of its period?

    The final session counts only if the next weekday already belongs to a new period.
    """
    following = F.coalesce(F.lead("date").over(Window.orderBy("date")), next_weekday(F.col("date")))
    out = calendar.withColumn("_next", following)
    flags = {f: period_end(F.col("date"), F.col("_next"), f) for f in ("daily", "weekly", "monthly")}
    return out.withColumns(flags).drop("_next")
