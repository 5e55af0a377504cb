"""Long price tables -> the dense point-in-time panel (date, pos, ticker, mask, sector, fields).

Shape of the plan: price rows, membership changes and published fundamentals of a ticker are put on
one timeline, which is exchanged by ticker and sorted once. Everything after that - as-of carrying, the
membership mask, returns and their breaks, traded-value averages - is a window in that order over the
rows that exist. Membership and fundamentals are therefore never joined by range. The dense grid is
grown last, by exploding each row up to the next one of its ticker, not by a product of dates and
tickers. Only the calendar is broadcast (see ``sessions``: bounded by the date type).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import div
from ..functions.timeseries import ts_mean
from .sessions import EARLIEST, session_calendar, session_of_day

ASSUMED_DELISTING_RETURN = -0.30  # fixed value: used when a delisted ticker has no recorded return
RAW = ("open", "high", "low", "close", "adj_close", "volume")
PANEL_COLUMNS = (
    "date", "pos", "ticker", "mask", "sector", "close", "raw_close", "returns", "open", "high", "low",
    "volume", "vwap", "dollar_volume", "adv20", "last_pos",
)
PLACES = ("date", "pos", "ticker", "mask", "sector", "raw_close", "last_pos")  # columns that are no field of a signal


# -- selection ------------------------------------------------------------------
def restrict_tickers(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    return df.where(F.col("ticker").isin(list(tickers)))


def universe_members(membership: DataFrame, universe: str) -> DataFrame:
    return membership.where(F.col("universe") == universe)


def ever_members(prices: DataFrame, membership: DataFrame, universe: str) -> DataFrame:
    """Prices of the tickers that ever belong to the universe."""
    names = universe_members(membership, universe).select("ticker").distinct()
    return prices.join(names, "ticker", "left_semi")


def ever_liquid(prices: DataFrame, floor: float) -> DataFrame:
    """Prices of tickers whose best single day reaches ``floor`` in traded value.

    The maximum is combined before its shuffle, so the reduction moves one row per ticker and task.
    """
    peak = prices.groupBy("ticker").agg(F.max(F.col("close") * F.col("volume")).alias("peak"))
    return prices.join(peak.where(F.col("peak") >= floor).select("ticker"), "ticker", "left_semi")


def select_prices(
    prices: DataFrame,
    end: str | None = None,
    tickers: Sequence[str] | None = None,
    universe: str = "all",
    membership: DataFrame | None = None,
    min_dollar_volume: float | None = None,
) -> DataFrame:
    out = prices
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
        if "year" in prices.columns:  # also prune the year partitions of a stored table
            out = out.where(F.col("year") <= F.year(F.lit(end).cast("date")))
    if tickers:
        out = restrict_tickers(out, tickers)
    if universe != "all":
        if membership is None:
            raise ValueError(f"universe {universe!r} needs a membership table")
        out = ever_members(out, membership, universe)
    if min_dollar_volume is not None:
        out = ever_liquid(out, min_dollar_volume)
    return out.select("date", "ticker", *RAW)


# -- timeline --------------------------------------------------------------------
def membership_changes(membership: DataFrame, universe: str, day_map: DataFrame) -> DataFrame:
    """(ticker, eff_pos, delta): +1 where an interval opens, -1 on the session after it closes.

    The running sum of delta counts covering intervals, so overlaps need no merging.
    """
    spans = universe_members(membership, universe).where(
        F.col("start_date").isNotNull() & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("start_date")))
    )
    moves = F.array(
        F.struct(F.col("start_date").alias("day"), F.lit(1).alias("delta")),
        F.struct(F.date_add("end_date", 1).alias("day"), F.lit(-1).alias("delta")),
    )
    changes = spans.select("ticker", F.explode(moves).alias("m")).select("ticker", "m.day", "m.delta")
    return _on_sessions(changes.where(F.col("day").isNotNull()), day_map).select(
        "ticker", "eff_pos", "n_sessions", "delta"
    )


def _on_sessions(rows: DataFrame, day_map: DataFrame) -> DataFrame:
    """Attach the first session on or after ``day``; rows later than the last session drop out."""
    rows = rows.withColumn("day", F.greatest("day", F.lit(EARLIEST).cast("date")))
    return rows.join(F.broadcast(day_map), "day")


def latest_published(fundamentals: DataFrame) -> DataFrame:
    """One value per (ticker, field, available_date): the latest period published that day.

    Only then are missing values skipped, so a newer period that is empty hides an older one of the
    same day. ``max_by`` combines before the shuffle.
    """
    return (
        fundamentals.groupBy("ticker", "field", "available_date")
        .agg(F.max_by("value", F.coalesce("period_end", F.lit(EARLIEST).cast("date"))).alias("value"))
        .where(F.col("value").isNotNull() & F.col("available_date").isNotNull())
    )


def published_facts(fundamentals: DataFrame, fields: Sequence[str], day_map: DataFrame) -> DataFrame:
    """(ticker, eff_pos, one struct(value, available_date) per field)."""
    facts = latest_published(fundamentals.where(F.col("field").isin(list(fields))))
    facts = _on_sessions(facts.withColumnRenamed("available_date", "day").withColumn("stamp", F.col("day")), day_map)
    picks = [
        F.max_by(
            F.when(F.col("field") == f, F.struct("value", "stamp")),
            F.when(F.col("field") == f, F.col("stamp")),
        ).alias(_carry(f))
        for f in fields
    ]
    return facts.groupBy("ticker", "eff_pos", "n_sessions").agg(*picks)


def _carry(field: str) -> str:
    return f"_asof_{field}"


def field_names(fundamentals: DataFrame) -> list[str]:
    """Distinct field names: they become columns, so there are only as many as a table can have."""
    return sorted(r[0] for r in fundamentals.select("field").distinct().collect())


def _timeline(px, calendar, universe, membership, fundamentals, fields, meta) -> DataFrame:
    """Price rows (kind 1), membership changes and published facts (kind 0) of every ticker."""
    line = px.join(F.broadcast(calendar.select("date", "pos", "n_sessions")), "date").drop("date")
    line = line.withColumn("kind", F.lit(1))
    if universe != "all" or fields:
        day_map = session_of_day(calendar)
        if universe != "all":
            moves = membership_changes(membership, universe, day_map).withColumnRenamed("eff_pos", "pos")
            line = line.unionByName(moves.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        if fields:
            facts = published_facts(fundamentals, fields, day_map).withColumnRenamed("eff_pos", "pos")
            line = line.unionByName(facts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    if meta is not None:
        return line.join(meta.select("ticker", "sector", "delisted_date", "delisting_return"), "ticker", "left")
    return line.withColumns(
        {
            "sector": F.lit(None).cast("string"),
            "delisted_date": F.lit(None).cast("date"),
            "delisting_return": F.lit(None).cast("double"),
        }
    )


def _at_events(line: DataFrame, universe: str, fields, max_gap_sessions: int, max_daily_gain: float) -> DataFrame:
    """What each event row knows: state carried so far, its return with artefacts broken out, adv20.

    Everything is a window down the ticker in (pos, kind) order: one exchange, one sort. Sessions a
    ticker did not trade have no row yet; frames that must count them are ranges over ``pos``.
    """
    name = Window.partitionBy("ticker")
    order = name.orderBy("pos", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    always = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered, so that one pass serves all
    line = line.withColumn("adj", F.coalesce("adj_close", "close"))
    print_pos = F.when(F.col("adj").isNotNull(), F.col("pos"))
    line = line.withColumns(
        {
            "_member": (F.sum("delta").over(so_far) > 0) if universe != "all" else F.lit(True),
            "_from": F.when(F.lag("pos").over(order).isNull(), 0).otherwise(F.col("pos")),
            "_to": F.coalesce(F.lead("pos").over(order) - 1, F.col("n_sessions") - 1),
            "_carried": F.last("adj", ignorenulls=True).over(so_far),
            "_earlier": F.last("adj", ignorenulls=True).over(before),
            "_printed": F.last(print_pos, ignorenulls=True).over(before),
            "_priced": F.max("kind").over(always) == 1,
            "last_pos": F.max(print_pos).over(always),
            **{_carry(f): F.last(_carry(f), ignorenulls=True).over(so_far) for f in fields},
        }
    )
    change = F.when(F.col("adj").isNotNull(), div(F.col("adj"), F.col("_earlier")) - 1.0)
    rejoined = F.col("pos") - F.col("_printed") > max_gap_sessions
    line = line.withColumn("_return", F.when(~F.coalesce(rejoined, F.lit(False)), change))
    line = line.withColumns(
        {
            "_jump": F.when(F.col("_return") > max_daily_gain, 1),
            "_traded": F.col("close") * F.col("volume"),
        }
    )
    sessions = name.orderBy("pos")
    month = sessions.rangeBetween(-19, Window.currentRow)
    line = line.withColumns(
        {
            "_jump_next": F.max("_jump").over(sessions.rangeBetween(1, 1)),
            "adv20": F.when(F.count("_traded").over(month) == 20, F.avg("_traded").over(month)),
        }
    )
    # a jump is a break; a crash that the very next session undoes by a jump was a bad print
    undone = (F.col("_return") < -0.9) & F.col("_jump_next").isNotNull()
    broken = F.col("_jump").isNotNull() | F.coalesce(undone, F.lit(False))
    return line.withColumn("_return", F.when(~broken, F.col("_return")))


def _on_grid(line: DataFrame, fields) -> DataFrame:
    """One row per session: each event row is unfolded up to the session before the ticker's next event."""
    rows = line.where(F.col("_priced") & (F.col("_to") >= F.col("_from")))
    rows = rows.select("*", F.explode(F.sequence("_from", "_to")).alias("cell"))
    cell = F.col("cell")
    here = (cell == F.col("pos")) & (F.col("kind") == 1)
    reached = cell >= F.col("pos")
    factor = div(F.col("adj"), F.col("close"))
    on_day = lambda c: F.when(here, c)
    # halted inside its life: the price is carried, so the return is zero
    carried = F.when(reached & F.col("_carried").isNotNull() & (cell <= F.col("last_pos")), 0.0)
    traded = F.when(here & F.col("adj").isNotNull(), F.col("_return")).otherwise(carried)
    booked = F.col("delisted_date").isNotNull() & (cell == F.col("last_pos") + 1)
    high, low = F.col("high") * factor, F.col("low") * factor
    return rows.select(
        cell.alias("pos"),
        "ticker",
        (here & F.col("close").isNotNull() & F.coalesce("_member", F.lit(False))).alias("mask"),
        "sector",
        on_day(F.col("adj")).alias("close"),
        on_day(F.col("close")).alias("raw_close"),
        F.when(booked, F.coalesce("delisting_return", F.lit(ASSUMED_DELISTING_RETURN))).otherwise(traded).alias("returns"),
        on_day(F.col("open") * factor).alias("open"),
        on_day(high).alias("high"),
        on_day(low).alias("low"),
        on_day(F.col("volume")).alias("volume"),
        on_day(F.coalesce((high + low + F.col("adj")) / 3.0, F.col("adj"))).alias("vwap"),
        on_day(F.col("_traded")).alias("dollar_volume"),
        on_day(F.col("adv20")).alias("adv20"),
        "last_pos",
        *[F.when(reached, F.col(_carry(f))).alias(_carry(f)) for f in fields],
    )


def with_known_fields(grid: DataFrame, fields: Sequence[str], max_staleness_days: int = 400) -> DataFrame:
    """Value of each field as known on the date, null once its publication is too old."""
    known = {}
    for f in fields:
        carried = F.col(_carry(f))
        fresh = F.datediff(F.col("date"), carried["stamp"]) <= max_staleness_days
        known[f] = F.when(fresh, carried["value"])
    return grid.withColumns(known).drop(*[_carry(f) for f in fields]) if fields else grid


def build_panel(
    prices: DataFrame,
    membership: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    meta: DataFrame | None = None,
    *,
    universe: str = "all",
    start: str | None = None,
    end: str | None = None,
    tickers: Sequence[str] | None = None,
    fields: Sequence[str] | None = None,
    max_staleness_days: int = 400,
    min_dollar_volume: float | None = None,
    max_gap_sessions: int = 20,
    max_daily_gain: float = 9.0,
) -> DataFrame:
    """The dense panel: one row per (session, ticker).

    A ticker's missing day is a row of nulls, because a session counts for shifts and windows whether
    or not the ticker printed. ``start`` is cut off last: returns, adv20 and as-of values are warm.
    The calendar is read several times by the plan and is kept: a row per session.
    """
    px = select_prices(prices, end, tickers, universe, membership, min_dollar_volume)
    calendar = session_calendar(px, start).persist()
    if fundamentals is None:
        fields = []
    elif fields is None:
        fields = field_names(fundamentals)
    line = _timeline(px, calendar, universe, membership, fundamentals, list(fields), meta)
    line = _at_events(line, universe, fields, max_gap_sessions, max_daily_gain)
    grid = _on_grid(line, fields)

    wanted = calendar.select("pos", "date", *(["cut_pos"] if start is not None else []))
    if start is not None:
        wanted = wanted.where(F.col("cut_pos") >= 0)
    grid = grid.join(F.broadcast(wanted), "pos")
    if start is not None:
        grid = grid.withColumns({"last_pos": F.col("last_pos") - F.col("pos") + F.col("cut_pos"), "pos": F.col("cut_pos")})
    grid = with_known_fields(grid, fields, max_staleness_days)
    return grid.select(*PANEL_COLUMNS, *fields)


# -- on a finished panel -------------------------------------------------------------
def slice_panel(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= date <= end; ``pos`` and ``last_pos`` are counted again from the new start."""
    out = panel
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    name = Window.partitionBy("ticker")
    out = out.withColumn("_first", F.min("pos").over(name))
    out = out.withColumn("pos", F.col("pos") - F.col("_first"))
    if "last_pos" in panel.columns:
        printed = F.when(F.col("close").isNotNull(), F.col("pos"))
        out = out.withColumn("last_pos", F.max(printed).over(name))
    return out.drop("_first")


def liquid_mask(panel: DataFrame, min_adv: float | None) -> DataFrame:
    """Narrow the mask to members whose 20-session traded value reaches the floor (null fails)."""
    if min_adv is None:
        return panel
    if "adv20" in panel.columns:
        adv = F.col("adv20")
    elif "volume" in panel.columns:
        adv = ts_mean(F.col("close") * F.col("volume"), 20)
    else:
        return panel
    return panel.withColumn("mask", F.col("mask") & F.coalesce(adv >= min_adv, F.lit(False)))


def panel_calendar(panel: DataFrame) -> DataFrame:
    """(date, pos, n_sessions) of a finished panel."""
    days = panel.select("date", "pos").distinct()
    return days.withColumn("n_sessions", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))
