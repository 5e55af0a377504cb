"""Bring a warehouse up to date from landed market data: the incremental and the full load.

New bars are adjusted, cleaned and upserted (only the years they touch are rewritten). Splits executed
since the refresh re-base older rows of the split tickers. Meta keeps sectors known earlier; the
universe's intervals are rebuilt for the refreshed tickers from their first stored bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjust, relate, reports
from ..operators.cleaning import clean_prices
from ..operators.intervals import intervals_from_prices
from ..schema import META
from ..session import checkpointed
from ..sources.warehouse import Warehouse


def next_start(wh: Warehouse) -> str | None:
    """First date not stored yet, as text; None for an empty warehouse."""
    day = reports.refresh_start(wh.read("prices", ["date"])).first()[0]
    return None if day is None else str(day)


def load_bars(
    wh: Warehouse, bars: DataFrame, splits: DataFrame, order: Sequence[str], source: str = "", spike: float = 0.5
) -> DataFrame:
    """Adjust, clean and upsert landed bars; returns the tickers that got rows."""
    rows = checkpointed(clean_prices(adjust.apply_splits(bars, splits), order, spike))
    wh.write("prices", rows, source)
    return rows.select("ticker").distinct()


def rebase_stored(wh: Warehouse, splits: DataFrame, since: str) -> None:
    """Fold splits executed on or after ``since`` into the rows stored before it."""
    rows = adjust.readjust_touched(wh.read("prices"), splits, since)
    if rows.head(1):
        wh.write("prices", rows, f"splits since {since}")


def rebuild_adjusted(wh: Warehouse, splits: DataFrame) -> int:
    """adj_close of every stored row from a complete split table."""
    return wh.rewrite_prices(adjust.apply_splits(wh.read("prices"), splits), "rebuild adj_close")


def refresh(
    wh: Warehouse,
    bars: DataFrame,
    splits: DataFrame,
    reference: DataFrame,
    universe: str,
    order: Sequence[str],
    since: str | None = None,
    source: str = "",
) -> None:
    """One refresh: bars of listed tickers, re-based history, meta, membership.

    ``since`` is the first new date (None for a first load, which needs no re-basing).
    """
    listed = relate.keep_listed(bars, reference)
    got = checkpointed(load_bars(wh, listed, splits, order, source))
    if not got.head(1):
        return
    if since is not None:
        rebase_stored(wh, splits, since)
    fresh = relate.meta_for_priced(got, reference.select(*META.fieldNames()))
    wh.write("meta", relate.carry_sectors(fresh, wh.read("meta")), source)
    stored = wh.read("prices", ["date", "ticker"]).join(got, "ticker", "left_semi")
    wh.write("membership", intervals_from_prices(stored, wh.read("meta"), universe), source)


def missing_constituents(wh: Warehouse, universe: str) -> DataFrame:
    """Constituents of a universe without a single price row."""
    members = wh.read("membership", ["ticker", "universe"]).where(F.col("universe") == universe)
    return relate.without_prices(members, wh.read("prices", ["ticker"]))
