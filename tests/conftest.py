from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "barline-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def weekdays(n: int, start: str = "2024-01-01") -> list[dt.date]:
    return [t.date() for t in pd.bdate_range(start, periods=n)]


def bars(ticker, dates, closes, adj=None, volume=1000.0):
    """Price rows with all sides at the close."""
    adj = closes if adj is None else adj
    return [(d, ticker, c, c, c, c, a, volume) for d, c, a in zip(dates, map(float, closes), map(float, adj))]


def wide(df, value: str) -> pd.DataFrame:
    """date x ticker frame of a long Spark result."""
    pdf = df.select("date", "ticker", value).toPandas()
    return pdf.pivot(index="date", columns="ticker", values=value).sort_index()


def column(df, ticker: str, value: str) -> list:
    rows = df.where(f"ticker = '{ticker}'").orderBy("date").select(value).collect()
    return [r[0] for r in rows]
