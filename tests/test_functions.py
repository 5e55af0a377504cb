"""Rolling and cross-sectional functions against pandas on data with gaps and ties."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import crosssection as xs
from barline.functions import elementwise as el
from barline.functions import recursive, sliding
from barline.functions import timeseries as ts

N = 40


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2024-01-01", periods=N)
    x = pd.DataFrame(np.round(rng.normal(0, 1, (N, 5)), 1), index=days, columns=list("ABCDE"))
    y = pd.DataFrame(np.round(rng.normal(0, 1, (N, 5)), 1), index=days, columns=list("ABCDE"))
    x[rng.random((N, 5)) < 0.06] = np.nan
    x.iloc[10:20, 0] = 2.0  # a flat stretch
    mask = pd.DataFrame(rng.random((N, 5)) < 0.8, index=days, columns=list("ABCDE"))
    return x, y, mask


@pytest.fixture(scope="module")
def grid(spark, frames):
    x, y, mask = frames
    rows = [
        (d.date(), i, t, None if np.isnan(x.loc[d, t]) else float(x.loc[d, t]), float(y.loc[d, t]), bool(mask.loc[d, t]), "g" if t in "AB" else None)
        for i, d in enumerate(x.index)
        for t in x.columns
    ]
    layout = "date date, pos int, ticker string, x double, y double, mask boolean, sector string"
    return spark.createDataFrame(rows, layout).cache()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got = got.astype(float).to_numpy()
    np.testing.assert_allclose(got, want.to_numpy(dtype=float), rtol=1e-9, atol=1e-10)


def test_rolling_functions_equal_pandas(grid, frames):
    x, y, _ = frames
    c = F.col("x")
    cases = {
        "mean": (ts.ts_mean(c, 4), x.rolling(4).mean()),
        "std": (ts.ts_std(c, 4), x.rolling(4).std()),
        "sum": (ts.ts_sum(c, 3), x.rolling(3).sum()),
        "lo": (ts.ts_min(c, 3), x.rolling(3).min()),
        "hi": (ts.ts_max(c, 3), x.rolling(3).max()),
        "med": (ts.ts_median(c, 4), x.rolling(4).median()),
        "rank": (ts.ts_rank(c, 5), x.rolling(5).rank(pct=True)),
        "z": (ts.ts_zscore(c, 4), ((x - x.rolling(4).mean()) / x.rolling(4).std()).replace([np.inf, -np.inf], np.nan)),
        "lag": (ts.ts_delay(c, 2), x.shift(2)),
        "delta": (ts.ts_delta(c, 2), x - x.shift(2)),
        "ret": (ts.ts_return(c, 2), (x / x.shift(2) - 1).replace([np.inf, -np.inf], np.nan)),
        "skew": (ts.ts_skew(c, 5), x.rolling(5).skew()),
        "decay": (ts.ts_decay_linear(c, 3), (3 * x + 2 * x.shift(1) + x.shift(2)) / 6),
    }
    pdf = grid.select("date", "ticker", *[e.alias(k) for k, (e, _) in cases.items()]).toPandas()
    for name, (_, want) in cases.items():
        got = pdf.pivot(index="date", columns="ticker", values=name).sort_index()
        flat = got.isna().to_numpy() & (x.rolling(4).std() < 1e-12).to_numpy() if name == "z" else False
        same(got.mask(flat) if name == "z" else got, want.mask(flat) if name == "z" else want)


def test_rolling_correlation_is_null_without_variance(grid, frames):
    x, y, _ = frames
    pdf = grid.select("date", "ticker", ts.ts_corr(F.col("x"), F.col("y"), 4).alias("v")).toPandas()
    got = pdf.pivot(index="date", columns="ticker", values="v").sort_index().astype(float)
    want = x.rolling(4).corr(y)
    flat = (x.rolling(4).max() == x.rolling(4).min()).to_numpy()
    assert got.to_numpy()[flat].size and np.isnan(got.to_numpy()[flat]).all()
    same(got.mask(flat), want.mask(flat))


def test_exponential_averages_equal_pandas(grid, frames):
    x = frames[0]
    out = recursive.with_averages(grid, {"e": ("ema", "x", 4), "r": ("rsi", "x", 3)}).toPandas()
    same(out.pivot(index="date", columns="ticker", values="e").sort_index(), x.ewm(span=4, adjust=False, min_periods=4).mean())
    move = x.diff()
    up = move.clip(lower=0).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()
    down = (-move.clip(upper=0)).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()
    want = 100 - 100 / (1 + (up / down).replace([np.inf, -np.inf], np.nan))
    same(out.pivot(index="date", columns="ticker", values="r").sort_index(), want)


def test_cross_sectional_functions_see_members_only(grid, frames):
    x, _, mask = frames
    m = x.where(mask)
    mu, sd = m.mean(axis=1), m.std(axis=1)
    group = m.copy()
    for names in (["A", "B"], ["C", "D", "E"]):
        group[names] = m[names].sub(m[names].mean(axis=1), axis=0)
    c = F.col("x")
    cases = {
        "rank": (xs.rank(c), m.rank(axis=1, pct=True)),
        "z": (xs.zscore(c), m.sub(mu, axis=0).div(sd, axis=0).replace([np.inf, -np.inf], np.nan)),
        "demean": (xs.demean(c), m.sub(mu, axis=0)),
        "scale": (xs.scale(c), m.div(m.abs().sum(axis=1), axis=0).replace([np.inf, -np.inf], np.nan)),
        "wins": (xs.winsorize(c, 0.5), m.clip(lower=mu - 0.5 * sd, upper=mu + 0.5 * sd, axis=0)),
        "neutral": (xs.group_neutralize(c, "sector"), group),
    }
    pdf = grid.select("date", "ticker", *[e.alias(k) for k, (e, _) in cases.items()]).toPandas()
    for name, (_, want) in cases.items():
        same(pdf.pivot(index="date", columns="ticker", values=name).sort_index(), want)


def test_median_and_functions_of_functions(grid, frames):
    x, _, mask = frames
    staged = grid.withColumn("m", ts.ts_delta(F.col("x"), 2))
    out = staged.select("date", "ticker", xs.median(xs.members(F.col("x"))).alias("med"), xs.rank(F.col("m")).alias("k")).toPandas()
    med = out.groupby("date")["med"].first().astype(float)
    np.testing.assert_allclose(med.to_numpy(), x.where(mask).median(axis=1).to_numpy())
    same(out.pivot(index="date", columns="ticker", values="k").sort_index(), (x - x.shift(2)).where(mask).rank(axis=1, pct=True))


def test_no_function_looks_ahead(grid):
    exprs = [
        ts.ts_zscore(F.col("x"), 5).alias("a"),
        ts.ts_rank(F.col("x"), 5).alias("b"),
        xs.rank(F.col("y")).alias("c"),
        ts.ts_corr(F.col("x"), F.col("y"), 5).alias("d"),
    ]
    key = ["date", "ticker"]
    full = grid.select(*key, *exprs).where("date <= '2024-02-05'").toPandas().sort_values(key).reset_index(drop=True)
    cut = grid.where("date <= '2024-02-05'").select(*key, *exprs).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(full, cut)
    averages = {"e": ("ema", "y", 3), "r": ("rsi", "y", 3)}
    full = recursive.with_averages(grid, averages).where("pos < 20").toPandas().sort_values(key).reset_index(drop=True)
    cut = recursive.with_averages(grid.where("pos < 20"), averages).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(full, cut)


@pytest.mark.parametrize("n", [0, -1, 2521, True, float("inf"), "5"])
def test_bad_windows_are_refused(n):
    with pytest.raises(ValueError):
        el.window_size(n)


def test_windows_round_half_to_even():
    assert (el.window_size(2.5), el.window_size(3.5), el.window_size(4.2)) == (2, 4, 4)


def test_missing_values_in_row_functions(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (-4.0, 2.0, 0.0)], "a double, b double, z double")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(
        el.lt(a, b), el.ne(a, b), el.div(a, z), el.larger(a, b), el.clip(b, 0, 1), el.choose(el.gt(b, 0), 1, 2),
        el.truth(b), el.negate(b), el.fill_missing(b, 9), el.sqrt(a), el.log(a), el.power(a, 0.5), el.add(el.gt(a, 0), 1),
    ).collect()
    assert list(row[0]) == [False, True, None, 1.0, None, 2.0, False, True, 9.0, 1.0, 0.0, 1.0, 2.0]
    assert list(row[1]) == [True, True, None, 2.0, 1.0, 1.0, True, False, 2.0, None, None, None, 1.0]


def test_overflow_and_nan_become_null(spark):
    df = spark.createDataFrame([(1e308, float("nan"))], "a double, b double")
    row = df.select(el.mul(F.col("a"), 10), el.finite(F.col("b")), el.div(F.col("a"), 1e-10)).first()
    assert list(row) == [None, None, None]


@pytest.mark.parametrize("n", [2, 5, 40, 700])
def test_averages_equal_pandas_over_long_and_broken_histories(spark, n):
    """Thousands of sessions, gaps of one and of hundreds, values that jump by orders of magnitude."""
    from barline.functions.recursive import with_averages

    g = np.random.default_rng(n)
    x = np.exp(np.cumsum(g.normal(0, 0.05, 3000)))
    x[g.random(3000) < 0.1] = np.nan
    x[1200:1650] = np.nan
    x[:7] = np.nan
    rows = [(t, i, None if np.isnan(v) else float(v * s)) for t, s in (("A", 1.0), ("B", 1e-6)) for i, v in enumerate(x)]
    out = with_averages(spark.createDataFrame(rows, "ticker string, pos int, close double"), {"e": ("ema", "close", n), "r": ("rsi", "close", n)})
    s = pd.Series(x)
    move = s.diff()
    smooth = lambda y: y.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    rise, fall = smooth(move.clip(lower=0)), smooth((-move).clip(lower=0))
    for t, scale in (("A", 1.0), ("B", 1e-6)):
        got = out.where(F.col("ticker") == t).orderBy("pos").toPandas()
        np.testing.assert_allclose(got["e"].to_numpy(float), (s * scale).ewm(span=n, adjust=False, min_periods=n).mean(), rtol=1e-9)
        np.testing.assert_allclose(got["r"].to_numpy(float), (100 * rise / (rise + fall)).where(fall > 0), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("size", [4, 4096])
def test_sliding_statistics_equal_windows(spark, monkeypatch, size):
    monkeypatch.setattr(sliding, "BLOCK_SESSIONS", size)
    g = np.random.default_rng(size)
    rows = [(t, p, None if g.random() < 0.03 else round(float(g.normal()), 1), "kept") for t in "ab" for p in range(3, 90)]
    df = spark.createDataFrame(rows, "ticker string, pos int, x double, other string").repartition(3)
    wanted = {f"{kind}{n}": (kind, "x", n) for kind in ("median", "rank") for n in (2, 5, 20)} | {"median1": ("median", "x", 1)}
    got = sliding.with_order_statistics(df, wanted)
    windows = {"median": ts.ts_median, "rank": ts.ts_rank}
    want = df.withColumns({name: windows[kind](F.col(x), n) for name, (kind, x, n) in wanted.items()})
    a, b = (x.orderBy("ticker", "pos").toPandas() for x in (got, want))
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    with pytest.raises(ValueError, match="window"):
        sliding.with_order_statistics(df, {"y": ("rank", "x", 1)})


def test_sliding_cost_does_not_grow_with_the_window():
    x = np.random.default_rng(1).normal(size=20_000)

    def took(n):
        begun = time.perf_counter()
        for kind in ("median", "rank"):
            for _ in range(5):
                sliding.slide(x, kind, n)
        return time.perf_counter() - begun

    took(20)
    assert took(2520) < 3 * took(20)


@pytest.mark.parametrize("kind", ["ema", "rsi"])
def test_averages_sort_each_ticker_twice(spark, grid, kind):
    """Once by session and once by stretch, however many windows follow."""
    plan = recursive.with_averages(grid.select("date", "pos", "ticker", "x"), {"v": (kind, "x", 5)})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") <= 2 and text.count("Exchange hashpartitioning") == 1
