"""Metrics, grids, folds and orders: small exact cases."""

from __future__ import annotations

import math
import time
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import metrics as M
from barline.operators import orders, reports, tuning
from barline.queries import catalog

from .conftest import weekdays


def series(spark, trials: dict):
    rows = [(t, d, i, float(v), 0.0) for t, vs in trials.items() for i, (d, v) in enumerate(zip(weekdays(len(vs)), vs))]
    return spark.createDataFrame(rows, "trial string, date date, pos int, net double, benchmark double")


def test_return_measures(spark):
    rng = np.random.default_rng(14)
    data = {f"t{i}": rng.normal(0.0004, 0.012, 300 + i) for i in range(4)}
    data |= {"steady": np.full(60, 0.002), "lost": np.array([0.3, -1.0, 0.2])}
    out = {r["trial"]: r for r in M.return_measures(series(spark, data)).collect()}
    for name, x in data.items():
        path = np.cumprod(1 + x)
        assert out[name]["cumulative_return"] == pytest.approx(path[-1] - 1)
        assert out[name]["max_drawdown"] == pytest.approx(min(0, (path / np.maximum.accumulate(np.r_[1, path])[1:] - 1).min()))
        if name.startswith("t"):
            assert out[name]["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5)
            assert out[name]["annualised_return"] == pytest.approx(path[-1] ** (252 / len(x)) - 1)
    assert out["steady"]["calmar"] is None and out["steady"]["sortino"] is None
    assert out["lost"]["annualised_return"] == -1.0


def test_information_ratio_of_the_benchmark_itself(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(0, 0.01, 300)
    df = series(spark, {"x": b}).withColumn("benchmark", F.col("net"))
    assert M.return_measures(df).first()["information_ratio"] is None
    ahead = df.withColumn("net", F.col("net") + 0.001 + F.when(F.col("pos") % 2 == 0, 0.0005).otherwise(-0.0005))
    assert M.return_measures(ahead).first()["information_ratio"] > 5


def test_forward_returns_exclude_the_day_itself(spark):
    moves = [0.9, -0.05, 0.04, 0.3, 0.01]
    df = spark.createDataFrame([("ELM", i, r) for i, r in enumerate(moves)], "ticker string, pos int, returns double")
    got = [r[0] for r in df.select(M.forward_return("returns", 3).alias("f"), "pos").orderBy("pos").collect()]
    assert got[:2] == pytest.approx([0.95 * 1.04 * 1.3 - 1, 1.04 * 1.3 * 1.01 - 1]) and got[2:] == [None] * 3


def test_rank_correlation_of_a_perfect_signal(spark):
    rng = np.random.default_rng(2)
    days = weekdays(60)
    rows = [("t", d, f"N{j}", float(v), float(v) ** 3) for d in days for j, v in enumerate(rng.normal(0, 1, 8))]
    df = spark.createDataFrame(rows, "trial string, date date, ticker string, score double, forward double")
    row = M.ic_measures(M.daily_ic(df), 5).first()
    assert row["ic_mean"] == pytest.approx(1.0) and row["ic_hit_rate"] == 1.0
    few = df.where("ticker < 'N4'")
    assert M.daily_ic(few).count() == 0
    one = M.ic_measures(M.daily_ic(df.where(F.col("date") == days[0])), 5).first()
    assert one["ic_mean"] is None


def test_selection_corrected_sharpe(spark):
    r = np.random.default_rng(3).normal(0.0006, 0.01, 1500)
    m = M.moments(series(spark, {"x": r})).cache()
    row = m.select(
        M.probabilistic_sharpe().alias("p"), M.deflated_sharpe(1, 0.0).alias("d1"),
        M.deflated_sharpe(10, 0.0005).alias("d10"), M.deflated_sharpe(1000, 0.0005).alias("d1000"),
        M.expected_max_sharpe(10, 0.0005).alias("e10"), M.expected_max_sharpe(1000, 0.0005).alias("e1000"),
    ).first()
    s = pd.Series(r)
    sr, kurt = s.mean() / s.std(), s.kurt() + 3
    want = NormalDist().cdf(sr * math.sqrt(1499) / math.sqrt(1 - s.skew() * sr + (kurt - 1) / 4 * sr**2))
    assert row["p"] == pytest.approx(want) and row["d1"] == pytest.approx(want)
    assert row["p"] > row["d10"] > row["d1000"] and row["e1000"] > row["e10"] > 0
    short = M.moments(series(spark, {"x": [0.1, 0.2]})).select(M.probabilistic_sharpe()).first()[0]
    assert short is None


# -- tuning ---------------------------------------------------------------------------
def test_grid_and_sample(spark):
    trials = tuning.grid(spark, {"lookback": [20.0, 60.0], "freq": ["weekly", "monthly"], "vol": [0.1, 0.2]})
    rows = [(r["trial"], r["lookback"], r["freq"], r["vol"]) for r in trials.orderBy("trial").collect()]
    assert [r[0] for r in rows] == list(range(8)) and rows[0][1:] == (20.0, "weekly", 0.1) and rows[5][1:] == (60.0, "weekly", 0.2)
    picked = [r[0] for r in tuning.sample_trials(trials, 3, 1).collect()]
    assert len(set(picked)) == 3 and picked == [r[0] for r in tuning.sample_trials(trials, 3, 1).collect()]
    with pytest.raises(ValueError):
        tuning.grid(spark, {"a": []})


def test_default_grid(spark):
    params = spark.createDataFrame(
        [("n", 60.0, 20.0, 121.0, "int"), ("q", 0.2, 0.1, 0.3, "float"), ("k", 5.0, 5.0, 5.0, "int")],
        "name string, value double, low double, high double, kind string",
    )
    out = tuning.default_grid(params).groupBy("name").agg(F.sort_array(F.collect_list("point")).alias("p")).collect()
    got = {r["name"]: r["p"] for r in out}
    assert got["n"] == [20.0, 60.0, 70.0, 121.0] and got["q"] == pytest.approx([0.1, 0.2, 0.3]) and got["k"] == [5.0]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation_reaches_every_number_once(n):
    for seed in (0, 9):
        assert sorted(tuning.permuted(i, n, seed) for i in range(n)) == list(range(n))
    assert n < 16 or [tuning.permuted(i, n, 1) for i in range(n)] != [tuning.permuted(i, n, 2) for i in range(n)]


def test_a_sample_of_a_huge_grid_costs_its_own_size(spark):
    sizes = (1000, 1000, 1000, 1000)
    values = [list(range(k)) for k in sizes]
    begun = time.perf_counter()
    numbers = [tuning.permuted(i, 10**12, 4) for i in range(200)]
    picked = [tuning.combination(n, values) for n in numbers]
    assert time.perf_counter() - begun < 2 and len(set(numbers)) == 200
    spread = [sum(p[k] for p in picked) / 200 for k in range(4)]
    assert all(350 < m < 650 for m in spread)
    one = spark.range(1).select(*[F.sequence(F.lit(0), F.lit(k - 1)).alias(f"v{i}") for i, k in enumerate(sizes)])
    got = tuning.sample_expand(one, {f"k{i}": F.col(f"v{i}") for i in range(4)}, 200, seed=4).collect()
    assert {(r["trial"], r["k0"], r["k1"], r["k2"], r["k3"]) for r in got} == {(n, *p) for n, p in zip(numbers, picked)}
    few = tuning.sample_expand(spark.range(1).select(F.array(F.lit(5), F.lit(6)).alias("v")), {"a": F.col("v"), "b": F.col("v")}, 10).collect()
    assert sorted((r["trial"], r["a"], r["b"]) for r in few) == [(0, 5, 5), (1, 5, 6), (2, 6, 5), (3, 6, 6)]


@pytest.mark.parametrize("expanding", [False, True])
def test_fold_arithmetic_equals_the_windows(spark, expanding):
    span = tuning.Span(7, 100, 30, 17, expanding)
    folds = [tuple(r) for r in tuning.fold_table(spark, span).orderBy("fold").collect()]
    daily = spark.range(100).select(F.col("id").cast("int").alias("pos"))
    got = {(r["fold"], r["pos"]) for r in tuning.training_rows(daily, span).collect()}
    assert got == {(f, p) for f, a, b, _ in folds for p in range(a, b)}
    got = {(r["fold"], r["pos"]) for r in tuning.test_rows(daily, span).collect()}
    assert got == {(f, p) for f, _, b, c in folds for p in range(b, c)}


@pytest.mark.parametrize("expanding", [False, True])
@pytest.mark.parametrize("train, test", [(30, 17), (34, 17), (5, 17), (16, 3)])
def test_fold_scores_equal_scores_over_repeated_sessions(spark, expanding, train, test):
    g = np.random.default_rng(train)
    span = tuning.Span(7, 100, train, test, expanding)
    rows = [(t, p, None if t == 2 and p % 9 == 0 else -1.0 if t == 1 and p == 60 else float(g.normal(0.001, 0.05))) for t in range(3) for p in range(100)]
    daily = spark.createDataFrame(rows + [(3, p, 0.0) for p in range(100)], "trial long, pos int, net double")
    for objective in M.OBJECTIVES:
        by = lambda rows, c: {(r["trial"], r["fold"]): r[c] for r in rows}
        got = tuning.fold_scores(daily, span, objective, 52).collect()
        filled = daily.fillna(0.0) if objective == "calmar" else daily
        for source, c in ((tuning.training_rows, "score"), (tuning.test_rows, "oos_score")):
            want = by(M.objective_scores(source(filled, span), objective, ["fold", "trial"], 52).collect(), "score")
            found = by(got, c)
            assert found.keys() == want.keys()
            assert all((found[k] is None) == (v is None) and (v is None or found[k] == pytest.approx(v, rel=1e-9, abs=1e-12)) for k, v in want.items()), (objective, c)


def test_sessions_are_not_repeated_for_folds(spark):
    daily = spark.range(2000).selectExpr("0L AS trial", "CAST(id AS INT) AS pos", "CAST(0.001 AS DOUBLE) AS net")
    plan = tuning.fold_scores(daily, tuning.Span(0, 2000, 500, 5), "sharpe")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan


# -- orders -----------------------------------------------------------------------------
def test_shares_are_truncated_toward_zero(spark):
    wanted = {"ELM": 0.33, "OAK": -0.41, "ASH": 0.0002, "FIR": 0.1}
    w = spark.createDataFrame([(3, t, x) for t, x in wanted.items()], "trial int, ticker string, weight double")
    px = spark.createDataFrame([("ELM", 17.0), ("OAK", 23.0), ("ASH", 90.0), ("FIR", None)], "ticker string, price double")
    assert {r["ticker"]: r["shares"] for r in orders.target_shares(w, px, 5000.0).collect()} == {"ELM": 97, "OAK": -89}
    assert {r["ticker"] for r in orders.unpriced_targets(w, px).collect()} == {"FIR"}


def test_orders_sell_first_and_skip_dust(spark):
    book = lambda m: spark.createDataFrame([(3, k, v) for k, v in m.items()], "trial int, ticker string, shares bigint")
    px = spark.createDataFrame([("ELM", 4.0), ("OAK", 50.0), ("ASH", 7.0), ("YEW", 100.0)], "ticker string, price double")
    have, want = {"YEW": 3, "ELM": 80, "OAK": 20, "FIR": 6}, {"OAK": 26, "ELM": 75, "ASH": 30, "YEW": 1}
    out = orders.diff_orders(book(have), book(want), px, 100.0)
    assert [(r["side"], r["ticker"], r["quantity"]) for r in out.orderBy("nth").collect()] == [("SELL", "YEW", 2), ("BUY", "ASH", 30), ("BUY", "OAK", 6)]


def test_a_book_without_a_decision_is_left_alone(spark):
    layout = "trial int, date date, pos int, ticker string, weight double, flag boolean"
    d = weekdays(2)
    goals = [(0, d[0], 0, "ELM", 0.5, True), (0, d[1], 1, "ELM", 0.9, False), (1, d[0], 0, "ELM", 0.5, False), (1, d[1], 1, "ELM", None, True)]
    targets = spark.createDataFrame(goals, layout)
    panel = spark.createDataFrame([("ELM", 1, 10.0), ("OAK", 1, 5.0), ("FIR", 1, None)], "ticker string, pos int, close double")
    daily = spark.createDataFrame([(t, 1, 0.5, False) for t in (0, 1)], "trial int, pos int, scale double, breaker boolean")
    held = spark.createDataFrame([(t, x, 40) for t in (0, 1, 2) for x in ("OAK", "ALIEN")], "trial int, ticker string, shares bigint")
    plan = orders.order_plan(targets, panel, daily, held, 4000.0, min_notional=1.0)
    assert {(r["trial"], r["side"], r["ticker"], r["quantity"]) for r in plan.orders.collect()} == {(0, "BUY", "ELM", 100), (0, "SELL", "OAK", 40)}
    assert [(r["trial"], r["decided_on"]) for r in plan.decisions.collect()] == [(0, d[0])]
    assert {r["trial"] for r in plan.undecided.collect()} == {1, 2}
    assert {r["ticker"] for r in plan.foreign.collect()} == {"ALIEN"} and plan.unpriced.count() == 0
    with pytest.raises(ValueError, match="decision"):
        orders.order_plan(targets.where("trial = 1"), panel, daily, held, 4000.0)


def test_breaker_makes_the_target_flat(spark):
    daily = spark.createDataFrame([(0, 0, 1.0, False), (0, 1, 0.7, True)], "trial int, pos int, scale double, breaker boolean")
    assert orders.final_scale(daily).first()["scale"] == 0.0


def test_monthly_table(spark):
    df = series(spark, {"x": [0.1] * 40})  # 23 weekdays in January 2024, 17 in February
    row = reports.monthly_returns(df).first()
    assert row["m1"] == pytest.approx(1.1**23 - 1) and row["m2"] == pytest.approx(1.1**17 - 1)
    assert row["m3"] is None and row["total"] == pytest.approx(1.1**40 - 1)


# -- registry ------------------------------------------------------------------------------
QUICK = ["p19_refresh_start", "j02_j03_netted_and_cumulative_ratios", "u02_snapshots_to_intervals", "w01_ts_mean", "c01_rank",
         "m04_sharpe_ratio", "q12_cleaning_report", "b03_b06_b09_equal_weights", "a03_a08_book_accounting", "t12_degradation"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    """A few registered queries against DuckDB on the smallest tables; check.py runs all of them."""
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, cur.fetchall()) and got


def test_targets_and_panel_of_an_order_list_are_worked_out_once(spark):
    read = {k: spark.sparkContext.accumulator(0) for k in ("targets", "panel")}

    def watched(df, name):
        seen = read[name]

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    d = weekdays(2)
    goals = [(0, x, i, "YEW", 0.5, True) for i, x in enumerate(d)] + [(0, d[1], 1, "ASH", 0.25, True)]
    targets = spark.createDataFrame(goals, "trial int, date date, pos int, ticker string, weight double, flag boolean")
    panel = spark.createDataFrame([("YEW", 0, 8.0), ("YEW", 1, 10.0), ("ASH", 0, 5.0), ("ASH", 1, None), ("BOX", 1, None)], "ticker string, pos int, close double")
    daily = spark.createDataFrame([(0, 1, 1.0, False)], "trial int, pos int, scale double, breaker boolean")
    held = spark.createDataFrame([(0, "BOX", 3), (0, "ASH", 20), (0, "ALIEN", 1)], "trial int, ticker string, shares bigint")
    out = orders.plan_orders(watched(targets, "targets"), watched(panel, "panel"), daily, held, 1000.0, min_notional=1.0)
    assert {(r["side"], r["ticker"], r["quantity"]) for r in out.collect()} == {("BUY", "YEW", 50), ("BUY", "ASH", 30)}
    assert {k: v.value for k, v in read.items()} == {"targets": 3, "panel": 5}
