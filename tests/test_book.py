"""Construction and book accounting: exact small cases and a day-by-day walk on random books."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import book as bk
from barline.operators import construct, overlay
from barline.plans import backtest
from barline.plans.backtest import run_backtest, run_sweep, run_walk_forward
from barline.plans.strategy import Rules, dip_buyer, momentum
from barline.functions import elementwise as el

from .conftest import weekdays

FREE = dict(commission_bps=0, slippage_bps=0, borrow_bps_annual=0)
LAYOUT = "trial bigint, date date, pos int, ticker string, close double, returns double, weight double"


def targets(spark, closes: dict, weights: dict, returns: dict | None = None):
    """Rows of one trial; a weight of None on a day means no decision that day."""
    days = weekdays(len(next(iter(closes.values()))))
    rows = []
    for t, px in closes.items():
        px = [None if p is None else float(p) for p in px]
        r = (returns or {}).get(t) or [None] + [
            None if a is None or b is None else b / a - 1 for a, b in zip(px, px[1:])
        ]
        w = weights[t]
        rows += [(0, d, i, t, px[i], r[i], None if w[i] is None else float(w[i])) for i, d in enumerate(days)]
    return bk.with_flags(spark.createDataFrame(rows, LAYOUT), "daily")


def base(book) -> list:
    return [r[0] for r in book.daily.orderBy("pos").select("base").collect()]


@pytest.mark.parametrize("lag", [0, 1, 2, 3])
def test_a_decision_earns_from_the_session_after_its_fill(spark, lag):
    path = [8, 10, 9, 9.9, 11.88, 10.692]
    moves = [0, 0.25, -0.1, 0.1, 0.2, -0.1]
    rows = targets(spark, {"ELM": path}, {"ELM": [0.6] * 6})
    got = base(bk.run_book(rows, bk.BookConfig(execution_lag=lag, **FREE)))
    # refilled to 0.6 at every close from session ``lag`` on
    assert got == pytest.approx([0.6 * m if i > lag else 0 for i, m in enumerate(moves)])


def test_costs_follow_turnover_and_shorts_pay_borrow(spark):
    still = {"ELM": [20] * 6, "OAK": [30] * 6}
    weights = {"ELM": [0.3, 0.3, -0.2, -0.2, -0.2, -0.2], "OAK": [0.5, 0.5, 0.5, 0, 0, 0]}
    rows = targets(spark, still, weights)
    fees = bk.run_book(rows, bk.BookConfig(commission_bps=4, slippage_bps=6, borrow_bps_annual=0))
    assert base(fees) == pytest.approx([0, -0.0008, 0, -0.0005, -0.0005, 0])
    lent = bk.run_book(rows, bk.BookConfig(commission_bps=0, slippage_bps=0, borrow_bps_annual=100, periods_per_year=50))
    assert base(lent) == pytest.approx([0, 0, 0, 0, -0.2 * 0.0002, -0.2 * 0.0002])


def test_weights_drift_between_fills(spark):
    closes = {"ELM": [5, 5, 5, 7, 7], "OAK": [9] * 5, "ASH": [4, 4, 4, 4, 2]}
    first = lambda w: [w] + [None] * 4
    out = bk.run_book(targets(spark, closes, {"ELM": first(0.25), "OAK": first(0.25), "ASH": first(0.5)}), bk.BookConfig(**FREE))
    assert base(out)[3:] == pytest.approx([0.1, -0.25 / 1.1])
    held = {(r["pos"], r["ticker"]): r["weight"] for r in out.weights.where("pos >= 3").collect()}
    assert held[3, "ELM"] == pytest.approx(0.35 / 1.1) and held[3, "ASH"] == pytest.approx(0.5 / 1.1)
    assert held[4, "ASH"] == pytest.approx(0.25 / 0.85) and held[4, "OAK"] == pytest.approx(0.25 / 0.85)


def test_delisting_return_is_booked_then_cash(spark):
    closes = {"ELM": [6, 6, None, None, None], "OAK": [3] * 5}
    goals = {"ELM": [0.8, None, None, None, None], "OAK": [0.2, None, None, None, None]}
    rows = targets(spark, closes, goals, {"ELM": [None, 0.0, -0.75, None, None]})
    out = bk.run_book(rows, bk.BookConfig(**FREE))
    assert base(out) == pytest.approx([0, 0, -0.6, 0, 0])
    left = {(r["pos"], r["ticker"]): r["weight"] for r in out.weights.where("pos >= 2").collect()}
    assert left == pytest.approx({(i, "OAK"): 0.5 for i in (2, 3, 4)})


def test_dead_names_leave_no_segments(spark):
    closes = {"ELM": [6, 6] + [None] * 8, "OAK": [3] * 10}
    rows = targets(spark, closes, {"ELM": [0.5] + [None] * 9, "OAK": [0.5] + [None] * 9})
    sums = bk.segment_sums(bk.with_holdings(rows))
    assert sums.where("pos > 2 AND segment IS NOT NULL").count() == 7  # one live name a session


def day_walk(closes, returns, goals, lag=1, rate=0.0006):
    """Session-by-session book over a matrix; goals rows of NaN mean no decision."""
    days, names = closes.shape
    last = [max((d for d in range(days) if np.isfinite(closes[d, j])), default=-1) for j in range(names)]
    held, out = np.zeros(names), []
    for d in range(days):
        move = np.nan_to_num(returns[d])
        pnl = held @ move
        if pnl > -1:
            held = held * (1 + move) / (1 + pnl)
        held = np.where(d > np.array(last), 0.0, held)
        traded = 0.0
        if d >= lag and np.isfinite(goals[d - lag]).any():
            new = np.where(np.isfinite(closes[d]), np.nan_to_num(goals[d - lag]), held)
            traded, held = np.abs(new - held).sum(), new
        out.append((pnl, traded, np.abs(held).sum()))
    return np.array(out)


@pytest.mark.parametrize("lag", [0, 1, 2])
def test_book_equals_a_day_by_day_walk(spark, lag):
    """Halted names, delistings, a total loss, sessions that lose more than the book, many trials at once."""
    rng = np.random.default_rng(11 + lag)
    days, names, rows, expected = weekdays(50), 6, [], {}
    for trial in range(3):
        closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, (50, names)), axis=0))
        closes[rng.random((50, names)) < 0.15] = np.nan
        closes[35:, 0] = np.nan
        returns = rng.normal(0, 0.05, (50, names))
        returns[20, 1] = -1.0
        if trial == 2:
            returns[[12, 13, 30], 2] = 6.0  # shorts of this name lose everything
        goals = np.full((50, names), np.nan)
        for d in range(3, 50, 4):
            goals[d] = rng.normal(0, 0.4, names)
        if trial == 2:
            goals[3:30:4, 2] = -0.5
        expected[trial] = day_walk(closes, returns, goals, lag)
        ok = lambda v: None if np.isnan(v) else float(v)
        rows += [
            (trial, days[d], d, f"N{j}", ok(closes[d, j]), ok(returns[d, j]), ok(goals[d, j]))
            for d in range(50)
            for j in range(names)
        ]
    frame = bk.with_flags(spark.createDataFrame(rows, LAYOUT), "daily")
    daily = bk.run_book(frame, bk.BookConfig(execution_lag=lag)).daily.toPandas()
    assert daily[daily["trial"] == 2]["ruined"].any()
    for trial, want in expected.items():
        got = daily[daily["trial"] == trial].sort_values("pos")[["pnl", "turnover", "gross"]].to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


# -- overlay -------------------------------------------------------------------------
def daily_rows(spark, values, trial=0):
    rows = [(trial, i, float(v), 1.0, 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "trial bigint, pos int, base double, gross double, cost_rate double")


def walked(base, gross, wanted, limit, rest, rate):
    """The breaker told session by session, from its rule: after a close too far below the peak since the last
    restart the book is flat for ``rest`` sessions."""
    scale, net, on, flat_until, value, peak = [], [], [], -1, 1.0, 1.0
    for t in range(len(base)):
        now = 1.0 if t == 0 else 0.0 if t <= flat_until else wanted[t - 1]
        paid = abs(now - scale[-1]) * gross[t - 1] * rate if t else 0.0
        scale.append(now)
        net.append(now * base[t] - paid)
        value *= 1 + net[t]
        peak = max(peak, value)
        if t > flat_until and value / peak - 1 <= -limit:
            flat_until = t + rest
        if t == flat_until:
            peak = value
        on.append(t < flat_until)
    return scale, net, on


@pytest.mark.parametrize("seed, rest, rate", [(1, 1, 0.0), (2, 4, 0.01), (3, 30, 0.002), (4, 200, 0.002)])
def test_breaker_equals_its_rule(seed, rest, rate):
    rng = np.random.default_rng(seed)
    base, gross, wanted = rng.normal(0, 0.03, 150), rng.uniform(0, 2, 150), rng.uniform(0.2, 2, 150)
    scale, net, on, _ = overlay._breaker(base, gross, wanted, 0.08, rest, rate)
    want = walked(base, gross, wanted, 0.08, rest, rate)
    np.testing.assert_allclose(scale, want[0])
    np.testing.assert_allclose(net, want[1], atol=1e-15)
    assert on.tolist() == want[2] and (rest > 100 or sum(np.diff(on.astype(int)) == 1) > 1)


def test_volatility_target_hits_it_without_looking_ahead(spark):
    values = np.random.default_rng(21).normal(0.0, 0.012, 900)
    shocked = values.copy()
    shocked[640] = -0.4
    settings = dict(vol_target=0.25, vol_lookback=40, max_leverage=4, **FREE)
    both = daily_rows(spark, values).unionByName(daily_rows(spark, shocked, 1))
    found = overlay.apply_overlay(both, bk.BookConfig(**settings)).toPandas().sort_values(["trial", "pos"])
    calm, other = (found[found["trial"] == i] for i in (0, 1))
    assert calm["net"][60:].std() * np.sqrt(252) == pytest.approx(0.25, rel=0.1)
    np.testing.assert_array_equal(calm["scale"].to_numpy()[:641], other["scale"].to_numpy()[:641])
    # arrays, used with a breaker, ask for the leverage that the window does
    arrays = overlay.apply_overlay(both, bk.BookConfig(dd_limit=0.99, **settings)).toPandas().sort_values(["trial", "pos"])
    np.testing.assert_allclose(arrays["scale"].to_numpy(), found["scale"].to_numpy(), rtol=1e-9)


def test_every_overlay_setting_can_differ_by_trial(spark):
    values = np.random.default_rng(9).normal(0, 0.01, 300)
    config = bk.BookConfig(vol_target=0.3, **FREE)
    for name, pair in {"vol_lookback": (15, 50), "max_leverage": (1.0, 5.0), "vol_target": (0.1, 0.2), "periods_per_year": (252, 52)}.items():
        rows = [daily_rows(spark, values, i).withColumn(name, F.lit(v)) for i, v in enumerate(pair)]
        together = overlay.apply_overlay(rows[0].unionByName(rows[1]), config).toPandas().sort_values(["trial", "pos"])
        for i, v in enumerate(pair):
            alone = overlay.apply_overlay(daily_rows(spark, values), bk.BookConfig(**{**config.__dict__, name: v})).orderBy("pos").toPandas()
            np.testing.assert_allclose(together[together["trial"] == i]["scale"].to_numpy(), alone["scale"].to_numpy(), rtol=1e-9)


def test_uninvested_sessions_do_not_lever_the_book(spark):
    values = np.r_[np.zeros(90), np.random.default_rng(4).normal(0, 0.004, 60)]
    out = overlay.apply_overlay(daily_rows(spark, values), bk.BookConfig(vol_target=0.4, vol_lookback=30, max_leverage=6, **FREE))
    assert out.where("pos <= 90 + 14").agg(F.max("scale")).first()[0] == 1.0
    assert out.agg(F.max("scale")).first()[0] > 1.0


def test_overlay_knobs_per_trial(spark):
    rows = daily_rows(spark, [0.0, -0.2, 0.1, 0.1]).withColumn("dd_limit", F.lit(0.1))
    rows = rows.unionByName(daily_rows(spark, [0.0, -0.2, 0.1, 0.1], 1).withColumn("dd_limit", F.lit(None).cast("double")))
    out = overlay.apply_overlay(rows, bk.BookConfig(**FREE)).toPandas()
    assert out[out["trial"] == 0]["net"].tolist() == [0.0, -0.2, 0.0, 0.0]
    assert out[out["trial"] == 1]["net"].tolist() == [0.0, -0.2, 0.1, 0.1]


# -- construction ---------------------------------------------------------------------
def cross(spark, scores, days=1):
    day = weekdays(days)
    rows = [(d, i, f"N{j:02d}", None if s is None else float(s), True) for i, d in enumerate(day) for j, s in enumerate(scores)]
    return spark.createDataFrame(rows, "date date, pos int, ticker string, score double, mask boolean")


def test_small_cross_sections_get_a_name_per_leg_and_no_overlap(spark):
    out = construct.target_weights(cross(spark, [1.0, None, 2.0]), max_weight=1.0).orderBy("ticker").collect()
    assert [r["weight"] for r in out] == [-0.5, 0.0, 0.5]
    alone = construct.target_weights(cross(spark, [1.0]), max_weight=1.0).first()
    assert alone["weight"] == 0.5 and construct.target_weights(cross(spark, [None])).first()["weight"] is None


def test_weights_are_neutral_capped_and_fill_the_book(spark):
    scores = np.random.default_rng(2).normal(0, 1, 30)
    out = construct.target_weights(cross(spark, scores, 2), weighting="signal", long_q=0.4, short_q=0.4, max_weight=0.06)
    w = out.toPandas().groupby("date")["weight"]
    np.testing.assert_allclose(w.sum(), 0, atol=1e-6)  # eight rounds, not a limit
    np.testing.assert_allclose(w.apply(lambda x: x.abs().sum()), 1.0, atol=1e-6)
    assert out.agg(F.max(F.abs("weight"))).first()[0] <= 0.06 + 1e-12


def test_bad_construction_settings_are_refused(spark):
    df = cross(spark, [1.0, 2.0])
    for bad in ({"long_q": 0.0}, {"mode": "x"}, {"direction": "x"}, {"weighting": "x"}):
        with pytest.raises(ValueError):
            construct.target_weights(df, **bad)


def test_two_sided_positions_follow_their_rules(spark):
    rng = np.random.default_rng(8)
    n = 200
    flags = rng.random((n, 4)) < 0.25
    member = rng.random(n) < 0.9
    flags &= member[:, None]
    rows = [(i, "A", bool(member[i]), *map(bool, flags[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "pos int, ticker string, mask boolean, el boolean, xl boolean, es boolean, xs boolean")
    got = [r["side"] for r in construct.two_sided_positions(df, "el", "xl", "es", "xs").orderBy("pos").collect()]
    state, want = 0, []
    for i in range(n):
        enter_long, exit_long, enter_short, exit_short = flags[i]
        if (state == 1 and exit_long) or (state == -1 and exit_short) or not member[i]:
            state = 0
        if state == 0:
            state = 1 if enter_long else (-1 if enter_short else 0)
        want.append(state)
    assert got == want
    one = construct.one_sided_positions(df, F.col("el"), F.col("xl")).orderBy("pos").collect()
    state, want = 0, []
    for i in range(n):
        state = 0 if (flags[i][1] or not member[i]) else state
        state = 1 if flags[i][0] else state
        want.append(state)
    assert [r["side"] for r in one] == want


# -- composed ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(3)
    n, names = 160, 12
    days = weekdays(n)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (n, names)), axis=0))
    rows = []
    for j in range(names):
        for i, d in enumerate(days):
            r = None if i == 0 else float(px[i, j] / px[i - 1, j] - 1)
            rows.append((d, i, f"N{j:02d}", True, float(px[i, j]), r, 1e7))
    return spark.createDataFrame(rows, "date date, pos int, ticker string, mask boolean, close double, returns double, adv20 double").cache()


def test_backtest_does_not_look_ahead(market):
    plan = momentum(lookback=10, skip=2, rebalance="weekly")
    whole = run_backtest(market, plan).daily.where("pos < 98").orderBy("pos").toPandas()
    cut = run_backtest(market.where("pos < 100"), plan).daily.where("pos < 98").orderBy("pos").toPandas()
    np.testing.assert_allclose(whole["net"], cut["net"], atol=1e-12)


def test_sweep_ranks_and_deflates(market):
    overrides = [{"lookback": a, "top_quantile": q} for a in (5, 20) for q in (0.1, 0.3)]
    bt, ranked, best = run_sweep(market, momentum(skip=1), overrides)
    table = ranked.toPandas()
    assert len(table) == 4 and table["sharpe"].is_monotonic_decreasing
    winner = best.first()
    assert winner["sharpe"] == pytest.approx(table["sharpe"][0]) and winner["n_trials"] == 4
    assert winner["deflated_sharpe"] < winner["psr"]
    alone = run_backtest(market, momentum(lookback=20, skip=1, top_quantile=0.3)).daily.orderBy("pos").toPandas()
    together = bt.daily.where("trial = 3").orderBy("pos").toPandas()
    np.testing.assert_allclose(alone["net"], together["net"], atol=1e-12)


def test_walk_forward_folds_do_not_overlap(market):
    folds, oos, record = run_walk_forward(market, momentum(skip=1), [{"lookback": 5}, {"lookback": 20}], train=50, test=20)
    f = folds.orderBy("fold").toPandas()
    assert len(f) == 5 and (f["train_start"] < f["test_start"]).all()
    assert (f["test_start"][1:].to_numpy() == f["test_end"][:-1].to_numpy()).all()
    days = oos.select("pos").toPandas()["pos"]
    assert days.is_unique and set(days) == set(range(f["test_start"][0], 160))
    row = record.first().asDict()
    assert "deflated_sharpe" not in row and np.isfinite(row["sharpe"]) and row["n_trials"] == 2
    with pytest.raises(ValueError, match="not enough history"):
        run_walk_forward(market, momentum(skip=1), [{"lookback": 5}], train=5000)


def test_rules_and_per_trial_settings(market):
    plan = dip_buyer(rsi_window=5, oversold=60, recovered=75, trend_window=20, position_cap=0.2)
    bt = run_backtest(market, plan, bk.BookConfig(), [{}, {"position_cap": 0.05, "commission_bps": 100}])
    caps = bt.targets.groupBy("trial").agg(F.max("weight").alias("w")).orderBy("trial").collect()
    assert caps[0]["w"] <= 0.2 + 1e-12 and caps[1]["w"] <= 0.05 + 1e-12
    costs = bt.daily.groupBy("trial").agg((F.sum("costs") / F.sum("turnover")).alias("c")).orderBy("trial").collect()
    assert costs[0]["c"] == pytest.approx(0.0006) and costs[1]["c"] == pytest.approx(0.0105)
    two = Rules(
        enter_long=lambda k: el.gt(F.col("returns"), 0.02),
        enter_short=lambda k: el.lt(F.col("returns"), -0.02),
        exit_long=lambda k: el.lt(F.col("returns"), 0),
    )
    both = momentum(lookback=5, skip=1, finish=lambda x, by: x, rules=two, max_weight=0.3)
    sides = run_backtest(market, both).targets.agg(F.min("weight"), F.max("weight")).first()
    assert sides[0] < 0 < sides[1]
    with pytest.raises(KeyError):
        run_backtest(market, plan, overrides=[{"nope": 1}])


def test_trials_may_differ_in_every_setting(market):
    other = {"execution_lag": 2, "periods_per_year": 52, "ic_horizon": 3, "initial_capital": 5.0}
    together = run_backtest(market, momentum(lookback=10, skip=2), overrides=[{}, other])
    alone = [run_backtest(market, momentum(lookback=10, skip=2)), run_backtest(market, momentum(lookback=10, skip=2), bk.BookConfig(**other))]
    found = {r["trial"]: r.asDict() for r in together.metrics().collect()}
    for i, one in enumerate(alone):
        want = one.metrics().first().asDict()
        assert {k: v for k, v in found[i].items() if k != "trial"} == pytest.approx({k: v for k, v in want.items() if k != "trial"}, nan_ok=True)
        ends = [b.daily.where(F.col("trial") == t).orderBy(F.desc("pos")).first()["equity_value"] for b, t in ((together, i), (one, 0))]
        assert ends[0] == pytest.approx(ends[1])


def test_grids_of_a_sweep():
    from barline.plans.backtest import grid_overrides

    plan = momentum(lookback=90, skip=5)
    whole = grid_overrides(plan)
    assert len(whole) == 4 * 4 and {c["lookback"] for c in whole} == {40, 90, 150, 260} and {c["skip"] for c in whole} == {0, 5, 10, 20}
    assert grid_overrides(plan, {"skip": [1, 2], "rebalance": ["daily", "weekly"]})[1] == {"skip": 1, "rebalance": "weekly"}
    some = grid_overrides(plan, max_trials=6, seed=3)
    assert len(some) == 6 and some == grid_overrides(plan, max_trials=6, seed=3) != grid_overrides(plan, max_trials=6, seed=4)
    assert [c for c in whole if c in some] == some
    with pytest.raises(ValueError, match="no values"):
        grid_overrides(plan, {"skip": []})


# -- scans over blocks of sessions ----------------------------------------------------------------
@pytest.mark.parametrize("size", [1, 4, 128])
def test_equity_scan_equals_a_walk_of_days(spark, monkeypatch, size):
    monkeypatch.setattr(bk, "BLOCK_SESSIONS", size)
    g = np.random.default_rng(3)
    rows, still = [], {(1, 13), (1, 14), (1, 16)}
    for trial in (0, 1):
        fills = []
        for t in range(5, 60):
            fills += [t] * (t % 5 == 2)
            open_ = fills[-1:] + [f for f in fills[:-1] if g.random() < 0.2]
            rows += [(trial, t, s, float(g.random()), float(g.random()), float(g.normal(0, 0.2))) for s in open_] or [(trial, t, None, 0.0, 0.0, 0.0)]
    sums = spark.createDataFrame(rows, "trial long, pos int, segment int, gross double, short double, gain double").withColumn("date", F.expr("date_add(date'2024-01-01', pos)"))
    frozen = spark.createDataFrame(sorted(still), "trial long, pos int")
    got = {(r["trial"], r["pos"]): r for r in bk.equity_path(sums, frozen=frozen).collect()}
    assert len(got) == 110
    for trial in (0, 1):
        equity, gain = {}, 0.0
        for t in range(5, 60):
            before = equity.get(t - 1, 1.0)
            pnl = gain / before
            equity[t] = before if (trial, t) in still else before + gain
            own = [r for r in rows if r[:2] == (trial, t) and r[2] is not None]
            gain = sum(r[5] * equity[r[2]] for r in own)
            row = got[trial, t]
            assert row["equity"] == pytest.approx(equity[t], rel=1e-9) and row["pnl"] == pytest.approx(pnl, rel=1e-9, abs=1e-12)
            assert row["gross"] == pytest.approx(sum(r[3] * equity[r[2]] for r in own) / equity[t], rel=1e-9)
            assert row["short"] == pytest.approx(sum(r[4] * equity[r[2]] for r in own) / equity[t], rel=1e-9)
            assert row["ruined"] == (pnl <= -1)


def test_one_long_trial_uses_several_tasks(spark):
    long = spark.range(2000).selectExpr("id DIV 1000000 AS trial", "CAST(id AS INT) AS pos", "date_add(date'2000-01-01', CAST(id AS INT)) AS date", "CAST(id - id % 20 AS INT) AS segment", "1D AS gross", "0D AS short", "0.001D AS gain")
    path = bk.equity_path(long)
    assert path.count() == 2000 and "Python" not in path._jdf.queryExecution().executedPlan().toString()
    days = path._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [trial" in days and "_block" in days.split("RepartitionByExpression [trial")[1].split("]")[0]


@pytest.mark.parametrize("size", [1, 3, 256])
def test_two_sided_positions_equal_a_walk(spark, monkeypatch, size):
    monkeypatch.setattr(construct, "BLOCK_SESSIONS", size)
    g = np.random.default_rng(size)
    rows = [(t, p, *(bool(x) for x in g.random(5) < (0.95, 0.2, 0.2, 0.2, 0.2)), float(p)) for t in "ab" for p in range(40)]
    df = spark.createDataFrame(rows, "ticker string, pos int, mask boolean, el boolean, xl boolean, es boolean, xs boolean, other double")
    got = construct.two_sided_positions(df, "el", "xl", "es", "xs")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["ticker"], r["pos"]): r for r in got.collect()}
    for t in "ab":
        side = 0
        for _, p, mask, enter_long, exit_long, enter_short, exit_short, other in rows[:40] if t == "a" else rows[40:]:
            if side == 0 or not mask or (exit_long if side == 1 else exit_short):
                side = 1 if enter_long else -1 if enter_short else 0
            assert (got[t, p]["side"], got[t, p]["other"]) == (side, other)


# -- many settings ------------------------------------------------------------------------------------
def test_signals_from_one_array_equal_columns(market, monkeypatch):
    overrides = [{"lookback": a, "skip": s} for a in (1, 5, 20, 33, 200) for s in (1, 2)]
    plan = momentum()
    rows = backtest.trial_rows(plan, overrides)
    wide = backtest.fan_out_trials(market, plan, rows, ["ticker", "pos"])
    monkeypatch.setattr(backtest, "SIDE_BY_SIDE", 100)
    side = backtest.fan_out_trials(market, plan, rows, ["ticker", "pos"])
    form = lambda df: {(r["trial"], r["ticker"], r["pos"]): r["raw"] for r in df.collect()}
    assert form(wide) == form(side)


def test_a_thousand_settings_plan_quickly(market):
    overrides = [{"lookback": 10 + i, "skip": 1 + i % 7} for i in range(1000)]
    begun = time.perf_counter()
    rows = backtest.trial_rows(momentum(), overrides)
    targets = backtest.build_targets(market, momentum(), rows, backtest.trial_frame(market, rows))
    targets._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - begun < 30


def test_trials_share_no_exchange_of_their_own(market):
    """Rows of one trial stay spread over tasks: settings come to them, not they to their trial's settings."""
    rows = backtest.trial_rows(momentum(lookback=5, skip=1), [{}])
    plan = backtest.build_targets(market, momentum(lookback=5, skip=1), rows, backtest.trial_frame(market, rows))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [trial" in text and "SortMergeJoin" not in text


def test_equal_weights_need_no_sort_by_leg(spark):
    rows = [(day, f"T{i}", s) for day, scores in (("d", [1.0, 2.0, 3.0, 4.0, None]), ("e", [None] * 5), ("f", [2.0, 2.0, None, None, None])) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "date string, ticker string, score double")
    out = construct.target_weights(df, long_q=0.5, short_q=0.25, max_weight=0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1  # places with their number, then totals with decisions
    got = {(r["date"], r["ticker"]): r["weight"] for r in out.collect()}
    assert [got["d", f"T{i}"] for i in range(5)] == [-0.3, 0.0, 0.25, 0.25, 0.0]
    assert [got["e", f"T{i}"] for i in range(5)] == [None] * 5
    assert [got["f", f"T{i}"] for i in range(5)] == [0.25, 0.25, 0.0, 0.0, 0.0]


def test_the_end_of_a_holding_shares_the_pass_of_its_growth(spark):
    layout = "trial bigint, date date, pos int, ticker string, weight double, flag boolean, close double, returns double"
    targets = spark.createDataFrame([(0, x, i, "ELM", 1.0, True, 5.0 if i < 2 else None, 0.1) for i, x in enumerate(weekdays(4))], layout)
    out = bk.with_holdings(targets, 0)
    assert [r["held"] for r in out.orderBy("pos").collect()] == pytest.approx([1.0, 1.0, 0.0, 0.0])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 3
