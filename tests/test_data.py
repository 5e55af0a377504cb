"""Files, cleaning, storage, landed pages, splits and intervals: small exact cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barline import schema
from barline.operators import adjust, cleaning, intervals, relate, reports
from barline.plans import refresh
from barline.sources import constituents, files, landed, runs
from barline.sources.snapshots import Snapshots
from barline.sources.warehouse import Warehouse, canonical, merge_upsert
from barline.streaming import landing

from .conftest import bars, weekdays

LEDGER = """When;Tic;O;H;L;Last;Shares_Traded
19/02/2026;  kelp;7,5;8;7;7.75;2,500
20/02/2026;kelp;7.75;7;8.25;8;310
20/02/2026;kelp;7.75;7;8.25;8.125;310
23/02/2026;kelp;8;64;7;60;90
21/02/2026;kelp;8;8.5;8;8.25;75
24/02/2026;kelp;8;8.5;7.5;8.375;80
25/02/2026;kelp;8;8;8;0;80
soon;kelp;8;8;8;8;8
"""


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_ledger_with_every_kind_of_fault(spark, tmp_path, sep):
    """A wrong weekday, a zero price, a repeated day, a spike that reverts, swapped sides, commas in numbers."""
    path = tmp_path / "ledger.txt"
    path.write_text("\ufeff" + LEDGER.replace(";", sep), encoding="utf-8")
    raw = files.read_raw(spark, str(path))
    roles = files.infer_mapping(raw.withColumnRenamed("When", "Day"))
    assert (roles.date, roles.ticker, roles.close, roles.volume) == ("Day", "Tic", "Last", "Shares_Traded")
    clean, _, report = files.ingest_prices(spark, str(path), files.Mapping(date="When", ticker="Tic", open="O", high="H", low="L", close="Last", volume="Shares_Traded"))
    got = [(str(r["date"]), r["ticker"], r["close"], r["volume"]) for r in clean.orderBy("date").collect()]
    assert got == [("2026-02-19", "KELP", 7.75, 2500.0), ("2026-02-20", "KELP", 8.125, 310.0), ("2026-02-24", "KELP", 8.375, 80.0)]
    counted = {(r["kind"], r["rule"]): r["n"] for r in report.collect()}
    dropped = (cleaning.UNPARSEABLE, cleaning.BAD_CLOSE, cleaning.WEEKEND, cleaning.DUPLICATE, cleaning.BAD_TICK)
    assert [counted["dropped", rule] for rule in dropped] == [1] * 5
    assert counted["rows", "in"] - counted["rows", "out"] == 5 and counted["flagged", cleaning.SWAPPED] == 1


def test_wide_file_is_scaled(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_text("day,oak,elm,ash\n2025-11-05,12,340,\n2025-11-06,14,n/a,8\n2025-11-07,15,350,9\n")
    raw = files.read_raw(spark, str(path))
    roles = files.infer_mapping(raw)
    assert roles.wide and roles.date == "day"
    out = files.apply_mapping(raw, roles.with_(price_scale=0.5))
    assert {(r["ticker"], str(r["date"])[-1], r["adj_close"]) for r in out.where("adj_close IS NOT NULL").collect()} == {
        ("OAK", "5", 6.0), ("OAK", "6", 7.0), ("OAK", "7", 7.5), ("ELM", "5", 170.0), ("ELM", "7", 175.0), ("ASH", "6", 4.0), ("ASH", "7", 4.5),
    }


def test_files_without_a_ticker_column_are_named_by_file(spark, tmp_path):
    for i, name in enumerate(("fern", "moss", "reed")):
        (tmp_path / f"{name}.csv").write_text(f"dt;px_last\n2025-03-0{i + 3};{i + 5}\n")
    clean, _, _ = files.ingest_prices(spark, str(tmp_path))
    assert {r["ticker"]: r["close"] for r in clean.collect()} == {"FERN": 5.0, "MOSS": 6.0, "REED": 7.0}


def test_folder_of_two_headers_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,ticker,close\n2025-03-03,IVY,5\n")
    (tmp_path / "b.csv").write_text("price;sym;day\n6;yew;2025-03-04\n")
    clean, roles, _ = files.ingest_prices(spark, str(tmp_path))
    assert {(r["ticker"], str(r["date"]), r["close"]) for r in clean.collect()} == {("IVY", "2025-03-03", 5.0), ("YEW", "2025-03-04", 6.0)}
    assert len(roles) == 2
    with pytest.raises(ValueError, match="different headers"):
        files.read_raw(spark, str(tmp_path))


@pytest.mark.parametrize("texts, want", [
    (["03/01/2025", "13/01/2025", ""], ["2025-01-03", "2025-01-13", None]),
    (["03/01/2025", "01/13/2025", "13/01/2025", "02/14/2025"], ["2025-03-01", "2025-01-13", None, "2025-02-14"]),
    (["3-Mar-2025", "Apr 5, 2025", "6 May 2025", "never"], ["2025-03-03", "2025-04-05", "2025-05-06", None]),
    (["02/03/2025"], ["2025-02-03"]),
])
def test_a_file_keeps_one_order_of_day_and_month(spark, texts, want):
    raw = spark.createDataFrame([(t, "F", "1", i) for i, t in enumerate(texts)], "d string, ticker string, close string, _row long")
    roles = files.Mapping(date="d", ticker="ticker", close="close")
    got = [r["date"] and str(r["date"]) for r in files.apply_mapping(raw, roles).orderBy("_row").collect()]
    assert got == want
    note = files.unreadable_dates(raw, roles).first()
    assert (note["n_rows"], note["n_unreadable"]) == (len(texts), sum(w is None and t != "" for t, w in zip(texts, want)))


def test_day_and_month_order_is_told_file_by_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,close\n02/03/2025,1\n28/03/2025,2\n")
    (tmp_path / "q.csv").write_text("date,close\n02/03/2025,1\n03/28/2025,2\n")
    clean, _, _ = files.ingest_prices(spark, str(tmp_path))
    assert {(r["ticker"], str(r["date"])) for r in clean.collect()} == {("Q", "2025-02-03"), ("P", "2025-03-28"), ("Q", "2025-03-28")}  # 2 March 2025 is a Sunday


@pytest.mark.parametrize("layout, row, what", [
    ("apples string", ("4",), "date column"),
    ("when string, day string, note string", ("a", "2025-05-05", "b"), "price column"),
])
def test_files_without_usable_columns_are_refused(spark, layout, row, what):
    with pytest.raises(ValueError, match=what):
        files.infer_mapping(spark.createDataFrame([row], layout))


def test_dates_in_several_layouts(spark):
    same = ["2031-07-09", "2031/7/9", "20310709", "2031-07-09T23:59:59Z", "2031-07-09 00:00:01.5-07:00", "09.07.2031", "9-Jul-2031"]
    df = spark.createDataFrame([(v,) for v in [*same, "31.12.2030", "?"]], "d string")
    got = [r[0] for r in df.select(files.as_date(F.col("d"), None, True)).collect()]
    assert got == [day("2031-07-09")] * len(same) + [day("2030-12-31"), None]


@pytest.mark.parametrize("path, n", [([60, 61, 20.2, 20, 21], 1), ([10, 99.5, 101, 100, 102], 1), ([60, 61, 60, 59, 58], 0)])
def test_unadjusted_split_is_flagged(spark, path, n):
    rows = [(d, "FIG", None, None, None, float(c), None, 3.0) for d, c in zip(weekdays(len(path), "2025-09-01"), path)]
    report = cleaning.cleaning_counts(spark.createDataFrame(rows, schema.PRICES), ["date"])
    assert sum(r["n"] for r in report.where("kind = 'flagged'").collect() if r["rule"] == cleaning.SPLIT) == n


def test_a_hot_group_of_copies_keeps_one_row_and_is_counted_whole(spark):
    copies = spark.range(5000).select(
        F.lit("2024-01-02").cast("date").alias("date"), F.lit("HOT").alias("ticker"),
        *[(F.col("id") + 1).cast("double").alias(c) for c in schema.PRICE_FIELDS], F.col("id").alias("place"),
    )
    assert cleaning.clean_prices(copies, ["place"]).first()["close"] == 5000.0
    report = {r["rule"]: (r["n"], r["examples"]) for r in cleaning.cleaning_report(copies, ["place"]).collect()}
    assert report[cleaning.DUPLICATE] == (4999, ", ".join(["HOT 2024-01-02"] * 5))
    plan = cleaning.cleaning_examples(copies, ["place"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # groups are cut before they are shuffled


# -- storage --------------------------------------------------------------------------
def test_upsert_touches_only_its_years(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    d = weekdays(300, "2021-06-01")
    px = lambda days, c: spark.createDataFrame(bars("PINE", days, [c] * len(days)), schema.PRICES)
    assert not wh.has("prices") and wh.read("prices").count() == 0
    assert wh.write("prices", px(d, 40), "all") == 300

    def stored(year):
        files = {f for f in wh.prices_between().inputFiles() if f"/year={year}/" in f}
        assert files
        return files

    old, new = stored(2021), stored(2022)
    late = [x for x in d if x.year == 2022][-7:]
    assert wh.write("prices", px(late, 44), "fix") == 300
    assert stored(2021) == old and not stored(2022) & new
    assert wh.read("prices", where=F.col("close") == 44).count() == 7
    assert wh.prices_between(str(late[0]), str(late[3])).count() == 4
    plan = wh.prices_between("2022-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert [(r["rows"], r["source"]) for r in wh.ingest_log().orderBy("at").collect()] == [(300, "all"), (300, "fix")]
    assert reports.refresh_start(wh.read("prices")).first()[0] == d[-1] + dt.timedelta(days=1)
    assert wh.write("prices", px(d[:2], 1), replace=True) == 2


def test_readers_see_a_table_before_or_after_a_write(spark, tmp_path, monkeypatch):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    days = weekdays(300, "2021-06-01")
    px = lambda c: spark.createDataFrame(bars("PINE", days, [c] * 300), schema.PRICES)
    closes = lambda df: {r["close"] for r in df.select("close").distinct().collect()}
    wh.write("prices", px(1.0))
    early = wh.read("prices")

    # a task that fails after other partitions were written
    bad = px(2.0).withColumn("close", F.when(F.year("date") == 2022, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        wh._replace_partitions("prices", canonical("prices", bad))
    assert closes(wh.read("prices")) == {1.0}

    # a driver that fails before the commit
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            wh.write("prices", px(3.0))
    assert closes(wh.read("prices")) == {1.0} and wh.snapshots("prices").versions() == [1]

    wh.write("prices", px(4.0))
    assert closes(early) == {1.0} and closes(wh.read("prices")) == {4.0}  # a reader keeps the state it began with

    # two writers from one state: the later one fails
    table = wh.snapshots("prices")
    monkeypatch.setattr(Snapshots, "versions", lambda self: [1])
    with pytest.raises(Exception, match="exists"):
        wh._replace_partitions("prices", canonical("prices", px(5.0)))
    monkeypatch.undo()
    assert closes(wh.read("prices")) == {4.0} and table.versions() == [1, 2]
    assert table.expire() == 4 and table.versions() == [2]  # a state, its folder and two left by failed writers
    assert closes(wh.read("prices")) == {4.0}
    assert wh.write("prices", px(6.0).limit(0), replace=True) == 0 and not wh.has("prices")


def test_upsert_keeps_rows_of_null_and_empty_partitions(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    spans = lambda rows: spark.createDataFrame([(u, t, dt.date(2020, 1, 6), None) for u, t in rows], schema.MEMBERSHIP)
    assert wh.write("membership", spans([(None, "A"), (None, "B"), ("", "C"), ("x", "D")])) == 4
    assert wh.write("membership", spans([(None, "A"), (None, "E")])) == 5
    assert wh.write("membership", spans([("", "C"), ("", "F")])) == 6
    assert wh.write("membership", spans([("x", "G")])) == 7
    meta = lambda names: spark.createDataFrame([(n, "", "s", None, None) for n in names], schema.META)
    assert wh.write("meta", meta(["", None, "oak"])) == 3
    assert wh.write("meta", meta([None, "Elm"])) == 4


def test_new_rows_of_one_key_need_an_order(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    twice = spark.createDataFrame(bars("A", weekdays(1) * 2, [1, 2]), schema.PRICES)
    with pytest.raises(ValueError, match="order"):
        wh.write("prices", twice)
    wh.write("prices", twice, order=["close"])
    assert wh.read("prices").first()["close"] == 2


def test_an_upsert_without_an_order_sorts_no_rows(spark, tmp_path):
    d = weekdays(2)
    of = lambda c, note="": spark.createDataFrame([(x, "A", None, note, c) for x in d[:1]] + [(None, "A", c, None, c)], "date date, ticker string, close double, note string, v double")
    old, new = of(1.0, "old"), of(2.0, "new").where("date IS NOT NULL")
    got = {tuple(r) for r in merge_upsert(old, new, ["date", "ticker"]).collect()}
    assert got == {(d[0], "A", None, "new", 2.0), (None, "A", 1.0, None, 1.0)}  # whole rows, nulls too
    plain = merge_upsert(old.drop("note"), new.drop("note"), ["date", "ticker"])
    assert "SortAggregate" not in plain._jdf.queryExecution().executedPlan().toString()
    wh = Warehouse(spark, str(tmp_path / "wh"))
    first = spark.createDataFrame(bars("A", d, [1, 2]), schema.PRICES)
    assert wh.write("prices", first) == 2 and wh.write("prices", first.withColumn("close", F.lit(7.0)).limit(1)) == 2
    assert sorted(r["close"] for r in wh.read("prices").collect()) in ([1, 7], [2, 7])
    assert wh.write("prices", first, replace=True) == 2 and sorted(r["close"] for r in wh.read("prices").collect()) == [1, 2]


def test_later_rows_win_within_one_batch(spark):
    old = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, v double")
    new = spark.createDataFrame([("A", 3.0, 2), ("A", 4.0, 1), ("C", None, 1)], "ticker string, v double, seq int")
    out = {r["ticker"]: r["v"] for r in merge_upsert(old, new, ["ticker"], ["seq"]).collect()}
    assert out == {"A": 3.0, "B": 2.0, "C": None}


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="lack"):
        canonical("meta", spark.createDataFrame([("A",)], "ticker string"))


def test_survivorship_warnings(spark):
    long, short = weekdays(1500, "2012-03-01"), weekdays(40, "2012-03-01")
    prices = spark.createDataFrame(bars("ELM", long, [3.0] * 1500), schema.PRICES)
    row = reports.survivorship(prices).first()
    assert (row["n_tickers"], row["n_delisted"]) == (1, 0) and row["warn_survivors"] and row["warn_no_membership"]
    mixed = prices.unionByName(spark.createDataFrame(bars("OAK", short, [2.0] * 40), schema.PRICES))
    assert reports.survivorship(mixed).first()["n_delisted"] == 1


def test_stored_runs(spark, tmp_path):
    root, d = str(tmp_path), weekdays(3, "2030-04-01")
    layout = "trial bigint, date date, pos int, net double, base double, benchmark double, equity_value double, turnover double, scale double"
    daily = spark.createDataFrame([(7, x, i, 0.2, 0.2, 0.0, 5.0 + i, 0.0, 1.0) for i, x in enumerate(d)], layout)
    measured = lambda s: spark.createDataFrame([(7, s, 0.3, 12)], "trial bigint, sharpe double, hit_rate double, n_days bigint")
    for run, sharpe in (("only", 0.4), ("grid", 0.9), ("steps", None)):
        runs.save_run(root, run, daily, measured(sharpe), {"lag": 2, "limit": None})
    runs.save_sweep(root, "grid", measured(0.9))
    runs.save_sweep(root, "steps", measured(0.9))
    runs.save_folds(root, "steps", spark.createDataFrame([(0, 7)], "fold bigint, trial bigint"), daily)
    out = runs.stored_runs(spark, root).collect()
    assert [(r["run"], r["kind"]) for r in out] == [("grid", "sweep"), ("only", "backtest"), ("steps", "walk-forward")]
    assert [r["last_equity"] for r in out] == pytest.approx([7.0, 7.0, 1.2**3])
    assert all((r["hit_rate"], r["n_days"], r["start"], r["end"]) == (0.3, 12, d[0], d[2]) for r in out)
    assert runs.stored_runs(spark, str(tmp_path / "none")).count() == 0


# -- landed pages ---------------------------------------------------------------------------
DAY_MS, T0 = 86_400_000, 1704153600000  # 2024-01-02 UTC


def bar(t, c, name):
    return {"T": name, "t": t, "o": c, "h": c * 1.01, "l": c * 0.99, "c": c, "v": 1000}


def land(spark, tmp_path, name, layout, *pages):
    folder = tmp_path / name
    folder.mkdir()
    for i, page in enumerate(pages):
        (folder / f"{i}.json").write_text(json.dumps(page))
    return landed.read_pages(spark, str(folder), layout)


def test_bars_and_splits(spark, tmp_path):
    pages = land(
        spark, tmp_path, "bars", landed.BAR_PAGES,
        {"status": "OK", "results": [bar(T0, 90, "KELP"), {"T": "MUTE", "t": T0}, bar(T0, 4, "DULSE")]},
        {"status": "OK", "resultsCount": 0},
        {"status": "OK", "results": [bar(T0 + DAY_MS, 30, "KELP"), bar(T0 + 2 * DAY_MS, 33, "KELP")]},
    )
    tripled = {"ticker": "KELP", "execution_date": "2024-01-03", "split_from": 1, "split_to": 3}
    splits = land(spark, tmp_path, "splits", landed.SPLIT_PAGES, {"status": "OK", "results": [tripled]})
    px = landed.adjusted_bars(pages, splits).where("ticker = 'KELP'").orderBy("date").collect()
    assert [(r["close"], r["adj_close"]) for r in px] == [(90, 30), (30, 30), (33, 33)]
    listed = spark.createDataFrame([("KELP", "XLON")], "ticker string, primary_exchange string")
    assert {r["ticker"] for r in relate.keep_listed(landed.bars(pages), listed).collect()} == {"KELP"}
    assert landed.splits(splits, ["DULSE"]).count() == 0


def test_ticker_reference_prefers_the_active_list(spark, tmp_path):
    gone = lambda t, y: {"ticker": t, "name": f"{t} of {y}", "active": False, "delisted_utc": f"{y}-10-09T00:00:00Z"}
    pages = land(
        spark, tmp_path, "tickers", landed.TICKER_PAGES,
        {"results": [gone("KELP", 1999), gone("WRACK", 2011)]},
        {"results": [{"ticker": "kelp", "name": "Kelp plc", "primary_exchange": "XLON", "type": "CS", "active": True}]},
    )
    rows = {r["ticker"]: (r["name"], r["delisted_date"]) for r in landed.ticker_reference(pages).collect()}
    assert rows == {"KELP": ("Kelp plc", None), "WRACK": ("WRACK of 2011", day("2011-10-09"))}


def test_statements_count_from_publication_within_ninety_days(spark, tmp_path):
    income = land(
        spark, tmp_path, "income", landed.INCOME_PAGES,
        {"results": [
            {"tickers": ["LATE"], "filing_date": "2019-03-01", "period_end": "2018-03-31", "revenue": 8.0},
            {"tickers": ["KELP", "DULSE"], "filing_date": "2018-05-04", "period_end": "2018-03-31", "revenue": 6.5, "basic_earnings_per_share": 0.4},
            {"tickers": ["MUTE"], "period_end": "2018-03-31", "revenue": 1.0},
        ]},
    )
    balance = land(spark, tmp_path, "balance", landed.BALANCE_PAGES, {"results": [{"tickers": ["DULSE"], "filing_date": "2018-05-08", "period_end": "2018-03-31", "total_equity": 77.0}]})
    known = {(r["ticker"], r["field"]): r["available_date"] for r in landed.fundamentals(income, balance).collect()}
    assert known.pop(("LATE", "revenue")) == day("2018-06-29")
    assert known.pop(("DULSE", "total_equity")) == day("2018-05-08")
    assert known == {(t, f): day("2018-05-04") for t in ("KELP", "DULSE") for f in ("revenue", "eps")}


# -- splits and intervals ------------------------------------------------------------------
def test_splits_of_one_day_multiply_and_rows_do_not_depend_on_each_other(spark):
    layout = "ticker string, execution_date date, split_from double, split_to double"
    events = [("FIG", "2018-02-05", 3.0, 1.0), ("FIG", "2018-02-05", 1.0, 3.0), ("FIG", "2015-05-04", 2.0, 5.0), ("FIG", "2016-01-04", 1.0, 0.0)]
    splits = spark.createDataFrame([(t, day(x), a, b) for t, x, a, b in events], layout)
    asked = ["2015-05-01", "2015-05-04", "2017-12-29", "2018-02-05"]
    prices = spark.createDataFrame([(day(x), "FIG", 10.0) for x in asked], "date date, ticker string, close double")
    found = {str(r["date"]): r["factor"] for r in adjust.with_split_factor(prices, splits).collect()}
    assert found == pytest.approx(dict(zip(asked, [0.4, 1.0, 1.0, 1.0])))
    for x in asked:
        assert adjust.with_split_factor(prices.where(F.col("date") == x), splits).first()["factor"] == pytest.approx(found[x])


def test_history_is_rebased_before_the_refresh_only(spark):
    d = weekdays(4, "2019-08-05")
    stored = spark.createDataFrame([(x, "FIG", 90.0, 90.0) for x in d[:3]], "date date, ticker string, close double, adj_close double")
    third = spark.createDataFrame([("FIG", d[3], 2.0, 6.0)], "ticker string, execution_date date, split_from double, split_to double")
    out = adjust.readjust_history(stored, third, str(d[2])).orderBy("date").collect()
    assert [r["adj_close"] for r in out] == pytest.approx([30.0, 30.0, 90.0])
    assert [r["date"] for r in adjust.readjust_touched(stored, third, str(d[2])).orderBy("date").collect()] == d[:2]


def test_membership_files(spark, tmp_path):
    shots = tmp_path / "shots.csv"
    seen = {"2010-01-04": "kelp DULSE", "2010-02-01": "KELP", "2010-03-01": "KELP dulse wrack"}
    shots.write_text("date,ticker\n" + "".join(f"{x},{t}\n" for x, names in seen.items() for t in names.split()))
    spans = {(r["ticker"], str(r["start_date"])): r["end_date"] and str(r["end_date"]) for r in constituents.load_membership(spark, str(shots), "weed").collect()}
    assert spans == {("KELP", "2010-01-04"): None, ("DULSE", "2010-01-04"): "2010-01-31", ("DULSE", "2010-03-01"): None, ("WRACK", "2010-03-01"): None}
    names = tmp_path / "names.csv"
    names.write_text("ticker\nkelp\nwrack\ndulse\n")
    with pytest.warns(UserWarning, match="survivorship"):
        assert constituents.load_membership(spark, str(names), "weed").count() == 3
    dated = tmp_path / "dated.csv"
    dated.write_text("Symbol,Start Date\nwrack ,2011-06-06\nkelp,\n")
    assert [tuple(r)[:3] for r in constituents.load_membership(spark, str(dated), "weed").select("ticker", "start_date", "end_date").collect()] == [("WRACK", day("2011-06-06"), None)]


def test_flags_to_intervals(spark):
    on = [False, True, True, True, False, False, True]
    d = weekdays(7, "2022-05-02")
    rows = [(x, i, "ASH", f, 7) for i, (x, f) in enumerate(zip(d, on))]
    df = spark.createDataFrame(rows, "date date, pos int, ticker string, flag boolean, n_sessions int")
    out = intervals.intervals_from_flags(df, "flag", "u").orderBy("start_date").collect()
    assert [(r["start_date"], r["end_date"]) for r in out] == [(d[1], d[3]), (d[6], None)]


def test_joins(spark):
    old = spark.createDataFrame([("A", "x"), ("B", None)], "ticker string, sector string")
    new = spark.createDataFrame([("A", "y"), ("B", "z"), ("C", "q")], "ticker string, sector string")
    assert {tuple(r) for r in relate.carry_sectors(new, old).collect()} == {("A", "x"), ("B", "z"), ("C", "q")}
    assert {tuple(r) for r in relate.meta_for_priced(new, old).collect()} == {("A", "x"), ("B", None), ("C", None)}
    assert [r[0] for r in relate.without_prices(new, old).collect()] == ["C"]


# -- refresh --------------------------------------------------------------------------------
def test_refresh_rebases_history_and_keeps_sectors(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    layout = "date date, ticker string, open double, high double, low double, close double, volume double"
    d = weekdays(6)
    rows = lambda dates, t, c: [(x, t, c, c, c, c, 10.0) for x in dates]
    none = spark.createDataFrame([], "ticker string, execution_date date, split_from double, split_to double")
    reference = spark.createDataFrame(
        [("A", "a", None, None, None), ("B", "b", None, d[5], None)], schema.META
    )
    first = spark.createDataFrame(rows(d[:3], "A", 100.0) + rows(d[:3], "B", 10.0) + rows(d[:3], "X", 1.0), layout)
    refresh.refresh(wh, first, none, reference, "all_listed", ["close"])
    known = [("A", "a", "tech", None, None)]
    wh.write("meta", spark.createDataFrame(known, schema.META))
    assert refresh.next_start(wh) == str(d[2] + dt.timedelta(days=1))
    split = spark.createDataFrame([("A", d[4], 1.0, 2.0)], none.schema)
    more = spark.createDataFrame(rows(d[3:4], "A", 100.0) + rows(d[4:], "A", 50.0), layout)
    refresh.refresh(wh, more, split, reference, "all_listed", ["close"], since=str(d[3]))
    stored = wh.read("prices").where("ticker = 'A'").orderBy("date").collect()
    assert [r["adj_close"] for r in stored] == [50.0] * 6 and [r["close"] for r in stored] == [100.0] * 4 + [50.0] * 2
    assert wh.read("prices").where("ticker = 'X'").count() == 0
    assert wh.read("meta").where("ticker = 'A'").first()["sector"] == "tech"
    spans = {r["ticker"]: (r["start_date"], r["end_date"]) for r in wh.read("membership").collect()}
    assert spans == {"A": (d[0], None), "B": (d[0], d[5])}
    assert refresh.rebuild_adjusted(wh, split) == 9 and refresh.missing_constituents(wh, "all_listed").count() == 0


def test_landing_folder_is_upserted_once_per_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    wh = Warehouse(spark, str(tmp_path / "wh"))
    splits = spark.createDataFrame([], "ticker string, execution_date date, split_from double, split_to double")
    for i, page in enumerate(([bar(T0, 100.0, "A")], [bar(T0 + DAY_MS, 101.0, "A"), bar(T0, 7.0, "B")])):
        (folder / f"{i}.json").write_text(json.dumps({"status": "OK", "results": page}))
        landing.watch_bars(spark, str(folder), wh, splits, str(tmp_path / "done")).awaitTermination(120)
    got = [(str(r["date"]), r["ticker"], r["close"]) for r in wh.read("prices").orderBy("ticker", "date").collect()]
    assert got == [("2024-01-02", "A", 100.0), ("2024-01-03", "A", 101.0), ("2024-01-02", "B", 7.0)]
    assert [r["source"] for r in wh.ingest_log().orderBy("at").collect()] == ["landing batch 0", "landing batch 1"]


def test_a_stored_series_is_worked_out_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        asked.add(1)
        return x

    rows = [(i % 2, d, p) for p, d in enumerate(weekdays(6)) for i in range(2)]
    daily = spark.createDataFrame(rows, "trial bigint, date date, pos int")
    daily = daily.withColumns({c: F.lit(0.5) for c in runs.SERIES}).where(counted(F.lit(1.0) * F.col("pos")) < 9)
    runs.save_run(str(tmp_path), "a b=c", daily, spark.createDataFrame([(0, 1.0), (1, 2.0)], "trial bigint, sharpe double"), {})
    assert asked.value == len(rows)
    assert {(r["trial"], r["start"], r["end"]) for r in spark.read.parquet(f"{tmp_path}/run_metrics").collect()} == {(i, rows[0][1], rows[-1][1]) for i in (0, 1)}


def test_layouts_are_tried_where_they_may_fit(spark):
    """The quick look at a text's marks loses no date that a layout reads."""
    texts = ["2020-1-2", " 2020-01-02 ", "2020-01-02 3:04:05", "2020-01-02T3:04:05.123Z", "2020/1/2", "20200102", "1/2/2020", "13/2/2020", "1-2-2020", "1.2.2020", "-2020-1-2", "+12020/1/2"]
    texts += ["2-Jan-2020", "2 Jan 2020", "Jan 2, 2020", "Jan 2 2020", "2-January-2020", "2 January 2020", "January 2, 2020", "January 2 2020", "2020-01-02 03:04+01:00", "n/a", "", "-", "1/2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    usual = [*files.PLAIN_DATES, *files.NAMED_MONTHS, *files.DAY_FIRST, *files.MONTH_FIRST]
    for layout in usual:
        got = df.select(files._read_date(F.col("t"), [layout]).cast("string").alias("a"), files._read_date(F.col("t"), [layout], usual=False).cast("string").alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], layout
    assert df.where(files._may_fit(F.col("t"), "yyyy/M/d")).count() == 2


def test_report_reads_the_staged_rows_once(spark):
    rows = spark.createDataFrame([(d, "A", 1.0, 0.5, 2.0, 1.0, 1.0, 5.0, i) for i, d in enumerate(weekdays(5))], "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, place int")
    report = cleaning.cleaning_report(rows, ["place"])
    assert report._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") >= 5
    assert {r["rule"]: r["n"] for r in report.collect()} == {"in": 5, "out": 5, cleaning.SWAPPED: 5}
