"""Book accounting: what the targets would have earned, for any number of trials in one job.

Down each (trial, ticker) - one exchange, one sort order - windows find the fill a holding dates from (its
segment), the target taken then, and its growth since. A date's holdings then collapse to one row per
(trial, session, segment) by a combining aggregate. Equity at a session depends on equity at earlier fills,
linearly, so blocks of sessions are worked out as linear forms side by side and then chained.

Units: a holding is ``target x growth`` in units of the equity at its own fill; ``equity`` ignores
costs, which are subtracted from returns but never change weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeseries import down
from .sessions import next_weekday, period_end

TRIAL: tuple[str, ...] = ("trial",)


@dataclass(frozen=True)
class BookConfig:
    initial_capital: float = 1_000_000.0
    commission_bps: float = 1.0
    slippage_bps: float = 5.0
    borrow_bps_annual: float = 50.0
    execution_lag: int = 1
    vol_target: float | None = None
    vol_lookback: int = 60
    max_leverage: float = 2.0
    dd_limit: float | None = None
    dd_cooldown_days: int = 21
    ic_horizon: int = 5
    periods_per_year: int = 252

    @property
    def cost_rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 1e4


def with_flags(targets: DataFrame, rebalance, by: Sequence[str] = TRIAL) -> DataFrame:
    """+ ``flag``: is this session the last of its period? ``rebalance`` is text or a per-trial column.

    On the dense grid a ticker's next row is the next session, so the calendar needs no join and the
    flag shares the window of the holdings.
    """
    following = F.lead("date").over(down((*by, "ticker")))
    out = targets.withColumn("_following", F.coalesce(following, next_weekday(F.col("date"))))
    return out.withColumn("flag", period_end(F.col("date"), F.col("_following"), rebalance)).drop("_following")


def equal_weight_benchmark(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, pos, benchmark): mean return of yesterday's members, 0 where none has a return."""
    was_member = F.coalesce(F.lag("mask").over(down((*by, "ticker"))), F.lit(False))
    rows = panel.withColumn("_earned", F.when(was_member, F.col("returns")))
    return rows.groupBy(*by, "date", "pos").agg(F.coalesce(F.avg("_earned"), F.lit(0.0)).alias("benchmark"))


def book_benchmark(holdings: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, pos, benchmark) from kept holdings: members' mean next return, read one session later."""
    rows = holdings.groupBy(*by, "pos").agg(F.avg(F.when(F.col("mask"), F.col("next_return"))).alias("_ahead"))
    ahead = F.lag("_ahead").over(Window.partitionBy(*by).orderBy("pos"))
    return rows.select(*by, "pos", F.coalesce(ahead, F.lit(0.0)).alias("benchmark"))


# -- holdings --------------------------------------------------------------------------
def with_holdings(targets: DataFrame, lag: int = 1, by: Sequence[str] = TRIAL, frozen: DataFrame | None = None) -> DataFrame:
    """+ segment, held (after the day's fill), drifted (before it), old_segment, next_return.

    ``targets`` needs weight (null = no decision), flag, close, returns, pos on the dense grid. A
    ticker without a price on the fill date is not traded and keeps its segment; a name that is not held has none; after a ticker's
    last print and the return booked then, its holding is cash. ``frozen`` lists (by, pos) on which
    weights did not drift (see ``run_book``).
    """
    if not isinstance(lag, int) or lag < 0:
        raise ValueError("execution lag must be a whole number of sessions, 0 or more")
    key = (*by, "ticker")
    w = down(key)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    go = F.col("flag") & F.col("weight").isNotNull()
    rows = targets.withColumn("_r", F.coalesce("returns", F.lit(0.0)))
    if frozen is not None:
        rows = rows.join(frozen.withColumn("_still", F.lit(True)), [*by, "pos"], "left")
        rows = rows.withColumn("_move", F.when(F.col("_still"), 0.0).otherwise(F.col("_r"))).drop("_still")
    else:
        rows = rows.withColumn("_move", F.col("_r"))
    priced = F.when(F.col("close").isNotNull(), F.col("pos"))
    rows = rows.withColumns(
        {
            "_go": F.coalesce(F.lag(go, lag).over(w) if lag else go, F.lit(False)),
            "_target": F.coalesce(F.lag("weight", lag).over(w) if lag else F.col("weight"), F.lit(0.0)),
            "_end": F.max(priced).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            # growth index that skips total losses; those are handled by their position
            "_index": F.coalesce(F.product(F.when(F.col("_move") != -1, 1 + F.col("_move"))).over(so_far), F.lit(1.0)),
            "_wiped": F.max(F.when(F.col("_move") == -1, F.col("pos"))).over(so_far),
            "next_return": F.lead("returns").over(w),
        }
    )
    fills = F.col("_go") & F.col("close").isNotNull()
    rows = rows.withColumn("filled", fills)
    at_fill = lambda c: F.last(F.when(F.col("filled"), F.col(c)), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"segment": at_fill("pos"), "_units": at_fill("_target"), "_base": at_fill("_index")})
    growth = F.when(F.coalesce(F.col("_wiped") > F.col("segment"), F.lit(False)), 0.0).otherwise(
        F.col("_index") / F.col("_base")
    )
    alive = F.col("segment").isNotNull() & (F.col("pos") <= F.col("_end"))
    rows = rows.withColumn("held", F.when(alive, F.col("_units") * growth).otherwise(0.0))
    # what holds nothing dates from no fill: sold and dead names add no rows to the sums
    rows = rows.withColumn("segment", F.when(F.col("held") != 0, F.col("segment")))
    rows = rows.withColumns(
        {
            "old_segment": F.lag("segment").over(w),
            "drifted": F.coalesce(F.lag("held").over(w) * (1 + F.col("_move")), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("drifted", F.when(F.col("pos") <= F.col("_end"), F.col("drifted")).otherwise(0.0))
    return rows.drop("_r", "_move", "_go", "_end", "_index", "_wiped", "_units", "_base").withColumnRenamed(
        "_target", "fill_target"
    )


HOLDING_COLUMNS = (
    "date", "pos", "ticker", "segment", "held", "next_return", "filled", "fill_target", "old_segment", "drifted"
)
CARRIED = ("mask", "score", "forward")  # kept next to the holdings for benchmark and rank correlation


def segment_sums(holdings: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, pos, date, segment): gross, short and the next session's gain, in units of the segment's fill."""
    return holdings.groupBy(*by, "pos", "date", "segment").agg(
        F.sum(F.abs("held")).alias("gross"),
        F.sum(F.when(F.col("held") < 0, -F.col("held")).otherwise(0.0)).alias("short"),
        F.sum(F.col("held") * F.coalesce("next_return", F.lit(0.0))).alias("gain"),
    )


#: Sessions whose equity is worked out together, as a function of the equity at earlier sessions.
BLOCK_SESSIONS = 128
_FLOWS = ("gain", "gross", "short")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _block_forms(block: str = "_days") -> Column:
    """For each session of a block: equity, and its change into the next session, as linear forms of the block's inputs.

    Equity obeys E[t] = E[t-1] + sum over segments s of gain[t-1, s] * E[s]. The inputs are the equity of the block's first
    session and that at the older fills from which its holdings date (``_ext``); a form is an array of coefficients.
    """
    pos = F.transform(block, lambda day: day["pos"])
    width = F.size("_ext") + 1
    unit = lambda i: F.transform(F.sequence(F.lit(0), width - 1), lambda j: (j == i).cast("double"))

    def step(done: Column, day: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        moved = F.zip_with(last["e"], last["gain"], lambda x, y: x + y)
        equity = F.when(F.size(done) == 0, unit(F.lit(0))).when(day["still"], last["e"]).otherwise(moved)

        def day_of(e: Column) -> Column:
            def form(s: Column) -> Column:
                inside = F.get(done, F.array_position(pos, s).cast("int") - 1)["e"]
                return F.when(s == day["pos"], e).when(s >= pos[0], inside).otherwise(unit(F.array_position("_ext", s)))

            add = lambda v, t: F.zip_with(v, form(t["segment"]), lambda x, y: x + t["gain"] * y)
            none = F.array_repeat(F.lit(0.0), width)
            return F.struct(e.alias("e"), F.aggregate(day["terms"], none, add).alias("gain"))

        return F.concat(done, F.array(_let(equity, day_of)))

    return F.aggregate(block, F.array().cast("array<struct<e:array<double>,gain:array<double>>>"), step)


def _block_inputs(blocks: str = "_blocks") -> Column:
    """The values of each block's inputs, and the return into its first session, block after block."""
    referred = F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["ext"])))

    def step(state: Column, b: Column) -> Column:
        first = F.size(state["out"]) == 0
        e = F.when(first, 1.0).when(b["days"][0]["still"], state["e"]).otherwise(state["e"] + state["gain"])
        pnl = F.when(first, 0.0).otherwise(F.try_divide(state["gain"], state["e"]))

        def passed(values: Column) -> Column:
            last = F.element_at(b["forms"], -1)
            zipped = F.arrays_zip(b["days"].alias("day"), b["forms"].alias("form"))
            later = F.filter(zipped, lambda z: F.array_contains(referred, z["day"]["pos"]))
            fills = F.map_from_entries(F.transform(later, lambda z: F.struct(z["day"]["pos"], _dot(z["form"]["e"], values))))
            return F.struct(
                _dot(last["e"], values).alias("e"),
                _dot(last["gain"], values).alias("gain"),
                F.map_concat(state["known"], fills).alias("known"),
                F.concat(state["out"], F.array(F.struct(values.alias("values"), pnl.alias("pnl")))).alias("out"),
            )

        return _let(F.concat(F.array(e), F.transform(b["ext"], lambda s: F.try_element_at(state["known"], s))), passed)

    start = F.struct(
        F.lit(1.0).alias("e"),
        F.lit(0.0).alias("gain"),
        F.create_map().cast("map<int,double>").alias("known"),
        F.array().cast("array<struct<values:array<double>,pnl:double>>").alias("out"),
    )
    return F.aggregate(blocks, start, step, lambda state: state["out"])


def equity_path(sums: DataFrame, by: Sequence[str] = TRIAL, frozen: DataFrame | None = None) -> DataFrame:
    """(by, pos, date, equity, pnl, gross, short, ruined), a scan over blocks of sessions.

    A block's sessions become linear forms of its inputs, whatever those will be: blocks are independent tasks, also those
    of one trial. Then each trial's blocks, one small row each, pass their values on, and the forms are applied. A
    session that loses the whole book or more is marked; equity stays where it was on the sessions of ``frozen``
    (by, pos), where weights are not rescaled. Sessions after a loss that is not frozen mean nothing.
    """
    keys = list(by)
    rows = sums.withColumn("_block", F.expr(f"pos DIV {BLOCK_SESSIONS}"))
    if frozen is not None:
        rows = rows.join(frozen.withColumn("_still", F.lit(True)), [*keys, "pos"], "left")
    still = F.coalesce(F.max("_still"), F.lit(False)) if frozen is not None else F.lit(False)
    live = F.when(F.col("segment").isNotNull(), F.struct(F.col("segment").cast("int").alias("segment"), *_FLOWS))
    # of one session as many terms as fills that holdings still date from
    days = (
        rows.repartition(*keys, "_block")
        .groupBy(*keys, "_block", "pos", "date")
        .agg(still.alias("still"), F.sort_array(F.collect_list(live)).alias("terms"))
    )
    day = F.struct(F.col("pos").cast("int").alias("pos"), "date", "still", "terms")
    blocks = days.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(day)).alias("_days"))
    older = F.flatten(F.transform("_days", lambda d: F.transform(F.filter(d["terms"], lambda t: t["segment"] < F.col("_days")[0]["pos"]), lambda t: t["segment"])))
    blocks = blocks.withColumn("_ext", F.array_sort(F.array_distinct(older)))
    blocks = blocks.withColumn("_b", F.struct("_block", F.col("_ext").alias("ext"), F.col("_days").alias("days"), _block_forms().alias("forms")))
    trials = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list("_b")).alias("_blocks"))
    solved = trials.select(*keys, F.inline(F.arrays_zip(F.col("_blocks").alias("b"), _block_inputs().alias("given"))))
    b, given = F.col("b"), F.col("given")
    solved = solved.withColumn("_pos", F.transform(b["days"], lambda d: d["pos"]))
    solved = solved.withColumn("_e", F.transform(b["forms"], lambda form: _dot(form["e"], given["values"])))

    def equity_at(s: Column) -> Column:
        return F.when(s >= F.col("_pos")[0], F.get("_e", F.array_position("_pos", s).cast("int") - 1)).otherwise(F.get(given["values"], F.array_position(b["ext"], s).cast("int")))

    def session(day: Column, i: Column) -> Column:
        equity = F.get("_e", i)
        share = lambda flow: F.aggregate(day["terms"], F.lit(0.0), lambda total, t: total + t[flow] * equity_at(t["segment"]))
        return F.struct(day["pos"].alias("pos"), day["date"].alias("date"), equity.alias("equity"), *[F.try_divide(share(c), equity).alias(c) for c in _FLOWS])

    solved = solved.select(*keys, given["pnl"].alias("_pnl"), F.transform(b["days"], session).alias("_out"))
    into = lambda i: F.when(i == 0, F.col("_pnl")).otherwise(F.get("_out", i - 1)["gain"])
    kept = lambda x, i: F.struct(*[x[c].alias(c) for c in ("pos", "date", "equity")], into(i).alias("pnl"), *[x[c].alias(c) for c in ("gross", "short")])
    out = solved.select(*keys, F.inline(F.transform("_out", kept)))
    return out.withColumns({"pos": F.col("pos").cast(sums.schema["pos"].dataType), "ruined": F.coalesce(F.col("pnl") <= -1, F.lit(False))})


def turnover(holdings: DataFrame, path: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, pos, turnover): sum of |target - drifted weight| over names traded at a fill."""
    keys = list(by)
    now = path.select(*keys, "pos", F.col("equity").alias("_now"))
    then = path.select(*keys, F.col("pos").alias("old_segment"), F.col("equity").alias("_then"))
    traded = holdings.where(F.col("filled") & ((F.col("fill_target") != 0) | (F.col("drifted") != 0)))
    traded = traded.select(*keys, "pos", "old_segment", "fill_target", "drifted")
    traded = traded.join(now, [*keys, "pos"]).join(then, [*keys, "old_segment"], "left")
    before = F.coalesce(F.col("drifted") * F.col("_then") / F.col("_now"), F.lit(0.0))
    return traded.groupBy(*keys, "pos").agg(F.sum(F.abs(F.col("fill_target") - before)).alias("turnover"))


def held_weights(holdings: DataFrame, path: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """(by, date, pos, ticker, weight) at each close, non-zero weights only."""
    keys = list(by)
    now = path.select(*keys, "pos", F.col("equity").alias("_now"))
    then = path.select(*keys, F.col("pos").alias("segment"), F.col("equity").alias("_then"))
    rows = holdings.where(F.col("held") != 0).select(*keys, "date", "pos", "ticker", "segment", "held")
    rows = rows.join(now, [*keys, "pos"]).join(then, [*keys, "segment"])
    return rows.select(*keys, "date", "pos", "ticker", (F.col("held") * F.col("_then") / F.col("_now")).alias("weight"))


@dataclass(frozen=True)
class Book:
    holdings: DataFrame
    path: DataFrame
    daily: DataFrame
    by: tuple[str, ...]

    @property
    def weights(self) -> DataFrame:
        return held_weights(self.holdings, self.path, self.by)

    def release(self) -> None:
        """Give back the storage of the kept holdings and path; what is still read of them is computed anew."""
        self.holdings.unpersist()
        self.path.unpersist()


def run_book(targets: DataFrame, config: BookConfig = BookConfig(), by: Sequence[str] = TRIAL, knobs: DataFrame | None = None) -> Book:
    """Targets with flags -> daily book: pnl, gross, short, turnover, costs and base return.

    ``knobs`` overrides config values per trial by column name. The equity table is small (a row per
    trial and session) and read several times, so it is persisted; a lost block is recomputed from
    its lineage. If a trial loses its whole book on some session, weights must not drift on it, which
    changes what follows: that session is frozen and the path computed again, until nothing changes.
    """
    by = tuple(by)
    frozen = None
    frozen_rows: set[tuple] = set()
    while True:
        extra = [c for c in CARRIED if c in targets.columns]
        holdings = with_holdings(targets, config.execution_lag, by, frozen).select(*by, *HOLDING_COLUMNS, *extra)
        # read again for turnover and weights: kept, so the targets are not computed twice
        holdings = holdings.persist(StorageLevel.MEMORY_AND_DISK)
        path = equity_path(segment_sums(holdings, by), by, frozen).persist(StorageLevel.MEMORY_AND_DISK)
        ruin = path.where("ruined")
        if frozen is not None:
            ruin = ruin.join(frozen, [*by, "pos"], "left_anti")
        # at most one row per trial: its first ruinous session not yet frozen
        fresh = ruin.groupBy(*by).agg(F.min("pos").alias("pos")).collect()
        if not fresh:
            break
        frozen_rows |= {tuple(r) for r in fresh}
        layout = T.StructType([path.schema[c] for c in (*by, "pos")])
        frozen = path.sparkSession.createDataFrame(sorted(frozen_rows), layout)
        path.unpersist()
        holdings.unpersist()
    daily = base_returns(path, turnover(holdings, path, by), config, by, knobs)
    return Book(holdings, path, daily, by)


def knob(df: DataFrame, name: str, config: BookConfig) -> Column:
    """A per-trial column of that name, or the config value."""
    value = getattr(config, name)
    if name in df.columns:
        return F.col(name)
    return F.lit(value).cast("double") if not isinstance(value, int) else F.lit(value)


def base_returns(
    path: DataFrame, traded: DataFrame, config: BookConfig = BookConfig(), by: Sequence[str] = TRIAL, knobs: DataFrame | None = None
) -> DataFrame:
    """path + turnover, costs, base (pnl less trading cost and borrow on yesterday's shorts)."""
    keys = list(by)
    out = path.join(traded, [*keys, "pos"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    if knobs is not None:
        out = out.join(knobs, keys, "left")
    rate = (knob(out, "commission_bps", config) + knob(out, "slippage_bps", config)) / 1e4
    carry_rate = knob(out, "borrow_bps_annual", config) / 1e4 / knob(out, "periods_per_year", config)
    shorted = F.coalesce(F.lag("short").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(0.0))
    out = out.withColumn("cost_rate", rate)
    out = out.withColumn("costs", F.col("turnover") * rate + carry_rate * shorted)
    return out.withColumn("base", F.col("pnl") - F.col("costs"))
