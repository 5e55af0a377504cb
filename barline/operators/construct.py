"""Scores or entry/exit rules -> target weights, for any number of trials in one plan.

``by`` names the cross-section: ("date",) for one strategy, ("trial", "date") for many. All windows
here partition by a prefix of (by, leg), so a plan needs one exchange for the whole construction.
Knobs (quantiles, cap, gross) may be numbers or per-trial columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import DATE, across, average_rank, counted, median
from ..functions.elementwise import as_column, div
from ..functions.timeseries import TICKER, down, ts_std

DIRECTIONS = ("long_short", "long_only", "short_only")
WEIGHTINGS = ("equal", "signal", "inverse_vol")
CAP_ROUNDS = 8  # fixed value: passes that hand a capped name's excess to the others


# -- who is held ---------------------------------------------------------------------
def with_quantile_legs(df: DataFrame, long_q, short_q, by: Sequence[str] = DATE, score: str = "score") -> DataFrame:
    """+ ``leg``: 1 for the top quantile, -1 for the bottom one, null in between.

    Each leg takes at least one name, and a name in the long leg is never short.
    """
    for q in (long_q, short_q):
        if not isinstance(q, Column) and not 0 < q <= 1:
            raise ValueError("quantiles must be in (0, 1]")
    out = df.withColumns({"_place": average_rank(F.col(score), by), "_n": counted(F.col(score), by)})
    pct = F.col("_place") / F.col("_n")
    least = div(1.0, F.greatest("_n", F.lit(1)))
    is_long = pct > 1 - F.greatest(as_column(long_q).cast("double"), least)
    is_short = pct <= F.greatest(as_column(short_q).cast("double"), least)
    return out.withColumn("leg", F.when(is_long, 1).when(is_short, -1)).drop("_place", "_n")


def one_sided_positions(df: DataFrame, enter: Column, leave: Column, by=TICKER, mask="mask", out="side") -> DataFrame:
    """1 from an entry until an exit or the loss of membership; an entry wins over an exit that day."""
    event = F.when(~F.col(mask), 0).when(enter, 1).when(leave, 0)
    so_far = down(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(0)))


#: Sessions of a ticker whose maps are composed together.
BLOCK_SESSIONS = 256


def _steps(days: str) -> Column:
    """For each session of a block: the side at its close for each side before the block (-1, 0, 1)."""

    def step(done: Column, day: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.array(*[F.lit(side) for side in (-1, 0, 1)]))
        after = lambda side: F.when((side == 1) & day["hold_long"], 1).when((side == -1) & day["hold_short"], -1).otherwise(day["entry"])
        return F.concat(done, F.array(F.transform(before, after)))

    return F.aggregate(days, F.array().cast("array<array<int>>"), step)


def two_sided_positions(
    df: DataFrame, enter_long: str, exit_long: str, enter_short: str, exit_short: str, by=TICKER, mask="mask", out="side"
) -> DataFrame:
    """-1 / 0 / 1 per session from four condition columns (already false outside the universe).

    A held side survives until its own exit or the loss of membership; whoever is flat after that
    takes the day's entry, long before short. So a session maps the side before it to the side after, and
    such maps compose: inside blocks of sessions for all three sides before the block, then from block to block.
    """
    entry = F.when(F.col(enter_long), 1).when(F.col(enter_short), -1).otherwise(0)
    day = F.struct("pos", entry.alias("entry"), (F.col(mask) & ~F.col(exit_long)).alias("hold_long"), (F.col(mask) & ~F.col(exit_short)).alias("hold_short"), F.struct(*df.columns).alias("row"))
    rows = df.withColumn("_block", F.expr(f"pos DIV {BLOCK_SESSIONS}"))
    blocks = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(day), lambda x, y: (x["pos"] - y["pos"]).cast("int")).alias("_days"))
    blocks = blocks.withColumn("_steps", _steps("_days"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one map of three sides per earlier block
    passed = F.collect_list(F.element_at("_steps", -1)).over(earlier)
    start = F.aggregate(passed, F.lit(0), lambda side, block: F.get(block, side + 1))
    blocks = blocks.withColumn("_start", start)
    whole = F.transform("_days", lambda d, i: F.struct(*[d["row"][c].alias(c) for c in df.columns], F.get(F.get("_steps", i), F.col("_start") + 1).alias(out)))
    return blocks.select(F.inline(whole))


def with_rule_legs(df: DataFrame, side: str = "side") -> DataFrame:
    return df.withColumn("leg", F.when(F.col(side) != 0, F.col(side)))


def keep_direction(leg: Column, direction: str) -> Column:
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    if direction == "long_only":
        return F.when(leg > 0, leg)
    if direction == "short_only":
        return F.when(leg < 0, leg)
    return leg


def leg_gross(gross, direction: str) -> Column:
    """Each leg gets half the book only when there are two."""
    gross = as_column(gross).cast("double")
    return gross / 2 if direction == "long_short" else gross


# -- how much ------------------------------------------------------------------------
def inverse_vol(returns, n, by=TICKER) -> Column:
    """1 / sample deviation of the last n returns; null where they do not vary. A per-ticker window."""
    return div(1.0, ts_std(returns, n, by))


def raw_weight(weighting: str, by: Sequence[str] = DATE, score: str = "score", vol_weight: str = "inverse_vol") -> Column:
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting!r}")
    if weighting == "signal":
        return F.abs(F.col(score) - median(F.col(score), by)) + 1e-12
    if weighting == "inverse_vol":
        return F.col(vol_weight)
    return F.lit(1.0)


def capped(df: DataFrame, weight: str, room_for_leg: Column, cap: Column, leg: Window) -> DataFrame:
    """CAP_ROUNDS passes: names over the cap are set to it, all others share the remaining room."""
    out = df
    for _ in range(CAP_ROUNDS):
        over = F.coalesce(F.col(weight) > cap, F.lit(False))
        out = out.withColumn("_over", over)
        out = out.withColumns(
            {
                "_capped": F.count_if("_over").over(leg) * cap,
                "_free": F.sum(F.when(~F.col("_over"), F.col(weight))).over(leg),
            }
        )
        room = F.greatest(room_for_leg - F.col("_capped"), F.lit(0.0))
        out = out.withColumn(weight, F.when(F.col("_over"), cap).otherwise(div(F.col(weight), F.col("_free")) * room))
    return out.drop("_over", "_capped", "_free")


def target_weights(
    df: DataFrame,
    *,
    by: Sequence[str] = DATE,
    mode: str = "quantile",
    direction: str = "long_short",
    weighting: str = "equal",
    long_q=0.2,
    short_q=0.2,
    max_weight=0.1,
    gross=1.0,
    score: str = "score",
    side: str = "side",
    out: str = "weight",
) -> DataFrame:
    """+ ``weight``: signed target of every row, or null on dates without a decision.

    mode "quantile" decides on dates where a leg holds someone and fills each leg; mode "rules" reads
    ``side``, decides wherever any score exists, and never levers a lone position up.
    """
    if mode == "quantile":
        rows = with_quantile_legs(df, long_q, short_q, by, score)
    elif mode == "rules":
        rows = with_rule_legs(df, side)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows.withColumn("leg", keep_direction(F.col("leg"), direction))
    rows = rows.withColumn("_raw", F.when(F.col("leg").isNotNull(), raw_weight(weighting, by, score)))
    one_leg = Window.partitionBy(*by, "leg")
    share, cap = leg_gross(gross, direction), as_column(max_weight).cast("double")
    has = F.col("leg").isNotNull() if mode == "quantile" else F.col(score).isNotNull()
    decided = F.max(has).over(across(by))
    if mode == "quantile" and weighting == "equal":
        # legs are 1 and -1: the cross-section is summed as it lies, without a sort by leg
        side = lambda one: F.when(one, F.sum(F.when(one, F.col("_raw"))).over(across(by)))
        total = F.coalesce(side(F.col("leg") > 0), side(F.col("leg") < 0))
        rows = rows.withColumns({"_total": total, "_decided": decided})
        total, decided = F.col("_total"), F.col("_decided")
    else:
        total = F.sum("_raw").over(one_leg)
    rows = rows.withColumn("_w", div(F.col("_raw"), total) * share)
    if mode == "quantile" and weighting != "equal":
        # equal weights are all over the cap or all under it, so passing excess on changes nothing
        rows = capped(rows, "_w", share, cap, one_leg)
    size = F.least(F.col("_w"), cap)
    size = F.when(F.col("_w").isNotNull() & F.col("leg").isNotNull(), F.col("leg") * size).otherwise(0.0)
    return rows.withColumn(out, F.when(decided, size)).drop("_raw", "_w", "_total", "_decided")
