"""Exponential averages: the two functions whose value depends on the whole past, as window expressions.

An average is the recursion y = a y' + b over a ticker's observations. Inside a stretch over which the
weights decay by no more than e**-DECAY it is a running sum divided by a running product. What came before
a stretch enters through its first row; what came two stretches earlier has decayed below the precision of
a double, so two passes over the stretches are exact. Everything runs down each ticker, on one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .elementwise import number, window_size
from .timeseries import down

DECAY = 92.0  # e**-92 is about 1e-40


def _smooth(df: DataFrame, inputs: Mapping[str, Column], alpha: float, least: int, by: Sequence[str]) -> DataFrame:
    """Add an average for each input; the inputs are null on the same rows.

    A row without an observation keeps the value before it, and the weight of the past decays over it.
    Fewer than ``least`` observations give null.
    """
    w = down(by)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    stretch = Window.partitionBy(*by, "_stretch").orderBy("pos")
    # the order of ``w`` written like that of ``stretch``, which never falls down a ticker: one sort serves both
    along = Window.partitionBy(*by).orderBy("_stretch", "pos")
    within = stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = list(inputs)
    made = ["_seen", "_gap", "_loss", "_decay", "_stretch", "_left", "_a", *(f"{k}_{n}" for n in names for k in ("_x", "_b", "_own", "_y"))]

    out = df.withColumns({f"_x_{n}": c for n, c in inputs.items()})
    seen = F.col(f"_x_{names[0]}").isNotNull()
    before = F.last(F.when(seen, F.col("pos")), ignorenulls=True).over(earlier)
    out = out.withColumns({"_seen": F.count(F.when(seen, 1)).over(so_far), "_gap": F.when(seen, F.col("pos") - before)})
    past = F.pow(F.lit(1.0 - alpha), F.col("_gap"))
    first = F.col("_gap").isNull()
    out = out.withColumns(
        {
            "_a": F.when(seen, F.when(first, 1.0).otherwise(past / (past + alpha))),
            # through logarithms, so that a long gap can't underflow
            "_loss": F.when(seen & ~first, F.log(past + alpha) - F.col("_gap") * F.log(F.lit(1.0 - alpha)) if alpha < 1 else F.lit(2 * DECAY)).otherwise(0.0),
            **{f"_b_{n}": F.when(first, F.col(f"_x_{n}")).otherwise(F.col(f"_x_{n}") * (alpha / (past + alpha))) for n in names},
        }
    )
    out = out.withColumn("_decay", F.sum("_loss").over(so_far))
    out = out.withColumn("_stretch", F.floor(F.col("_decay") / DECAY))
    out = out.withColumn("_left", F.exp(F.first("_decay").over(stretch) - F.col("_decay")))
    out = out.withColumns({f"_own_{n}": F.col("_left") * F.coalesce(F.sum(F.col(f"_b_{n}") / F.col("_left")).over(within), F.lit(0.0)) for n in names})
    out = out.withColumns({f"_y_{n}": F.col(f"_own_{n}") for n in names})
    for _ in range(2):
        # the value before the stretch, brought to its first row
        out = out.withColumns({f"_y_{n}_from": F.coalesce(F.lag(f"_y_{n}").over(along), F.lit(0.0)) * F.exp(-F.col("_loss")) for n in names})
        out = out.withColumns({f"_y_{n}": F.col(f"_own_{n}") + F.col("_left") * F.first(f"_y_{n}_from").over(stretch) for n in names})
        out = out.drop(*(f"_y_{n}_from" for n in names))
    out = out.withColumns({n: F.when(F.col("_seen") >= least, F.col(f"_y_{n}")) for n in names})
    return out.drop(*made)


def with_averages(df: DataFrame, specs: Mapping[str, tuple[str, str, float]], by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add columns ``{name: (kind, input column, n)}`` with kind ``"ema"`` or ``"rsi"``.

    ema weighs the newest value by 2 / (n + 1). rsi compares the averages (newest weight 1 / n) of upward and
    downward moves on a scale to 100, and is null while there is no downward move.
    """
    out = df
    for name, (kind, source, n) in specs.items():
        if kind == "ema":
            size = window_size(n, 1)
            out = _smooth(out, {name: number(F.col(source))}, 2.0 / (size + 1), size, by)
        elif kind == "rsi":
            size = window_size(n, 2)
            x = number(F.col(source))
            move = out.withColumn("_move", x - F.lag(x).over(down(by)))
            sides = {"_rise": F.greatest(F.col("_move"), F.lit(0.0)), "_fall": F.greatest(-F.col("_move"), F.lit(0.0))}
            sides = {k: F.when(F.col("_move").isNotNull(), c) for k, c in sides.items()}
            both = _smooth(move, sides, 1.0 / size, size, by)
            index = F.when(F.col("_fall") > 0, 100.0 * F.col("_rise") / (F.col("_rise") + F.col("_fall")))
            out = both.withColumn(name, index).drop("_move", "_rise", "_fall")
        else:
            raise ValueError(f"unknown average {kind!r}")
    return out
