"""Grids, sweeps and walk-forward selection. Trials are rows; all of them run in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import metrics as M


# -- grids ---------------------------------------------------------------------------------
def expand(df: DataFrame, knobs: Mapping[str, Column], trial: str = "trial") -> DataFrame:
    """Every combination of the array columns, numbered with the last knob varying fastest."""
    out = df.withColumn(trial, F.lit(0).cast("bigint"))
    for name, values in knobs.items():
        size = F.size(values)
        out = out.select(*out.columns, size.alias("_size"), F.posexplode(values).alias("_nth", name))
        out = out.withColumn(trial, F.col(trial) * F.col("_size") + F.col("_nth")).drop("_size", "_nth")
    return out


def grid(spark: SparkSession, knobs: Mapping[str, Sequence]) -> DataFrame:
    """trials(trial, knobs...) from lists of values."""
    if not knobs or not all(len(v) for v in knobs.values()):
        raise ValueError("empty grid")
    arrays = {k: F.array(*[F.lit(v) for v in values]) for k, values in knobs.items()}
    return expand(spark.range(1).drop("id"), arrays)


ROUNDS, _SPREAD, _PRIME = 4, 2_654_435_761, 4_294_967_291


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + 7_919 * i + 12_345) % (1 << 31) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half of the numbers that a permutation of ``n`` numbers (2**62 at most) runs over."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def permuted(i: int, n: int, seed: int = 0) -> int:
    """Where a keyed permutation of 0 ... n - 1 sends ``i``: a Feistel network over the next power of four, again until
    the result is inside. The first k of these are a sample without repeats, at the cost of k."""
    half = half_bits(n)
    mask, x = (1 << half) - 1, i
    while True:
        left, right = x >> half, x & mask
        for k in round_keys(seed):
            left, right = right, left ^ ((right * _SPREAD + k) % _PRIME & mask)
        x = left << half | right
        if x < n:
            return x


def combination(number: int, values: Sequence[Sequence]) -> list:
    """The combination of that number, the last knob varying fastest."""
    out = []
    for options in reversed(values):
        number, nth = divmod(number, len(options))
        out.append(options[nth])
    return out[::-1]


#: A permuted number lies outside the range less than three times in four; so often that none is left.
_TURNS = 200


def sample_expand(df: DataFrame, knobs: Mapping[str, Column], max_trials: int, seed: int = 0, trial: str = "trial") -> DataFrame:
    """``expand`` of a sample: ``max_trials`` combinations (all if there are fewer) of the array columns, drawn by
    ``permuted`` from their numbers. Its cost is the sample's, however many combinations there are (2**62 at most)."""
    sizes = {name: f"_n_{name}" for name in knobs}
    out = df.withColumns({n: F.size(values).cast("bigint") for n, values in zip(sizes.values(), knobs.values())})
    total = F.lit(1).cast("bigint")
    for n in sizes.values():
        total = total * F.col(n)
    out = out.withColumn("_total", total).where("_total > 0")
    out = out.withColumn("_half", F.greatest(F.lit(1), ((F.length(F.bin(F.col("_total") - 1)) * (F.col("_total") > 1).cast("int") + 1) / 2).cast("int")))
    out = out.withColumn("_mask", F.expr("shiftleft(1L, _half) - 1"))
    out = out.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_total"), F.lit(max_trials)) - 1)))

    def turn(x: Column) -> Column:
        state = F.struct(F.call_function("shiftrightunsigned", x, F.col("_half")).alias("l"), x.bitwiseAND(F.col("_mask")).alias("r"))
        step = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(((s["r"] * _SPREAD + k) % _PRIME).bitwiseAND(F.col("_mask"))).alias("r"))
        keys = F.array(*[F.lit(k).cast("bigint") for k in round_keys(seed)])
        return F.aggregate(keys, state, step, lambda s: F.call_function("shiftleft", s["l"], F.col("_half")).bitwiseOR(s["r"]))

    inside = F.aggregate(F.sequence(F.lit(1), F.lit(_TURNS)), turn(F.col("_x")), lambda x, _: F.when(x < F.col("_total"), x).otherwise(turn(x)))
    out = out.withColumn(trial, inside).withColumn("_left", F.col(trial))
    for name, values in reversed(knobs.items()):
        out = out.withColumn(name, F.get(values, (F.col("_left") % F.col(sizes[name])).cast("int")))
        out = out.withColumn("_left", F.expr(f"_left DIV `{sizes[name]}`"))
    return out.drop("_total", "_half", "_mask", "_x", "_left", *sizes.values())


def sample_trials(trials: DataFrame, max_trials: int, seed: int = 0) -> DataFrame:
    """A seeded subset: the trials with the smallest hash of (seed, trial)."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string")))
    return trials.orderBy(draw).limit(max_trials)


def knob_points(value: Column, low: Column, high: Column, whole: Column, n: int = 3) -> Column:
    """n evenly spaced values over [low, high] plus the current one, rounded half-even for whole knobs."""
    coerce = lambda v: F.when(whole, F.bround(v, 0)).otherwise(v)
    now = F.array(coerce(value))
    if n <= 1:
        return now
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: coerce(low + i * (high - low) / (n - 1)))
    return F.when(low == high, now).otherwise(F.array_sort(F.array_distinct(F.concat(spaced, now))))


def default_grid(params: DataFrame, n: int = 3) -> DataFrame:
    """params(name, value, low, high, kind) -> (name, point), one row per grid value."""
    points = knob_points(F.col("value"), F.col("low"), F.col("high"), F.col("kind") == "int", n)
    keys = [c for c in params.columns if c not in ("value", "low", "high", "kind")]
    return params.select(*keys, F.explode(points).alias("point"))


def fan_out(panel: DataFrame, signals: Mapping[object, Column], keep: Sequence[str], key: str = "sig") -> DataFrame:
    """One row per (panel row, signal): all signal variants from one scan and one ticker exchange.

    Windows over literal-length frames are computed side by side, then exploded; later operators
    carry ``key`` instead of the panel being scanned once per variant.
    """
    named = {f"_s{i}": c for i, c in enumerate(signals.values())}
    out = panel.withColumns(named)
    pairs = F.array(*[F.struct(F.lit(k).alias(key), F.col(c).alias("raw")) for k, c in zip(signals, named)])
    return out.select(*keep, F.inline(pairs))


# -- ranking -------------------------------------------------------------------------------
def rank_trials(table: DataFrame, objective: str = "sharpe") -> DataFrame:
    column = objective if objective in table.columns else "sharpe"
    return table.orderBy(F.desc_nulls_last(column), "trial")


def trial_sharpe_variance(table: DataFrame, ppy: int = 252) -> DataFrame:
    """One row: sample variance of the per-period Sharpe ratios (missing ones ignored), and the count."""
    per_period = F.col("sharpe") / F.sqrt(F.lit(float(ppy)))
    return table.agg(
        F.coalesce(F.var_samp(per_period), F.lit(0.0)).alias("variance"), F.count(F.lit(1)).alias("n_trials")
    )


def deflated_winner(table: DataFrame, objective: str = "sharpe", ppy: int = 252) -> DataFrame:
    """The best trial with its Sharpe measured against the best to expect by luck.

    ``table`` is ``metrics.summarize`` output: one row per trial, so the windows below are tiny.
    """
    everyone = Window.partitionBy()
    column = objective if objective in table.columns else "sharpe"
    best = F.row_number().over(Window.orderBy(F.desc_nulls_last(column), "trial"))
    rows = table.withColumns(
        {
            "variance": F.coalesce(F.var_samp(F.col("sharpe") / F.sqrt(F.lit(float(ppy)))).over(everyone), F.lit(0.0)),
            "n_trials": F.count(F.lit(1)).over(everyone),
            "_best": best,
        }
    ).where(F.col("_best") == 1)
    return rows.withColumn("deflated_sharpe", M.deflated_sharpe(F.col("n_trials"), F.col("variance"))).drop("_best")


# -- walk-forward -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Span:
    """Fold geometry: sessions of the return series and the first one every trial trades on."""

    first: int
    sessions: int
    train: int
    test: int
    expanding: bool = False

    def __post_init__(self):
        if self.first + self.train + self.test > self.sessions:
            raise ValueError(
                f"not enough history: need {self.train}+{self.test} sessions after warm-up, "
                f"have {self.sessions - self.first}"
            )

    @property
    def folds(self) -> int:
        return -(-(self.sessions - self.first - self.train) // self.test)


def common_start(live: DataFrame, daily: DataFrame) -> tuple[int, int]:
    """(first session all trials trade on, number of sessions): two numbers, from two aggregates."""
    first = live.agg(F.max("live_pos")).head()[0]
    return int(first), int(daily.agg(F.max("pos")).head()[0]) + 1


def fold_table(spark: SparkSession, span: Span) -> DataFrame:
    """(fold, train_start, test_start, test_end) in sessions, ends exclusive; the last test may be short."""
    folds = spark.range(span.folds).withColumnRenamed("id", "fold")
    start = F.col("fold") * span.test + span.first + span.train
    train_start = F.lit(span.first) if span.expanding else start - span.train
    return folds.select(
        "fold",
        train_start.cast("int").alias("train_start"),
        start.cast("int").alias("test_start"),
        F.least(start + span.test, F.lit(span.sessions)).cast("int").alias("test_end"),
    )


def training_rows(daily: DataFrame, span: Span) -> DataFrame:
    """daily x the folds whose training window holds the session.

    The folds of a session follow from arithmetic on ``pos``, so no range join is needed; each row is
    repeated once per fold it trains. Scores of folds do not need this: see ``fold_scores``.
    """
    back = F.col("pos") - span.first - span.train  # sessions past the first test start
    low = F.greatest(F.floor(back / F.lit(span.test)) + 1, F.lit(0))
    if span.expanding:
        high = F.lit(span.folds - 1)
    else:
        high = F.least(F.floor((back + span.train) / F.lit(span.test)), F.lit(span.folds - 1))
    rows = daily.where(F.col("pos") >= span.first).withColumns({"_lo": low.cast("bigint"), "_hi": high.cast("bigint")})
    rows = rows.where(F.col("_lo") <= F.col("_hi"))
    return rows.withColumn("fold", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def block_of(span: Span) -> tuple[Column, int]:
    """The block of a session, and blocks per test window: every training and test window is a run of whole blocks.

    Windows begin and end at multiples of ``test`` from the first session, or ``train`` sessions later.
    """
    back, cut = F.col("pos") - span.first, span.train % span.test
    period = F.floor(back / F.lit(span.test))
    if not cut:
        return period.cast("int"), 1
    return (period * 2 + (back % span.test >= cut).cast("int")).cast("int"), 2


def block_summaries(daily: DataFrame, span: Span, by: Sequence[str] = ("trial",), r: str = "net") -> DataFrame:
    """(by, block, summary): what any objective needs of a block of sessions, in a form that can be merged."""
    rows = daily.where(F.col("pos") >= span.first).select(*by, "pos", block_of(span)[0].alias("block"), F.col(r).alias("_r"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("pos", "_r"))), lambda x: x["_r"])
    out = rows.groupBy(*by, "block").agg(M.block_summary("_r").alias("_s"), path.alias("_path"))
    return out.select(*by, "block", M.with_path(F.col("_s"), F.col("_path")).alias("summary"))


def fold_scores(daily: DataFrame, span: Span, objective: str, ppy: int = 252) -> DataFrame:
    """(trial, fold, score, oos_score): each fold's objective over its training and its test window.

    Sessions are summed up once, by block; a trial's blocks are then merged in order, along the whole history for expanding
    windows and window by window for rolling ones. No session is repeated for a fold.
    """
    per_test = block_of(span)[1]
    blocks = block_summaries(daily, span).groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("block", "summary"))).alias("_blocks"))
    whole, odd = divmod(span.train, span.test)
    train_blocks = whole * per_test + (1 if odd else 0)  # from the first session to the first test
    blocks = blocks.withColumn("_all", F.transform("_blocks", lambda b: b["summary"]))
    if span.expanding:
        blocks = blocks.withColumn("_upto", M.running_summaries(F.col("_all")))
    run = lambda start, length: M.merged_summaries(F.slice("_all", start + 1, length))

    def one(f: Column) -> Column:
        f = f.cast("int")
        test = f * per_test + train_blocks
        train = F.get("_upto", test - 1) if span.expanding else run(f * per_test, F.lit(train_blocks))
        tested = run(test, F.least(F.lit(per_test), F.size("_all") - test))
        return F.struct(f.cast("bigint").alias("fold"), M.summary_objective(train, objective, ppy).alias("score"), M.summary_objective(tested, objective, ppy).alias("oos_score"))

    folds = F.transform(F.sequence(F.lit(0), F.lit(span.folds - 1)), one)
    return blocks.select("trial", F.inline(folds))


def test_rows(daily: DataFrame, span: Span) -> DataFrame:
    """daily rows inside a test window, with its fold."""
    start = span.first + span.train
    return daily.where(F.col("pos") >= start).withColumn(
        "fold", F.floor((F.col("pos") - start) / F.lit(span.test)).cast("bigint")
    )


def pick_in_sample(scores: DataFrame) -> DataFrame:
    """Per fold the trial with the best training score, lowest trial on ties; folds without one drop out."""
    order = Window.partitionBy("fold").orderBy(F.desc_nulls_last("score"), "trial")
    best = scores.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1)
    return best.where(F.col("score").isNotNull()).withColumnRenamed("score", "is_score").drop("_nth")


def stitched(daily: DataFrame, picks: DataFrame, span: Span) -> DataFrame:
    """Out-of-sample rows of each fold's pick, one per session."""
    return test_rows(daily, span).join(picks.select("fold", "trial"), ["fold", "trial"])


def walk_forward(daily: DataFrame, span: Span, objective: str = "sharpe", ppy: int = 252) -> tuple[DataFrame, DataFrame]:
    """(folds table, stitched out-of-sample rows). Trials were simulated once over the whole history."""
    picks = pick_in_sample(fold_scores(daily, span, objective, ppy))
    oos = stitched(daily, picks, span)
    folds = fold_table(daily.sparkSession, span).join(picks, "fold")
    return folds.select("fold", "train_start", "test_start", "test_end", "trial", "is_score", "oos_score"), oos


def degradation(folds: DataFrame) -> DataFrame:
    """One row: mean out-of-sample minus in-sample score, over folds that have both."""
    return folds.agg(F.avg(F.col("oos_score") - F.col("is_score")).alias("degradation"))
