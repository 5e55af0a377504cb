"""Deterministic cleaning of price rows, with a report of everything dropped or flagged.

The input order decides which of several rows for one (date, ticker) wins, so callers name the
columns that carry it (``order``): file path, split offset and row number for files, or any unique
column list of a table.

Duplicates are resolved by a combining aggregate, not a sort of each group: however many copies a
single (date, ticker) has, one partial row per task reaches the shuffle. After that step a ticker
holds at most one row per day, which bounds the per-ticker windows of the later rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import div
from ..schema import PRICE_FIELDS, PRICES

# fixed values: names of the rules in the report
UNPARSEABLE = "unparseable date/ticker"
BAD_CLOSE = "missing/non-positive close"
WEEKEND = "weekend date"
DUPLICATE = "duplicate (date, ticker)"
SWAPPED = "high < low (swapped)"
BAD_TICK = "bad tick (spike that reverses next day)"
SPLIT = "possible unadjusted split (no adj_close)"

SPLIT_RATIOS = (1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10, 2, 3, 4, 5, 10)  # fixed values
EMPTY_TICKERS = ("", "NAN", "NONE")  # fixed values
EXAMPLES = 5


# -- row rules -------------------------------------------------------------------
def unparseable() -> Column:
    return F.col("date").isNull() | F.col("ticker").isNull() | F.col("ticker").isin(*EMPTY_TICKERS)


def bad_close() -> Column:
    return F.col("close").isNull() | (F.col("close") <= 0)


def weekend() -> Column:
    return F.weekday("date") >= 5


def drop_unparseable(df: DataFrame) -> DataFrame:
    return df.where(~unparseable())


def drop_bad_close(df: DataFrame) -> DataFrame:
    return df.where(~bad_close())


def drop_weekends(df: DataFrame) -> DataFrame:
    return df.where(~weekend())


def first_broken_rule() -> Column:
    """The first row rule a row breaks; null for rows that pass all."""
    return F.when(unparseable(), UNPARSEABLE).when(bad_close(), BAD_CLOSE).when(weekend(), WEEKEND)


# -- duplicates --------------------------------------------------------------------
def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str | None = None) -> DataFrame:
    """Per key the row that comes last by ``order``; optionally how many rows the key had."""
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "_row.*", *([count] if count else []))


# -- per-ticker rules -----------------------------------------------------------------
def null_bad_sides(df: DataFrame) -> DataFrame:
    """Non-positive open/high/low/adj_close and negative volume become missing."""
    sides = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("open", "high", "low", "adj_close")}
    return df.withColumns({**sides, "volume": F.when(F.col("volume") >= 0, F.col("volume"))})


def swap_crossed(df: DataFrame, flag: str = "swapped") -> DataFrame:
    crossed = F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    return df.withColumn(flag, crossed).withColumns(
        {
            "high": F.when(F.col(flag), F.col("low")).otherwise(F.col("high")),
            "low": F.when(F.col(flag), F.col("high")).otherwise(F.col("low")),
        }
    )


def _by_day():
    return Window.partitionBy("ticker").orderBy("date")


def mark_bad_ticks(df: DataFrame, spike: float = 0.5, flag: str = "bad_tick") -> DataFrame:
    """A move of more than ``spike`` that the next row undoes to within 10 %."""
    w = _by_day()
    out = df.withColumn("_px", F.coalesce("adj_close", "close"))
    out = out.withColumns({"_prev": F.lag("_px").over(w), "_next": F.lead("_px").over(w)})
    there = F.abs(div(F.col("_px"), F.col("_prev")) - 1) > spike
    back = F.abs(div(F.col("_next"), F.col("_prev")) - 1) < 0.1
    return out.withColumn(flag, F.coalesce(there & back, F.lit(False))).drop("_px", "_prev", "_next")


def mark_unadjusted_splits(df: DataFrame, flag: str = "split_like") -> DataFrame:
    """Close changed by a round ratio in a row that has no adjusted close."""
    out = df.withColumn("_ratio", div(F.col("close"), F.lag("close").over(_by_day())))
    off = F.least(*[F.abs(F.col("_ratio") / F.lit(float(k)) - 1) for k in SPLIT_RATIOS])
    near = F.coalesce(off < 0.03, F.lit(False)) & F.col("adj_close").isNull()
    return out.withColumn(flag, near).drop("_ratio")


def staged(df: DataFrame, order: Sequence[str], spike: float = 0.5) -> DataFrame:
    """Unique rows with the per-ticker rules evaluated; bad ticks still present but marked."""
    ok = df.where(first_broken_rule().isNull())
    unique = keep_last(ok, ["date", "ticker"], order, count="copies")
    return mark_bad_ticks(swap_crossed(null_bad_sides(unique)), spike)


def clean_prices(df: DataFrame, order: Sequence[str], spike: float = 0.5) -> DataFrame:
    """The cleaned canonical price rows."""
    return staged(df, order, spike).where(~F.col("bad_tick")).select(*PRICES.fieldNames())


# -- report ---------------------------------------------------------------------------
def cleaning_counts(df: DataFrame, order: Sequence[str], spike: float = 0.5, marked: DataFrame | None = None) -> DataFrame:
    """(kind, rule, n): rows in and out, dropped and flagged. Rules that hit nothing are absent.

    ``marked``: the ``staged`` rows of ``df``, if they are known already.
    """
    broken = (
        df.groupBy(first_broken_rule().alias("rule"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    row_rules = broken.where(F.col("rule").isNotNull()).select(F.lit("dropped").alias("kind"), "rule", "n")
    rows_in = broken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("rows").alias("kind"), F.lit("in").alias("rule"), "n"
    )
    marked = staged(df, order, spike) if marked is None else marked
    kept = mark_unadjusted_splits(marked.where(~F.col("bad_tick")))
    hits = marked.agg(
        F.sum(F.col("copies") - 1).alias("dup"),
        F.count_if("swapped").alias("swapped"),
        F.count_if("bad_tick").alias("tick"),
        F.count_if(~F.col("bad_tick")).alias("out"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("dropped").alias("kind"), F.lit(DUPLICATE).alias("rule"), F.col("dup").alias("n")),
                F.struct(F.lit("flagged").alias("kind"), F.lit(SWAPPED).alias("rule"), F.col("swapped").alias("n")),
                F.struct(F.lit("dropped").alias("kind"), F.lit(BAD_TICK).alias("rule"), F.col("tick").alias("n")),
                F.struct(F.lit("rows").alias("kind"), F.lit("out").alias("rule"), F.col("out").alias("n")),
            )
        )
    )
    splits = kept.agg(F.count_if("split_like").alias("n")).select(
        F.lit("flagged").alias("kind"), F.lit(SPLIT).alias("rule"), "n"
    )
    out = rows_in.unionByName(row_rules).unionByName(hits).unionByName(splits)
    return out.where((F.col("n") > 0) | (F.col("kind") == "rows"))


def dropped_copies(ok: DataFrame, order: Sequence[str]) -> DataFrame:
    """Up to EXAMPLES rows of each (date, ticker) that a later copy replaces, earliest first.

    ``row_number`` with a limit right above it lets Spark cut every group to a few rows before the
    shuffle, so a huge group of copies costs no more than a small one.
    """
    group = Window.partitionBy("date", "ticker").orderBy(*order)
    few = ok.withColumn("_rn", F.row_number().over(group)).where(F.col("_rn") <= EXAMPLES + 1)
    few = few.withColumn("_later", F.lead("_rn").over(group))
    return few.where(F.col("_later").isNotNull()).drop("_rn", "_later")


def cleaning_examples(df: DataFrame, order: Sequence[str], spike: float = 0.5, marked: DataFrame | None = None) -> DataFrame:
    """(rule, examples): the first rows each rule hit, as "TICKER date, ...".

    Rows with an unreadable date or ticker have nothing to show and get no examples.
    """
    label = F.concat_ws(" ", "ticker", F.col("date").cast("string")).alias("label")
    by_input = F.struct(*order).alias("place")
    by_name = F.struct("ticker", "date").alias("place")
    tagged = df.withColumn("rule", first_broken_rule())
    ok = tagged.where(F.col("rule").isNull()).drop("rule")
    marked = staged(ok, order, spike) if marked is None else marked
    kept = mark_unadjusted_splits(marked.where(~F.col("bad_tick")))

    def first_rows(rows: DataFrame, rule: Column, place: Column) -> DataFrame:
        rows = rows.select(rule.alias("rule"), label, place)
        top = Window.partitionBy("rule").orderBy("place")
        rows = rows.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= EXAMPLES)
        return rows.select("rule", "nth", "label")

    parts = [
        first_rows(tagged.where(F.col("rule").isin(BAD_CLOSE, WEEKEND)), F.col("rule"), by_input),
        first_rows(dropped_copies(ok, order), F.lit(DUPLICATE), by_input),
        first_rows(marked.where("swapped"), F.lit(SWAPPED), by_name),
        first_rows(marked.where("bad_tick"), F.lit(BAD_TICK), by_name),
        first_rows(kept.where("split_like"), F.lit(SPLIT), by_name),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # at most EXAMPLES labels per rule reach this aggregate
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda s: s["label"])
    return out.groupBy("rule").agg(F.array_join(listed, ", ").alias("examples"))


def cleaning_report(df: DataFrame, order: Sequence[str], spike: float = 0.5) -> DataFrame:
    """(kind, rule, n, examples) for one input.

    The staged rows are read by five parts of the report: kept, so copies are resolved and ticks marked once.
    """
    marked = staged(df, order, spike).select("date", "ticker", "close", "adj_close", "copies", "swapped", "bad_tick")
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    return cleaning_counts(df, order, spike, marked).join(cleaning_examples(df, order, spike, marked), "rule", "left")


def as_prices(df: DataFrame) -> DataFrame:
    """Canonical price columns of any frame: missing ones null, close filled from adj_close, ticker normalised."""
    have = set(df.columns)
    fields = {c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in PRICE_FIELDS}
    extra = [c for c in df.columns if c not in PRICES.fieldNames()]
    out = df.withColumns(fields)
    out = out.withColumn("close", F.coalesce("close", "adj_close"))
    out = out.withColumn("ticker", F.upper(F.trim(F.col("ticker").cast("string"))))
    return out.select(*PRICES.fieldNames(), *extra)
