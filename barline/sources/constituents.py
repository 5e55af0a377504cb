"""Constituent files: membership intervals, dated snapshots, or a bare list of tickers."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import intervals_from_snapshots
from .files import as_date, normalise, read_raw, source_columns


def tidy_columns(df: DataFrame) -> DataFrame:
    """Normalised names, ``symbol`` read as ``ticker``, a lone column taken as the ticker."""
    out = df.select(*[F.col(f"`{c}`").alias(normalise(c)) for c in source_columns(df)])
    if "ticker" not in out.columns and "symbol" in out.columns:
        out = out.withColumnRenamed("symbol", "ticker")
    if "ticker" not in out.columns:
        if len(out.columns) != 1:
            raise ValueError(f"need a 'ticker' column; found {out.columns}")
        out = out.withColumnRenamed(out.columns[0], "ticker")
    return out.withColumn("ticker", F.upper(F.trim(F.col("ticker").cast("string"))))


def _day(df: DataFrame, name: str):
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("date") if kind != "string" else as_date(F.col(name), None, False)


def membership_rows(df: DataFrame, universe: str) -> DataFrame:
    """Membership intervals from any of the three layouts (columns already tidy)."""
    if "start_date" in df.columns:
        end = _day(df, "end_date") if "end_date" in df.columns else F.lit(None).cast("date")
        return df.select(
            F.lit(universe).alias("universe"), "ticker", _day(df, "start_date").alias("start_date"), end.alias("end_date")
        ).where(F.col("start_date").isNotNull())
    if "date" not in df.columns:
        warnings.warn(
            "tickers without dates are taken as today's members, which is survivorship-biased; "
            "use intervals or dated snapshots for a point-in-time universe",
            stacklevel=2,
        )
        snapshots = df.withColumn("date", F.current_date())
    else:
        snapshots = df.withColumn("date", _day(df, "date"))
    return intervals_from_snapshots(snapshots, universe)


def load_membership(spark: SparkSession, path: str, universe: str) -> DataFrame:
    return membership_rows(tidy_columns(read_raw(spark, path)), universe)
