"""Stored runs: daily series, metrics and configuration per run, and the sweep / walk-forward tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeseries import down
from .warehouse import read_or_empty

SERIES = ("net", "base", "benchmark", "equity_value", "turnover", "scale")
RETURNS_LAYOUT = "trial bigint, date date, pos int, " + ", ".join(f"{c} double" for c in SERIES) + ", run string"
OOS_LAYOUT = "date date, pos int, oos_return double, run string"
METRICS_LAYOUT = "trial bigint, sharpe double, max_drawdown double, annualised_return double, psr double, run string"


def _put(df: DataFrame, root: str, table: str, run: str) -> None:
    """Replace one run's partition of a table; other runs are untouched."""
    writer = df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run").parquet(f"{root}/{table}")


def save_run(root: str, run: str, daily: DataFrame, metrics: DataFrame, config: Mapping[str, object]) -> None:
    """Store a run: its daily series, every metric as it is with the first and last date, and its configuration."""
    columns = [F.col("trial").cast("bigint"), "date", "pos", *SERIES]
    _put(daily.select(*columns), root, "run_returns", run)
    # read from what has just been stored: the series is worked out once
    stored = read_or_empty(daily.sparkSession, f"{root}/run_returns", RETURNS_LAYOUT).where(F.col("run") == run)
    span = stored.groupBy("trial").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    table = metrics.withColumn("trial", F.col("trial").cast("bigint")).drop("start", "end").join(span, "trial", "left")
    _put(table, root, "run_metrics", run)
    rows = [(str(k), None if v is None else str(v)) for k, v in config.items()]
    _put(daily.sparkSession.createDataFrame(rows, "name string, value string"), root, "run_config", run)


def save_sweep(root: str, run: str, table: DataFrame) -> None:
    _put(table, root, "run_sweep", run)


def save_folds(root: str, run: str, folds: DataFrame, oos: DataFrame) -> None:
    _put(folds, root, "run_folds", run)
    _put(oos.select("date", "pos", F.col("net").alias("oos_return")), root, "run_oos", run)


def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, kind, trial, metrics..., last_equity) best Sharpe first, runs without one last.

    What is stored makes the kind: out-of-sample rows a walk-forward, else a sweep table a sweep, else a
    backtest. Equity of a walk-forward run is the compounded out-of-sample path, of any other run the stored one.
    """
    metrics = _table(spark, f"{root}/run_metrics", METRICS_LAYOUT)
    returns = read_or_empty(spark, f"{root}/run_returns", RETURNS_LAYOUT)
    oos = read_or_empty(spark, f"{root}/run_oos", OOS_LAYOUT)
    swept = _table(spark, f"{root}/run_sweep", "run string").select("run").distinct()
    path = returns.groupBy("run", "trial").agg(F.max_by("equity_value", "pos").alias("stored_equity"))
    oos_end = oos.groupBy("run").agg(F.product(1 + F.col("oos_return")).alias("oos_growth"))
    kinds = oos_end.select("run", F.lit(2).alias("_k")).unionByName(swept.withColumn("_k", F.lit(1))).groupBy("run").agg(F.max("_k").alias("_k"))
    kind = F.when(F.col("_k") == 2, "walk-forward").when(F.col("_k") == 1, "sweep").otherwise("backtest")
    named = metrics.drop("kind").join(kinds, "run", "left").withColumn("kind", kind).drop("_k")
    return list_runs(named, path, oos_end)


FOLDS_LAYOUT = "fold bigint, train_start int, test_start int, test_end int, trial string, is_score double, oos_score double, run string"


def stored_sweep(spark: SparkSession, root: str) -> DataFrame:
    """(run, trial, knobs and measures..., start, end) of all stored sweeps; a column that a run does not have is null."""
    rows = _table(spark, f"{root}/run_sweep", "run string, trial bigint")
    spans = _table(spark, f"{root}/run_metrics", METRICS_LAYOUT + ", start date, end date").select("run", "trial", "start", "end")
    return rows.drop("start", "end").join(spans, ["run", "trial"], "left")


def stored_folds(spark: SparkSession, root: str) -> DataFrame:
    """(run, fold..., sessions, growth) of all stored walk-forwards: each fold with its stored out-of-sample rows."""
    folds = _table(spark, f"{root}/run_folds", FOLDS_LAYOUT)
    oos = read_or_empty(spark, f"{root}/run_oos", OOS_LAYOUT)
    # test windows don't overlap: a session of a run belongs to one fold
    tested = folds.where("test_start < test_end").select("run", "fold", F.explode(F.sequence(F.col("test_start").cast("int"), F.col("test_end").cast("int") - 1)).alias("pos"))
    grown = oos.join(tested, ["run", "pos"]).groupBy("run", "fold").agg(F.count(F.lit(1)).alias("sessions"), F.product(1 + F.col("oos_return")).alias("growth"))
    return folds.join(grown, ["run", "fold"], "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def _table(spark: SparkSession, path: str, empty: str) -> DataFrame:
    """A stored table with whatever columns its runs have, or no rows."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path).withColumn("run", F.col("run").cast("string"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], empty)


def list_runs(metrics: DataFrame, path: DataFrame, oos_end: DataFrame) -> DataFrame:
    out = metrics.join(path, ["run", "trial"], "left").join(oos_end, "run", "left")
    out = out.withColumn("last_equity", F.coalesce("oos_growth", "stored_equity")).drop("oos_growth", "stored_equity")
    return out.orderBy(F.desc_nulls_last("sharpe"), "run", "trial")


def run_equity(returns: DataFrame, oos: DataFrame) -> DataFrame:
    """(run, date, pos, equity): out-of-sample growth where a run has it, else the stored curve."""
    grown = oos.withColumn("equity", F.product(1 + F.col("oos_return")).over(down(("run",))))
    grown = grown.select("run", "date", "pos", "equity")
    plain = returns.join(oos.select("run").distinct(), "run", "left_anti")
    return grown.unionByName(plain.select("run", "date", "pos", F.col("equity_value").alias("equity")))
