"""Market tables derived from the driver's star schema, in Spark and in SQL.

A ticker is a supplier and a session a week (always its Friday), so both grow with the scale factor and
about four cells in five are filled. Attributes come from the suppliers' own data: those with a negative
balance stop trading at the end of 1999, rich ones carry a 2:1 split, regions are sectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import build_panel
from ..operators.sessions import session_calendar
from ..session import checkpoint_folder


# Known layouts: Spark need not open a file to plan a query.
LAYOUTS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder of the session's shared checkpoint folder, for what one run of a query stores."""
    return f"{checkpoint_folder(spark)}/query-{uuid.uuid4().hex}"


def ticker(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


def friday(column: str):
    return F.date_add(F.to_date(F.date_trunc("week", column)), 4)


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per supplier. Close and sides come from discounts and taxes, so they stay near 100.

    All are extremes or mid-points, rounded like quotes: equal bars are equal whatever order their lines
    were read in, and later means and ratios do not fall on rounding ties.
    """
    line = table(spark, sf, "lineitem")
    bars = line.groupBy(friday("l_shipdate").alias("date"), F.col("l_suppkey").alias("k")).agg(
        F.round(100 * (1 + F.min("l_discount") - F.max("l_tax")), 6).alias("o"),
        F.round(100 * (1 + F.max("l_discount")), 6).alias("h"),
        F.round(100 * (1 - F.max("l_tax")), 6).alias("l"),
        F.round(100 * (1 + (F.min("l_discount") + F.max("l_discount") - F.min("l_tax") - F.max("l_tax")) / 2), 6).alias("c"),
        F.sum("l_quantity").alias("volume"),
    )
    who = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    rows = bars.join(who, "k").where(~((F.col("s_acctbal") < 0) & (F.col("date") > F.lit("1999-12-31").cast("date"))))
    split = (F.col("s_acctbal") > 5000) & (F.col("date") < F.lit("1998-07-03").cast("date"))
    m = F.when(split, 2.0).otherwise(1.0)
    return rows.select(
        "date",
        ticker("k").alias("ticker"),
        (F.col("o") * m).alias("open"),
        (F.col("h") * m).alias("high"),
        (F.col("l") * m).alias("low"),
        (F.col("c") * m).alias("close"),
        F.col("c").alias("adj_close"),
        "volume",
    )


def rough_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly cheapest and dearest line per supplier: jumps of ten times and crashes of 90 % occur."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(friday("l_shipdate").alias("date"), ticker("l_suppkey").alias("ticker")).agg(
        F.max("l_extendedprice").alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.min("l_extendedprice").alias("close"),
        F.lit(None).cast("double").alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """2:1 for rich suppliers, 3:2 for the better half, and a pair that cancels on one day for the richest."""
    who = table(spark, sf, "supplier").select(ticker("s_suppkey").alias("ticker"), "s_acctbal")
    event = lambda day, a, b, floor: F.when(
        F.col("s_acctbal") > floor,
        F.struct(F.lit(day).cast("date").alias("execution_date"), F.lit(a).alias("split_from"), F.lit(b).alias("split_to")),
    )
    events = F.array(
        event("1998-07-03", 1.0, 2.0, 5000),
        event("1997-03-07", 2.0, 3.0, 2500),
        event("1999-02-05", 1.0, 10.0, 7500),
        event("1999-02-05", 10.0, 1.0, 7500),
        event("2000-05-05", 0.0, 2.0, 1000),
    )
    return who.select("ticker", F.explode(F.array_compact(events)).alias("e")).select("ticker", "e.*")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    who = table(spark, sf, "supplier")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = who.join(nation, who.s_nationkey == nation.n_nationkey, "left")
    rows = rows.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return rows.select(
        ticker("s_suppkey").alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(~F.col("s_acctbal").between(0, 1500), F.col("r_name")).alias("sector"),
        F.when(F.col("s_acctbal") < 0, F.lit("1999-12-31").cast("date")).alias("delisted_date"),
        F.when(F.col("s_acctbal") < -500, -0.45).alias("delisting_return"),
    )


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """'idx': the first nations' suppliers until the end of 1997, everybody with a balance under 9000 from 1998."""
    who = table(spark, sf, "supplier").select(ticker("s_suppkey").alias("ticker"), "s_nationkey", "s_acctbal")
    day = lambda x: F.lit(x).cast("date")
    span = lambda ok, a, b: F.when(ok, F.struct(a.alias("start_date"), b.alias("end_date")))
    spans = F.array(
        span(F.col("s_nationkey") < 12, day("1995-01-06"), day("1997-12-26")),
        span(F.col("s_nationkey") < 6, day("1997-06-06"), day("1998-03-06")),
        span(F.col("s_acctbal") < 9000, day("1998-01-02"), day(None)),
    )
    rows = who.select("ticker", F.explode(F.array_compact(spans)).alias("s"))
    return rows.select(F.lit("idx").alias("universe"), "ticker", "s.*")


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly sales and mean order size per supplier, published with a lag; poor suppliers restate sales."""
    line = table(spark, sf, "lineitem")
    quarter = F.date_trunc("quarter", "l_shipdate")
    figures = line.groupBy(quarter.alias("q"), F.col("l_suppkey").alias("k")).agg(
        F.sum("l_extendedprice").alias("sales"), F.avg("l_quantity").alias("order_size")
    )
    who = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", "s_acctbal")
    rows = figures.join(who, "k").withColumn("period_end", F.last_day(F.add_months(F.to_date("q"), 2)))
    lag = F.date_add("period_end", F.lit(45) + F.col("s_nationkey"))
    late = F.date_add("period_end", F.lit(105) + F.col("s_nationkey"))
    fact = lambda f, when, v: F.struct(F.lit(f).alias("field"), when.alias("available_date"), v.alias("value"))
    facts = F.array(
        fact("sales", lag, F.col("sales")),
        fact("order_size", lag, F.col("order_size")),
        F.when(F.col("s_acctbal") < 3000, fact("sales", late, F.col("sales") * 1.01)),
    )
    out = rows.select(ticker("k").alias("ticker"), "period_end", F.explode(F.array_compact(facts)).alias("f"))
    return out.select("ticker", "f.field", "period_end", "f.available_date", "f.value")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who ordered in a quarter: names drop out and return."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date"),
        F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("ticker"),
    ).distinct()


RAW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A dirty long file: every line a bar, weekends, many rows per key, bad closes, crossed sides."""
    line = table(spark, sf, "lineitem")
    bad = F.col("l_quantity") == 1
    text = F.concat(F.lit(" s"), F.col("l_suppkey").cast("string"), F.lit(" "))
    return line.select(
        F.when(F.col("l_linenumber") < 7, F.to_date("l_shipdate")).alias("date"),
        F.upper(F.trim(F.when(F.col("l_quantity") == 2, F.lit(" none")).otherwise(text))).alias("ticker"),
        F.when(F.col("l_tax") == 0, -1.0).otherwise(100 * (1 + F.col("l_discount"))).alias("open"),
        (100 * (1 + F.col("l_discount"))).alias("high"),
        (100 * (1 + F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 0.2).otherwise(-0.05))).alias("low"),
        F.when(bad, -1.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        F.lit(None).cast("double").alias("adj_close"),
        F.when(F.col("l_returnflag") == "N", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"),
        *RAW_ORDER,
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Shares per customer number read as a supplier number; most numbers have no prices."""
    who = table(spark, sf, "customer")
    return who.groupBy(ticker("c_custkey").alias("ticker")).agg((F.sum("c_acctbal") / 10).cast("bigint").alias("shares"))


def panel(spark: SparkSession, sf: str, universe: str = "idx", fields=(), **options) -> DataFrame:
    return build_panel(
        prices(spark, sf),
        membership(spark, sf),
        fundamentals(spark, sf) if fields else None,
        meta(spark, sf),
        universe=universe,
        fields=list(fields),
        **options,
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return session_calendar(prices(spark, sf))


# -- the same tables as SQL common table expressions ------------------------------------
TICKER = "'S' || lpad({0}::VARCHAR, 6, '0')"

CTE: dict[str, str] = {
    "bars": """
  SELECT date_trunc('week', l_shipdate)::DATE + 4 AS date, l_suppkey AS k,
         round(100 * (1 + min(l_discount) - max(l_tax)), 6) AS o, round(100 * (1 + max(l_discount)), 6) AS h,
         round(100 * (1 - max(l_tax)), 6) AS l, round(100 * (1 + (min(l_discount) + max(l_discount) - min(l_tax) - max(l_tax)) / 2), 6) AS c,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2""",
    "prices": f"""
  SELECT date, {TICKER.format('k')} AS ticker, o * m AS open, h * m AS high, l * m AS low, c * m AS close,
         c AS adj_close, volume
  FROM (SELECT b.*, CASE WHEN s_acctbal > 5000 AND date < DATE '1998-07-03' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m
        FROM bars b JOIN supplier ON s_suppkey = k
        WHERE NOT (s_acctbal < 0 AND date > DATE '1999-12-31'))""",
    "rough": f"""
  SELECT date_trunc('week', l_shipdate)::DATE + 4 AS date, {TICKER.format('l_suppkey')} AS ticker,
         max(l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         min(l_extendedprice) AS close, NULL::DOUBLE AS adj_close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2""",
    "splits": f"""
  SELECT {TICKER.format('s_suppkey')} AS ticker, e.execution_date, e.split_from, e.split_to
  FROM supplier JOIN (VALUES
    (DATE '1998-07-03', 1.0::DOUBLE, 2.0::DOUBLE, 5000), (DATE '1997-03-07', 2.0, 3.0, 2500),
    (DATE '1999-02-05', 1.0, 10.0, 7500), (DATE '1999-02-05', 10.0, 1.0, 7500),
    (DATE '2000-05-05', 0.0, 2.0, 1000)) e(execution_date, split_from, split_to, floor) ON s_acctbal > e.floor""",
    "meta": f"""
  SELECT {TICKER.format('s_suppkey')} AS ticker, s_name AS name,
         CASE WHEN NOT (s_acctbal BETWEEN 0 AND 1500) THEN r_name END AS sector,
         CASE WHEN s_acctbal < 0 THEN DATE '1999-12-31' END AS delisted_date,
         CASE WHEN s_acctbal < -500 THEN -0.45::DOUBLE END AS delisting_return
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "membership": f"""
  SELECT 'idx' AS universe, {TICKER.format('s_suppkey')} AS ticker, v.start_date, v.end_date
  FROM supplier JOIN (VALUES
    (DATE '1995-01-06', DATE '1997-12-26', 1), (DATE '1997-06-06', DATE '1998-03-06', 2),
    (DATE '1998-01-02', NULL::DATE, 3)) v(start_date, end_date, kind)
    ON (kind = 1 AND s_nationkey < 12) OR (kind = 2 AND s_nationkey < 6) OR (kind = 3 AND s_acctbal < 9000)""",
    "figures": """
  SELECT date_trunc('quarter', l_shipdate)::DATE AS q, l_suppkey AS k, sum(l_extendedprice) AS sales,
         avg(l_quantity) AS order_size FROM lineitem GROUP BY 1, 2""",
    "reported": """
  SELECT f.*, s_nationkey AS nk, s_acctbal, last_day((q + INTERVAL 2 MONTH)::DATE) AS period_end
  FROM figures f JOIN supplier ON s_suppkey = k""",
    "fundamentals": f"""
  SELECT {TICKER.format('k')} AS ticker, 'sales' AS field, period_end, (period_end + (45 + nk)::INT)::DATE AS available_date,
         sales AS value FROM reported
  UNION ALL SELECT {TICKER.format('k')}, 'order_size', period_end, (period_end + (45 + nk)::INT)::DATE, order_size FROM reported
  UNION ALL SELECT {TICKER.format('k')}, 'sales', period_end, (period_end + (105 + nk)::INT)::DATE, sales * 1.01
    FROM reported WHERE s_acctbal < 3000""",
    "snapshots": """
  SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS date, 'C' || lpad(o_custkey::VARCHAR, 7, '0') AS ticker
  FROM orders""",
    "raw_rows": """
  SELECT CASE WHEN l_linenumber < 7 THEN l_shipdate::DATE END AS date,
         upper(trim(CASE WHEN l_quantity = 2 THEN ' none' ELSE ' s' || l_suppkey::VARCHAR || ' ' END)) AS ticker,
         CASE WHEN l_tax = 0 THEN -1.0::DOUBLE ELSE 100 * (1 + l_discount) END AS open,
         100 * (1 + l_discount) AS high,
         100 * (1 + l_discount + (CASE WHEN l_returnflag = 'R' THEN 0.2::DOUBLE ELSE -0.05::DOUBLE END)) AS low,
         CASE WHEN l_quantity = 1 THEN -1.0::DOUBLE ELSE l_extendedprice / l_quantity END AS close,
         NULL::DOUBLE AS adj_close,
         CASE WHEN l_returnflag = 'N' THEN -l_quantity ELSE l_quantity END AS volume,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity
  FROM lineitem""",
    "holdings": f"""
  SELECT {TICKER.format('c_custkey')} AS ticker, trunc(sum(c_acctbal) / 10)::BIGINT AS shares FROM customer GROUP BY 1""",
}

NEEDS = {
    "prices": ["bars"],
    "reported": ["figures"],
    "fundamentals": ["reported"],
}


def with_tables(*names: str) -> list[str]:
    """CTE definitions of the named tables and what they need, in order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return [f"{name} AS ({CTE[name]})" for name in seen]


def panel_ctes(
    source: str = "prices",
    universe: str | None = "idx",
    fields: tuple[str, ...] = (),
    gap: int = 20,
    gain: float = 9.0,
    stale: int = 400,
    selected: str | None = None,
    with_meta: bool = True,
) -> list[str]:
    """CTE chain ending in ``panel`` (with ``cal``): the dense panel of build_panel."""
    tables = [source] + (["membership"] if universe else []) + (["meta"] if with_meta else []) + (["fundamentals"] if fields else [])
    pick = selected or (
        f"SELECT * FROM {source} WHERE ticker IN (SELECT ticker FROM membership WHERE universe = '{universe}')"
        if universe
        else f"SELECT * FROM {source}"
    )
    member = (
        "EXISTS (SELECT 1 FROM membership m WHERE m.ticker = g7.ticker AND g7.date BETWEEN m.start_date "
        "AND coalesce(m.end_date, DATE '9999-12-31'))"
        if universe
        else "true"
    )
    meta_join = "LEFT JOIN meta m ON m.ticker = g.ticker" if with_meta else ""
    meta_cols = (
        "m.sector, m.delisted_date, m.delisting_return"
        if with_meta
        else "NULL::VARCHAR AS sector, NULL::DATE AS delisted_date, NULL::DOUBLE AS delisting_return"
    )
    name = "base" if fields else "panel"
    ctes = with_tables(*tables) + [
        f"sel AS ({pick})",
        "cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS pos, (count(*) OVER ())::INT AS n_sessions "
        "FROM (SELECT DISTINCT date FROM sel))",
        "grid AS (SELECT c.date, c.pos, c.n_sessions, t.ticker, s.open, s.high, s.low, s.close AS raw_close, s.adj_close, "
        "s.volume FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM sel) t LEFT JOIN sel s ON s.date = c.date AND s.ticker = t.ticker)",
        f"g1 AS (SELECT g.*, coalesce(adj_close, raw_close) AS close, {meta_cols} FROM grid g {meta_join})",
        "g2 AS (SELECT *, close / nullif(raw_close, 0) AS factor, "
        "last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos) AS carried, "
        "max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY ticker) AS last_pos, "
        "last_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS printed FROM g1)",
        "g3 AS (SELECT *, CASE WHEN pos <= last_pos THEN carried END AS px FROM g2)",
        "g4 AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY pos), 0) - 1 AS r0 FROM g3)",
        f"g5 AS (SELECT *, CASE WHEN close IS NOT NULL AND pos - printed > {gap} THEN NULL ELSE r0 END AS r1 FROM g4)",
        f"g6 AS (SELECT *, coalesce(r1 > {gain}, false) AS jump FROM g5)",
        "g7 AS (SELECT *, CASE WHEN jump OR (r1 < -0.9 AND coalesce(lead(jump) OVER (PARTITION BY ticker ORDER BY pos), false)) "
        "THEN NULL ELSE r1 END AS r2 FROM g6)",
        f"g8 AS (SELECT date, pos, n_sessions, ticker, sector, last_pos, raw_close, close, volume, open * factor AS open, "
        "high * factor AS high, low * factor AS low, raw_close * volume AS dollar_volume, "
        "CASE WHEN delisted_date IS NOT NULL AND pos = last_pos + 1 THEN coalesce(delisting_return, -0.30::DOUBLE) ELSE r2 END AS returns, "
        f"raw_close IS NOT NULL AND {member} AS mask FROM g7)",
        f"{name} AS (SELECT *, coalesce((high + low + close) / 3, close) AS vwap, "
        "CASE WHEN count(dollar_volume) OVER w = 20 THEN avg(dollar_volume) OVER w END AS adv20 FROM g8 "
        "WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
    ]
    if fields:
        picks = []
        joins = []
        for f in fields:
            ctes.append(
                f"facts_{f} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, available_date "
                f"ORDER BY period_end DESC) AS rn FROM fundamentals WHERE field = '{f}') WHERE rn = 1 AND value IS NOT NULL)"
            )
            picks.append(f"CASE WHEN b.date - {f}.available_date <= {stale} THEN {f}.value END AS {f}")
            joins.append(
                f"ASOF LEFT JOIN facts_{f} {f} ON b.ticker = {f}.ticker AND b.date >= {f}.available_date"
            )
        ctes.append(f"panel AS (SELECT b.*, {', '.join(picks)} FROM base b {' '.join(joins)})")
    return ctes


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
