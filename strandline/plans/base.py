"""What the registered queries share: the registry, inputs made of the driver's tables, and SQL fragments of their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import windows as fw
from ..operators import bars
from ..sources.tables import HOUR, table, ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: CTEs that the SQL twins share.
TICKS = """ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, value AS price, coalesce(CAST(props->>'$.k' AS BIGINT), 0) AS latency_ms,
  epoch_us(ts) + 1000 * coalesce(CAST(props->>'$.k' AS BIGINT), 0) AS arrival_us, event_id, user_id FROM events)"""
BARS = TICKS + """,
b0 AS (SELECT symbol, us // 3600000000 AS bar, arg_min(price, (us, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (us, event_id)) AS close, count(*) AS n FROM ticks GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS idx FROM b0)"""
MONTHS = """m0 AS (SELECT l_suppkey AS symbol, year(l_shipdate) * 12 + month(l_shipdate) AS bar, sum(l_extendedprice) / sum(l_quantity) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS idx, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar), 0) - 1 AS ret,
  lead(close) OVER (PARTITION BY symbol ORDER BY bar) / nullif(close, 0) - 1 AS fwd FROM m0)"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return bars.indexed(bars.time_bars(ticks(spark, d), HOUR))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as symbols: monthly mean price, volume, return and next return."""
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("symbol"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("bar")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )
    w = W.partitionBy("symbol").orderBy("bar")
    rows = bars.indexed(rows).withColumn("ret", fw.change(F.col("close"), w))
    return rows.withColumn("fwd", F.lead("ret").over(w))


WS = "PARTITION BY symbol ORDER BY idx"


def full(fn: str, x: str, n: int, shift: int = 0) -> str:
    """SQL of a rolling value that is null until its frame is full."""
    frame = f"OVER ({WS} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {'CURRENT ROW' if not shift else f'{shift} PRECEDING'})"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {fn}({x}) {frame} END"


def rank_sql(x: str, part: str = "bar") -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"
