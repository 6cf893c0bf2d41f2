"""Bars: ticks to open-high-low-close rows on event time, arrival time or equal counts, gap filling and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ohlc(price: str, order: Column) -> list[Column]:
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("n"),
    ]


def time_bars(ticks: DataFrame, width_us: int, clock: str = "us") -> DataFrame:
    """symbol, bar (number of the interval), open, high, low, close, n. Ties of the clock go to the lesser event_id."""
    bar = F.floor(F.col(clock) / width_us).cast("long").alias("bar")
    return ticks.groupBy("symbol", bar).agg(*ohlc("price", F.struct(clock, "event_id")))


def count_bars(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` ticks each; the last one of a symbol may be short."""
    k = F.row_number().over(W.partitionBy("symbol").orderBy("us", "event_id")) - 1
    rows = ticks.withColumn("bar", F.floor(k / size).cast("long"))
    return rows.groupBy("symbol", "bar").agg(*ohlc("price", F.struct("us", "event_id")))


def fill_gaps(bars: DataFrame) -> DataFrame:
    """A row for each interval between a symbol's first and last; prices of absent ones are the last close, n is 0."""
    span = bars.groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b")).alias("bar"))
    w = W.partitionBy("symbol").orderBy("bar").rowsBetween(W.unboundedPreceding, 0)
    rows = grid.join(bars, ["symbol", "bar"], "left").withColumn("last", F.last("close", True).over(w))
    return rows.select("symbol", "bar", *[F.coalesce(c, "last").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("n", F.lit(0)).alias("n"))


def roll_up(bars: DataFrame, factor: int) -> DataFrame:
    """Longer bars out of bars."""
    return bars.groupBy("symbol", F.floor(F.col("bar") / factor).cast("long").alias("bar")).agg(
        F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("n").alias("n")
    )


def indexed(bars: DataFrame) -> DataFrame:
    """With idx: the place of a bar in its symbol, from 0."""
    return bars.withColumn("idx", F.row_number().over(W.partitionBy("symbol").orderBy("bar")) - 1)
