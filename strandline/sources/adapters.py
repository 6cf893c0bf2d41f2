"""Other shapes of input: trades and fills to positions, wide tables to long ones, clocks, quotes and stream messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_bar(points: DataFrame, bars: DataFrame, time: str, key: str = "symbol", clock: str = "us") -> DataFrame:
    """``points`` with at: idx of the first bar of their symbol that starts at or after their time; null after the last.

    A union and one window, not a range join: bars look backwards from the end."""
    cols = points.columns
    a = points.withColumns({"_t": F.col(time), "_bar": F.lit(None).cast("long"), "_side": F.lit(1)})
    b = bars.select(F.col(key), F.col(clock).alias("_t"), F.col("idx").cast("long").alias("_bar"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("at", F.last("_bar", True).over(w))
    return rows.where("_side = 1").select(*cols, "at")


def positions_from_trades(bars: DataFrame, trades: DataFrame, key: str = "symbol", clock: str = "us") -> DataFrame:
    """key, idx, position: the sign of the trades held at each bar. A trade (open_us, close_us, side) is decided one bar
    before it fills, so it covers the bars from that before its first to that before its end. Entries and exits are steps
    that are added up: no join of trades to every bar they cover."""
    opened = first_bar(trades, bars, "open_us", key, clock).withColumnRenamed("at", "_a")
    both = first_bar(opened, bars, "close_us", key, clock).withColumnRenamed("at", "_z")
    last = bars.groupBy(key).agg((F.max("idx") + 1).alias("_n"))
    both = both.join(last, key).where("_a IS NOT NULL")
    a, z = F.greatest(F.col("_a") - 1, F.lit(0)), F.greatest(F.coalesce("_z", "_n") - 1, F.lit(0))
    steps = both.withColumns({"_from": a, "_to": z}).where("_from < _to").select(key, F.inline(F.array(F.struct(F.col("_from").alias("idx"), F.col("side").cast("double").alias("d")), F.struct(F.col("_to").alias("idx"), (-F.col("side")).cast("double").alias("d")))))
    steps = steps.groupBy(key, "idx").agg(F.sum("d").alias("d"))
    rows = bars.select(key, F.col("idx").cast("long").alias("idx")).join(steps, [key, "idx"], "left")
    held = F.sum(F.coalesce("d", F.lit(0.0))).over(W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(key, "idx", F.signum(F.round(held, 9)).cast("int").alias("position"))


def positions_from_fills(bars: DataFrame, fills: DataFrame, key: str = "symbol", clock: str = "us") -> DataFrame:
    """key, idx, position: the sign of the running sum of signed quantities (us, qty), each at the bar before it fills.
    Sums below 1e-9 of the largest are rounding noise, and flat."""
    at = first_bar(fills, bars, clock, key, clock)
    last = bars.groupBy(key).agg(F.max("idx").alias("_n"))
    at = at.join(last, key).withColumn("idx", F.least("_n", F.greatest(F.coalesce(F.col("at"), F.col("_n") + 1) - 1, F.lit(0))).cast("long"))
    steps = at.groupBy(key, "idx").agg(F.sum("qty").alias("d"))
    rows = bars.select(key, F.col("idx").cast("long").alias("idx")).join(steps, [key, "idx"], "left")
    w = W.partitionBy(key)
    rows = rows.withColumn("_q", F.sum(F.coalesce("d", F.lit(0.0))).over(w.orderBy("idx").rowsBetween(W.unboundedPreceding, 0))).withColumn("_m", F.max(F.abs("_q")).over(w))
    return rows.select(key, "idx", F.when(F.abs("_q") <= 1e-9 * F.col("_m"), 0).otherwise(F.signum("_q")).cast("int").alias("position"))


def long_legs(wide: DataFrame, time: str, prefixes: tuple[str, ...] = ("px_", "qty_")) -> DataFrame:
    """time, leg and a column for each prefix, out of columns such as px_a, qty_a. A leg that lacks one of them is an error."""
    legs = sorted({c[len(prefixes[0]) :] for c in wide.columns if c.startswith(prefixes[0])})
    missing = [p + leg for leg in legs for p in prefixes if p + leg not in wide.columns]
    if not legs or missing:
        raise ValueError(f"missing leg columns: {', '.join(missing) or prefixes[0] + '*'}")
    structs = [F.struct(F.lit(leg).alias("leg"), *[F.col(p + leg).cast("double").alias(p.rstrip("_")) for p in prefixes]) for leg in legs]
    return wide.select(time, F.inline(F.array(*structs)))


def epoch_micros(value: Column) -> Column:
    """Microseconds out of an epoch number in seconds, milli-, micro- or nanoseconds, told apart by size."""
    v = value.cast("long")
    size = F.abs(v)
    return F.when(size > F.lit(10**17), F.round((v - F.pmod(v, F.lit(1000))) / 1000)).when(size > F.lit(10**14), v).when(size > F.lit(10**11), v * F.lit(1000).cast("long")).otherwise(v * F.lit(1_000_000).cast("long")).cast("long")


def as_returns(rows: DataFrame, column: str, key: list[str]) -> DataFrame:
    """With ret: percent figures (a median size above 0.5 within the key) divided by 100."""
    w = W.partitionBy(*key)
    return rows.withColumn("_m", F.median(F.abs(column)).over(w)).withColumn("ret", F.col(column) / F.when(F.col("_m") > 0.5, 100.0).otherwise(1.0)).drop("_m")


#: A best bid and offer message, plain or inside a combined stream's envelope.
TICKER = "struct<E:bigint,s:string,b:string,a:string,data:struct<E:bigint,s:string,b:string,a:string>>"


def parse_tickers(messages: DataFrame, column: str) -> DataFrame:
    """event_ms, symbol, bid, ask of JSON messages; what cannot be read is null and its row stays."""
    j = F.from_json(column, TICKER)
    rows = messages.withColumn("_j", j)
    pick = lambda c: F.coalesce(F.col(f"_j.data.{c}"), F.col(f"_j.{c}"))
    return rows.select(*messages.columns, pick("E").alias("event_ms"), pick("s").alias("ticker"), pick("b").try_cast("double").alias("bid"), pick("a").try_cast("double").alias("ask"))


def venue(symbol: Column) -> Column:
    """The part after @ of a symbol such as ABC@X; null without one."""
    return F.nullif(F.regexp_extract(symbol, "@(.+)$", 1), F.lit(""))


def close_minutes(exchange_zone: str, day: Column, local: str = "16:00:00") -> Column:
    """Minutes after midnight UTC at which an exchange closes on a day, whatever its clock does in summer."""
    at = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(local))), exchange_zone)
    return F.hour(at) * 60 + F.minute(at)


def total_return_factors(bars: DataFrame, actions: DataFrame, key: str = "symbol") -> DataFrame:
    """``bars`` with factor: prices before an action's bar times 1 - dividend / last close, or over the split's ratio.

    actions: key, idx, kind (dividend or split), value. Factors of later bars are multiplied backwards by a sum of logarithms."""
    w = W.partitionBy(key).orderBy("idx")
    each = F.when(F.col("kind") == "dividend", F.struct(F.col("value").alias("v"), F.lit(0.0).alias("s"))).otherwise(F.struct(F.lit(0.0).alias("v"), F.log("value").alias("s")))
    per = actions.withColumn("_e", each).groupBy(key, "idx").agg(F.sum("_e.v").alias("_div"), F.sum("_e.s").alias("_split"))
    rows = bars.join(per, [key, "idx"], "left").withColumn("_before", F.lag("close").over(w))
    own = F.log(1 - F.coalesce("_div", F.lit(0.0)) / F.col("_before")) - F.coalesce("_split", F.lit(0.0))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(0.0)))
    later = F.coalesce(F.sum("_own").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
    return rows.withColumn("factor", F.exp(later)).drop("_div", "_split", "_before", "_own")
