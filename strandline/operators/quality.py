"""Data-quality scans of price tables and quote streams: one window per symbol, then aggregates.

Limits are fixed values of the checks: a spike exceeds 20 scaled median deviations (5 % at least) and is taken back by
three quarters; a frozen run has five bars; a time gap is five median steps, or 1.5 times the 95 % point of long steps
where long steps recur as sessions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.windows import by, div, islands

SPLITS = (2.0, 3.0, 4.0, 5.0, 10.0, 20.0)


def _move_limit(rows: DataFrame, move: str, key: str) -> DataFrame:
    """With _limit: 20 scaled median absolute deviations of the moves, 0.05 at least; two medians per key."""
    k = W.partitionBy(key)
    rows = rows.withColumn("_mid", F.median(move).over(k)).withColumn("_n", F.count(move).over(k))
    rows = rows.withColumn("_mad", F.median(F.abs(F.col(move) - F.col("_mid"))).over(k))
    scale = F.when(F.col("_n") >= 10, 1.4826 * F.col("_mad")).otherwise(0.0)
    return rows.withColumn("_limit", F.greatest(20 * scale, F.lit(0.05))).drop("_mid", "_mad", "_n")


def spikes(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Bars whose log move exceeds the limit and that the next bar takes back by three quarters at least: with move and back."""
    w = by(key)
    rows = bars.withColumn("move", F.log(div(F.col("close"), F.lag("close").over(w))))
    rows = _move_limit(rows, "move", key).withColumn("back", F.lead("move").over(w))
    hit = (F.abs("move") > F.col("_limit")) & (F.signum("back") == -F.signum("move")) & (F.abs(F.col("move") + F.col("back")) <= 0.25 * F.abs("move"))
    return rows.where(hit).drop("_limit")


def split_jumps(bars: DataFrame, key: str = "symbol", tolerance: float = 0.03) -> DataFrame:
    """Bars that jump from the last close, at the open or else at the close, by about a split's ratio: with ratio."""
    w = by(key)
    last = F.lag("close").over(w)
    rows = bars.withColumns({"_m": F.log(div(F.col("close"), last)), "_o": div(F.col("open"), last), "_c": div(F.col("close"), last)})
    rows = _move_limit(rows, "_m", key)

    def fits(x: Column) -> Column:
        near = F.exists(F.array(*[F.lit(k) for k in SPLITS]), lambda k: (F.abs(x * k - 1) <= tolerance) | (F.abs(x / k - 1) <= tolerance))
        return (F.abs(F.log(x)) > F.col("_limit")) & near

    ratio = F.when(fits(F.col("_o")), F.col("_o")).when(fits(F.col("_c")), F.col("_c"))
    return rows.withColumn("ratio", ratio).where("ratio IS NOT NULL").drop("_m", "_o", "_c", "_limit")


def _runs(bars: DataFrame, hit: Column, key: str) -> DataFrame:
    """Runs of consecutive bars where ``hit``: key, start, end (idx), rows."""
    w = by(key)
    rows = bars.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(islands(F.col("_hit"), w)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_hit")
    return rows.groupBy(key, "_run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count(F.lit(1)).alias("rows")).drop("_run")


def frozen_runs(bars: DataFrame, key: str = "symbol", least: int = 5) -> DataFrame:
    """Runs of ``least`` or more bars at which no price differs from the last close."""
    last = F.lag("close").over(by(key))
    still = (F.col("open") == last) & (F.col("high") == last) & (F.col("low") == last) & (F.col("close") == last)
    return _runs(bars, still, key).where(F.col("rows") >= least)


def stale_runs(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """key, longest: the longest run of bars equal to the one before them; keys without one are absent."""
    w = by(key)
    same = (F.lag("open").over(w) == F.col("open")) & (F.lag("high").over(w) == F.col("high")) & (F.lag("low").over(w) == F.col("low")) & (F.lag("close").over(w) == F.col("close"))
    return _runs(bars, same, key).groupBy(key).agg(F.max("rows").alias("longest"))


def time_gaps(rows: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, steps, sessions, gaps, largest (seconds), missing_share. Fewer than 20 steps: no gaps."""
    w = W.partitionBy(key).orderBy(seconds)
    steps = rows.select(key, seconds, (F.col(seconds) - F.lag(seconds).over(w)).alias("d"))
    k = W.partitionBy(key)
    steps = steps.withColumns({"_weeks": (F.max(seconds).over(k) - F.min(seconds).over(k)) / 604800.0}).where("d > 0")
    steps = steps.withColumn("_mid", F.median("d").over(k))
    steps = steps.withColumn("_long", F.when(F.col("d") > 5 * F.col("_mid"), F.col("d")))
    least = F.greatest(0.5 * F.first("_weeks"), F.lit(3.0))
    one = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("steps"), F.first("_mid").alias("_mid"), (F.count("_long") >= least).alias("sessions"), F.percentile("_long", F.lit(0.95)).alias("_p95"),
        (F.sum(((F.col("d") > 2.5 * F.col("_mid")) & (F.col("d") <= 5 * F.col("_mid"))).cast("long")) >= least).alias("_closed"),
        F.avg(((F.col("d") > 1.5 * F.col("_mid")) & (F.col("d") <= 5 * F.col("_mid"))).cast("double")).alias("_two"),
    )
    limit = F.when(F.col("sessions"), F.greatest(5 * F.col("_mid"), 1.5 * F.col("_p95"))).otherwise(5 * F.col("_mid"))
    one = one.withColumn("_limit", F.when(F.col("steps") >= 20, limit)).withColumn("missing_share", F.when(~F.col("sessions") & ~F.col("_closed") & (F.col("steps") >= 20), F.col("_two")).otherwise(0.0))
    big = steps.select(key, "d").join(one.select(key, "_limit"), key).groupBy(key).agg(F.count(F.when(F.col("d") > F.col("_limit"), 1)).alias("gaps"), F.max(F.when(F.col("d") > F.col("_limit"), F.col("d"))).alias("largest"))
    return one.select(key, "steps", "sessions", "missing_share").join(big, key)


def integrity(bars: DataFrame, key: str = "symbol", clock: str = "bar") -> DataFrame:
    """key and counts: rows, null_prices, not_positive, high_low (high under another price, or low over it), backward and repeated clocks."""
    prices = ("open", "high", "low", "close")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    null = F.lit(False)
    low = F.lit(False)
    for p in prices:
        null, low = null | F.col(p).isNull() | F.isnan(p), low | (F.col(p) <= 0)
    crossed = (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))
    rows = bars.withColumn("_last", F.lag(clock).over(by(key)))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), n(null).alias("null_prices"), n(low).alias("not_positive"), n(crossed).alias("high_low"),
        n(F.col(clock) < F.col("_last")).alias("backward"), n(F.col(clock) == F.col("_last")).alias("repeated"),
    )


def quote_quality(quotes: DataFrame, key: str = "symbol", stale_ms: float = 50.0) -> DataFrame:
    """key and a quote stream's counts: crossed, locked, not_positive, negative_latency, repeated, longest unchanged run,
    late arrivals, latency points and stale share. quotes: key, us, arrival_us, latency_ms, bid, ask and a total order."""
    w = W.partitionBy(key).orderBy("us", "event_id")
    before = {c: F.lag(c).over(w) for c in ("us", "bid", "ask")}
    held = (before["bid"] == F.col("bid")) & (before["ask"] == F.col("ask"))
    rows = quotes.withColumns({"_held": F.coalesce(held, F.lit(False)), "_twice": held & (before["us"] == F.col("us")), "_late": F.col("arrival_us") < F.max("arrival_us").over(w.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.withColumn("_run", F.sum(islands(F.col("_held"), w)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    runs = rows.where("_held").groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_k")).groupBy(key).agg(F.max("_k").alias("_longest"))
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    one = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("quotes"), n(F.col("bid") > F.col("ask")).alias("crossed"), n(F.col("bid") == F.col("ask")).alias("locked"), n((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("not_positive"),
        n(F.col("latency_ms") < 0).alias("negative_latency"), n(F.col("_twice")).alias("repeated"), n(F.col("_late")).alias("late"), p.alias("_p"), F.avg((F.col("latency_ms") > stale_ms).cast("double")).alias("stale_share"),
    )
    one = one.join(runs, key, "left").withColumn("longest_unchanged", F.coalesce("_longest", F.lit(0)))
    return one.select("*", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), F.col("_p")[2].alias("p99")).drop("_p", "_longest")


def capacity(trades: DataFrame, key: str, value: str, change: str, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """key, share, capital: what can be traded at these shares of the market's value, from the 10 % point of value over the weight change."""
    room = trades.where((F.abs(F.col(change)) > 0) & (F.col(value) > 0)).groupBy(key).agg(F.percentile(F.col(value) / F.abs(F.col(change)), F.lit(0.1)).alias("_room"))
    return room.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * F.col("_room")).alias("capital")) for s in shares])).alias("x")).select(key, "x.*")
