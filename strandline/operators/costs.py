"""What trading costs: ladders, break-even, square-root impact, capacity, funding and the tests that shift a strategy in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.windows import by, div, rolling
from . import backtest


def breakeven_bps(free: DataFrame, keys: list[str], high: float = 200.0, steps: int = 14) -> DataFrame:
    """keys, breakeven: the fee in basis points at which the compounded trades return nothing, by bisection on [0, high].

    free: trades without cost (side, entry_px, exit_px). 0 if they lose without cost, ``high`` if they gain at it. A run's
    trades are one array of pairs; the bisection is an expression over it."""
    pairs = free.groupBy(*keys).agg(F.collect_list(F.struct(F.col("side").alias("s"), (F.col("exit_px") / F.col("entry_px")).alias("r"))).alias("t"))

    def gains(bps: Column) -> Column:
        def ln(x: Column) -> Column:
            factor = 1 - x["s"] - bps / 1e4 + x["s"] * x["r"] - x["r"] * bps / 1e4
            return F.when(factor > 0, F.log(factor)).otherwise(-1e9)

        return F.aggregate("t", F.lit(0.0), lambda a, x: a + ln(x)) > 0

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        up = gains(mid)
        return F.struct(F.when(up, mid).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(high).alias("hi")), halve, lambda a: a["lo"])
    return pairs.select(*keys, F.when(~gains(F.lit(0.0)), 0.0).when(gains(F.lit(high)), high).otherwise(found).alias("breakeven"))


def timing_p(bars: DataFrame, key: str, target: str, shifts: int = 200, fee: float = 0.0005, slippage: float = 0.0005) -> DataFrame:
    """key, log_return, shifts, p: the run against copies whose positions are turned round by even offsets of a twentieth
    (10 bars at least) to the rest. Each copy is a row set of its own: positions are sent to where they land, by an
    equality join, and all copies are backtested in one plan. Runs too short to shift are left out."""
    size = bars.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lo = F.greatest(F.lit(10), F.floor(F.col("n") / 20))
    k = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(shifts - 1)), lambda i: F.floor(lo + i * (F.col("n") - 2 * lo) / F.lit(max(1, shifts - 1))).cast("long")))
    offsets = size.where(F.col("n") > 2 * lo).select(key, "n", F.explode(F.concat(F.array(F.lit(0).cast("long")), k)).alias("shift"))
    sent = bars.select(key, "idx", target).join(offsets, key).select(key, "shift", ((F.col("idx") + F.col("shift")) % F.col("n")).alias("idx"), target)
    rows = sent.join(bars.select(key, "idx", "open", "close"), [key, "idx"])
    made = backtest.totals(backtest.trades(rows, target, [key, "shift"], fee, slippage), [key, "shift"])
    all_runs = offsets.select(key, "shift").join(made.select(key, "shift", "total_return"), [key, "shift"], "left").withColumn("total_return", F.round(F.coalesce("total_return", F.lit(0.0)), 9))
    real = all_runs.where("shift = 0").select(key, F.col("total_return").alias("_own"))
    found = all_runs.where("shift > 0").join(real, key)
    return found.groupBy(key, F.col("_own").alias("total_return")).agg(
        F.count(F.lit(1)).alias("shifts"), ((1 + F.sum((F.col("total_return") >= F.col("_own")).cast("long"))) / (F.count(F.lit(1)) + 1)).alias("p")
    )


def impact_costs(panel: DataFrame, aums: list[float], coef: float = 0.1, window: int = 20, symbol: str = "symbol", time: str = "bar") -> DataFrame:
    """time, aum, gross, impact, net: a book's return less square-root impact at each size of capital. Volatility and
    traded value are those of the ``window`` rows before; weights earn the next row. panel: symbol, idx, time, ret, close, volume, weight."""
    w = by(symbol)
    value = F.col("close") * F.col("volume")
    rows = panel.withColumns(
        {
            "_sd": rolling(F.stddev_samp, F.col("ret"), window, w, 1),
            "_adv": rolling(F.avg, value, window, w, 1),
            "_dw": F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))),
            "_earned": F.coalesce(F.lag("weight").over(w), F.lit(0.0)) * F.coalesce("ret", F.lit(0.0)),
        }
    )
    rows = rows.select(time, "_sd", "_adv", "_dw", "_earned", F.explode(F.array(*[F.lit(float(a)) for a in aums])).alias("aum"))
    cost = F.col("_dw") * F.least(F.lit(1.0), coef * F.col("_sd") * F.sqrt(div(F.col("_dw") * F.col("aum"), F.col("_adv"))))
    out = rows.groupBy(time, "aum").agg(F.sum("_earned").alias("gross"), F.sum(F.coalesce(cost, F.lit(0.0))).alias("impact"))
    return out.withColumn("net", F.col("gross") - F.col("impact"))


def funding_drag(weight: Column, funding_bps: Column, borrow_bps: Column) -> Column:
    """What a bar's holding costs: funding on the weight, and a borrow fee on shorts."""
    return (weight * funding_bps + F.greatest(-weight, F.lit(0.0)) * borrow_bps) / 1e4


def side_fee_bps(maker: float, taker: float, maker_share: Column) -> Column:
    return maker_share * maker + (1 - maker_share) * taker


def shortfall(fills: DataFrame, keys: list[str]) -> DataFrame:
    """keys, filled, shortfall_bps: size-weighted signed distance of fill from arrival price. fills: side, qty, price, arrival."""
    cost = F.col("side") * (F.col("price") - F.col("arrival")) * F.col("qty")
    return fills.groupBy(*keys).agg(F.sum("qty").alias("filled"), (1e4 * div(F.sum(cost), F.sum(F.col("arrival") * F.col("qty")))).alias("shortfall_bps"))


def impact_coefficient(fills: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, coef: least squares through the origin of cost on sd * sqrt(participation). fills: cost, sd, participation."""
    x = F.col("sd") * F.sqrt("participation")
    return fills.where(x.isNotNull() & F.col("cost").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), div(F.sum(x * F.col("cost")), F.sum(x * x)).alias("coef"))


def participation(rows: DataFrame, keys: list[str], value: str, market: str, assumed: float) -> DataFrame:
    """keys, mean, p95, most and share of bars above ``assumed``: traded over market value."""
    p = div(F.col(value), F.col(market))
    return rows.where(p > 0).groupBy(*keys).agg(F.avg(p).alias("mean"), F.percentile(p, F.lit(0.95)).alias("p95"), F.max(p).alias("most"), F.avg((p > assumed).cast("double")).alias("exceeding"))


def timing_luck(panel: DataFrame, weight: str, every: int, time: str = "bar") -> DataFrame:
    """offset, total: what the book makes when it rebalances every ``every`` rows at each offset."""
    w = W.partitionBy("symbol", "offset").orderBy("idx")
    rows = panel.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(every - 1))))
    held = F.coalesce(F.last(F.when(F.col("idx") % every == F.col("offset"), F.col(weight)), True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    daily = rows.withColumn("_h", held).groupBy("offset", time).agg(F.sum(F.col("_h") * F.coalesce("ret", F.lit(0.0))).alias("r"))
    return daily.groupBy("offset").agg(F.sum("r").alias("total"))
