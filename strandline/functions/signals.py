"""A library of cross-sectional scores: columns over one window per symbol, then a ranking or z-score per time.

``rows`` has symbol, idx, bar, close, volume, ret and mkt (the market's return at that time). Rolling values are null until
their frame is full; nothing looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from .windows import by, change, div, rolling


def beta(n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n + 1, 0)
    cov = F.covar_samp("ret", "mkt").over(frame)
    return F.when(F.count(F.col("ret") + F.col("mkt")).over(frame) >= n, div(cov, F.var_samp("mkt").over(frame)))


def momentum(n: int, skip: int, w: WindowSpec) -> Column:
    return div(F.lag("close", skip).over(w), F.lag("close", skip + n).over(w)) - 1


def skew(n: int, w: WindowSpec) -> Column:
    """Sample skewness, adjusted for bias."""
    frame = w.rowsBetween(-n + 1, 0)
    m1, m2, m3 = (F.avg(F.col("ret") ** k).over(frame) for k in (1, 2, 3))
    var = m2 - m1 * m1
    g = div(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1, F.pow(F.when(var > 1e-15, var), 1.5))
    return F.when(F.count("ret").over(frame) >= n, g * (n * (n - 1)) ** 0.5 / (n - 2))


def scores(rows: DataFrame, n: int = 6, long: int = 12) -> DataFrame:
    """``rows`` with one column for each family."""
    w, c, x = by(), F.col("close"), F.col("ret")
    value = F.col("close") * F.col("volume")
    top, low = rolling(F.max, c, long, w), rolling(F.min, c, long, w)
    sd = rolling(F.stddev_samp, x, n, w)
    one = rows.withColumns(
        {
            "mom": momentum(n, 1, w),
            "rev": change(c, w, 1),
            "vsmom": div(change(c, w, n), sd * n**0.5),
            "lowvol": sd,
            "bab": beta(long, w),
            "maxl": rolling(F.max, x, n, w),
            "skewness": skew(long, w),
            "hi": div(c, top),
            "illiq": rolling(F.avg, div(F.abs("ret"), value), n, w),
            "size": F.log(rolling(F.avg, value, n, w)),
            "voltrend": change(c, w, n) * div(rolling(F.avg, value, n, w), rolling(F.avg, value, long, w)),
            "range": div(top - low, c),
            "tstrend": div(F.signum(change(c, w, n)), sd),
            "strev": change(c, w, 1) * div(rolling(F.avg, value, long, w), value),
            "eligible_value": F.when(F.count(value).over(w.rowsBetween(-long + 1, 0)) >= long * 3 // 4, F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-long + 1, 0))),
        }
    )
    one = one.withColumn("residual", F.col("ret") - F.col("bab") * F.col("mkt"))
    e = F.col("residual")
    return one.withColumns({"idiovol": rolling(F.stddev_samp, e, n, w), "resmom": div(rolling(F.sum, e, n, w), rolling(F.stddev_samp, e, n, w))}).drop("residual")


def z_by_time(x: str, time: str = "bar") -> Column:
    """The score against all symbols of its time; null without variation."""
    t = W.partitionBy(time)
    return div(F.col(x) - F.avg(x).over(t), F.stddev_samp(x).over(t))


def composite(rows: DataFrame, parts: dict[str, int], time: str = "bar") -> Column:
    """The mean of the parts' z-scores, each with its sign; null if a part is."""
    return sum((sign * z_by_time(p, time) for p, sign in parts.items()), F.lit(0.0)) / len(parts)


def net_portfolio(rows: DataFrame, score: str, every: int, fee: float, time: str = "bar") -> DataFrame:
    """time, gross, cost, net: top third long and bottom third short, half the capital each, rebalanced every ``every``
    times; a bar earns what was held the bar before. rows: symbol, time, ret and the score (null: not held)."""
    t = W.partitionBy(time)
    ranked = rows.withColumns({"_r": F.rank().over(t.orderBy(F.col(score).asc_nulls_last())), "_of": F.count(score).over(t)})
    pct = F.when(F.col(score).isNotNull(), F.col("_r") / F.col("_of"))
    ranked = ranked.withColumns({"_hi": (F.coalesce(pct, F.lit(0.5)) > 2 / 3).cast("int"), "_lo": (F.coalesce(pct, F.lit(0.5)) <= 1 / 3).cast("int")})
    weight = 0.5 * F.coalesce(div(F.col("_hi").cast("double"), F.sum("_hi").over(t)), F.lit(0.0)) - 0.5 * F.coalesce(div(F.col("_lo").cast("double"), F.sum("_lo").over(t)), F.lit(0.0))
    w = W.partitionBy("symbol").orderBy(time)
    ranked = ranked.withColumn("_w", F.when(F.col(time) % every == 0, weight))
    ranked = ranked.withColumn("_held", F.coalesce(F.last("_w", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("_moved", F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0.0))))
    out = ranked.groupBy(time).agg(F.sum(F.col("_held") * F.coalesce("ret", F.lit(0.0))).alias("gross"), (fee * F.sum("_moved")).alias("cost"))
    return out.withColumn("net", F.col("gross") - F.col("cost"))
