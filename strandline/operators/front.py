"""The front door: a strategy, a score or a live record in, evidence rows, a verdict and a certificate out; and the small checks they are made of."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal
from ..functions.draws import gaussian, hashed
from ..functions.windows import div, quotient
from . import evidence, resample, robust, stats

#: The hurdle of a mean's t that many tried factors ask for, and below it the t of a single one.
HURDLE, SINGLE = 3.0, 2.0
_NORMAL = NormalDist()


def track_record(moments: DataFrame, confidence: float = 0.95, hurdle: float = 0.0) -> DataFrame:
    """``moments`` (n, sharpe, skew, kurt a row) with needed: rows until the ratio beats ``hurdle`` with this confidence; null if it does not."""
    z, s = _NORMAL.inv_cdf(confidence), F.col("sharpe")
    spread = F.greatest(1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s, F.lit(1e-12))
    return moments.withColumn("needed", F.when(s > hurdle, F.ceil(F.round(1 + spread * F.pow(z / (s - hurdle), 2), 6))))


def least_detectable(trials: Column, n: Column, periods: float, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The annual ratio that a search of so many trials can tell from luck on ``n`` rows (Bonferroni). trials: a SQL-named column."""
    return (-normal.ppf(f"({alpha}e0 / {trials})") + _NORMAL.inv_cdf(power)) / F.sqrt(n) * periods**0.5


def least_years(sharpe: Column, trials: Column) -> Column:
    """Years after which the best of so many lucky trials no longer reaches this annual ratio."""
    return F.when(sharpe > 0, 2 * F.log(trials) / (sharpe * sharpe))


def hurdle_status(t: Column) -> Column:
    return F.when(t.isNull() | (t < SINGLE), "info").when(t < HURDLE, "warn").otherwise("pass")


def strategy_checks(rets: DataFrame, bars: DataFrame, keys: list[str], x: str = "ret", cost: float = 0.0005) -> DataFrame:
    """keys, id, category, status, value of a strategy's returns and the bars it traded. rets: keys, idx, x, t (the target held into the row)."""
    w = W.partitionBy(*keys).orderBy("idx")
    bad = bars.groupBy(*keys).agg(F.sum(((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)).cast("long")).alias("bad"))
    one = stats.moments(rets, keys, x)
    rows = rets.where(F.col(x).isNotNull()).withColumn("_half", F.ntile(2).over(w)).withColumn("_e", F.sum(F.log1p(x)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_dd", 1 - F.exp(F.col("_e") - F.greatest(F.lit(0.0), F.max("_e").over(w.rowsBetween(W.unboundedPreceding, 0)))))
    rows = rows.withColumn("_traded", F.abs(F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0))))
    more = rows.groupBy(*keys).agg(
        F.max("_dd").alias("dd"), F.sum(x).alias("total"), F.sum("_traded").alias("traded"), *[F.avg(F.when(F.col("_half") == k, F.col(x))).alias(f"half{k}") for k in (1, 2)],
    )
    one = track_record(one).join(more, keys).join(bad, keys).join(stats.newey_west(rets, keys, x).select(*keys, F.col("t").alias("nw")), keys)
    r9 = lambda c: F.round(c, 9)
    net, t, gap = r9(F.col("total") - cost * F.col("traded")), r9(F.col("nw")), r9(F.least("half1", "half2"))
    dd, need = r9(F.col("dd")), F.col("n") / F.col("needed")
    checks = [
        evidence.check("prices_hold", "integrity", F.col("bad"), F.col("bad") > 0),
        evidence.check("net_of_costs", "economics", net, net <= -0.5, net <= 0),
        evidence.check("drawdown", "economics", dd, dd > 0.9, dd > 0.3),
        evidence.check("mean_hurdle", "statistics", t, t < 0, t < HURDLE),
        evidence.check("track_record", "statistics", r9(need), warn=need < 1),
        evidence.check("both_halves", "statistics", gap, warn=gap <= 0),
    ]
    return evidence.rows(one, keys, checks)


def rechecked(stored: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status of stored certificates (keys, verdict, certificate) against checks run again: match, verdict, content or missing."""
    now = evidence.certificates(checks, keys).select(*keys, F.col("verdict").alias("_v"), F.col("certificate").alias("_c"))
    rows = stored.join(now, keys, "left")
    status = F.when(F.col("_c").isNull(), "missing").when(F.col("verdict") != F.col("_v"), "verdict").when(F.col("certificate") != F.col("_c"), "content").otherwise("match")
    return rows.select(*keys, status.alias("status"))


def alpha_checks(panel: DataFrame, ic: DataFrame, score: str, q: int, cost: float, periods: float) -> DataFrame:
    """id, category, status, value of a score: panel (symbol, bar, score, ret), ic (bar, ic)."""
    mean = ic.agg(F.avg("ic").alias("ic"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic"))).alias("ic_t"))
    net = robust.net_spread(panel, score, q, cost)
    whole = net.agg(robust.ratio("net", periods).alias("sharpe"))
    paths = robust.purged_paths(net, 6, 1, periods).agg(F.avg((F.round("sharpe", 9) > 0).cast("double")).alias("paths"))
    parts = robust.subset_spreads(panel, score, q, cost, 0.7, 100).groupBy("rep").agg(F.avg("net").alias("m"))
    parts = parts.agg(F.avg((F.round("m", 12) > 0).cast("double")).alias("subsets"))
    one = mean.crossJoin(whole).crossJoin(paths).crossJoin(parts).withColumn("score", F.lit(score))  # one row each
    c = {k: F.round(k, 6) for k in ("ic", "ic_t", "sharpe", "paths", "subsets")}
    checks = [
        evidence.check("mean_ic", "statistics", c["ic"], warn=F.abs(c["ic"]) < 0.01), evidence.check("ic_significance", "statistics", c["ic_t"], F.abs(c["ic_t"]) < 1, F.abs(c["ic_t"]) < SINGLE),
        evidence.check("net_sharpe", "economics", c["sharpe"], c["sharpe"] < -1, c["sharpe"] <= 0), evidence.check("purged_paths", "statistics", c["paths"], warn=c["paths"] < 0.6),
        evidence.check("subsets", "statistics", c["subsets"], c["subsets"] < 0.5, c["subsets"] < 0.8),
    ]
    return evidence.rows(one, ["score"], checks)


def live_against(test: DataFrame, live: DataFrame, keys: list[str], time: str, periods: float, x: str = "ret") -> DataFrame:
    """keys, n, corr, tracking (annual deviation of the difference), gap (annual mean difference), on the times that both have."""
    rows = test.select(*keys, time, F.col(x).alias("_a")).join(live.select(*keys, time, F.col(x).alias("_b")), [*keys, time])
    gap = F.col("_b") - F.col("_a")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("corr"), (F.stddev_samp(gap) * periods**0.5).alias("tracking"), (F.avg(gap) * periods).alias("gap"))


def portfolio_risk(rows: DataFrame, name: str, time: str, x: str) -> DataFrame:
    """name, share (of the variance of the equally weighted book), bets (effective number, by entropy of the shares)."""
    book = rows.groupBy(time).agg(F.avg(x).alias("_b"), F.count(F.lit(1)).alias("_k"))
    names = F.count(F.lit(1)).over(W.partitionBy())  # a row a name, after the aggregation
    one = rows.join(book, time).groupBy(name).agg(F.covar_samp(x, "_b").alias("_c")).withColumn("_n", names)
    one = one.withColumn("share", F.col("_c") / F.sum("_c").over(W.partitionBy()))
    p = F.greatest(F.col("share"), F.lit(1e-12))
    one = one.withColumn("_p", p / F.sum(p).over(W.partitionBy()))
    return one.select(name, "share", F.exp(-F.sum(F.col("_p") * F.log("_p")).over(W.partitionBy())).alias("bets"))


def drawdown_draws(moments: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """keys, rep, dd: the greatest drawdown of ``n`` paths of normal returns with the keys' length (n), mean and sd."""
    paths = resample.replicates(moments.select(*keys, "n", "mean", "sd"), n).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    paths = gaussian(paths, "_z", seed, F.col("rep"), *[F.col(k) for k in keys], F.col("idx"))
    w = W.partitionBy(*keys, "rep").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    paths = paths.withColumn("_e", F.sum(F.log1p(F.col("mean") + F.col("sd") * F.col("_z"))).over(w))
    paths = paths.withColumn("_d", 1 - F.exp(F.col("_e") - F.greatest(F.lit(0.0), F.max("_e").over(w))))
    return paths.groupBy(*keys, "rep").agg(F.max("_d").alias("dd"))


def holdings(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, bars, exposure (share of bars held), long_share, runs, median_hold: what positions tell of a strategy's habits."""
    w = W.partitionBy(*keys).orderBy("idx")
    side = F.signum(position)
    d = rows.withColumn("_s", side).withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0.0))).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.where("_s <> 0").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("len")).groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.median("len").alias("median_hold"))
    one = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.avg((F.col("_s") != 0).cast("double")).alias("exposure"), div(F.sum(F.greatest(F.col(position), F.lit(0))), F.sum(F.abs(position))).alias("long_share")
    )
    return one.join(runs, keys, "left")


def mirrored(bars: DataFrame, at: int) -> DataFrame:
    """The bars with all prices after bar ``at`` turned over: each is the square of the close at ``at`` over itself, so every rise
    becomes the fall of the same size and what is known at ``at`` stays. A price of zero turns into an infinite one."""
    pivot = F.max(F.when(F.col("idx") == at, F.col("close"))).over(W.partitionBy("symbol"))
    d = bars.withColumn("_c", pivot)
    flip = lambda c: F.when(F.col("idx") > at, quotient(F.col("_c") * F.col("_c"), F.col(c))).otherwise(F.col(c))
    return d.select(*[{"open": flip("open"), "close": flip("close"), "high": F.when(F.col("idx") > at, flip("low")).otherwise(F.col("high")), "low": F.when(F.col("idx") > at, flip("high")).otherwise(F.col("low"))}.get(c, F.col(c)).alias(c) for c in bars.columns])


def foreign(bars: DataFrame, seed: int = 1) -> DataFrame:
    """symbol, idx, close: an independent walk with the bars' own length, start and volatility, for signals that should know nothing of it."""
    w = W.partitionBy("symbol")
    o = w.orderBy("idx")
    d = bars.select("symbol", "idx", "close").withColumn("_r", F.log(F.col("close") / F.lag("close").over(o)))
    d = gaussian(d.withColumns({"_sd": F.stddev_samp("_r").over(w), "_s": F.first("close").over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}), "_z", seed, F.col("symbol"), F.col("idx"))
    step = F.when(F.col("idx") > 0, F.col("_sd") * F.col("_z")).otherwise(0.0)
    return d.withColumn("_l", step).select("symbol", "idx", (F.col("_s") * F.exp(F.sum("_l").over(o.rowsBetween(W.unboundedPreceding, 0)))).alias("close"))


def significance(rows: DataFrame, keys: list[str], feature: str, label: str, n: int, seed: int = 1) -> DataFrame:
    """keys, ic, p: correlation of a feature with its label, against ``n`` circular shifts of the label. rows: keys, idx from 0 without holes."""
    d = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    draws = resample.replicates(d.select(*keys, "_n").distinct(), n).withColumn("_k", 1 + F.pmod(hashed(seed, F.col("rep"), *[F.col(k) for k in keys]), F.col("_n") - 1)).drop("_n")
    moved = d.join(draws, keys).select(*keys, "rep", F.col(feature).alias("_f"), F.pmod(F.col("idx") - F.col("_k"), F.col("_n")).alias("_at"))
    null = moved.join(rows.select(*keys, F.col("idx").alias("_at"), F.col(label).alias("_l")), [*keys, "_at"]).groupBy(*keys, "rep").agg(F.corr("_f", "_l").alias("_c"))
    seen = rows.groupBy(*keys).agg(F.corr(feature, label).alias("ic"))
    hit = F.round(F.abs("_c"), 9) >= F.round(F.abs("ic"), 9)
    return null.join(seen, keys).groupBy(*keys, "ic").agg(((1 + F.sum(hit.cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))


def splits(rows: DataFrame, keys: list[str], discovery: float, validation: float) -> DataFrame:
    """``rows`` with part: discovery, validation or holdout, by the share of the key's history that lies before."""
    w = W.partitionBy(*keys)
    at = (F.row_number().over(w.orderBy("idx")) - 1) / F.count(F.lit(1)).over(w)
    return rows.withColumn("_at", at).withColumn("part", F.when(F.col("_at") < discovery, "discovery").when(F.col("_at") < discovery + validation, "validation").otherwise("holdout")).drop("_at")


def ended(rows: DataFrame, key: str, time: str) -> DataFrame:
    """key, first, last, missing: names that stop before the last time of all, and how many of its times they miss."""
    ends = rows.agg(F.max(time).alias("_end"))
    one = rows.groupBy(key).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return one.crossJoin(ends).where(F.col("last") < F.col("_end")).select(key, "first", "last", (F.col("_end") - F.col("last")).alias("missing"))  # one row


def terminal(rows: DataFrame, key: str, time: str, price: str, back: float) -> DataFrame:
    """``rows`` (key, time, price) and, for names that stop early, a last price of 1 + ``back`` of their last at the next time."""
    gone = ended(rows, key, time).select(key, F.col("last").alias(time))
    last = rows.join(gone, [key, time]).select(key, (F.col(time) + 1).alias(time), (F.col(price) * (1 + back)).alias(price))
    return rows.select(key, time, price).unionByName(last)
