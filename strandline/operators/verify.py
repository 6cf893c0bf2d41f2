"""A strategy verified with all that the library has: probes, repainting, prices, delays and costs, returns, and the search it came from.

Each part is a DataFrame of one row a symbol, made on its own and turned into evidence rows (id, category, status, value); the union of
all is what verdicts and certificates are made of. Values are rounded before they are judged, so a certificate does not hang on the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import xsection
from ..functions.windows import div
from ..sources.scratch import saved
from . import alpha, backtest, evidence, front, gram, probes, repaint, resample, search, stats

#: Fills that come later (bars), costs (basis points a fill) that a strategy should live with.
DELAYS, COSTS = (1, 2, 3, 5), (0, 20)


def _rows(one: DataFrame, *checks: Column) -> DataFrame:
    return evidence.rows(one, ["symbol"], list(checks))


def lookahead(bars: DataFrame, signal: probes.Signal, checks: int = 8) -> DataFrame:
    """Prefixes, mirrored futures, two runs, an unrelated market, and repainting over history."""
    check = evidence.check
    cut, mirrored = probes.truncation(bars, signal, checks), probes.perturbation(bars, signal, checks)
    parts = [
        _rows(cut, check("prefixes", "lookahead", F.col("mismatches"), F.col("mismatches") > 0)),
        _rows(mirrored, check("mirrored_future", "lookahead", F.col("mismatches"), F.col("mismatches") > 0)),
        _rows(probes.determinism(bars, signal), check("two_runs", "lookahead", F.col("differing"), F.col("differing") > 0)),
        _rows(probes.stored_answer(bars, signal), check("stored_answer", "lookahead", F.round("same", 6), F.col("status") == "fail")),
        _rows(repaint.repaint_history(bars, signal), check("repainting", "lookahead", F.round("repaint_rate", 6), F.col("status") == "fail")),
    ]
    return _union(parts)


def execution(bars: DataFrame, target: str, periods: float) -> DataFrame:
    """Later fills, costs, and the habits of the trades. bars: symbol, idx, open, close and the target."""
    check = evidence.check
    logs = lambda name, **how: backtest.totals(backtest.trades(bars, target, ["symbol"], **how), ["symbol"]).select("symbol", F.round("log_return", 6).alias(name), F.col("n_ruined").alias(f"ruined_{name}"), F.col("n_trades").alias(f"n_{name}"))
    late = None
    for k in DELAYS:
        one = logs(f"d{k}", delay=k)
        late = one if late is None else late.join(one, "symbol", "left")
    later = F.greatest(*[F.coalesce(F.col(f"d{k}"), F.lit(0.0)) for k in DELAYS[1:]])
    costs = None
    for bps in COSTS:
        one = logs(f"c{bps}", fee=bps / 1e4, slippage=0.0)
        costs = one if costs is None else costs.join(one, "symbol", "left")
    high = f"c{COSTS[-1]}"
    return _union([
        _rows(late, check("needs_the_next_fill", "economics", later, (F.col("d1") > 0) & (later <= 0), F.col("d1") <= 0), check("trades", "statistics", F.col("n_d1"), F.col("n_d1") < 1, F.col("n_d1") < 30)),
        _rows(costs, check("lives_with_costs", "economics", F.col(high), (F.col(f"ruined_{high}") > 0) | ((F.col("c0") > 0) & (F.col(high) <= 0)), F.col(high) <= 0)),
    ])


def returns(rets: DataFrame, periods: float, n: int = 1000) -> DataFrame:
    """Probabilistic ratio, bootstrap interval, both halves out of each other's sight. rets: symbol, idx from 0 without holes, ret."""
    check = evidence.check
    psr = stats.probabilistic_sharpe(rets, ["symbol"]).withColumn("v", F.round("psr", 6))
    boot = resample.bootstrap_interval(rets, ["symbol"], n, periods, "ret").select("symbol", F.round("sharpe_low", 4).alias("low"), F.round("sharpe_high", 4).alias("high"))
    w = W.partitionBy("symbol").orderBy("idx")
    half = rets.withColumn("_h", F.ntile(2).over(w))
    ratio = lambda k: F.round(div(F.avg(F.when(F.col("_h") == k, F.col("ret"))), F.stddev_samp(F.when(F.col("_h") == k, F.col("ret")))) * periods**0.5, 5)
    halves = half.groupBy("symbol").agg(ratio(1).alias("first"), ratio(2).alias("second"))
    return _union([
        _rows(psr, check("probabilistic_ratio", "statistics", F.col("v"), F.col("v") < 0.5, F.col("v") < 0.95)),
        _rows(boot, check("bootstrap_interval", "statistics", F.col("low"), F.col("high") < 0, F.col("low") <= 0)),
        _rows(halves, check("second_half", "statistics", F.col("second"), warn=(F.col("first") > 0) & (F.col("second") < 0.5 * F.col("first")))),
    ])


def searched(trials: DataFrame, n: int = 1000) -> DataFrame:
    """Whether the best of the trials is more than luck. trials: symbol, trial, idx from 0, ret."""
    check = evidence.check
    dsr = stats.deflated_sharpe(stats.moments(trials, ["symbol", "trial"]), ["symbol"]).withColumn("v", F.round("dsr", 6))
    pbo = search.overfitting(trials, ["symbol"], "trial").withColumn("v", F.round("pbo", 6))
    spa = search.reality_check(trials, ["symbol"], "trial", n).withColumn("v", F.round("p_spa", 6))
    return _union([
        _rows(dsr, check("deflated_ratio", "statistics", F.col("v"), F.col("v") < 0.5, F.col("v") < 0.95)),
        _rows(pbo, check("overfitting", "statistics", F.col("v"), F.col("v") > 0.5, F.col("v") > 0.2)),
        _rows(spa, check("better_than_cash", "statistics", F.col("v"), F.col("v") > 0.5, F.col("v") > 0.1)),
    ])


def strategy(bars: DataFrame, signal: probes.Signal, rets: DataFrame, trials: DataFrame | None = None, periods: float = 8760.0, n: int = 1000) -> DataFrame:
    """symbol, id, category, status, value of everything above and of :func:`front.strategy_checks`.

    bars: symbol, idx, open, high, low, close and t, the target that ``signal`` gives; rets: symbol, idx, ret and t; trials: the search that found it, if
    there was one."""
    numbered = rets.where(F.col("ret").isNotNull()).withColumn("idx", F.row_number().over(W.partitionBy("symbol").orderBy("idx")) - 1)
    parts = [lookahead(bars, signal), front.strategy_checks(rets, bars, ["symbol"]), execution(bars, "t", periods), returns(numbered, periods, n)]
    return _union(parts + ([] if trials is None else [searched(trials, n)]))


def score(panel: DataFrame, name: str, forward: str, book: DataFrame, ret: str, factors: list[str], q: int = 5, cost: float = 0.001, periods: float = 12.0, draws: int = 200) -> DataFrame:
    """score, id, category, status, value: a score verified with all that applies to one, beside :func:`front.alpha_checks`: a placebo, its buckets and
    legs, and what its book's returns owe to known factors and to falling markets.

    panel: symbol, bar, the score and its forward return, better written than planned, as every check reads it; book: bar, the book's return ``ret``, market and the ``factors``."""
    check = evidence.check
    ics = saved(xsection.rank_ic(panel, name, forward), "ics")  # a row a date
    parts = [front.alpha_checks(panel, ics, name, q, cost, periods)]
    subject = lambda df: df.withColumn("score", F.lit(name))

    def rows(one: DataFrame, *checks: Column) -> None:
        parts.append(evidence.rows(subject(one), ["score"], list(checks)))

    r6 = lambda c: F.round(c, 6)
    rows(alpha.placebo(panel, name, forward, draws, ics=ics), check("placebo", "statistics", r6("p"), r6("p") > 0.5, r6("p") > 0.1))
    rows(alpha.monotonicity(alpha.bucket_means(panel, name, forward, q)), check("rising_buckets", "statistics", r6("rising"), warn=r6("rising") < 0.75))
    rows(alpha.leg_shares(panel, name, forward, q), check("short_leg", "economics", r6("short_share"), warn=r6("short_share") > 0.8))
    span = gram.spanning(book, [], ret, factors, periods).withColumn("_g", F.round("gain", 4))
    rows(span, check("spanned_by_factors", "statistics", F.col("_g"), warn=F.col("_g") < gram.LEAST_GAIN))
    const = alpha.ols(book, ret, factors).where("term = 'const'")
    rows(const, check("residual_return", "statistics", r6("t"), r6("t") < 0, r6("t") < front.SINGLE))
    gap = F.round(r6("down") - r6("up"), 5)
    rows(alpha.up_down_beta(book, ret, "market"), check("falls_with_the_market", "statistics", gap, warn=gap > 0.5))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
