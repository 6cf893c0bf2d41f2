"""Expression search: generations of trees scored together on a market and on markets that have nothing to find.

A null market is the market's own bars with its moves in another order (hashes decide it, so it is the same on every cluster). Real and null
markets are rows of one table, and a generation is one plan over all of them: every different subtree is a column made once, every
candidate's trades come out of one sweep. A candidate is named only if it beats the best that the same search finds on all null markets.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dsl
from ..functions.windows import by, div, ln
from . import backtest, resample

#: Lengths of the mean that a candidate is held against, by turns.
RULES = (5, 10, 20)


def markets(bars: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """symbol, market, idx, open, high, low, close: the bars as market 0, and ``n`` markets of their moves dealt anew.

    A bar's move, and how far it reached beyond open and close, stay together; a low of zero stays one."""
    own = bars.select("symbol", F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    moves = own.withColumns({
        "r": ln(div(F.col("close"), F.lag("close").over(by()))), "u": ln(div(F.col("high"), F.greatest("open", "close"))), "d": ln(div(F.col("low"), F.least("open", "close"))),
        "_c": F.first("close").over(W.partitionBy("symbol").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    }).where("idx > 0")
    dealt = resample.permuted(moves.select("symbol", (F.col("idx") - 1).alias("idx"), "r", "u", "d", "_c"), ["symbol"], n, seed)
    w = W.partitionBy("symbol", "rep").orderBy("idx")
    made = dealt.withColumn("close", F.col("_c") * F.exp(F.sum("r").over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("_c")))
    made = made.withColumns({"high": F.greatest("open", "close") * F.exp(F.coalesce("u", F.lit(0.0))), "low": F.least("open", "close") * F.exp(F.coalesce("d", F.lit(0.0)))})
    cols = ["symbol", "market", "idx", "open", "high", "low", "close"]
    return own.withColumn("market", F.lit(0)).select(cols).unionByName(made.withColumns({"market": (F.col("rep") + 1).cast("int"), "idx": F.col("idx") + 1}).select(cols))


def candidates(trees: list[dsl.Tree]) -> list[tuple[dsl.Tree, dsl.Tree]]:
    """Each tree beside its own mean, of lengths by turns: the rule is to be long above it."""
    return [(t, ("sma", t, RULES[k % len(RULES)])) for k, t in enumerate(trees)]


def scored(rows: DataFrame, trees: list[dsl.Tree], least: int = 10, fee: float = 0.0005, slippage: float = 0.0005) -> DataFrame:
    """market, candidate (place in ``trees``), n_trades, score: the t value of the log factors of a candidate's trades over all symbols of a market.

    Fewer than ``least`` trades, or a ruinous one, give no score."""
    pairs = candidates(trees)
    made, names = dsl.evaluate_all(rows.withColumn("series", F.concat_ws("|", "symbol", "market")), [t for p in pairs for t in p], ["series"])
    above = lambda a, b: F.when(F.round(F.col(names[dsl.key(a)]) - F.col(names[dsl.key(b)]), 6) > 0, 1).otherwise(0)
    targets = [((k,), above(*p)) for k, p in enumerate(pairs)]
    trades = backtest.sweep(made.select("series", "idx", "open", "close", *{n: None for n in names.values()}), "series", ["candidate"], targets, fee, slippage)
    trades = trades.withColumn("market", F.split("series", r"\|")[1].cast("int")).withColumn("_l", F.log(F.when(F.col("factor") > 0, F.col("factor"))))
    one = trades.groupBy("market", "candidate").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("_l").alias("_m"), F.stddev_samp("_l").alias("_s"), F.count("_l").alias("_k"))
    fine = (F.col("n_trades") >= least) & (F.col("_k") == F.col("n_trades")) & (F.col("_s") > 1e-12)
    return one.select("market", "candidate", "n_trades", F.when(fine, F.col("_m") / F.col("_s") * F.sqrt("n_trades")).alias("score"))


def named(scores: DataFrame) -> DataFrame:
    """candidate, n_trades, score, hurdle (the best score of each null market, and the greatest of these), p, named: of the real market's candidates."""
    best = scores.where("market > 0").groupBy("market").agg(F.max("score").alias("_b"))
    hurdle = best.agg(F.max("_b").alias("hurdle"), F.collect_list(F.round("_b", 9)).alias("_all"))  # a value a null market
    real = scores.where("market = 0").crossJoin(hurdle)  # one row
    beaten = F.size(F.filter("_all", lambda b: b >= F.round(F.col("score"), 9)))
    p = (1 + beaten) / (1 + F.size("_all"))
    return real.select("candidate", "n_trades", "score", "hurdle", F.when(F.col("score").isNotNull(), p).alias("p"), F.coalesce(F.round("score", 9) > F.round("hurdle", 9), F.lit(False)).alias("named"))


def evolve(bars: DataFrame, seed: int, size: int, rounds: int, n_null: int, keep: int = 4, deepest: int = 3) -> tuple[DataFrame, list[dsl.Tree]]:
    """The named table of all trees that a search has looked at, and the trees: the best ``keep`` of each generation on the real market are changed into the next.

    What comes to the driver in a round is ``keep`` numbers. The null markets search through the same trees, so looking more raises the hurdle."""
    rng = random.Random(seed)
    seen = {dsl.key(t): t for t in dsl.generation(seed, size, deepest)}
    front = list(seen.values())
    for _ in range(rounds):
        best = scored(markets(bars, 0, seed), front).where("market = 0 AND score IS NOT NULL").orderBy(F.desc("score"), "candidate").limit(keep).collect()
        parents = [front[r["candidate"]] for r in best] or front[:keep]
        made = {}
        for k in range(20 * size):
            t = dsl.mutate(rng, parents[k % len(parents)], deepest)
            if dsl.key(t) not in seen and len(made) < size:
                made[dsl.key(t)] = t
        if not made:
            break
        seen |= made
        front = list(made.values())
    trees = list(seen.values())
    return named(scored(markets(bars, n_null, seed), trees)), trees
