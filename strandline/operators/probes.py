"""Look-ahead probes of a signal function: it must say the same about a bar whatever comes after it.

A signal is a kernel of one symbol's columns (arrays by name, in time order) that returns an array. Each checkpoint is a
group of its own: the rows up to it (or with the rows after it rewritten), so all probes of all symbols run as one grouped
map. Checkpoints are few and fixed, so a symbol is replicated that many times at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import recursive, draws
from ..functions.windows import by, div
from . import causality

Signal = Callable[[dict[str, np.ndarray]], np.ndarray]
PRICES = ("open", "high", "low", "close")


def positions(bars: DataFrame, signal: Signal, keys: list[str], name: str = "position") -> DataFrame:
    """keys, idx, position."""
    cols = [c for c in (*PRICES, "volume") if c in bars.columns]
    made = recursive.per_group(bars.select(*keys, "idx", *cols), keys, "idx", lambda c: {name: np.asarray(signal(c), float)}, {name: "double"})
    return made.select(*keys, "idx", F.coalesce(name, F.lit(0.0)).alias(name))


def dealt(views: DataFrame, *keys: str) -> DataFrame:
    """``views`` with each on its own among the tasks: a copy of a symbol's bars for each checkpoint is otherwise sorted where the symbol is, all
    of them in one task, as rows by symbol are by symbol and checkpoint too. The number is given: small copies must not be merged again."""
    return views.repartition(int(views.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpoints(bars: DataFrame, full: DataFrame, checks: int) -> DataFrame:
    """symbol, at: even places from a tenth of the bars on, and as many of the bars where the position changes."""
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("lo", F.greatest(F.lit(2), F.floor(F.col("n") / 10))).where("n - 2 > lo")
    even = size.select("symbol", F.explode(F.transform(F.sequence(F.lit(0), F.lit(checks - 1)), lambda i: F.floor(F.col("lo") + i * (F.col("n") - 2 - F.col("lo")) / max(1, checks - 1)).cast("long"))).alias("at"))
    moved = full.withColumn("_old", F.lag("position").over(by())).where("_old <> position").join(size, "symbol").where("idx >= lo AND idx <= n - 2")
    w = W.partitionBy("symbol")
    moved = moved.withColumns({"_k": F.row_number().over(w.orderBy("idx")) - 1, "_of": F.count(F.lit(1)).over(w)}).withColumn("_step", F.greatest(F.lit(1), F.ceil(F.col("_of") / checks)))
    return even.unionByName(moved.where("_k % _step = 0").select("symbol", F.col("idx").cast("long").alias("at"))).distinct()


def _compare(views: DataFrame, full: DataFrame, signal: Signal, points: DataFrame) -> DataFrame:
    seen = positions(views, signal, ["symbol", "at"], "seen").where("idx <= at")
    both = seen.join(full, ["symbol", "idx"])
    differs = F.col("seen") != F.col("position")
    found = both.groupBy("symbol", "at").agg(F.sum(differs.cast("long")).alias("changed"), F.min(F.when(differs, F.col("idx"))).alias("first"))
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("checkpoints"), F.sum((F.col("changed") > 0).cast("long")).alias("mismatches"), F.min("first").alias("first_bar")).withColumn(
        "status", F.when(F.col("mismatches") > 0, "fail").otherwise("pass")
    )


def truncation(bars: DataFrame, signal: Signal, checks: int = 8) -> DataFrame:
    """symbol, checkpoints, mismatches, first_bar, status: signals on prefixes against the whole."""
    full = positions(bars, signal, ["symbol"])
    points = checkpoints(bars, full, checks)
    return _compare(dealt(bars.join(points, "symbol").where("idx <= at"), "symbol", "at"), full, signal, points)


def perturbation(bars: DataFrame, signal: Signal, checks: int = 8) -> DataFrame:
    """The same with the future mirrored: prices after a checkpoint are scaled by the square of its close over theirs."""
    full = positions(bars, signal, ["symbol"])
    points = checkpoints(bars, full, checks)
    at = dealt(bars.join(points, "symbol"), "symbol", "at").withColumn("_c", F.max(F.when(F.col("idx") == F.col("at"), F.col("close"))).over(W.partitionBy("symbol", "at")))
    ratio = div(F.col("_c"), F.col("close"))
    factor = F.when(F.col("idx") > F.col("at"), ratio * ratio).otherwise(1.0)
    views = at.withColumn("_f", factor).withColumns({c: F.col(c) * F.col("_f") for c in PRICES if c in bars.columns}).drop("_f", "_c")
    return _compare(views, full, signal, points)


def determinism(bars: DataFrame, signal: Signal) -> DataFrame:
    """symbol, differing: bars on which two runs disagree."""
    a, b = positions(bars, signal, ["symbol"]), positions(bars, signal, ["symbol"], "again")
    return a.join(b, ["symbol", "idx"]).groupBy("symbol").agg(F.sum((F.col("position") != F.col("again")).cast("long")).alias("differing"))


def stored_answer(bars: DataFrame, signal: Signal, seed: int = 1) -> DataFrame:
    """symbol, same, status: the share of bars with the same position on an unrelated market; a stored answer does not read prices."""
    own = positions(bars, signal, ["symbol"])
    w = by()
    sd = F.coalesce(F.stddev_samp("_r").over(W.partitionBy("symbol")), F.lit(0.01))
    other = bars.withColumn("_r", F.log(div(F.col("close"), F.lag("close").over(w)))).withColumn("_sd", sd)
    other = draws.gaussian(other, "_z", seed, F.col("symbol"), F.col("idx"))
    walk = 100 * F.exp(F.sum(F.least(F.col("_sd"), F.lit(0.05)) * F.col("_z")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    other = other.withColumn("_p", walk).withColumns({c: F.col("_p") for c in PRICES if c in bars.columns})
    both = own.join(positions(other, signal, ["symbol"], "other"), ["symbol", "idx"])
    share = F.avg((F.col("position") == F.col("other")).cast("double"))
    moved = F.countDistinct("position")
    return both.groupBy("symbol").agg(share.alias("same"), moved.alias("_m")).withColumn("status", F.when((F.col("same") >= 0.999) & (F.col("_m") > 1), "fail").otherwise("pass")).drop("_m")


def implausible(rows: DataFrame, position: str) -> DataFrame:
    """symbol, active, hits, rate, z, status: how often a position is right about the next bar. No strategy is right so often."""
    w = by()
    move = F.lead("close").over(w) - F.lead("open").over(w)
    rows = rows.withColumn("_m", move).where((F.col(position) != 0) & (F.col("_m") != 0))
    one = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("active"), F.sum((F.signum(position) == F.signum("_m")).cast("long")).alias("hits"))
    one = one.withColumn("rate", F.col("hits") / F.col("active")).withColumn("z", (F.col("rate") - 0.5) / F.sqrt(0.25 / F.col("active")))
    return one.withColumn("status", F.when((F.col("rate") >= 0.7) & (F.col("z") >= 3.5) & (F.col("active") >= 100), "fail").otherwise("pass"))


def plan_looks_ahead(df: DataFrame, time: tuple[str, ...] = ("idx", "bar", "ts")) -> bool:
    """Whether the plan of ``df`` may tell a row something of later ones (see :mod:`causality` for the rules)."""
    return causality.looks_ahead(df, time)
