"""Repainting: does what a signal says of a closed bar change as bars arrive?

What is known of a bar is bitemporal: (symbol, idx, known_at, value). All prefixes, the bars with an invented future and the bars
with their last ones restated are views of one table, told apart by a column, so the signal runs once over all of them as one grouped map,
and changes are found by one window along ``known_at``. Prefixes are few (``checks`` and as many where the position changes), so a symbol's
rows are copied so many times at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import gaussian
from ..functions.windows import by, div
from .probes import PRICES, Signal, checkpoints, dealt, positions

#: Bars that a vendor restates at the end, by how much, and the rows that an invented future's volatility is taken from.
REVISED, REVISION, RECENT = 3, 1.001, 256


def extension_length(n: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(50), F.floor(n / 20))).cast("long")


def extended(bars: DataFrame, seed: int = 1) -> DataFrame:
    """The bars and after them a twentieth as many (3 to 50) invented ones: a walk from the last close with the volatility of the last bars."""
    w = W.partitionBy("symbol")
    rows = bars.withColumns({"_r": F.log(div(F.col("close"), F.lag("close").over(by()))), "_n": F.count(F.lit(1)).over(w)})
    last = rows.groupBy("symbol", "_n").agg(F.max_by("close", "idx").alias("_c"), F.stddev_pop(F.when(F.col("idx") > F.col("_n") - RECENT, F.col("_r"))).alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-3)
    more = last.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), extension_length(F.col("_n")) - 1)))
    more = gaussian(more, "_z", seed, F.col("symbol"), F.col("_j"))
    path = W.partitionBy("symbol").orderBy("_j")
    more = more.withColumn("close", F.col("_c") * F.exp(F.sum(sd * F.col("_z")).over(path.rowsBetween(W.unboundedPreceding, 0))))
    more = more.withColumn("open", F.coalesce(F.lag("close").over(path), F.col("_c"))).withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "idx": F.col("_n") + F.col("_j")})
    own = [c for c in ("symbol", "idx", *PRICES) if c in bars.columns]
    return bars.select(own).unionByName(more.select(own))


def revised(bars: DataFrame) -> DataFrame:
    """The bars with the prices of the last few restated."""
    late = F.col("idx") > F.max("idx").over(W.partitionBy("symbol")) - REVISED
    rows = bars.withColumn("_f", F.when(late, REVISION).otherwise(1.0))
    return rows.withColumns({c: F.col(c) * F.col("_f") for c in PRICES if c in bars.columns}).drop("_f")


def history(bars: DataFrame, signal: Signal, checks: int = 12, seed: int = 1) -> DataFrame:
    """symbol, view (prefix, extended, revised), known_at, idx, value: what the signal says of each bar in each view.

    The prefix of the last bar is the whole table; prefixes also end at the two bars before it."""
    own = [c for c in ("symbol", "idx", *PRICES) if c in bars.columns]
    bars = bars.select(own).withColumn("idx", F.col("idx").cast("long"))
    full = positions(bars, signal, ["symbol"])
    ends = bars.groupBy("symbol").agg(F.max("idx").alias("_last"))
    late = ends.select("symbol", F.explode(F.array(F.col("_last") - 2, F.col("_last") - 1, F.col("_last"))).alias("at")).where("at >= 2")
    points = checkpoints(bars, full, checks).unionByName(late).distinct()
    prefixes = bars.join(points, "symbol").where("idx <= at").withColumn("view", F.lit("prefix"))
    last = lambda df, name: df.join(ends, "symbol").select(*own, F.col("_last").alias("at"), F.lit(name).alias("view"))
    views = prefixes.unionByName(last(extended(bars, seed), "extended")).unionByName(last(revised(bars), "revised"))
    return positions(dealt(views, "symbol", "view", "at"), signal, ["symbol", "view", "at"], "value").withColumnRenamed("at", "known_at")


def changes(known: DataFrame) -> DataFrame:
    """symbol, idx, seen_at, known_at, depth: each time what was said of a closed bar is no longer said. known: symbol, known_at, idx, value."""
    w = W.partitionBy("symbol", "idx").orderBy("known_at")
    rows = known.withColumns({"_old": F.lag("value").over(w), "seen_at": F.lag("known_at").over(w)})
    return rows.where("_old <> value").select("symbol", "idx", "seen_at", "known_at", (F.col("seen_at") - F.col("idx")).alias("depth"))


def repaint_history(bars: DataFrame, signal: Signal, checks: int = 12, seed: int = 1) -> DataFrame:
    """symbol, checkpoints, moved_bars, repaint_rate, max_depth, first_bar, extension_changed, revision_changed, status.

    The rate is of the bars that some checkpoint before the last bar has seen. The two other views are compared with the whole table,
    the restated one without its restated bars."""
    known = history(bars, signal, checks, seed)
    prefixes = known.where("view = 'prefix'").drop("view")
    seen = prefixes.groupBy("symbol").agg(F.max("known_at").alias("_last")).join(prefixes.select("symbol", "known_at").distinct(), "symbol")
    seen = seen.where("known_at < _last").groupBy("symbol", "_last").agg(F.count(F.lit(1)).alias("checkpoints"), (F.max("known_at") + 1).alias("_compared"))
    moved = changes(prefixes).groupBy("symbol").agg(F.countDistinct("idx").alias("moved_bars"), F.max("depth").alias("max_depth"), F.min("idx").alias("first_bar"))
    whole = prefixes.join(seen.select("symbol", "_last"), "symbol").where("known_at = _last").select("symbol", "idx", F.col("value").alias("_full"), "_last")
    other = known.where("view <> 'prefix'").join(whole, ["symbol", "idx"]).where(F.col("_full") != F.col("value"))
    other = other.where((F.col("view") == "extended") | (F.col("idx") <= F.col("_last") - REVISED))
    count = lambda v: F.sum((F.col("view") == v).cast("long"))
    other = other.groupBy("symbol").agg(count("extended").alias("extension_changed"), count("revised").alias("revision_changed"))
    out = seen.join(moved, "symbol", "left").join(other, "symbol", "left").fillna(0, ["moved_bars", "max_depth", "extension_changed", "revision_changed"])
    failed = F.col("moved_bars") + F.col("extension_changed") + F.col("revision_changed") > 0
    return out.select(
        "symbol", "checkpoints", "moved_bars", (F.col("moved_bars") / F.col("_compared")).alias("repaint_rate"), "max_depth", "first_bar", "extension_changed", "revision_changed",
        F.when(failed, "fail").otherwise("pass").alias("status"),
    )
