"""Target weights: cleaning and causal transforms of a position column, as expressions over a window per symbol or per time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from .windows import div


def clean(weight: Column) -> Column:
    """Null and NaN as 0, clipped to [-1, 1]."""
    w = F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))


def sign(weight: Column) -> Column:
    return F.signum(clean(weight)).cast("int")


def mode(rows: DataFrame, weight: str) -> DataFrame:
    """One row: ``weight`` if all values are within [-1, 1] and some is no whole number, else ``sign``."""
    c = F.coalesce(F.col(weight), F.lit(0.0))
    inside, broken = F.bool_and(F.abs(c) <= 1), F.bool_or(c != F.rint(c))
    return rows.agg(F.when(inside & broken, "weight").otherwise("sign").alias("mode"))


def normalised(rows: DataFrame, weight: str, time: str, limit: float = 1.0) -> DataFrame:
    """Weights cleaned and, where the sum of their sizes at one time exceeds ``limit``, scaled down to it: with weight and scaled."""
    rows = rows.withColumn(weight, clean(F.col(weight)))
    gross = F.sum(F.abs(weight)).over(W.partitionBy(time))
    return rows.withColumn("scaled", gross > limit + 1e-12).withColumn(weight, F.col(weight) * F.when(F.col("scaled"), limit / gross).otherwise(1.0))


def delayed(weight: Column, bars: int, w: WindowSpec) -> Column:
    return F.coalesce(F.lag(weight, bars).over(w), F.lit(0.0))


def capped(weight: Column, cap: float) -> Column:
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), weight))


def rebalanced(weight: Column, every: int, offset: int, w: WindowSpec, idx: str = "idx") -> Column:
    """The weight of the last bar whose place is ``offset`` modulo ``every``; 0 before the first."""
    kept = F.when(F.col(idx) % every == offset % every, weight)
    return F.coalesce(F.last(kept, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))


def tranches(weight: Column, every: int, sleeves: int, w: WindowSpec) -> Column:
    """The mean of ``sleeves`` books that each rebalance every ``every`` bars at staggered offsets."""
    return sum((rebalanced(weight, every, j * every // sleeves, w) for j in range(sleeves)), F.lit(0.0)) / sleeves


def hysteresis(rows: DataFrame, z: str, enter: float, leave: float, key: str = "symbol") -> DataFrame:
    """With position: -1 from the first bar that z exceeds ``enter``, 1 from the first below -``enter``, until z is within
    ``leave`` or null. A state that is held is not turned round. Exits number the spells; a spell's first entry counts."""
    w = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    c = F.col(z)
    rows = rows.withColumns({"_out": F.sum((c.isNull() | (F.abs(c) < leave)).cast("int")).over(w), "_in": F.when(c > enter, -1).when(c < -enter, 1)})
    spell = W.partitionBy(key, "_out").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("position", F.coalesce(F.first("_in", True).over(spell), F.lit(0))).drop("_out", "_in")


def cadence(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """key, every: the commonest gap between changes of the weight if it is 2 or more and half of all gaps; six changes at least.
    Ties go to the shorter gap."""
    w = W.partitionBy(key).orderBy("idx")
    moved = rows.withColumn("_old", F.lag(weight).over(w)).where(F.col("_old").isNotNull() & (F.col("_old") != F.col(weight)))
    gaps = moved.select(key, (F.col("idx") - F.lag("idx").over(w)).alias("gap"))
    counts = gaps.groupBy(key, "gap").agg(F.count(F.lit(1)).alias("n"))
    best = counts.where("gap IS NOT NULL").groupBy(key).agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("every"), F.max("n").alias("_n"), F.sum("n").alias("_of"))
    return best.where((F.col("_of") >= 5) & (F.col("every") >= 2) & (F.col("_n") >= 0.5 * F.col("_of"))).select(key, "every")


def membership(rows: DataFrame, key: str, inside: Column) -> DataFrame:
    """key, start, end (idx): the runs of bars where ``inside``; a new run starts after a bar outside or a gap."""
    w = W.partitionBy(key).orderBy("idx")
    rows = rows.where(inside).withColumn("_g", F.col("idx") - F.row_number().over(w))
    return rows.groupBy(key, "_g").agg(F.min("idx").alias("start"), F.max("idx").alias("end")).drop("_g")


def turnover(weight: Column, w: WindowSpec) -> Column:
    return F.abs(weight - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))


def risk_parity(sd: Column, time: str) -> Column:
    """Weights in inverse proportion to the deviations, summing to 1 at each time; null where a deviation is null or zero."""
    inverse = div(F.lit(1.0), sd)
    return inverse / F.sum(inverse).over(W.partitionBy(time))


def vol_target(weight: Column, sd: Column, target: float, most: float = 1.0) -> Column:
    return weight * F.least(F.lit(most), div(F.lit(target), sd))
