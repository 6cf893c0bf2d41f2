"""Cross-sections: ranks, buckets, legs and correlations of all symbols at one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank_average(x: str, part: list[str]) -> Column:
    """Rank from 1, ties share the mean of their places. Nulls should be filtered before."""
    return F.rank().over(W.partitionBy(*part).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*part, x)) - 1) / 2


def bucket(rank: Column, n: Column, q: int) -> Column:
    """Quantile bucket 0 to q - 1 by average rank (not ntile: ties share a bucket)."""
    return F.least(F.lit(q - 1), F.floor((rank - 1) / n * q)).cast("int")


def correlation(x: str, y: str) -> Column:
    """Pearson by moments inside groupBy; null where one side does not vary."""
    n = F.count(F.col(x) * F.col(y))
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def rank_ic(panel: DataFrame, score: str, forward: str, least: int = 3, part: tuple[str, ...] = ("bar",)) -> DataFrame:
    """part (the date), n, ic: Spearman of score and forward return on each date with ``least`` pairs."""
    rows = panel.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    rows = rows.select(*part, rank_average(score, list(part)).alias("rs"), rank_average(forward, list(part)).alias("rf"))
    return rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), correlation("rs", "rf").alias("ic")).where(F.col("n") >= least)


def legs(panel: DataFrame, score: str, q: int, part: tuple[str, ...] = ("bar",)) -> DataFrame:
    """``panel`` with bucket and weight: equal weights summing to 1 in the top bucket and to -1 in the bottom one of each part."""
    rows = panel.where(F.col(score).isNotNull())
    rows = rows.withColumn("rank", rank_average(score, list(part))).withColumn("of", F.count(F.lit(1)).over(W.partitionBy(*part)))
    rows = rows.withColumn("bucket", bucket(F.col("rank"), F.col("of"), q))
    size = F.count(F.lit(1)).over(W.partitionBy(*part, "bucket"))
    return rows.withColumn("weight", F.when(F.col("bucket") == q - 1, 1 / size).when(F.col("bucket") == 0, -1 / size).otherwise(F.lit(0.0))).drop("rank", "of")


def neutral(weight: str, part: list[str]) -> Column:
    return F.col(weight) - F.avg(weight).over(W.partitionBy(*part))
