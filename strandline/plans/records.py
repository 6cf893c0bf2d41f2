"""Registered queries on records: a hold-out that opens once, and a journal of days against its replay."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import claims
from ..sources.scratch import shared
from ..streaming import daily
from .base import BARS, WS, full, hourly, query, r
from .stats import RETS, returns

_PROGRAM = "def signal(bars):\n    return bars.close.rolling(5).mean() > bars.close.rolling(20).mean()\n"


@query("sealed_holdout", f"""WITH {RETS}, tm AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT bar FROM rets)), ct AS (SELECT bar AS cut FROM tm WHERE k = CAST(floor(n * 0.8::DOUBLE) AS BIGINT))
SELECT symbol, any_value(cut) AS cut, count(*) AS n, round(sum(ret), 6) + 0 AS total, 'refused' AS again, 'it was opened more than once' AS standing FROM rets, ct WHERE bar >= cut GROUP BY symbol""")
def sealed_holdout(spark, d):
    """The last fifth of all times, sealed for a program and opened twice: evidence of the first look, and what the second does to it."""
    folder, rows = f"{shared(spark)}/sealed-{uuid.uuid4().hex}", returns(spark, d).select("symbol", "bar", F.round("ret", 12).alias("ret"))
    cut = claims.freeze(spark, folder, rows, "bar", _PROGRAM)
    checks = lambda df: df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))
    seen = claims.open_once(spark, folder, rows, _PROGRAM, checks)
    try:
        claims.open_once(spark, folder, rows, _PROGRAM, checks)
        again = "opened"
    except PermissionError:
        again = "refused"
    standing = claims.standing(spark, folder)["reason"]
    return seen.select("symbol", F.lit(int(cut)).cast("long").alias("cut"), "n", r("total").alias("total"), F.lit(again).alias("again"), F.lit(standing).alias("standing"))


@query("daily_journal", f"""WITH {BARS}, x AS (SELECT symbol, bar, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS p FROM b), dy AS (SELECT (bar - (SELECT min(bar) FROM b)) // 24 AS day, x.* FROM x)
SELECT symbol, CAST(day AS BIGINT) AS day, count(*) AS bars, sum(p)::BIGINT AS held, 0::BIGINT AS disagreements FROM dy GROUP BY symbol, day""")
def daily_journal(spark, d):
    """Bars taken by the day, every day twice and the first three once more at the end: each is entered once, and a replay says the same."""
    b = hourly(spark, d).select("symbol", "idx", "bar", "close")
    path = f"{shared(spark)}/days-{uuid.uuid4().hex}"
    b.write.parquet(f"{path}/bars")
    b = spark.read.parquet(f"{path}/bars")
    w = W.partitionBy("symbol").orderBy("bar")
    mean = lambda n: F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) >= n, F.avg("close").over(w.rowsBetween(1 - n, 0)))
    decide = lambda df: df.select("symbol", "bar", F.when(mean(5) > mean(20), 1).otherwise(0).alias("position"))
    first, last = b.agg(F.min("bar"), F.max("bar")).first() or (None, None)
    take = daily.step(f"{path}/journal", b, decide)
    weeks = range(0 if first is None else (last - first) // 168 + 1)
    for number in [*weeks, *weeks[-2:]]:  # a batch a week; the last two are run again under their own numbers
        take(b.where(F.floor((F.col("bar") - first) / 168) == number), number)
    for number in weeks[:3]:
        take(b.where(F.floor((F.col("bar") - first) / 168) == number), len(weeks) + number)
    journal = daily.entered(spark, f"{path}/journal")
    if journal is None:
        return b.select("symbol", F.lit(0).cast("long").alias("day"), *[F.lit(0).cast("long").alias(c) for c in ("bars", "held", "disagreements")])
    wrong = daily.disagreements(journal, b, decide).groupBy("symbol", F.floor((F.col("bar") - first) / 24).alias("day")).agg(F.count(F.lit(1)).alias("disagreements"))
    days = journal.groupBy("symbol", F.floor((F.col("bar") - first) / 24).alias("day")).agg(F.count(F.lit(1)).alias("bars"), F.sum("position").cast("long").alias("held"))
    return days.join(wrong, ["symbol", "day"], "left").withColumn("disagreements", F.coalesce("disagreements", F.lit(0).cast("long")))
