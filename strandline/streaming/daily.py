"""A strategy day by day: each batch of new bars is decided once and entered in a journal that a crash, a retry or a replay leaves as it is.

The journal is a table with a folder a batch. A batch's rows are a function of its bars and of the journal before it, its folder is replaced as a whole
and its number comes from the query's checkpoint, so a batch that is run again writes what it wrote. Rows of days that an earlier batch
has are left out, so old input sent again adds nothing. :func:`replay` makes the journal from the bars alone; the two must agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decide = Callable[[DataFrame], DataFrame]


def entered(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The journal (of the batches before one); None if there is none yet."""
    try:
        rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def step(path: str, bars: DataFrame, decide: Decide, keys: tuple[str, ...] = ("symbol", "bar"), since: int | None = None):
    """For ``foreachBatch``: the decisions of ``decide`` for the batch's bars. bars: all that are stored, of which ``decide`` sees those up to
    the batch's last (and at most ``since`` before its first, if it needs no more), so a late run sees what a timely one saw."""

    def take(batch: DataFrame, number: int) -> None:
        spark, time = batch.sparkSession, keys[-1]
        ends = batch.agg(F.min(time).alias("a"), F.max(time).alias("z")).first()
        if ends["a"] is None:
            return
        known = bars.where(F.col(time) <= ends["z"])
        known = known if since is None else known.where(F.col(time) >= ends["a"] - since)
        made = decide(known).join(batch.select(*keys).distinct(), list(keys), "left_semi")
        old = entered(spark, path, number)
        made = made if old is None else made.join(old.select(*keys), list(keys), "left_anti")
        made.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


def catch_up(stream: DataFrame, path: str, checkpoint: str, bars: DataFrame, decide: Decide, keys: tuple[str, ...] = ("symbol", "bar"), since: int | None = None) -> DataFrame:
    """Take all that has arrived, then stop; the journal. A run after a crash begins with the batch that was not confirmed."""
    query = stream.writeStream.foreachBatch(step(path, bars, decide, keys, since)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return entered(stream.sparkSession, path)


def replay(bars: DataFrame, decide: Decide) -> DataFrame:
    """What a journal of these bars must hold, if ``decide`` reads no future."""
    return decide(bars)


def disagreements(journal: DataFrame, bars: DataFrame, decide: Decide, value: str = "position", keys: tuple[str, ...] = ("symbol", "bar")) -> DataFrame:
    """keys, entered, replayed: rows of the journal that a replay gives another value or none."""
    again = replay(bars, decide).select(*keys, F.col(value).alias("replayed"))
    rows = journal.select(*keys, F.col(value).alias("entered")).join(again, list(keys), "left")
    return rows.where(~F.col("entered").eqNullSafe(F.col("replayed")))
