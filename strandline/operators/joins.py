"""Point-in-time joins: as-of by union and window (no cross product), intervals by key and range, and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def asof(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True, delay: int = 0) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same key whose time, plus ``delay``, is before
    (``strict``) or not after its own; null where there is none. One shuffle by key and one sort.

    Repeated rows of ``left`` stay; of rows of ``right`` at one time the one with the greatest values counts.
    """
    payload = F.struct(*[F.col(c) for c in values])
    left_side, right_side = (0, 1) if strict else (1, 0)
    cols = left.columns
    a = left.select(*cols, F.col(left_time).alias("_t"), F.lit(left_side).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    b = right.select(
        *[F.col(c) if c in key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols],
        (F.col(right_time) + delay).alias("_t"), F.lit(right_side).alias("_side"), payload.alias("_p"),
    )
    w = W.partitionBy(*key).orderBy("_t", "_side", F.col("_p").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    rows = a.unionByName(b).withColumn("_last", F.last("_p", True).over(w)).where(F.col("_side") == left_side)
    return rows.select(*cols, *[F.col(f"_last.{c}").alias(c) for c in values])


def _clock(df: DataFrame, c: str, stamped: bool) -> Column:
    """A time as a number: microseconds where ``stamped``, days of a date, or the number itself."""
    if stamped:
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.datediff(c, F.lit("1970-01-01")) if isinstance(df.schema[c].dataType, T.DateType) else F.col(c)


def _stamped(*sides: tuple[DataFrame, str]) -> bool:
    return any(isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) for df, c in sides)


def within(points: DataFrame, intervals: DataFrame, key: list[str], time: str, start: str, end: str) -> DataFrame:
    """Points inside an interval [start, end] of their key, once for each; a null end is open.

    An interval is cut to the times that points have, and goes into buckets of its own size: the power of eight below its length, so it touches nine at
    most, whatever the unit. A point is looked up once for each size that intervals have (21 at most), by key, size and bucket."""
    stamped = _stamped((points, time), (intervals, start), (intervals, end))
    p = points.withColumn("_t", _clock(points, time, stamped))
    ends = p.agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))  # one row
    own = intervals.withColumns({"_s": _clock(intervals, start, stamped), "_e": _clock(intervals, end, stamped)}).where("_s IS NOT NULL").crossJoin(ends)
    own = own.withColumns({"_from": F.greatest("_s", "_first"), "_to": F.least(F.coalesce("_e", "_last"), "_last")}).where("_from <= _to")
    own = own.withColumn("_l", (F.floor(F.log2(F.col("_to") - F.col("_from") + 1) / 3) * 3).cast("int"))
    place = lambda t: F.floor(F.col(t) / F.pow(F.lit(2.0), "_l")).cast("long")
    sizes = sorted(r[0] for r in own.select("_l").distinct().collect())
    own = own.withColumn("_b", F.explode(F.sequence(place("_from"), place("_to"))))
    p = p.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"))).withColumn("_b", place("_t"))
    both = p.join(own, [*key, "_l", "_b"]).where((F.col("_t") >= F.col("_s")) & (F.col("_e").isNull() | (F.col("_t") <= F.col("_e"))))
    return both.drop("_b", "_l", "_t", "_s", "_e", "_from", "_to", "_first", "_last")


def outside(points: DataFrame, intervals: DataFrame, key: list[str], time: str, start: str, end: str) -> DataFrame:
    """Points that no interval of their key holds: starts and ends are steps up and down between the points, added up in one sort by key."""
    stamped = _stamped((points, time), (intervals, start), (intervals, end))
    row = F.struct(*points.columns)
    nothing = F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType)
    at = lambda df, t, side, step, r: df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], t.alias("_t"), F.lit(side).alias("_side"), F.lit(step).alias("_step"), r.alias("_row"))
    s, e = _clock(intervals, start, stamped), _clock(intervals, end, stamped)
    whole = intervals.where(s.isNotNull() & (e.isNull() | (s <= e))).na.drop(subset=key)
    rows = at(points, _clock(points, time, stamped), 1, 0, row).unionByName(at(whole, s, 0, 1, nothing)).unionByName(at(whole.where(e.isNotNull()), e, 2, -1, nothing))
    w = W.partitionBy(*[f"_k{n}" for n in range(len(key))]).orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_open", F.sum("_step").over(w)).where("_side = 1 AND _open = 0").select("_row.*")
