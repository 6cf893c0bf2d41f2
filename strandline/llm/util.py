"""Shared helpers: durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where none is configured and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is (a shuffled join then).

    ``df`` should come from :func:`save`, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def attach(rows: DataFrame, found: DataFrame, on: list[str], n: str, salt: list[str], small: int = 0) -> DataFrame:
    """``rows`` with the columns of ``found`` (null where it has none), with no task that gets a hot key.

    found: a row for each key ``on``, from :func:`save`, with the column ``n``: how many of ``rows`` have the key. Keys with
    more than a thousandth of these rows, so fewer than a thousand keys, are broadcast, and their rows are dealt by a hash of the columns ``salt``;
    all others are joined by a shuffle, in which no key has more than a thousandth of the rows. If there are at most ``small`` keys, all are broadcast.
    """
    if small and found.limit(small + 1).count() <= small:
        own = found.drop(*[c for c in found.columns if c in rows.columns and c not in on])
        return rows.join(F.broadcast(own), on, "left").select(*rows.columns, *[c for c in own.columns if c not in on])
    total = found.agg(F.sum(n)).first()[0] or 0
    values = [c for c in found.columns if c not in on]
    hot = F.col(n) * 1000 > F.lit(total)
    known = lambda kept, name: found.where(kept).select(*on, F.struct(*values).alias(name))
    marked = rows.join(F.broadcast(known(hot, "_hot")), on, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*salt), F.lit(997)).cast("int")))
    both = marked.join(known(~hot, "_cold").withColumn("_salt", F.lit(0)), [*on, "_salt"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values if c not in rows.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(*cols: str) -> Column:
    """A 96-bit key of a row's columns and of which are null, as hashes pass nulls over: repeated rows share it, so whatever
    is decided for one holds for all."""
    each = [*cols, *[F.col(c).isNull() for c in cols]]
    return F.struct(F.xxhash64(*each).alias("a"), F.hash(*each).alias("b"))
