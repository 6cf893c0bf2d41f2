"""Scans: price tables by suffix, the driver's tables, and the event stream as trades or quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that price tables use for the same column. Fixed values.
ALIASES = {"time": "timestamp", "date": "timestamp", "datetime": "timestamp", "ticker": "symbol", "asset": "symbol", "instrument": "symbol"}
PRICES = ("open", "high", "low", "close")
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table by the suffix of its path: .parquet, .orc, .json(l), .csv or .txt."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "orc":
        return spark.read.orc(path)
    if suffix in ("json", "jsonl"):
        return spark.read.json(path)
    if suffix in ("csv", "txt", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if suffix == "tsv" else separator).csv(path)
    raise ValueError(f"no reader for .{suffix}")


def normalise_prices(df: DataFrame) -> DataFrame:
    """Lower-cased names, aliases resolved, prices as double (unreadable and NaN as null); missing columns are an error."""
    seen: set[str] = set()
    cols = []
    for c in df.columns:
        name = ALIASES.get(c.strip().lower(), c.strip().lower())
        if name in seen:
            continue
        seen.add(name)
        x = F.col(f"`{c}`")
        if name in PRICES or name == "volume":
            x = x.try_cast("double")
            x = F.when(~F.isnan(x), x)
        cols.append(x.alias(name))
    if missing := [p for p in (*PRICES, "timestamp") if p not in seen]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*cols)


def micros(ts: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us, price, latency_ms, arrival_us, event_id, user_id of the events."""
    latency = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("value").alias("price"), latency.alias("latency_ms"), "event_id", "user_id")
        .withColumn("arrival_us", F.col("us") + 1000 * F.col("latency_ms"))
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Sink by suffix, overwriting."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    kind = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv"}[suffix]
    out = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        out = out.option("header", True)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)
