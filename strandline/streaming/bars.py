"""Streams: bars under a watermark, sequential alarms with state, and a journal that takes a batch once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_bars(ticks: DataFrame, width: str, late: str, ts: str = "ts") -> DataFrame:
    """symbol, start, open, high, low, close, n of a stream (symbol, event_id, price, ts). Ticks later than ``late`` behind
    the newest are dropped; in append mode a bar comes out once the watermark has passed its end."""
    order = F.struct(ts, "event_id")
    rows = ticks.withWatermark(ts, late).groupBy("symbol", F.window(ts, width).alias("w"))
    bars = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


ALARM = "symbol string, idx bigint, kind string, value double"
STATE = "s double, llr double, accepted bigint, cusum_done boolean, sprt_done boolean"


def alarms(returns: DataFrame, mu: float, sigma: float, h: float = 4.0, k: float = 0.5, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    """Alarms of a stream of returns (symbol, idx, ret): the first time the sum of shortfalls exceeds ``h`` and the first
    time a repeated likelihood-ratio test says the mean is gone. The state of a symbol is five numbers."""
    upper, lower, shift = float(np.log((1 - beta) / alpha)), float(np.log(beta / (1 - alpha))), mu / sigma

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, llr, accepted, c_done, p_done = state.get if state.exists else (0.0, 0.0, 0, False, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("idx").itertuples():
            if not c_done:
                s = max(0.0, s + shift * ((mu - row.ret) / sigma - k * shift))
                if s > h:
                    out.append((key[0], row.idx, "cusum", s))
                    c_done = True
            if not p_done:
                llr += mu * (mu / 2 - row.ret) / (sigma * sigma)
                if llr >= upper:
                    out.append((key[0], row.idx, "sprt", llr))
                    p_done = True
                elif llr <= lower:
                    llr, accepted = 0.0, accepted + 1
        state.update((s, llr, accepted, c_done, p_done))
        yield pd.DataFrame(out, columns=["symbol", "idx", "kind", "value"])

    return returns.groupBy("symbol").applyInPandasWithState(step, ALARM, STATE, "append", "NoTimeout")


def journal(path: str, key: str = "bar"):
    """A sink for foreachBatch: rows whose key is not in the journal yet are appended, so a batch that is retried or a
    replay of old input adds nothing. The batch is written under its own id, which a retry overwrites."""

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={epoch}"
        try:
            known = spark.read.parquet(path).where(F.col("batch") != epoch).select("symbol", key).distinct()
            batch = batch.join(known, ["symbol", key], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.dropDuplicates(["symbol", key]).write.mode("overwrite").parquet(target)

    return take


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that has arrived, then stop; the written rows. A second run goes on where this one ended."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
