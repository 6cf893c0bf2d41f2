"""A store of price tables as one partitioned Parquet dataset: a symbol and time frame is a partition, so a read prunes to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("category", "symbol", "timeframe")


class PriceStore:
    """``root`` may be any path that Spark writes to. Saving a partition again replaces it and leaves others alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, symbol: str, timeframe: str, category: str = "raw") -> None:
        rows = df.withColumns({"category": F.lit(category), "symbol": F.lit(symbol), "timeframe": F.lit(timeframe)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*PARTS).parquet(self.root)

    def load(self, symbol: str, timeframe: str, category: str = "raw", columns: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", "false").parquet(self.root)
        rows = rows.where((F.col("category") == category) & (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
        return rows.select(*(columns or [c for c in rows.columns if c not in PARTS]))

    def info(self, time: str = "ts") -> DataFrame:
        """category, symbol, timeframe, rows, first, last."""
        rows = self.spark.read.parquet(self.root)
        return rows.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))

    def delete(self, symbol: str, timeframe: str, category: str = "raw") -> bool:
        """Whether there was such a partition; its files go by the store's own file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/category={category}/symbol={symbol}/timeframe={timeframe}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
