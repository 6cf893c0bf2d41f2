"""Stored ticks as a stream: a Python data source whose offsets are places in the ordered times of a Parquet table.

``spark.readStream.format("replay").option("path", ...)`` gives the table's rows in slices of ``width`` units of its time column, so streaming
operators can be held against batch ones on the same rows. A slice is read by one task each; offsets survive restarts in the
query's checkpoint, and a slice read again gives the same rows.

Options: path (a folder or file that Arrow's file systems know), time (its integer time column, ``us``), width (of a slice, an hour of microseconds), slices
(at most so many a batch, 24).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Slice(InputPartition):
    number: int

    def __init__(self, number: int):
        self.number = number


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(at, filesystem=system, format="parquet")


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.time = options["path"], options.get("time", "us")
        self.width, self.most = int(options.get("width", 3_600_000_000)), int(options.get("slices", 24))
        self.at: int | None = None

    def _ends(self) -> tuple[int, int]:
        """The first slice and the one after the last, by the statistics of the row groups alone."""
        low, high = None, None
        for piece in _dataset(self.path).get_fragments():
            meta = piece.metadata
            column = meta.schema.names.index(self.time)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(column).statistics
                if s is not None and s.has_min_max:
                    low, high = s.min if low is None else min(low, s.min), s.max if high is None else max(high, s.max)
        return (0, 0) if low is None else (low // self.width, high // self.width + 1)

    def initialOffset(self) -> dict:
        return {"slice": self._ends()[0]}

    def latestOffset(self) -> dict:
        first, end = self._ends()
        self.at = min(end, (first if self.at is None else self.at) + self.most)
        return {"slice": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = max(end["slice"], self.at or 0)  # a restarted query goes on from its checkpoint
        return [Slice(k) for k in range(start["slice"], end["slice"])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        t = ds.field(self.time)
        inside = (t >= partition.number * self.width) & (t < (partition.number + 1) * self.width)
        yield from _dataset(self.path).to_table(self.names, filter=inside).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the query's checkpoint."""


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Replay)
