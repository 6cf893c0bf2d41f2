"""How many trials a search ran, counted from what experiment trackers leave behind: a row for each state."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The query of each tracker's own tables.
TABLES = {
    "mlflow": "SELECT lifecycle_stage, COUNT(*) FROM runs WHERE ? IS NULL OR experiment_id = ? GROUP BY lifecycle_stage",
    "optuna": "SELECT state, COUNT(*) FROM trials WHERE ? IS NULL OR study_id = ? GROUP BY state",
}


def _counted(rows: DataFrame, state: str | None) -> DataFrame:
    named = F.coalesce(F.col(state).cast("string"), F.lit("unknown")) if state else F.lit("all")
    return rows.groupBy(named.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """state, n of exported rows; all rows are of one state if there is no such column."""
    rows = spark.read.csv(path, header=True)
    return _counted(rows, next((c for c in rows.columns if c.lower() in ("state", "status")), None))


def from_json(spark: SparkSession, path: str, state: str = "status") -> DataFrame:
    """state, n of a folder of trial files, one JSON document each."""
    rows = spark.read.json(path, multiLine=True)
    return _counted(rows, state if state in rows.columns else None)


def from_run_folders(spark: SparkSession, root: str) -> DataFrame:
    """state, n of runs kept as folders ``<experiment>/<run>/meta.yaml``."""
    text = spark.read.text(f"{root.rstrip('/')}/*/*/meta.yaml", wholetext=True)
    return _counted(text.select(F.regexp_extract("value", r"(?m)^lifecycle_stage:\s*(\S+)", 1).alias("state")), "state")


def from_sqlite(spark: SparkSession, path: str, tracker: str, wanted: int | None = None) -> DataFrame:
    """state, n out of a tracker's database file, which is opened read-only and counts by itself: a row a state reaches the driver."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        found = [(str(s), int(n)) for s, n in con.execute(TABLES[tracker], (wanted, wanted))]
    return spark.createDataFrame(found, "state string, n long")
