"""Every registered query that has a SQL twin gives its rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandline.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, twin, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = twin.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    df = registry.QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_row_order_and_partitions_do_not_matter(spark):
    from pyspark.sql import functions as F

    from strandline.operators import backtest, bars
    from strandline.sources.tables import HOUR, ticks

    t = ticks(spark, DIR)
    base = None
    for rows in (t, t.repartition(7), t.orderBy(F.rand(3)).repartition(13)):
        b = bars.indexed(bars.time_bars(rows, HOUR)).withColumn("t", (F.col("idx") % 5 > 2).cast("int"))
        got = sorted((r[0], r[1], round(r[3], 9)) for r in backtest.totals(backtest.trades(b, "t", ["symbol"]), ["symbol"]).collect())
        base = base or got
        assert got == base


def test_order_matching_has_an_order_on_every_bar(spark):
    import __spark_entry__
    from strandline.plans import trading

    bars = trading.hourly(spark, __spark_entry__.SMOKE_DIR).select("symbol", "idx")
    placed = trading._order_rows(spark, __spark_entry__.SMOKE_DIR).select("symbol", "placed")
    assert bars.count() > 0 and bars.exceptAll(placed).count() == 0 and placed.exceptAll(bars).count() == 0
