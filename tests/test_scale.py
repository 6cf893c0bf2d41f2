"""Joins by interval in any unit, ranks of tied values, sweeps in chunks, and bootstrap sums that trials share."""

import random

from pyspark.sql import functions as F

from strandline.functions import windows as fw
from strandline.operators import backtest, joins, resample


def test_intervals_in_microseconds_and_from_the_year_one(spark):
    rng, hour = random.Random(1), 3_600_000_000
    base = 1_700_000_000_000_000
    points = [(k, rng.choice("ab"), base + rng.randrange(0, 400 * hour)) for k in range(300)] + [(900, "a", None), (901, None, base)]
    intervals = [("a", base - 10**15, base + 3 * hour), ("a", -62_135_596_800_000_000, None), ("b", base + 50 * hour, base + 50 * hour), ("b", base + 5 * hour, base + 9 * hour), ("b", None, base), (None, base, None), ("b", base + 9, base)]
    intervals += [(rng.choice("ab"), s, s + rng.choice([1, 1000, hour, 30 * hour])) for s in (base + rng.randrange(0, 400 * hour) for _ in range(60))]
    points += [(1000, "b", base + 50 * hour), (1001, "b", base + 9 * hour), (1002, "b", base + 9 * hour + 1)]
    p = spark.createDataFrame(points, "id long, k string, t long")
    i = spark.createDataFrame(intervals, "k string, s long, e long").withColumn("n", F.monotonically_increasing_id())
    inside = lambda t, s, e: t is not None and s is not None and s <= t and (e is None or t <= e)
    want = sorted((q[0], n) for q in points for n, (k, s, e) in enumerate(intervals) if k is not None and k == q[1] and inside(q[2], s, e))
    order = {(r["s"], r["e"], r["k"]): r["n"] for r in i.collect()}
    got = sorted((r["id"], intervals.index((r["k"], r["s"], r["e"]))) for r in joins.within(p, i, ["k"], "t", "s", "e").collect())
    assert got == want and order
    held = {q for q, _ in want}
    assert sorted(r["id"] for r in joins.outside(p, i, ["k"], "t", "s", "e").collect()) == sorted(q[0] for q in points if q[0] not in held)
    plan = joins.within(p, i, ["k"], "t", "s", "e")
    assert set(plan.columns) == {"id", "k", "t", "s", "e", "n"}
    stamps = lambda df, *cs: df.withColumns({c: F.timestamp_micros(c) for c in cs})
    again = sorted(r["id"] for r in joins.outside(stamps(p, "t"), stamps(i, "s", "e"), ["k"], "t", "s", "e").collect())
    assert again == sorted(q[0] for q in points if q[0] not in held)


def test_ranks_where_most_values_are_one(spark):
    rng = random.Random(2)
    rows = [(k, 5.0 if k % 10 else float(rng.randrange(100))) for k in range(3000)] + [(5000 + k, None) for k in range(20)]
    rng.shuffle(rows)
    got = {r["k"]: (r["place"], r["of"]) for r in resample.placed(spark.createDataFrame(rows, "k long, v double"), "v", "k").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {k: (n + 1, len(rows)) for n, (k, _) in enumerate(order)}


def test_sweep_in_chunks_is_the_sweep(spark):
    i, w = F.col("id"), fw.by()
    rows = spark.range(1200).select(F.when(i % 2 == 0, "A").otherwise("B").alias("symbol"), F.floor(i / 2).cast("long").alias("idx"), (100 + 10 * F.sin(i / 50) + F.pmod(F.hash("id"), F.lit(100)) / 100).alias("close"))
    rows = rows.withColumn("open", F.lag("close", 1, 100.0).over(w))
    pairs = [(f, s) for f in range(3, 20) for s in (25, 30, 40, 50)]  # more than one word of bits
    wide = rows.withColumns({f"a{n}": fw.sma(F.col("close"), n, w) for n in sorted({n for p in pairs for n in p})})
    a = backtest.sweep(wide, "symbol", ["fast", "slow"], [((f, s), F.when(F.col(f"a{f}") > F.col(f"a{s}"), 1).otherwise(0)) for f, s in pairs])
    of = lambda df: sorted((r["symbol"], r["fast"], r["slow"], r["entry_idx"], r["exit_idx"], round(r["factor"], 9)) for r in df.collect())
    want = of(a)
    assert want and all(of(backtest.sma_sweep(rows, "symbol", pairs, chunk=c)) == want for c in (64, None))


def test_trials_share_their_draws(spark):
    rng = random.Random(3)
    rows = [(f, t, k, rng.gauss(0, 0.01)) for f in "xy" for t in range(7) for k in range(60 if t < 5 else 45)]
    rets = spark.createDataFrame(rows, "f string, t long, idx long, ret double")
    of = lambda df: {(r["f"], r["t"], r["rep"]): (r["total"], r["n"], round(r["ret"], 10)) for r in df.collect()}
    want = of(resample.block_sums(rets, ["f", "t"], ["f"], ["ret"], 25, 4))
    assert len(want) == 2 * 7 * 25 and of(resample.shared_block_sums(rets, ["f"], "t", "ret", 25, 4, width=3)) == want
