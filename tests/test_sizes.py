"""What fails only on more rows, or on prices of zero: runs that lose nearly all, long logs, books open for many days, dealt scores, all pairs."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import draws
from strandline.functions import windows as fw
from strandline.operators import accounts, alpha, backtest, discover, engine, evidence, front, options, probes, repaint, resample, robust, search, stats


def test_prices_of_zero_divide_as_in_sql(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [(r["q"], r["l"]) for r in rows.select(fw.quotient(F.col("a"), F.col("b")).alias("q"), fw.ln(F.col("a")).alias("l")).collect()]
    assert got[0] == (math.inf, 0.0) and math.isnan(got[1][0]) and got[1][1] == -math.inf and got[2][0] == -math.inf and math.isnan(got[2][1])
    assert got[3][0] == 1.5 and math.isclose(got[3][1], math.log(3)) and got[4] == (None, None) and got[5][0] is None


def test_spread_where_a_bar_touches_zero(spark, tmp_path):
    import __spark_entry__

    rows = [(k, f"2024-01-01 {k // 3:02d}:{k % 3 * 10:02d}:00", 1, "view", v, "{}") for k, v in enumerate([5.0, 6.0, 4.0, 5.0, 0.0, 3.0, 4.0, 6.0, 5.0, 5.0, 7.0, 6.0])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = [r["spread"] for r in __spark_entry__.queries()["corwin_schultz"](spark, str(tmp_path)).orderBy("bar").collect()]
    assert got[0] is None and math.isnan(got[1]) and math.isnan(got[2]) and got[3] == got[3]


def test_a_price_of_zero_turned_over(spark):
    rows = [("a", k, p, p, p, p) for k, p in enumerate([2.0, 4.0, 0.0, 8.0])]
    got = front.mirrored(spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double"), 1).orderBy("idx").collect()
    assert [r["close"] for r in got] == [2.0, 4.0, math.inf, 2.0]


def losing(n):
    price = np.array([1.0, 1.0, 0.01] * n + [1.0])
    return price, np.array([1, 0, 0] * n + [0]).astype(float)


def test_log_return_of_a_run_that_loses_nearly_all(spark):
    price, target = losing(200)
    rows = spark.createDataFrame([("a", k, *[float(p)] * 4, float(t)) for k, (p, t) in enumerate(zip(price, target))], "symbol string, idx long, open double, high double, low double, close double, t double")
    got = engine.run_bars(rows, ["symbol"], "t", engine.Model(fee_bps=5.0, slip_bps=0.0)).first()
    want = 200 * math.log((0.01 / 1.0) * (1 - 0.0005) - 0.0005)
    assert got["n_trades"] == 200 and math.isclose(got["log_return"], want, rel_tol=1e-9) and want < -745
    book = rows.select("symbol", F.lit("x").alias("run"), F.col("idx").alias("bar"), "open", "close", F.col("t").alias("weight"))
    again = engine.run_weights(book, ["run"], engine.Model(fee_bps=5.0, slip_bps=0.0)).first()
    assert again["fills"] == 400 and math.isclose(again["log_return"], want, rel_tol=1e-9)


def test_journal_of_a_run_that_loses_nearly_all():
    price, target = losing(200)
    _, trades = engine.simulate(price, price, price, price, target, engine.Model())
    assert [t["entry_idx"] for t in trades] == list(range(1, 600, 3))


def test_journal_goes_on_after_a_price_of_zero(spark):
    price = [3.0, 2.0, 0.0, 4.0, 5.0, 6.0, 0.0, 7.0, 8.0, 9.0, 3.0]  # the first trade is sold for nothing, the second bought for nothing
    target = [1, 0, 0, 0, 0, 1, 1, 0, 1, 1, 1]
    rows = spark.createDataFrame([("a", k, *[p] * 4, t) for k, (p, t) in enumerate(zip(price, target))], "symbol string, idx long, open double, high double, low double, close double, t int")
    own = ["entry_idx", "exit_idx", "entry_px", "exit_px"]
    run = engine.run_bars(rows, ["symbol"], "t", engine.Model(afresh=True))
    got = sorted(tuple(r) for r in run.select(F.inline("trades")).select(own).collect())
    want = sorted(tuple(r) for r in backtest.trades(rows, "t", ["symbol"]).select(own).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] == [(1, 2), (6, 8), (9, 10)] and np.allclose(got, want)
    assert run.first()["log_return"] is None
    assert len(engine.run_bars(rows, ["symbol"], "t").first()["trades"]) == 1  # an account that is not begun anew trades no more


def test_bar_returns_count_trades_after_a_price_of_zero(spark, tmp_path):
    import duckdb

    import __spark_entry__

    rng = random.Random(5)
    rows = []
    for symbol, zeros in (("ruined", True), ("whole", False), ("idle", None)):
        for k in range(400):
            price = round(100 + 20 * math.sin(k / 6) + rng.random(), 2) if zeros is not None else 100.0 - k / 8
            rows.append((len(rows), f"2024-01-{k // 24 + 1:02d} {k % 24:02d}:00:00", 1, symbol, 0.0 if zeros and k % 5 == 2 else price, "{}"))
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["symbol"]: (r["n_trades"], r["log_return"]) for r in __spark_entry__.queries()["engine_bar_returns"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {s: (n, log) for s, n, log in con.execute(__spark_entry__.oracle_sql()["engine_bar_returns"]).fetchall()}
    assert set(got) == set(want) == {"ruined", "whole"} and want["ruined"][0] >= 10 and math.isnan(want["ruined"][1])
    for s, (n, log) in want.items():
        assert got[s][0] == n and (math.isclose(got[s][1], log, abs_tol=2e-6) or math.isnan(got[s][1]) and math.isnan(log))


def test_bought_for_nothing_has_no_log_return():
    price = np.array([3.0, 2.0, 0.0, 4.0, 5.0])
    _, trades, growth = engine.grown(price, price, price, price, np.array([0, 1, 0, 0, 0]), engine.Model(afresh=True))
    assert len(trades) == 1 and growth is None


def test_a_log_of_any_length_is_chained_in_one_pass(spark):
    n = 30_000
    rows = spark.range(2 * n).select((F.col("id") % 2).alias("log"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("seq"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("b"), F.col("id") % 7)).alias("body"))
    made = evidence.chain(rows.repartition(5), "log", "seq", ["seq", "body"])
    last = {}
    for i in range(6):
        body = f"b{i % 7}" if i % 5 else None
        last[i % 2] = hashlib.sha256("|".join([last.get(i % 2, ""), str(i // 2 + 1), *([body] if body else [])]).encode()).hexdigest()
    assert {r["log"]: r["hash"] for r in made.where("seq = 3").collect()} == last
    forged = made.withColumn("body", F.when((F.col("log") == 1) & (F.col("seq") == 20_000), "x").otherwise(F.col("body")))
    got = {r["log"]: (r["entries"], r["broken"]) for r in evidence.chained(forged, "log", "seq", ["seq", "body"]).collect()}
    assert got == {0: (n, None), 1: (n, 20_000)}


def test_open_days_are_not_shuffled(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("AB"), (d := rng.randrange(0, 300)), d + rng.randrange(-1, 60), float(rng.randrange(80, 120))) for k in range(4000)]
    book = spark.createDataFrame(rows, "trade_id long, symbol string, d int, e int, underlying_price double")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    book = book.withColumns({"date": day("d"), "expiry": day("e")}).localCheckpoint()
    snap = options.snapshots(book)
    since = lambda c: F.datediff(c, F.lit("2024-01-01"))
    got = sorted(tuple(r) for r in snap.select("trade_id", since("now"), "s0").collect())
    days, want = {r[2] for r in rows}, []
    for now in sorted(days):
        open_ = [r for r in rows if r[2] <= now < r[3]]
        s0 = {s: max((r[2], r[0], r[4]) for r in open_ if r[1] == s)[2] for s in {r[1] for r in open_}}
        want += [(r[0], now, s0[r[1]]) for r in open_]
    assert got == sorted(want)
    # spreading a trade over its days comes after the last exchange
    plan = snap._jdf.queryExecution().sparkPlan().toString()
    assert "inline" in plan[: plan.index("Join")]


def test_stress_is_added_up_where_days_are_spread(spark):
    rng = random.Random(7)
    rows = []
    for k in range(600):
        d, size, strike = rng.randrange(0, 90), rng.choice([-3.0, 2.0, 5.0]), rng.choice([60.0, 95.0, 130.0])
        rows.append((k, rng.choice("AB"), d, d + rng.randrange(-1, 60), rng.choice("CP"), None if k % 50 == 7 else strike, None if k % 60 == 9 else size, 100, rng.choice([0.0, 0.2, 0.5]), float(rng.randrange(80, 120))))
    rows.append((600, "C", 200, 203, "C", None, 1.0, 100, 0.2, 100.0))  # a day whose only trade has no value
    book = spark.createDataFrame(rows, "trade_id long, symbol string, d int, e int, right string, strike double, qty double, multiplier int, iv_used double, underlying_price double")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    book = book.withColumns({"date": day("d"), "expiry": day("e")}).localCheckpoint()
    out = options.stress(book)
    got = {r["now"]: (r["gamma"], r["worst"]) for r in out.collect()}
    each = options.snapshots(book).withColumn("t", F.datediff("expiry", "now") / 365.0)
    size = F.col("qty") * F.col("multiplier")
    cases = []
    for j, (move, vol) in enumerate([(0.0, 1.0), *options.SCENARIOS]):
        one = options.priced(each.withColumns({"_s": F.col("s0") * (1 + move), "_v": F.col("iv_used") * vol}), s="_s", vol="_v").groupBy("now")
        cases.append({r["now"]: (r["v"], r["g"]) for r in one.agg(F.sum(size * F.col("price")).alias("v"), F.sum(F.when(F.col("strike").isNotNull(), size * F.col("gamma") * F.col("s0") * F.col("s0") * 0.01)).alias("g")).collect()})
    assert set(got) == set(cases[0]) and len(got) > 80
    for now, (gamma, worst) in got.items():
        v, g = zip(*(c[now] for c in cases))
        if v[0] is None:
            assert gamma is None and worst == 0.0
        else:
            assert math.isclose(gamma, g[0], rel_tol=1e-9) and math.isclose(worst, min(0.0, v[1] - v[0], v[2] - v[0]), rel_tol=1e-9, abs_tol=1e-6)
    # a trade leaves its task as sums by day, and no scenario is a row
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "inline" not in plan[: plan.index("MapInArrow")]


def test_normal_distribution_of_arrays(spark):
    from strandline.functions import normal

    x = [-60.0, -20.0, -7.5, -3.0, -0.1, 0.0, 0.1, 3.0, 7.2, 20.0, 60.0, math.inf, -math.inf]
    want = [r["p"] for r in spark.createDataFrame([(v,) for v in x], "x double").select(normal.cdf("x").alias("p")).collect()]
    assert np.allclose(normal.cdf_array(np.array(x)), want, rtol=1e-13, atol=0) and np.isnan(normal.cdf_array(np.array([np.nan]))).all()


def test_hashes_of_many_texts_are_those_of_each():
    rng = random.Random(7)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(45))) for _ in range(20_000)] + [b"", b"a\0"]
    for some in (texts, texts[-900:], [*texts, b"x" * 60]):  # by columns, few, and too long for a block
        want = [int(hashlib.md5(b"1|7|" + t).hexdigest()[:8], 16) for t in some]
        assert draws.hashes(some, 1, 7).tolist() == want


def test_scores_are_dealt_without_a_row_a_draw(spark):
    rng = random.Random(5)
    rows = [(s, b, float(rng.randrange(6)), rng.random()) for b in range(4) for s in range(2 + 5 * b)]
    panel = spark.createDataFrame(rows, "symbol long, bar long, s double, f double")
    got = {(r["rep"], r["bar"]): r["ic"] for r in alpha._dealt(panel, 11, 1, each=4).collect()}

    def ranks(x):
        return np.array([sum(v < a for v in x) + (sum(v == a for v in x) + 1) / 2 for a in x])

    want = {}
    for b in range(1, 4):
        one = sorted(r for r in rows if r[1] == b)
        for rep in range(11):
            order = sorted(one, key=lambda r: (int(hashlib.md5(f"1|{rep}|{b}|{r[0]}".encode()).hexdigest()[:8], 16), r[0]))  # noqa: B023
            want[rep, b] = float(np.corrcoef(ranks([r[2] for r in order]), ranks([r[3] for r in one]))[0, 1])
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    whole = alpha._dealt(panel, 11, 1)
    again = {(r["rep"], r["bar"]): r["ic"] for r in whole.collect()}
    assert again.keys() == want.keys() and all(math.isclose(again[k], want[k], abs_tol=1e-9) for k in want)
    # no row is copied for draws, and rows go once to as many tasks as are asked for
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Generate explode" not in plan and plan.count("Exchange hashpartitioning(bar") == 1 and "REPARTITION_BY_NUM" in plan


def test_slots_of_a_bootstrap_are_never_broadcast(spark, monkeypatch):
    rets = spark.range(40).select((F.col("id") % 2).alias("symbol"), F.floor(F.col("id") / 2).cast("long").alias("idx"), F.rand(1).alias("ret")).localCheckpoint()
    of = lambda: sorted(tuple(r) for r in resample.bootstrap(rets, ["symbol"], 5, 2, 8).select("symbol", "rep", "idx", "ret").collect())
    plan = lambda: resample.bootstrap(rets, ["symbol"], 5, 2, 8)._jdf.queryExecution().sparkPlan().toString()
    got = of()
    assert len(got) == 200 and "BroadcastHashJoin" in plan() and "BuildRight" in plan()
    monkeypatch.setattr(resample, "MOST_BROADCAST", 3)
    assert of() == got and "SortMergeJoin" in plan()



def test_clusters_that_leave_out_pairs_within_the_largest(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=12)
    rows = []
    for k in range(60):
        x = 0.1 * rng.normal(size=12) + (common if k % 3 else 0)  # two thirds are one cluster
        for t in range(12 if k % 7 else 6):
            rows.append((k, t, float(x[t])))
    rows += [(100 + k, t, v) for k in range(5) for j, t, v in rows if j == 3]  # copies
    rows += [(k, t, 1.0) for k in (200, 201) for t in range(12)]  # copies without variance: no link
    rows += [(k, t, float(t)) for k in (300, 301) for t in range(2)]  # copies of too few times
    rets = spark.createDataFrame(rows, "symbol long, bar long, ret double").localCheckpoint()
    for strong, block in ((0.4, 1024), (0.4, 6), (0.9, 6), (0.75, 10), (0.999, 8)):  # at the last only copies are linked, so every pair is compared
        want = {r["symbol"]: r["cluster"] for r in search.clusters(stats.correlations(rets, "symbol", "bar", strong=strong), rets.select("symbol"), strong).collect()}
        got = {r["symbol"]: r["cluster"] for r in search.correlation_clusters(rets, "symbol", "bar", strong, block=block).collect()}
        assert got == want, (strong, block)


def test_least_labels_of_a_long_chain():
    order = np.random.default_rng(1).permutation(500)
    label = search._least_labels(502, order[:-1], order[1:])
    assert (label[:500] == 0).all() and list(label[500:]) == [500, 501]


def test_correlations_by_tiles(spark):
    rng = random.Random(6)
    rows = [(f"k{k:02d}", t, rng.gauss(0, 1) if k % 9 else 1.0) for k in range(25) for t in range(300) if rng.random() < (0.7 if k % 5 else 0.01)]
    rets = spark.createDataFrame(rows, "symbol string, bar long, ret double")
    by = {}
    for k, t, x in rows:
        by.setdefault(k, {})[t] = x
    want = {}
    for a in by:
        for b in by:
            both = sorted(by[a].keys() & by[b].keys())
            if a < b and len(both) >= 3:
                x, y = np.array([by[a][t] for t in both]), np.array([by[b][t] for t in both])
                want[a, b] = (len(both), float(np.corrcoef(x, y)[0, 1]) if x.std() > 1e-7 and y.std() > 1e-7 else None)
    for block in (4, 1024):
        got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in stats.correlations(rets, "symbol", "bar", block=block).collect()}
        assert got.keys() == want.keys() and all(got[p][0] == n and (got[p][1] is None if c is None else math.isclose(got[p][1], c, abs_tol=1e-9)) for p, (n, c) in want.items())
    strong = stats.correlations(rets, "symbol", "bar", strong=0.1, block=4).collect()
    assert {(r["a"], r["b"]) for r in strong} == {p for p, (_, c) in want.items() if c is not None and abs(c) >= 0.1} != set()
    assert "Join" not in str(stats.correlations(rets, "symbol", "bar")._jdf.queryExecution().optimizedPlan()).replace("Join Cross", "")


def test_fills_at_a_price_of_zero(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 0.0), (0, 0.0, 2.0), (1, 2.0, 4.0)], "side int, entry double, x double")
    got = [r["f"] for r in rows.select(backtest.factor(F.col("side"), F.col("entry"), F.col("x"), 0.0, 1.0).alias("f")).collect()]
    assert math.isnan(got[0]) and got[1] == 0.0 and math.isnan(got[2]) and got[3] == 2.0


def test_null_markets_keep_lows_of_zero(spark):
    rows = [("a", k, 5.0 + k % 3, 9.0, 0.0 if k == 4 else 1.0, 5.0 + (k + 1) % 3) for k in range(8)]
    made = discover.markets(spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double"), 3)
    got = {r["market"]: r["n"] for r in made.groupBy("market").agg(F.sum((F.col("low") == 0).cast("long")).alias("n")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1}


def test_subsets_ranked_within_a_date(spark):
    rng = random.Random(7)
    rows = [(k, t, rng.choice([None, math.nan, round(rng.gauss(0, 1), 1)]) if k % 4 == 0 else rng.gauss(0, 1), rng.gauss(0, 0.1) if rng.random() < 0.9 else None) for k in range(23) for t in range(9) if rng.random() < 0.8 and not (k > 2 and t == 5)]
    panel = spark.createDataFrame(rows, "symbol long, bar long, s double, ret double")
    of = lambda df: {(r["rep"], r["bar"]): r["net"] for r in df.collect()}
    want = of(robust.net_spread(robust.subsets(panel, 0.5, 70), "s", 4, 0.01, ("rep",)))
    got = of(robust.subset_spreads(panel, "s", 4, 0.01, 0.5, 70))
    assert got.keys() == want.keys() and all((got[k] is None) == (x is None) and (x is None or math.isclose(got[k], x, abs_tol=1e-12)) for k, x in want.items())


def test_values_of_books_without_a_grid(spark):
    rng = random.Random(8)
    rows = [(b, s, t, k, float(rng.randint(-5, 5)), rng.randint(1, 40) / 4, 0.25) for k, (b, s, t) in enumerate((b, s, t) for b in range(3) for s in "xyz" for t in range(20) for _ in range(rng.randrange(3)))]
    plan = accounts.net_asset_value(spark.createDataFrame(rows, "book long, symbol string, day long, seq long, qty double, price double, fee double"), "book", "symbol", "day")
    want = {}
    for b, t in {(r[0], r[2]) for r in rows}:
        past = [r for r in rows if r[0] == b and r[2] <= t]
        worth = sum(sum(r[4] for r in past if r[1] == s) * max((r[2], r[3], r[5]) for r in past if r[1] == s)[2] for s in {r[1] for r in past})
        want[b, t] = (-sum(r[4] * r[5] + r[6] for r in past), worth)
    assert {(r["book"], r["day"]): (r["cash"], r["value"]) for r in plan.collect()} == want
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_latencies_drawn_without_a_row_a_draw(spark):
    rng, hour = random.Random(9), 3_600_000_000
    rows = [(s, rng.randrange(30 * hour), k, rng.uniform(1, 9), rng.choice([0, 5, 900_000, 10**7])) for k, s in enumerate("a" * 400 + "b" * 7)]
    ticks = spark.createDataFrame(rows, "symbol string, us long, event_id long, price double, latency_ms long")
    bars = spark.createDataFrame([(s, t, rng.gauss(0, 1)) for s in "ab" for t in range(34)], "symbol string, bar long, mkt double")
    of = lambda df: {(r["rep"], r["symbol"]): r["total"] for r in df.collect()}
    want = of(robust.arrival_returns(robust.redrawn(ticks, 6), 1000 * F.col("latency_ms"), bars, ("rep", "symbol"), hour))
    for stretches in (1, 11):
        got = of(robust.redrawn_returns(ticks, 6, 1000, bars, hour, stretches=stretches))
        assert len(want) == 12 and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_views_of_a_symbol_are_dealt_among_tasks(spark):
    rows = [("a", k, *[float(5 + k % 7)] * 4) for k in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double")
    signal = lambda c: (c["close"] > 8).astype(float)
    for made, keys in ((repaint.history(bars, signal), 3), (probes.truncation(bars, signal), 2), (probes.perturbation(bars, signal), 2)):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        asked = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line]
        assert any(line.split("hashpartitioning(")[1].split(")")[0].count("#") == keys for line in asked), plan
    one = probes.truncation(bars, signal).first()
    assert one["mismatches"] == 0 and one["checkpoints"] > 8


def test_checks_of_a_score_add_up_trades_once(spark, monkeypatch):
    from strandline.plans import base, registry
    from tests.test_queries import DIR

    planned, monthly = [], base.monthly
    monkeypatch.setattr("strandline.plans.research.monthly", lambda *a: planned.append(1) or monthly(*a))
    for name in ("score_evidence", "validate_alpha", "universe_subsampling", "signal_placebo", "factor_spanning", "known_anomalies"):
        planned.clear()
        read = registry.QUERIES[name](spark, DIR).inputFiles()
        assert len(planned) == 1 and read and not any("lineitem" in f for f in read), name
