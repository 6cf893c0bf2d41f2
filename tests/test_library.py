"""Kernels against hand-computed cases and brute force; edge cases of the operators."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dsl, normal, positions, recursive
from strandline.operators import alpha, backtest, engine, evidence, joins, options, orders, probes, quality, resample, search, series, stats
from strandline.sources import adapters, storage, tables
from strandline.streaming import bars as streams

FREE = engine.Model(fee_bps=0.0, slip_bps=0.0, cash=100.0)


def run(open_, high, low, close, target, m=FREE, session=None):
    return engine.simulate(*[np.array(x, float) for x in (open_, high, low, close, target)], m, session)


def test_next_open_fill_and_long_hold():
    equity, trades = run([10, 11, 12, 13], [10, 11, 12, 13], [10, 11, 12, 13], [10.5, 11.5, 12.5, 13.5], [1, 1, 1, 1])
    assert trades[0]["entry_idx"] == 1 and trades[0]["entry_px"] == 11 and trades[0]["reason"] == "end"
    assert equity[-1] == pytest.approx(100 * 13.5 / 11)


def test_costs_on_both_fills():
    m = engine.Model(fee_bps=10.0, slip_bps=0.0, cash=100.0)
    equity, _ = run([10] * 4, [10] * 4, [10] * 4, [10] * 4, [1, 1, 0, 0], m)
    assert equity[-1] == pytest.approx(100 - 100 * 0.001 * 2)


def test_funding_every_bar_and_borrow_on_shorts_only():
    flat = [10.0] * 5
    long = run(flat, flat, flat, flat, [1] * 5, engine.Model(fee_bps=0, slip_bps=0, cash=100.0, funding_bps=10, borrow_bps=20))[0]
    short = run(flat, flat, flat, flat, [-1] * 5, engine.Model(fee_bps=0, slip_bps=0, cash=100.0, funding_bps=10, borrow_bps=20, shorts=True))[0]
    assert long[-1] == pytest.approx(100 - 4 * 0.1) and short[-1] == pytest.approx(100 - 4 * 0.3)


def test_stop_at_level_gap_at_open_and_stop_before_target():
    m = engine.Model(fee_bps=0, slip_bps=0, cash=100.0, stop_pct=10, take_pct=10)
    _, t = run([100, 100, 95], [100, 101, 96], [100, 99, 85], [100, 100, 90], [1, 0, 0], m)
    assert (t[0]["reason"], t[0]["exit_px"]) == ("signal", 95)
    _, t = run([100, 100, 95, 95], [100, 101, 96, 96], [100, 99, 85, 95], [100, 100, 90, 95], [1, 1, 0, 0], m)
    assert (t[0]["reason"], t[0]["exit_idx"]) == ("stop", 2) and t[0]["exit_px"] == pytest.approx(90)
    _, t = run([100, 100, 80, 80], [100, 101, 85, 80], [100, 99, 75, 80], [100, 100, 80, 80], [1, 1, 0, 0], m)
    assert t[0]["exit_px"] == pytest.approx(80)  # a gap below the stop leaves at the open
    _, t = run([100, 100, 100, 100], [100, 101, 120, 100], [100, 99, 85, 100], [100, 100, 100, 100], [1, 1, 0, 0], m)
    assert t[0]["reason"] == "stop"
    _, t = run([100, 100, 130, 100], [100, 101, 140, 100], [100, 99, 125, 100], [100, 100, 135, 100], [1, 1, 0, 0], m)
    assert t[0]["reason"] == "take" and t[0]["exit_px"] == pytest.approx(110)  # a better open is not credited


def test_trailing_stop_follows_the_best_price_both_ways():
    m = engine.Model(fee_bps=0, slip_bps=0, cash=100.0, trail_pct=10, shorts=True)
    _, t = run([100, 100, 115, 118], [100, 110, 120, 118], [100, 99.5, 109, 100], [100, 110, 115, 105], [1, 1, 1, 1], m)
    assert (t[0]["reason"], t[0]["exit_idx"]) == ("trail", 3) and t[0]["exit_px"] == pytest.approx(108)
    _, t = run([100, 100, 85, 82], [100, 98, 87, 100], [100, 90, 80, 82], [100, 90, 85, 95], [-1, -1, -1, -1], m)
    assert t[0]["reason"] == "trail" and t[0]["exit_px"] == pytest.approx(88)


def test_session_blocks_entries_only():
    flat = [10.0] * 5
    assert not run(flat, flat, flat, flat, [1] * 5, FREE, [False] * 5)[1]
    assert run(flat, flat, flat, flat, [1, 0, 0, 0, 0], FREE, [True, False, False, False, False])[1][0]["exit_idx"] == 2


def test_engines_agree_with_the_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(4):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
        t = rng.integers(-1, 2, 120)
        rows += [(s, i, float(p[i]), float(p[i] * 1.02), float(p[i] * 0.98), float(p[i] * 1.001), int(t[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol long, idx long, open double, high double, low double, close double, t int")
    closed = {r["symbol"]: r["total_return"] for r in backtest.totals(backtest.trades(df, "t", ["symbol"]), ["symbol"]).collect()}
    m = engine.Model(shorts=True)
    cash = {r["symbol"]: r["total_return"] for r in engine.run_bars(df, ["symbol"], "t", m).collect()}
    book = df.select("symbol", F.col("symbol").alias("run"), F.col("idx").alias("bar"), "open", "close", F.col("t").cast("double").alias("weight"))
    weights = {r["run"]: r["total_return"] for r in engine.run_weights(book, ["run"], m).collect()}
    for k, v in closed.items():
        assert cash[k] == pytest.approx(v, abs=1e-9) and weights[k] == pytest.approx(v, abs=1e-9)


def test_weights_wait_for_prices_and_close_at_delisting():
    nan = math.nan
    open_ = np.array([[10, 10], [10, nan], [10, 20], [10, 20], [10, nan]], float)
    close = np.array([[10, 10], [10, nan], [10, 20], [10, 22], [10, nan]], float)
    w = np.array([[0, 0.5]] * 5, float)
    equity, fills, traded = engine.simulate_weights(open_, close, w, engine.Model(fee_bps=0, slip_bps=0, cash=100.0), np.zeros(2), np.zeros(2))
    # the order waits for bar 2, buys half at 20, and is sold at its last price 22
    assert fills == 2 and equity[-1] == pytest.approx(100 + 2.5 * 2) and traded == pytest.approx(50 + 55)


def test_model_refuses_nonsense():
    with pytest.raises(ValueError):
        engine.Model(size=0.0)
    with pytest.raises(ValueError):
        engine.Model(fee_bps=-1.0)


def test_normal(spark):
    from statistics import NormalDist

    n = NormalDist()
    xs = [-9.0, -6.5, -3.0, -0.4, 0.0, 0.7, 2.2, 7.2, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf("x")).collect()
    assert all(g[0] == pytest.approx(n.cdf(x), abs=1e-14) for g, x in zip(got, xs))
    ps = [1e-5, 0.01, 0.3, 0.5, 0.9, 0.9999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(normal.ppf("p")).collect()
    assert all(g[0] == pytest.approx(n.inv_cdf(p), abs=1e-7) for g, p in zip(got, ps)) and got[-1][0] is None


def test_recursive_features():
    x = np.array([1.0, 2.0, 4.0, 3.0])
    assert recursive.ema(x, 3).tolist() == [1.0, 1.5, 2.75, 2.875]
    assert np.isnan(recursive.rsi_wilder(x, 14)).all()
    assert recursive.rsi_wilder(np.arange(20.0), 5)[-1] == 100.0
    assert recursive.band(np.array([0.1, 0.5, 0.6, -1.0]), 0.3).tolist() == [0.0, 0.5, 0.5, -1.0]
    assert recursive.hold(np.array([1.0, -1, -1, 0, 0]), 2).tolist() == [1, 1, -1, -1, 0]


def test_hysteresis_keeps_a_side_until_the_exit(spark):
    z = [None, 2.5, 1.0, -3.0, 0.2, -2.5, None, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(z)], "symbol string, idx long, z double")
    got = [r["position"] for r in positions.hysteresis(df, "z", 2.0, 0.5).orderBy("idx").collect()]
    assert got == [0, -1, -1, -1, 0, 1, 0, 0]


def test_dsl():
    assert dsl.key(("add", "close", "open")) == dsl.key(("add", "open", "close"))
    assert dsl.key(("sub", "close", "open")) != dsl.key(("sub", "open", "close"))
    assert dsl.lookback(("sma", ("lag", "ret", 3), 5)) == 9
    for bad in (("nope", "close"), ("sma", "close"), ("sma", "close", 0), "price"):
        with pytest.raises(ValueError):
            dsl.key(bad)


def test_asof_by_force(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(3), rng.randrange(20)) for i in range(60)]
    right = [(rng.randrange(3), t, float(t)) for t in rng.sample(range(20), 15)]
    a = spark.createDataFrame(left, "id long, k long, t long")
    b = spark.createDataFrame(right, "k long, s long, v double")
    for strict in (True, False):
        got = {r["id"]: r["v"] for r in joins.asof(a, b, ["k"], "t", "s", ["v"], strict=strict).collect()}
        for i, k, t in left:
            seen = [v for kk, s, v in right if kk == k and (s < t if strict else s <= t)]
            assert got[i] == (max(seen) if seen else None)


def test_empty_tables(spark):
    bars = spark.createDataFrame([], "symbol string, idx long, bar long, open double, high double, low double, close double, t int, ret double")
    assert not backtest.trades(bars, "t", ["symbol"]).collect()
    assert not engine.run_bars(bars, ["symbol"], "t").collect()
    assert not stats.moments(bars, ["symbol"]).collect() and not stats.episodes(bars, ["symbol"]).collect()
    assert not quality.spikes(bars).collect() and not series.unit_roots(bars, ["symbol"], "close").collect()
    assert not resample.bootstrap(bars.select("symbol", "idx", "ret"), ["symbol"], 3).collect()


def test_bootstrap_draws_whole_blocks(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(23)], "symbol string, idx long, ret double")
    rows = resample.bootstrap(df, ["symbol"], 4, 7, 5).orderBy("rep", "idx").collect()
    assert len(rows) == 92
    for a, b in zip(rows, rows[1:]):
        if a["rep"] == b["rep"] and b["idx"] % 5:
            assert b["ret"] == (a["ret"] + 1) % 23
    again = resample.bootstrap(df.repartition(5), ["symbol"], 4, 7, 5).orderBy("rep", "idx").collect()
    assert rows == again
    for block in (1, 5):
        moved = resample.permuted(df, ["symbol"], 3, 7, block).collect()
        assert all(sorted(r["ret"] for r in moved if r["rep"] == k) == [float(i) for i in range(23)] for k in range(3))
        assert all(sorted(r["idx"] for r in moved if r["rep"] == k) == list(range(23)) for k in range(3))


def test_block_sums_by_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=77)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, idx long, ret double")
    import hashlib

    n, length = 77, round(77 ** (1 / 3))
    for row in resample.block_sums(df, ["symbol"], ["symbol"], ["ret"], 5, 3).collect():
        starts = [int(hashlib.md5(f"3|{row['rep']}|a|{b}".encode()).hexdigest()[:8], 16) % n for b in range(n // length)]
        assert row["ret"] == pytest.approx(sum(x[(s + j) % n] for s in starts for j in range(length)))


def test_econometrics():
    rng = np.random.default_rng(1)
    e = rng.normal(size=400)
    walk = np.cumsum(e)
    assert series.unit_root_p(series.unit_root(e)[0]) < 0.01 < 0.05 < series.unit_root_p(series.unit_root(walk)[0])
    assert series.unit_root_p(3.0) == 1.0 and series.unit_root_p(-20.0) == 0.0
    trace, vector = series.trace_statistics(np.column_stack([walk + rng.normal(size=400), walk + rng.normal(size=400)]))
    assert trace[0] > 15.5 and vector[1] == pytest.approx(-1, abs=0.1)
    # by force: every lag fitted on its own, by least squares
    step = np.diff(walk)
    top = min(int(12 * 4**0.25), 100)

    def fitted(lag, start):
        columns = np.column_stack([walk[start:-1], np.ones(len(step) - start), *[step[start - i : len(step) - i] for i in range(1, lag + 1)]])
        beta, *_ = np.linalg.lstsq(columns, step[start:], rcond=None)
        left = step[start:] - columns @ beta
        cov = np.linalg.inv(columns.T @ columns) * (left @ left) / (len(left) - columns.shape[1])
        return len(left) * np.log(left @ left / len(left)) + 2 * columns.shape[1], beta[0] / np.sqrt(cov[0, 0])

    lag = min(range(top + 1), key=lambda k: fitted(k, top)[0])
    assert series.unit_root(walk) == (pytest.approx(fitted(lag, lag)[1]), lag)


def test_johansen_by_force():
    """Eigenvalues of the product-moment matrices, as the textbook has them."""
    rng = np.random.default_rng(4)
    common = np.cumsum(rng.normal(size=300))
    levels = np.column_stack([common + rng.normal(size=300), 0.5 * common + rng.normal(size=300), np.cumsum(rng.normal(size=300))])
    trace, vector = series.trace_statistics(levels)
    change = np.diff(levels, axis=0)
    z = np.column_stack([np.ones(298), change[:-1]])
    free = np.eye(298) - z @ np.linalg.inv(z.T @ z) @ z.T
    r0, r1 = free @ change[1:], free @ levels[1:-1]
    values = np.sort(np.linalg.eigvals(np.linalg.inv(r1.T @ r1) @ r1.T @ r0 @ np.linalg.inv(r0.T @ r0) @ r0.T @ r1).real)[::-1]
    assert trace == pytest.approx([-298 * np.log(1 - values[k:]).sum() for k in range(3)])
    assert vector[1] == pytest.approx(-2, abs=0.3)


def test_cointegration_and_johansen_on_spark(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=250))
    y = 2.0 + 3.0 * x + rng.normal(size=250)
    alone = np.cumsum(rng.normal(size=250))
    df = spark.createDataFrame([(k, i, float(b), float(x[i])) for k, s in (("tied", y), ("apart", alone)) for i, b in enumerate(s)], "symbol string, idx long, y double, x double")
    got = {r.symbol: r for r in series.cointegration(df, ["symbol"], "y", "x").collect()}
    for k, s in (("tied", y), ("apart", alone)):
        beta, alpha = np.polyfit(x, s, 1)
        assert got[k].beta == pytest.approx(beta) and got[k].alpha == pytest.approx(alpha)
        assert (got[k].stat, got[k].lag) == (pytest.approx(series.unit_root(s - alpha - beta * x)[0]), series.unit_root(s - alpha - beta * x)[1])
    assert got["tied"].stat < series.COINTEGRATED[0.01] < got["apart"].stat
    ranks = {r.symbol: r.trace for r in series.johansen(df, ["symbol"], ["y", "x"]).collect()}
    assert ranks["tied"][0] > 19.9 and ranks["apart"][0] < 19.9  # the level of 1 % for two series


def test_mean_breaks(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=400)
    rows = [("still", i, float(v)) for i, v in enumerate(e)] + [("twice", i, float(v + 2 * (i >= 150) - 3 * (i >= 300))) for i, v in enumerate(e)] + [("short", i, 1.0 * (i > 20)) for i in range(40)]
    got = {r.symbol: r.starts for r in series.mean_breaks(spark.createDataFrame(rows, "symbol string, idx long, x double"), ["symbol"], "x").collect()}
    assert set(got) == {"still", "twice"} and got["still"] == []
    assert len(got["twice"]) == 2 and abs(got["twice"][0] - 150) < 6 and abs(got["twice"][1] - 300) < 6


def test_regression_by_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = 0.3 + x @ [1.0, -2.0] + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = {r["term"]: r for r in alpha.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert [got[k]["coef"] for k in ("const", "a", "b")] == pytest.approx(want.tolist()) and got["a"]["n"] == 80


def test_probes_catch_a_signal_that_peeks(spark):
    rng = np.random.default_rng(5)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 150)))
    df = spark.createDataFrame([("a", i, float(v), float(v * 1.01), float(v * 0.99), float(v)) for i, v in enumerate(p)], "symbol string, idx long, open double, high double, low double, close double")
    causal = lambda c: np.append(0.0, np.sign(np.diff(c["close"])))
    peek = lambda c: np.append(np.sign(np.diff(c["close"])), 0.0)
    whole = lambda c: np.sign(c["close"] - c["close"].mean())
    for probe in (probes.truncation, probes.perturbation):
        assert [probe(df, s).first()["status"] for s in (causal, peek, whole)] == ["pass", "fail", "fail"]
    stored = lambda c: np.sign(np.sin(np.arange(len(c["close"]))))
    assert [probes.stored_answer(df, s).first()["status"] for s in (causal, stored)] == ["pass", "fail"]
    assert [probes.determinism(df, causal).first()["differing"]] == [0]
    from strandline.functions.windows import by, sma

    w = by()
    assert not probes.plan_looks_ahead(df.withColumn("x", sma(F.col("close"), 5, w)))
    assert probes.plan_looks_ahead(df.withColumn("x", F.lead("close").over(w)))


def test_options(spark):
    day = datetime.date(2024, 1, 1)
    row = (1, "X", day, datetime.date(2024, 12, 31), "C", 100.0, -1.0, 5.0, 100, 0.2, day, 100.0)
    df = spark.createDataFrame([row, (2, "X", day, datetime.date(2024, 12, 31), "P", 100.0, 1.0, 5.0, 100, 0.2, day, 100.0)],
                               "trade_id long, symbol string, date date, expiry date, right string, strike double, qty double, fill_price double, multiplier int, iv_used double, iv_asof date, underlying_price double")
    got = {r["right"]: r for r in options.priced(df.withColumn("t", F.lit(1.0))).collect()}
    assert got["C"]["price"] == pytest.approx(7.9656, abs=1e-4) and got["P"]["price"] == pytest.approx(7.9656, abs=1e-4) and got["C"]["gamma"] == pytest.approx(0.019848, abs=1e-6)
    assert options.margin(df).first()["margin"] == pytest.approx((20 + 5) * 100)
    assert options.stress(df).first()["worst"] < 0


def test_orders(spark):
    bars = spark.createDataFrame([("a", i, 10.0 + i, 11.0 + i, 9.0 + i) for i in range(6)], "symbol string, idx long, open double, high double, low double")
    o = spark.createDataFrame([
        (1, "a", 0, 1, 5.0, None, None, None, "GTC"), (2, "a", 0, -1, 5.0, 13.0, None, None, "GTC"), (3, "a", 0, 1, 5.0, 5.0, None, None, "IOC"), (4, "a", 0, 1, 5.0, None, 9.0, 14.0, "GTC"), (5, "zz", 0, 1, 5.0, None, None, None, "GTC"),
    ], "order_id long, symbol string, placed long, side int, qty double, limit_px double, stop_px double, take_px double, tif string")
    got = {(r["order_id"], r["status"]): r for r in orders.match(o, bars, 0.0, 0.0).collect()}
    assert got[1, "filled"]["idx"] == 1 and got[1, "filled"]["price"] == 11
    assert got[2, "filled"]["idx"] == 2 and got[2, "filled"]["price"] == 13
    assert got[3, "canceled"]["price"] is None and got[4, "take"]["idx"] == 3 and got[4, "take"]["price"] == 14
    fills = spark.createDataFrame([("x", "s", 1, 2.0, 10.0, 0.0), ("x", "s", 2, 2.0, 20.0, 0.0), ("x", "s", 3, -6.0, 30.0, 1.0)], "acc string, symbol string, seq int, qty double, price double, fee double")
    n = orders.net(fills, "acc", "seq").first()
    assert (n["qty"], n["avg_px"], n["realized"], n["cash"]) == (-2.0, 30.0, 60.0, 119.0)


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", "x", "integrity", "fail"), ("b", "x", "statistics", "fail"), ("c", "x", "statistics", "warn"), ("d", "x", "integrity", "pass"), ("d", "y", "integrity", "skip")], "s string, id string, category string, status string")
    assert {r["s"]: r["verdict"] for r in evidence.verdicts(rows, ["s"]).collect()} == {"a": "REJECT", "b": "NEEDS_MORE_EVIDENCE", "c": "PASS_WITH_WARNINGS", "d": "PASS"}
    assert {len(r["certificate"]) for r in evidence.certificates(rows, ["s"]).collect()} == {16}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "3", "1", "2", "7"), ("2", "1", "3", "1", "nan", "7")], "Date string, Open string, High string, Low string, Close string, Ticker string")
    for suffix in ("csv", "parquet", "json", "orc"):
        tables.write_table(df, f"{tmp_path}/t.{suffix}")
        assert tables.read_table(spark, f"{tmp_path}/t.{suffix}").count() == 2
    rows = tables.normalise_prices(df).collect()
    assert rows[0]["open"] is None and rows[1]["close"] is None and rows[0]["symbol"] == "7"
    with pytest.raises(ValueError):
        tables.normalise_prices(df.drop("Close"))
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.xyz")
    store = storage.PriceStore(spark, f"file://{tmp_path}/store")
    px = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 1.0)], "ts timestamp, close double")
    store.save(px, "A", "1h")
    store.save(px.unionByName(px), "B", "1h")
    store.save(px, "B", "1h")
    assert store.load("A", "1h", columns=["close"]).collect()[0][0] == 1.0 and {(r["symbol"], r["rows"]) for r in store.info().collect()} == {("A", 1), ("B", 1)}
    assert store.delete("B", "1h") and not store.delete("B", "1h") and store.info().count() == 1
    with pytest.raises(ValueError):
        adapters.long_legs(spark.createDataFrame([(1, 2.0)], "d int, px_a double"), "d")
    pct = spark.createDataFrame([("a", 1.5), ("a", -2.0), ("b", 0.01), ("b", 0.02)], "k string, r double")
    assert {(r["k"], r["ret"]) for r in adapters.as_returns(pct, "r", ["k"]).collect()} == {("a", 0.015), ("a", -0.02), ("b", 0.01), ("b", 0.02)}


def test_streamed_alarms_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rets = [("a", i, float(v)) for i, v in enumerate(rng.normal(-0.001, 0.01, 300))] + [("b", i, float(v)) for i, v in enumerate(rng.normal(0.002, 0.01, 300))]
    df = spark.createDataFrame(rets, "symbol string, idx long, ret double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.alarms(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 0.002, 0.01)
    got = {(r["symbol"], r["kind"]): r["idx"] for r in streams.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
    want = {r["symbol"]: r["alarm"] for r in evidence.cusum(df, ["symbol"], "ret", F.lit(0.002), F.lit(0.01)).collect()}
    assert got.get(("a", "cusum")) == want["a"] and got.get(("b", "cusum")) == want["b"] and want["a"] is not None


def test_journal_takes_a_row_once(spark, tmp_path):
    path = f"{tmp_path}/journal"
    take = streams.journal(path)
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "symbol string, bar long, v double")
    take(rows, 0)
    take(rows.unionByName(spark.createDataFrame([("a", 3, 3.0)], rows.schema)), 1)
    take(rows.unionByName(spark.createDataFrame([("a", 3, 3.0)], rows.schema)), 1)  # a retry
    assert sorted(r["bar"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_clusters_and_folds(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.95), ("d", "e", 0.1)], "a string, b string, corr double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "symbol string")
    got = {r["symbol"]: r["cluster"] for r in search.clusters(pairs, nodes, 0.8).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
