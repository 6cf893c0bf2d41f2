"""Registered queries on bars, joins, window features, cross-sections and backtests, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import windows as fw
from ..functions import xsection as fx
from ..operators import backtest, bars, joins
from ..sources.tables import HOUR, table, ticks
from .base import BARS, MONTHS, TICKS, WS, full, hourly, monthly, query, r, rank_sql

OHLC = ("open", "high", "low", "close")


@query("bars_time", f"WITH {BARS} SELECT symbol, bar, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM b")
def bars_time(spark, d):
    return hourly(spark, d).select("symbol", "bar", *[r(c).alias(c) for c in OHLC], "n")


@query("bars_arrival_clock", f"""WITH {TICKS} SELECT symbol, arrival_us // 3600000000 AS bar, round(arg_min(price, (arrival_us, event_id)), 6) AS open, round(max(price), 6) AS high,
  round(min(price), 6) AS low, round(arg_max(price, (arrival_us, event_id)), 6) AS close, count(*) AS n FROM ticks GROUP BY ALL""")
def bars_arrival_clock(spark, d):
    return bars.time_bars(ticks(spark, d), HOUR, "arrival_us").select("symbol", "bar", *[r(c).alias(c) for c in OHLC], "n")


@query("bars_equal_count", f"""WITH {TICKS}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1) // 50 AS bar FROM ticks)
SELECT symbol, bar, round(arg_min(price, (us, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (us, event_id)), 6) AS close, count(*) AS n
FROM k GROUP BY symbol, bar""")
def bars_equal_count(spark, d):
    return bars.count_bars(ticks(spark, d), 50).select("symbol", "bar", *[r(c).alias(c) for c in OHLC], "n")


@query("bars_gap_filled", f"""WITH {BARS}, g AS (SELECT symbol, unnest(range(min(bar), max(bar) + 1)) AS bar FROM b GROUP BY symbol),
j AS (SELECT g.symbol, g.bar, open, high, low, close, n, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar) AS l FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.bar = b.bar)
SELECT symbol, bar, round(coalesce(open, l), 6) AS open, round(coalesce(high, l), 6) AS high, round(coalesce(low, l), 6) AS low, round(coalesce(close, l), 6) AS close, coalesce(n, 0) AS n FROM j""")
def bars_gap_filled(spark, d):
    return bars.fill_gaps(hourly(spark, d)).select("symbol", "bar", *[r(c).alias(c) for c in OHLC], "n")


@query("bars_rolled_up", f"""WITH {BARS} SELECT symbol, bar // 24 AS bar, round(arg_min(open, bar), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  round(arg_max(close, bar), 6) AS close, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY symbol, b.bar // 24""")
def bars_rolled_up(spark, d):
    return bars.roll_up(hourly(spark, d), 24).select("symbol", "bar", *[r(c).alias(c) for c in OHLC], "n")


def _asof_sides(spark, d):
    t = ticks(spark, d)
    buys = t.where("symbol = 'purchase'").select("event_id", "user_id", "us")
    views = t.where("symbol = 'view'").select("user_id", F.col("us").alias("v_us"), F.col("price").alias("v_price"))
    return buys, views


@query("asof_events", f"""WITH {TICKS}, p AS (SELECT * FROM ticks WHERE symbol = 'purchase'), v AS (SELECT user_id, us AS v_us, price AS v_price FROM ticks WHERE symbol = 'view')
SELECT p.event_id, v.v_us, round(v.v_price, 6) AS v_price FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us > v.v_us""")
def asof_events(spark, d):
    buys, views = _asof_sides(spark, d)
    return joins.asof(buys, views, ["user_id"], "us", "v_us", ["v_us", "v_price"]).select("event_id", "v_us", r("v_price").alias("v_price"))


@query("asof_events_delay", f"""WITH {TICKS}, p AS (SELECT * FROM ticks WHERE symbol = 'purchase'), v AS (SELECT user_id, us + 3600000000 AS d_us, us AS v_us, price AS v_price FROM ticks WHERE symbol = 'view')
SELECT p.event_id, v.v_us, round(v.v_price, 6) AS v_price FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.d_us""")
def asof_events_delay(spark, d):
    buys, views = _asof_sides(spark, d)
    return joins.asof(buys, views, ["user_id"], "us", "v_us", ["v_us", "v_price"], strict=False, delay=HOUR).select("event_id", "v_us", r("v_price").alias("v_price"))


_SPANS = "s AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)"


def _membership(spark, d):
    o = table(spark, d, "orders")
    spans = o.where("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate"), spans


@query("interval_membership", f"WITH {_SPANS} SELECT o_orderkey, o_custkey FROM orders JOIN s ON k = o_custkey AND o_orderdate BETWEEN a AND z")
def interval_membership(spark, d):
    return joins.within(*_membership(spark, d), ["o_custkey"], "o_orderdate", "a", "z").select("o_orderkey", "o_custkey")


@query("membership_violations", f"WITH {_SPANS} SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM s WHERE k = o_custkey AND o_orderdate BETWEEN a AND z)")
def membership_violations(spark, d):
    return joins.outside(*_membership(spark, d), ["o_custkey"], "o_orderdate", "a", "z").select("o_orderkey", "o_custkey")


@query("benchmark_outer_join", f"""WITH {BARS}, c AS (SELECT bar, avg(close) AS bench FROM b GROUP BY bar), v AS (SELECT * FROM b WHERE symbol = 'view')
SELECT coalesce(c.bar, v.bar) AS bar, round(v.close, 6) AS close, round(c.bench, 6) AS bench FROM c FULL JOIN v ON c.bar = v.bar""")
def benchmark_outer_join(spark, d):
    b = hourly(spark, d)
    bench = b.groupBy("bar").agg(F.avg("close").alias("bench"))
    return bench.join(b.where("symbol = 'view'").select("bar", "close"), "bar", "full").select("bar", r("close").alias("close"), r("bench").alias("bench"))


@query("sma_cross_signal", f"WITH {BARS} SELECT symbol, bar, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS signal FROM b")
def sma_cross_signal(spark, d):
    w, c = fw.by(), F.col("close")
    return hourly(spark, d).select("symbol", "bar", F.when(fw.sma(c, 5, w) > fw.sma(c, 20, w), 1).otherwise(0).alias("signal"))


@query("bollinger", f"""WITH {BARS}, x AS (SELECT symbol, bar, {full('avg', 'close', 20)} AS mid, {full('stddev_samp', 'close', 20)} AS sd FROM b)
SELECT symbol, bar, round(mid - 2 * sd, 6) AS lower, round(mid, 6) AS middle, round(mid + 2 * sd, 6) AS upper FROM x""")
def bollinger(spark, d):
    low, mid, up = fw.bollinger(F.col("close"), 20, 2.0, fw.by())
    return hourly(spark, d).select("symbol", "bar", r(low).alias("lower"), r(mid).alias("middle"), r(up).alias("upper"))


@query("atr", f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({WS})), abs(low - lag(close) OVER ({WS}))) AS tr FROM b)
SELECT symbol, bar, round({full('avg', 'tr', 14)}, 6) AS atr FROM t""")
def atr(spark, d):
    w = fw.by()
    return hourly(spark, d).withColumn("tr", fw.true_range(w)).select("symbol", "bar", r(fw.sma(F.col("tr"), 14, w)).alias("atr"))


@query("stochastic", f"""WITH {BARS}, k AS (SELECT *, 100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS k FROM b)
SELECT symbol, bar, round(k, 6) AS k, round({full('avg', 'k', 3)}, 6) AS d FROM k""")
def stochastic(spark, d):
    w = fw.by()
    rows = hourly(spark, d).withColumn("k", fw.stochastic_k(14, w))
    return rows.select("symbol", "bar", r("k").alias("k"), r(fw.sma(F.col("k"), 3, w)).alias("d"))


@query("rsi_simple", f"""WITH {BARS}, c AS (SELECT *, close - lag(close) OVER ({WS}) AS d FROM b), g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM c)
SELECT symbol, bar, round(100 - 100 / (1 + {full('avg', 'up', 14)} / nullif({full('avg', 'dn', 14)}, 0)), 6) AS rsi FROM g""")
def rsi_simple(spark, d):
    w = fw.by()
    rows = hourly(spark, d).withColumn("d", F.col("close") - F.lag("close").over(w))
    rows = rows.withColumns({"up": F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0))), "dn": F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0)))})
    up, dn = fw.sma(F.col("up"), 14, w), fw.sma(F.col("dn"), 14, w)
    return rows.select("symbol", "bar", r(100 - 100 / (1 + fw.div(up, dn))).alias("rsi"))


@query("roc_zscore", f"""WITH {BARS} SELECT symbol, bar, round(close / nullif(lag(close, 5) OVER ({WS}), 0) - 1, 6) AS roc,
  round((close - {full('avg', 'close', 30)}) / nullif({full('stddev_samp', 'close', 30)}, 0), 6) AS z FROM b""")
def roc_zscore(spark, d):
    w, c = fw.by(), F.col("close")
    return hourly(spark, d).select("symbol", "bar", r(fw.change(c, w, 5)).alias("roc"), r(fw.zscore(c, 30, w)).alias("z"))


@query("crosses_above", f"""WITH {BARS}, x AS (SELECT *, {full('avg', 'close', 5)} AS f, {full('avg', 'close', 20)} AS s FROM b),
y AS (SELECT symbol, bar, f > s AND lag(f) OVER ({WS}) <= lag(s) OVER ({WS}) AS up FROM x) SELECT symbol, bar FROM y WHERE up""")
def crosses_above(spark, d):
    w, c = fw.by(), F.col("close")
    rows = hourly(spark, d).withColumns({"f": fw.sma(c, 5, w), "s": fw.sma(c, 20, w)})
    return rows.withColumn("up", fw.crosses_above(F.col("f"), F.col("s"), w)).where("up").select("symbol", "bar")


@query("donchian", f"WITH {BARS} SELECT symbol, bar, round({full('max', 'high', 20, 1)}, 6) AS upper, round({full('min', 'low', 20, 1)}, 6) AS lower FROM b")
def donchian(spark, d):
    up, low = fw.donchian(20, fw.by())
    return hourly(spark, d).select("symbol", "bar", r(up).alias("upper"), r(low).alias("lower"))


_PAIR = """p AS (SELECT x.bar, 'pair' AS symbol, row_number() OVER (ORDER BY x.bar) - 1 AS idx, ln(x.close) AS y, ln(z.close) AS x FROM b x JOIN b z ON x.bar = z.bar AND x.symbol = 'view' AND z.symbol = 'click')"""


def _pair(spark, d):
    b = hourly(spark, d)
    a, c = b.where("symbol = 'view'").select("bar", F.log("close").alias("y")), b.where("symbol = 'click'").select("bar", F.log("close").alias("x"))
    rows = a.join(c, "bar").withColumn("symbol", F.lit("pair"))
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("symbol").orderBy("bar")) - 1)


_OLSF = f"OVER ({WS} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("rolling_ols_hedge", f"""WITH {BARS}, {_PAIR}, o AS (SELECT bar, count(*) {_OLSF} AS n, covar_samp(y, x) {_OLSF} / nullif(var_samp(x) {_OLSF}, 0) AS slope, avg(y) {_OLSF} AS my, avg(x) {_OLSF} AS mx, y, x FROM p)
SELECT bar, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(y - (my - slope * mx) - slope * x, 6) AS residual FROM o WHERE n >= 60""")
def rolling_ols_hedge(spark, d):
    w = fw.by()
    frame = w.rowsBetween(-59, 0)
    rows = _pair(spark, d).withColumns(
        {"n": F.count("y").over(frame), "slope": fw.div(F.covar_samp("y", "x").over(frame), F.var_samp("x").over(frame)), "my": F.avg("y").over(frame), "mx": F.avg("x").over(frame)}
    )
    rows = rows.where("n >= 60").withColumn("a", F.col("my") - F.col("slope") * F.col("mx"))
    return rows.select("bar", r("slope").alias("slope"), r("a").alias("intercept"), r(F.col("y") - F.col("a") - F.col("slope") * F.col("x")).alias("residual"))


@query("pair_half_life", f"""WITH {BARS}, {_PAIR}, s AS (SELECT idx, y - x AS s, lead(y - x) OVER (ORDER BY idx) - (y - x) AS ds FROM p), f AS (SELECT regr_slope(ds, s) AS k, count(ds) AS n FROM s WHERE ds IS NOT NULL)
SELECT n, round(k, 6) AS slope, round(CASE WHEN k > -1 AND k < 0 THEN -ln(2) / ln(1 + k) END, 6) AS half_life FROM f""")
def pair_half_life(spark, d):
    w = fw.by()
    rows = _pair(spark, d).withColumn("s", F.col("y") - F.col("x")).withColumn("ds", F.lead("s").over(w) - F.col("s")).where("ds IS NOT NULL")
    one = rows.agg(F.regr_slope("ds", "s").alias("k"), F.count("ds").alias("n"))
    return one.select("n", r("k").alias("slope"), r(F.when((F.col("k") > -1) & (F.col("k") < 0), -F.log(F.lit(2.0)) / F.log(1 + F.col("k")))).alias("half_life"))


@query("rolling_beta", f"""WITH {BARS}, x AS (SELECT *, close / nullif(lag(close) OVER ({WS}), 0) - 1 AS ret FROM b), y AS (SELECT *, avg(ret) OVER (PARTITION BY bar) AS mkt FROM x),
z AS (SELECT symbol, bar, count(ret + mkt) {_OLSF} AS n, covar_samp(ret, mkt) {_OLSF} / nullif(var_samp(mkt) {_OLSF}, 0) AS beta FROM y)
SELECT symbol, bar, round(CASE WHEN n >= 60 THEN beta END, 6) AS beta FROM z""")
def rolling_beta(spark, d):
    w = fw.by()
    rows = hourly(spark, d).withColumn("ret", fw.change(F.col("close"), w)).withColumn("mkt", F.avg("ret").over(W.partitionBy("bar")))
    return rows.select("symbol", "bar", r(fw.beta(F.col("ret"), F.col("mkt"), 60, w)).alias("beta"))


_K = "(3 - 2 * sqrt(2::DOUBLE))"


@query("corwin_schultz", f"""WITH {BARS}, x AS (SELECT *, pow(ln(high / low), 2) + pow(ln(lag(high) OVER ({WS}) / lag(low) OVER ({WS})), 2) AS beta, pow(ln(greatest(high, lag(high) OVER ({WS})) / least(low, lag(low) OVER ({WS}))), 2) AS gamma FROM b),
y AS (SELECT symbol, bar, idx, (sqrt(2 * beta) - sqrt(beta)) / {_K} - sqrt(gamma / {_K}) AS a FROM x)
SELECT symbol, bar, round(CASE WHEN idx > 0 THEN greatest(0, 2 * (exp(a) - 1) / (1 + exp(a))) END, 6) AS spread FROM y""")
def corwin_schultz(spark, d):
    w = fw.by()
    h, l, h1, l1 = F.col("high"), F.col("low"), F.lag("high").over(w), F.lag("low").over(w)
    k = 3 - 2 * 2**0.5
    span = lambda a, b: F.pow(fw.ln(fw.quotient(a, b)), 2)
    beta, gamma = span(h, l) + span(h1, l1), span(F.greatest(h, h1), F.least(l, l1))
    rows = hourly(spark, d).withColumn("a", (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k))
    return rows.select("symbol", "bar", r(F.when(F.col("idx") > 0, F.greatest(F.lit(0.0), 2 * (F.exp("a") - 1) / (1 + F.exp("a"))))).alias("spread"))


# Cross-sections on monthly supplier prices


@query("xs_rank_ic", f"""WITH {MONTHS}, v AS (SELECT bar, round(ret, 9) AS s, round(fwd, 9) AS f FROM m WHERE ret IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT bar, {rank_sql('s')} AS x, {rank_sql('f')} AS y FROM v),
g AS (SELECT bar, count(*) AS n, sum(x * y) - sum(x) * sum(y) / count(*) AS c, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM k GROUP BY bar)
SELECT bar, n, round(CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN c / sqrt(vx * vy) END, 6) AS ic FROM g WHERE n >= 3""")
def xs_rank_ic(spark, d):
    panel = monthly(spark, d).select("bar", F.round("ret", 9).alias("s"), F.round("fwd", 9).alias("f"))
    return fx.rank_ic(panel, "s", "f").select("bar", "n", r("ic").alias("ic"))


_LEGS = f"""v AS (SELECT * REPLACE (round(ret, 9) AS ret) FROM m WHERE ret IS NOT NULL), k AS (SELECT *, {rank_sql('ret')} AS rk, count(*) OVER (PARTITION BY bar) AS c FROM v),
q AS (SELECT *, least(4, CAST(floor((rk - 1) / c * 5) AS INTEGER)) AS bucket FROM k)"""


@query("xs_quantile_spread", f"""WITH {MONTHS}, {_LEGS} SELECT bar, bucket, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM q WHERE fwd IS NOT NULL GROUP BY bar, bucket""")
def xs_quantile_spread(spark, d):
    rows = fx.legs(monthly(spark, d).withColumn("ret", F.round("ret", 9)), "ret", 5).where("fwd IS NOT NULL")
    return rows.groupBy("bar", "bucket").agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd")).alias("mean_fwd"))


_WEIGHTS = f"{_LEGS}, w AS (SELECT *, CASE WHEN bucket = 4 THEN 1.0 WHEN bucket = 0 THEN -1.0 ELSE 0 END / count(*) OVER (PARTITION BY bar, bucket) AS weight FROM q)"


@query("xs_long_short", f"""WITH {MONTHS}, {_WEIGHTS} SELECT bar, round(sum(weight * fwd), 6) AS spread, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0 AS net, round(1 / nullif(sum(weight * weight), 0), 6) AS effective FROM w GROUP BY bar""")
def xs_long_short(spark, d):
    rows = fx.legs(monthly(spark, d).withColumn("ret", F.round("ret", 9)), "ret", 5)
    return rows.groupBy("bar").agg(
        r(F.sum(F.col("weight") * F.col("fwd"))).alias("spread"), r(F.sum(F.abs("weight"))).alias("gross"), r(F.sum("weight")).alias("net"),
        r(fw.div(F.lit(1.0), F.sum(F.col("weight") * F.col("weight")))).alias("effective"),
    )


@query("turnover_gross_net", f"""WITH {MONTHS}, {_WEIGHTS}, c AS (SELECT bar, weight, weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY bar), 0) AS dw, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY bar), 0) * ret AS pnl FROM w)
SELECT bar, round(sum(abs(dw)), 6) AS turnover, round(sum(pnl), 6) AS gross, round(sum(pnl) - 0.001 * sum(abs(dw)), 6) AS net FROM c GROUP BY bar""")
def turnover_gross_net(spark, d):
    w = W.partitionBy("symbol").orderBy("bar")
    rows = fx.legs(monthly(spark, d).withColumn("ret", F.round("ret", 9)), "ret", 5).withColumn("before", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    turn, pnl = F.sum(F.abs(F.col("weight") - F.col("before"))), F.sum(F.col("before") * F.col("ret"))
    return rows.groupBy("bar").agg(r(turn).alias("turnover"), r(pnl).alias("gross"), r(pnl - 0.001 * turn).alias("net"))


@query("xs_neutral", f"WITH {MONTHS} SELECT symbol, bar, round(ret - avg(ret) OVER (PARTITION BY bar), 6) + 0 AS ret FROM m WHERE ret IS NOT NULL")
def xs_neutral(spark, d):
    return monthly(spark, d).where("ret IS NOT NULL").select("symbol", "bar", r(fx.neutral("ret", ["bar"])).alias("ret"))


@query("liquid_topk", f"""WITH {MONTHS}, t AS (SELECT *, close * volume AS v FROM m), a AS (SELECT symbol, bar, round(avg(v) OVER ({WS} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS adv FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY bar ORDER BY adv DESC, symbol) AS place FROM a WHERE adv IS NOT NULL) SELECT symbol, bar, place FROM k WHERE place <= 10""")
def liquid_topk(spark, d):
    w = fw.by()
    rows = monthly(spark, d).withColumn("adv", F.round(F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(-6, -1)), 4)).where("adv IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("bar").orderBy(F.desc("adv"), "symbol"))).where("place <= 10").select("symbol", "bar", "place")


@query("xs_momentum_factor", f"""WITH {MONTHS}, s AS (SELECT *, round(lag(close, 1) OVER ({WS}) / nullif(lag(close, 12) OVER ({WS}), 0) - 1, 9) AS mom FROM m), v AS (SELECT * FROM s WHERE mom IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY bar ORDER BY mom DESC, symbol) AS hi, row_number() OVER (PARTITION BY bar ORDER BY mom, symbol) AS lo, greatest(1, CAST(floor(count(*) OVER (PARTITION BY bar) * 0.2) AS BIGINT)) AS n FROM v)
SELECT bar, round(avg(CASE WHEN hi <= n THEN ret END) - avg(CASE WHEN lo <= n THEN ret END), 6) AS factor FROM k GROUP BY bar""")
def xs_momentum_factor(spark, d):
    w, p = fw.by(), W.partitionBy("bar")
    rows = monthly(spark, d).withColumn("mom", F.round(fw.div(F.lag("close", 1).over(w), F.lag("close", 12).over(w)) - 1, 9)).where("mom IS NOT NULL")
    rows = rows.withColumns({
        "hi": F.row_number().over(p.orderBy(F.desc("mom"), "symbol")), "lo": F.row_number().over(p.orderBy("mom", "symbol")),
        "n": F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(p) * 0.2)),
    })
    return rows.groupBy("bar").agg(r(F.avg(F.when(F.col("hi") <= F.col("n"), F.col("ret"))) - F.avg(F.when(F.col("lo") <= F.col("n"), F.col("ret")))).alias("factor"))


# Backtests

_SIGNAL = f"s AS (SELECT *, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS t FROM b)"


def trades_sql(source: str, keys: str, fee: str = "0.0005", slip: str = "0.0005", delay: str = "1", prefix: str = "") -> str:
    """CTEs up to ``{prefix}trades``: the SQL twin of operators.backtest.trades over ``source`` (keys, idx, open, close, t)."""
    w = f"PARTITION BY {keys} ORDER BY idx"
    x = prefix
    return f"""{x}f AS (SELECT {keys}, idx, t, lead(open, {delay}) OVER ({w}) AS px, lead(idx, {delay}) OVER ({w}) AS fill_at, max(idx) OVER (PARTITION BY {keys}) AS fin, last_value(close) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM {source}),
{x}g AS (SELECT *, CASE WHEN lag(t) OVER ({w}) IS NOT DISTINCT FROM t AND row_number() OVER ({w}) > 1 THEN 0 ELSE 1 END AS nw FROM {x}f WHERE px IS NOT NULL),
{x}h AS (SELECT *, sum(nw) OVER ({w}) AS run FROM {x}g),
{x}i AS (SELECT {keys}, run, any_value(t) AS side, arg_min(px, idx) AS px, min(fill_at) AS fill_at, any_value(fin) AS fin, any_value(final) AS final FROM {x}h GROUP BY ALL),
{x}j AS (SELECT *, lead(px) OVER (PARTITION BY {keys} ORDER BY run) AS xp, lead(fill_at) OVER (PARTITION BY {keys} ORDER BY run) AS xa FROM {x}i),
{x}k AS (SELECT {keys}, side, fill_at AS entry_idx, coalesce(xa, fin) AS exit_idx, px * (1 + side * {slip}) AS entry_px, coalesce(xp, final) * (1 - side * {slip}) AS exit_px FROM {x}j WHERE side <> 0),
{x}trades AS (SELECT *, 1 - side - {fee} + side * exit_px / entry_px - exit_px / entry_px * {fee} AS factor FROM {x}k)"""


_TOTAL = "count(*) AS n_trades, count(*) FILTER (factor > 1) AS n_wins, round(sum(ln(CASE WHEN factor > 0 THEN factor END)), 6) AS log_return, count(*) FILTER (factor <= 0) AS n_ruined"


def _signals(spark, d, fast=5, slow=20):
    w, c = fw.by(), F.col("close")
    return hourly(spark, d).withColumn("t", F.when(fw.sma(c, fast, w) > fw.sma(c, slow, w), 1).otherwise(0))


@query("backtest_trades", f"WITH {BARS}, {_SIGNAL}, {trades_sql('s', 'symbol')} SELECT symbol, side, entry_idx, exit_idx, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, round(factor, 6) AS factor FROM trades")
def backtest_trades(spark, d):
    found = backtest.trades(_signals(spark, d), "t", ["symbol"])
    return found.select("symbol", "side", "entry_idx", "exit_idx", r("entry_px").alias("entry_px"), r("exit_px").alias("exit_px"), r("factor").alias("factor"))


@query("backtest_total_return", f"WITH {BARS}, {_SIGNAL}, {trades_sql('s', 'symbol')} SELECT symbol, {_TOTAL} FROM trades GROUP BY symbol")
def backtest_total_return(spark, d):
    return backtest.totals(backtest.trades(_signals(spark, d), "t", ["symbol"]), ["symbol"]).withColumn("log_return", r("log_return")).drop("total_return")


@query("delay_scan", "WITH " + BARS + ", " + _SIGNAL + ", " + ", ".join(trades_sql("s", "symbol", delay=str(k), prefix=f"d{k}") for k in (1, 2, 3, 5))
       + " " + " UNION ALL ".join(f"SELECT symbol, {k} AS delay, {_TOTAL} FROM d{k}trades GROUP BY symbol" for k in (1, 2, 3, 5)))
def delay_scan(spark, d):
    """Totals when fills come later: a signal that only works at once is suspect."""
    rows, out = _signals(spark, d), None
    for k in (1, 2, 3, 5):
        one = backtest.totals(backtest.trades(rows, "t", ["symbol"], delay=k), ["symbol"]).select("symbol", F.lit(k).alias("delay"), "n_trades", "n_wins", r("log_return").alias("log_return"), "n_ruined")
        out = one if out is None else out.unionByName(one)
    return out


@query("cost_ladder", f"""WITH {BARS}, {_SIGNAL}, {trades_sql('s', 'symbol', '0', '0')}, c AS (SELECT unnest([0, 5, 10, 20, 50]) AS bps),
x AS (SELECT symbol, bps, 1 - side - bps / 1e4 + side * exit_px / entry_px - exit_px / entry_px * bps / 1e4 AS factor FROM trades, c) SELECT symbol, bps, {_TOTAL} FROM x GROUP BY symbol, bps""")
def cost_ladder(spark, d):
    rows = backtest.trades(_signals(spark, d), "t", ["symbol"], fee=0.0, slippage=0.0)
    rows = rows.withColumn("bps", F.explode(F.array(*[F.lit(x) for x in (0, 5, 10, 20, 50)])))
    fee = F.col("bps") / 1e4
    ratio = F.col("exit_px") / F.col("entry_px")
    rows = rows.withColumn("factor", 1 - F.col("side") - fee + F.col("side") * ratio - ratio * fee)
    return backtest.totals(rows, ["symbol", "bps"]).withColumn("log_return", r("log_return")).drop("total_return")


_GRID = [(f, s) for f in (3, 5, 8) for s in (10, 20, 30)]
_SWEEP = ("x AS (SELECT *, " + ", ".join(f"{full('avg', 'close', n)} AS a{n}" for n in sorted({n for p in _GRID for n in p})) + " FROM b), s AS ("
          + " UNION ALL ".join(f"SELECT symbol, {f} AS fast, {s} AS slow, idx, bar, open, close, CASE WHEN a{f} > a{s} THEN 1 ELSE 0 END AS t FROM x" for f, s in _GRID) + ")")


def _sweep(spark, d):
    """Every pair's signal in one pass: each distinct mean once, then a row for each pair."""
    w, c = fw.by(), F.col("close")
    rows = hourly(spark, d).withColumns({f"a{n}": fw.sma(c, n, w) for n in sorted({n for p in _GRID for n in p})})
    pairs = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.when(F.col(f"a{f}") > F.col(f"a{s}"), 1).otherwise(0).alias("t")) for f, s in _GRID])
    return rows.select("symbol", "idx", "bar", "open", "close", F.inline(pairs))


_KEYS = "symbol, fast, slow"


def _swept(spark, d):
    return backtest.sma_sweep(hourly(spark, d), "symbol", _GRID)


@query("sma_sweep", f"WITH {BARS}, {_SWEEP}, {trades_sql('s', _KEYS)} SELECT {_KEYS}, {_TOTAL} FROM trades GROUP BY {_KEYS}")
def sma_sweep(spark, d):
    keys = ["symbol", "fast", "slow"]
    return backtest.totals(_swept(spark, d), keys).withColumn("log_return", r("log_return")).drop("total_return")


@query("sma_sweep_topk", f"""WITH {BARS}, {_SWEEP}, {trades_sql('s', _KEYS)}, z AS (SELECT {_KEYS}, {_TOTAL} FROM trades GROUP BY {_KEYS}),
top AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY log_return DESC, fast, slow) AS place FROM z) SELECT {_KEYS}, log_return, place FROM top WHERE place <= 3""")
def sma_sweep_topk(spark, d):
    keys = ["symbol", "fast", "slow"]
    rows = backtest.totals(_swept(spark, d), keys).withColumn("log_return", r("log_return")).drop("total_return")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("log_return"), "fast", "slow"))).where("place <= 3").select(*keys, "log_return", "place")


@query("walk_forward_pick", f"""WITH {BARS}, {_SWEEP}, {trades_sql('s', _KEYS)}, c AS (SELECT symbol, max(idx) + 1 AS n FROM b GROUP BY symbol),
y AS (SELECT t.*, CAST(floor(entry_idx * 4.0 / n) AS INTEGER) AS fold FROM trades t JOIN c USING (symbol)), z AS (SELECT {_KEYS}, fold, round(sum(ln(factor)), 6) AS lr FROM y WHERE factor > 0 GROUP BY {_KEYS}, fold),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY lr DESC, fast, slow) AS place FROM z)
SELECT p.symbol, p.fold + 1 AS fold, p.fast, p.slow, p.lr AS train, z.lr AS test FROM p LEFT JOIN z ON z.symbol = p.symbol AND z.fast = p.fast AND z.slow = p.slow AND z.fold = p.fold + 1 WHERE p.place = 1 AND p.fold < 3""")
def walk_forward_pick(spark, d):
    """The best pair of each quarter of a symbol's bars, and what it made in the next."""
    keys = ["symbol", "fast", "slow"]
    found = backtest.trades(_sweep(spark, d), "t", keys)
    size = hourly(spark, d).groupBy("symbol").agg((F.max("idx") + 1).alias("n"))
    rows = found.join(size, "symbol").where("factor > 0").withColumn("fold", F.floor(F.col("entry_idx") * 4.0 / F.col("n")).cast("int"))
    made = rows.groupBy(*keys, "fold").agg(F.round(F.sum(F.log("factor")), 6).alias("lr"))
    best = made.withColumn("place", F.row_number().over(W.partitionBy("symbol", "fold").orderBy(F.desc("lr"), "fast", "slow"))).where("place = 1 AND fold < 3")
    nxt = made.select(*keys, F.col("fold").alias("fold_"), F.col("lr").alias("test"))
    best = best.select(*keys, (F.col("fold") + 1).alias("fold"), F.col("lr").alias("train"))
    return best.join(nxt.withColumnRenamed("fold_", "fold"), [*keys, "fold"], "left").select("symbol", "fold", "fast", "slow", "train", "test")


@query("plateau_neighbours", f"""WITH {BARS}, {_SWEEP}, {trades_sql('s', _KEYS)}, z AS (SELECT {_KEYS}, {_TOTAL}, dense_rank() OVER (ORDER BY fast) AS i, dense_rank() OVER (ORDER BY slow) AS j FROM trades GROUP BY {_KEYS})
SELECT a.symbol, a.fast, a.slow, a.log_return, count(b.fast) AS n, round(avg(b.log_return), 6) AS around FROM z a LEFT JOIN z b ON a.symbol = b.symbol AND abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY ALL""")
def plateau_neighbours(spark, d):
    keys = ["symbol", "fast", "slow"]
    rows = backtest.totals(_swept(spark, d), keys).withColumn("log_return", r("log_return")).drop("total_return")
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in sorted({p[0 if c == "fast" else 1] for p in _GRID})]), F.col(c))
    rows = rows.withColumns({"i": place("fast"), "j": place("slow")})
    # each row is sent to its four neighbours' places: an equality join
    moves = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sent = rows.select("symbol", "i", "j", F.col("log_return").alias("near"), F.inline(moves)).select("symbol", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "near")
    return rows.join(sent, ["symbol", "i", "j"], "left").groupBy(*keys, "log_return").agg(F.count("near").alias("n"), r(F.avg("near")).alias("around"))
