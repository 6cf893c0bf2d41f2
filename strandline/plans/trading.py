"""Registered options checks, expression trees, probes, order matching, evidence rows, adapters and streams, with their SQL twins."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dsl, normal, recursive
from ..functions import windows as fw
from ..operators import evidence, options, orders, probes, stats
from ..sources import adapters
from ..sources.scratch import ensure_checkpoints
from ..sources.tables import HOUR, table, ticks
from ..streaming import bars as sb
from .base import BARS, MONTHS, TICKS, WS, full, hourly, monthly, query, r
from .features import _ema_sql
from .market import OHLC
from .resampling import RC, h, plain
from .stats import RETS, _pick, returns

# Options: each order line as an option trade on its part


_OPT = """op AS (SELECT l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS trade_id, l_partkey % 20 AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) + CAST(5 + l_partkey % 60 AS INTEGER) AS expiry,
  CASE WHEN l_linenumber % 2 = 1 THEN 'C' ELSE 'P' END AS "right", round(p_retailprice * (0.7 + (l_orderkey % 7) / 10.0::DOUBLE), 2) AS strike, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END AS qty, 100 AS multiplier, round(p_retailprice * (2 + l_orderkey % 5) / 100, 2) AS mid,
  (l_orderkey % 4) / 40.0::DOUBLE AS edge, l_orderkey % 3 AS kind, l_tax AS tax, l_discount AS disc, 0.15 + (l_partkey % 7) / 20.0::DOUBLE AS iv_used, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 10 - 8 AS INTEGER) AS iv_asof, p_retailprice AS underlying_price FROM lineitem JOIN part ON p_partkey = l_partkey),
opt AS (SELECT *, mid * 0.98 AS bid, mid * 1.02 AS ask, CASE WHEN kind = 0 THEN mid WHEN kind = 1 THEN mid * (1 + 0.02 * sign(qty)) ELSE mid * (1 - edge / 10 * sign(qty)) END AS fill_price, mid * (1 + tax - disc) AS exit_price FROM op)"""


def option_trades(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    date, k = F.col("l_shipdate").cast("date"), F.col("l_orderkey")
    mid = F.round(F.col("p_retailprice") * (2 + k % 5) / 100, 2)
    rows = rows.select(
        (F.col("l_orderkey") * 100_000 + F.row_number().over(own)).alias("trade_id"), (F.col("l_partkey") % 20).alias("symbol"), date.alias("date"), F.date_add(date, (5 + F.col("l_partkey") % 60).cast("int")).alias("expiry"),
        F.when(F.col("l_linenumber") % 2 == 1, "C").otherwise("P").alias("right"), F.round(F.col("p_retailprice") * (0.7 + (k % 7) / 10.0), 2).alias("strike"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("qty"), F.lit(100).alias("multiplier"), mid.alias("mid"), ((k % 4) / 40.0).alias("edge"), (k % 3).alias("kind"),
        (0.15 + (F.col("l_partkey") % 7) / 20.0).alias("iv_used"), F.date_add(date, (k % 10 - 8).cast("int")).alias("iv_asof"), F.col("p_retailprice").alias("underlying_price"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"),
    )
    m, s = F.col("mid"), F.signum("qty")
    fill = F.when(F.col("kind") == 0, m).when(F.col("kind") == 1, m * (1 + 0.02 * s)).otherwise(m * (1 - F.col("edge") / 10 * s))
    return rows.withColumns({"bid": m * 0.98, "ask": m * 1.02, "fill_price": fill, "exit_price": m * (1 + F.col("tax") - F.col("disc"))})


@query("option_fill_summary", f"""WITH {_OPT}, f AS (SELECT *, qty * multiplier * (exit_price - fill_price) AS reported, qty * multiplier * (CASE WHEN qty > 0 THEN exit_price - (ask - bid) / 2 ELSE exit_price + (ask - bid) / 2 END - CASE WHEN qty > 0 THEN ask ELSE bid END) AS touch,
  CASE WHEN qty > 0 THEN fill_price - (ask + bid) / 2 ELSE (ask + bid) / 2 - fill_price END AS paid FROM opt), g AS (SELECT symbol, count(*) AS n, sum(reported) AS reported, sum(touch) AS touch, avg(CASE WHEN paid < -1e-9 THEN 1.0 ELSE 0 END) AS better, avg(CASE WHEN paid <= 0.05 * greatest((ask - bid) / 2, 1e-12) THEN 1.0 ELSE 0 END) AS at_mid FROM f GROUP BY symbol)
SELECT symbol, n, round(reported, 2) AS reported, round(touch, 2) AS touch, round(better, 6) AS better, round(at_mid, 6) AS at_mid, CASE WHEN (reported > 0 AND touch <= 0) OR better > 0.2 THEN 'fail' WHEN at_mid > 0.5 THEN 'warn' ELSE 'pass' END AS status FROM g""")
def option_fill_summary(spark, d):
    one = options.fill_summary(option_trades(spark, d), ["symbol"])
    return one.select("symbol", "n", r("reported", 2).alias("reported"), r("touch", 2).alias("touch"), r("better").alias("better"), r("at_mid").alias("at_mid"), "status")


@query("option_future_volatility", f"WITH {_OPT} SELECT trade_id, CAST(iv_asof - date AS INTEGER) AS days FROM opt WHERE iv_asof > date")
def option_future_volatility(spark, d):
    return options.future_volatility(option_trades(spark, d)).select("trade_id", "days")


_D1 = options.d1_sql("underlying_price", "strike", "t", "iv_used")
_PX = options.price_sql("underlying_price", "strike", "t", "iv_used", "\"right\" = 'C'", "d1")


@query("option_prices", f"""WITH {_OPT}, t AS (SELECT *, date_diff('day', date, expiry) / 365.0::DOUBLE AS t FROM opt), dd AS (SELECT *, CASE WHEN t > 0 AND iv_used > 0 THEN {_D1} END AS d1 FROM t) SELECT trade_id, round({_PX}, 4) + 0 AS price, round({options.gamma_sql('underlying_price', 't', 'iv_used', 'd1')}, 8) AS gamma FROM dd""")
def option_prices(spark, d):
    rows = options.priced(option_trades(spark, d).withColumn("t", F.datediff("expiry", "date") / 365.0))
    return rows.select("trade_id", r("price", 4).alias("price"), r("gamma", 8).alias("gamma"))


_SNAP = f"{_OPT}, dy AS (SELECT DISTINCT date AS now FROM opt), sn AS (SELECT opt.*, now FROM opt JOIN dy ON date <= now AND now < expiry)"


@query("option_margin", f"""WITH {_OPT}, sh AS (SELECT *, arg_max(underlying_price, (date, trade_id)) OVER (PARTITION BY now, symbol) AS s0 FROM (SELECT * FROM opt WHERE qty < 0) o2 JOIN (SELECT DISTINCT date AS now FROM opt WHERE qty < 0) d2 ON o2.date <= now AND now < expiry)
SELECT CAST(now AS VARCHAR) AS now, round(sum((greatest(0.2 * s0 - greatest(0, CASE WHEN "right" = 'C' THEN strike - s0 ELSE s0 - strike END), 0.1 * CASE WHEN "right" = 'C' THEN s0 ELSE strike END) + fill_price) * -qty * multiplier), 4) AS margin FROM sh GROUP BY now""")
def option_margin(spark, d):
    return _pick(options.margin(option_trades(spark, d)).withColumn("now", F.col("now").cast("string")), ["now"], "margin", digits=4)


@query("option_stress", f"""WITH {_SNAP}, kn AS (SELECT now, symbol, arg_max(underlying_price, (date, trade_id)) AS s0 FROM sn GROUP BY ALL), x AS (SELECT sn.*, s0, date_diff('day', now, expiry) / 365.0::DOUBLE AS t FROM sn JOIN kn USING (now, symbol)),
sc AS (SELECT x.*, j, s0 * (1 + move) AS s1, iv_used * vol AS v1 FROM x, (VALUES (-1, 0.0::DOUBLE, 1.0::DOUBLE), (0, -0.2::DOUBLE, 2.0::DOUBLE), (1, 0.2::DOUBLE, 2.0::DOUBLE)) v(j, move, vol)), d1 AS (SELECT *, {options.d1_sql('s1', 'strike', 't', 'v1')} AS d1 FROM sc),
pr AS (SELECT *, {options.price_sql('s1', 'strike', 't', 'v1', '"right" = ' + "'C'", 'd1')} AS px, {options.gamma_sql('s1', 't', 'v1', 'd1')} AS gm FROM d1), ag AS (SELECT now, trade_id, any_value(qty * multiplier) AS size, any_value(s0) AS s0, max(px) FILTER (j = -1) AS p, max(px) FILTER (j = 0) AS p0, max(px) FILTER (j = 1) AS p1, max(gm) FILTER (j = -1) AS g FROM pr GROUP BY now, trade_id)
SELECT CAST(now AS VARCHAR) AS now, round(sum(size * g * s0 * s0 * 0.01), 0) + 0 AS gamma, round(least(0, sum(size * (p0 - p)), sum(size * (p1 - p))), 0) + 0 AS worst FROM ag GROUP BY now""")
def option_stress(spark, d):
    return _pick(options.stress(option_trades(spark, d)).withColumn("now", F.col("now").cast("string")), ["now"], "gamma", "worst", digits=0)


@query("option_event_risks", f"""WITH {_OPT}, e AS (SELECT *, CASE WHEN trade_id % 4 = 0 THEN date + 10 END AS ex, CASE WHEN trade_id % 8 = 0 THEN 1.0 END AS dividend, strike * (1 + (trade_id % 9 - 4) / 500.0::DOUBLE) AS ue, CASE WHEN trade_id % 2 = 0 THEN 'American' ELSE 'european' END AS style FROM opt WHERE qty < 0)
SELECT count(*) AS short_trades, count(*) FILTER ("right" = 'C' AND ex BETWEEN date AND expiry) AS over_dividend, count(*) FILTER ("right" = 'C' AND ex BETWEEN date AND expiry AND dividend IS NULL) AS amount_missing, count(*) FILTER (abs(ue - strike) / strike < 0.005) AS pinned, count(*) FILTER ("right" = 'P' AND lower(style) = 'american' AND underlying_price < 0.8 * strike) AS deep_puts FROM e""")
def option_event_risks(spark, d):
    i = F.col("trade_id")
    rows = option_trades(spark, d).withColumns({
        "ex_div_date": F.when(i % 4 == 0, F.date_add("date", 10)), "dividend": F.when(i % 8 == 0, 1.0), "underlying_at_expiry": F.col("strike") * (1 + (i % 9 - 4) / 500.0), "style": F.when(i % 2 == 0, "American").otherwise("european"),
    })
    return options.event_risks(rows)


# Expression trees


_TREES = {"a": ("zscore", ("sub", "close", ("sma", "close", 5)), 20), "b": ("div", ("std", "ret", 10), ("abs", ("lag", "range", 1))), "c": ("mul", ("sign", ("diff", "close", 3)), ("roc", "high", 4))}


@query("dsl_features", f"""WITH {BARS}, d0 AS (SELECT *, close - {full('avg', 'close', 5)} AS e, close / nullif(lag(close) OVER ({WS}), 0) - 1 AS ret, (high - low) / nullif(close, 0) AS rng FROM b), d1 AS (SELECT *, lag(rng, 1) OVER ({WS}) AS lr FROM d0)
SELECT symbol, bar, round((e - {full('avg', 'e', 20)}) / nullif({full('stddev_samp', 'e', 20)}, 0), 5) + 0 AS a, round({full('stddev_samp', 'ret', 10)} / CASE WHEN abs(lr) > 1e-12 THEN abs(lr) END, 4) + 0 AS b, round(sign(close - lag(close, 3) OVER ({WS})) * (high / nullif(lag(high, 4) OVER ({WS}), 0) - 1), 5) + 0 AS c FROM d1""")
def dsl_features(spark, d):
    out = dsl.evaluate(hourly(spark, d), _TREES)
    return out.select("symbol", "bar", r("a", 5).alias("a"), r("b", 4).alias("b"), r("c", 5).alias("c"))


@query("dsl_rule", f"""WITH RECURSIVE {BARS}, {_ema_sql('e', 'b', 'close', '(2.0::DOUBLE / 9)')}, j AS (SELECT symbol, idx, bar, e.y FROM e JOIN b USING (symbol, idx)) SELECT symbol, bar, CASE WHEN y > {full('avg', 'y', 10)} THEN 1 ELSE 0 END AS signal FROM j""")
def dsl_rule(spark, d):
    return dsl.rule(hourly(spark, d), ("ema", "close", 8), 10).select("symbol", "bar", "signal")


# Probes


def _cross(c):
    """A causal signal: two trailing means, by prefix sums."""
    def mean(x, n):
        out = np.full(len(x), np.nan)
        s = np.cumsum(np.append(0.0, x))
        out[n - 1 :] = (s[n:] - s[:-n]) / n
        return out

    return np.nan_to_num((mean(c["close"], 5) > mean(c["close"], 20)).astype(float))


def _peek(c):
    """A signal that reads the next close."""
    return np.append(np.sign(np.diff(c["close"])), 0.0)


#: What probes must find, by reasoning: a mean of the past says the same on every prefix; the sign of the next close is lost at the
#: last bar of a prefix, and turned over where the future is mirrored, wherever it is not zero.
_PROBED = f"""{BARS}, ps AS (SELECT 'causal' AS signal, symbol, idx, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS p FROM b UNION ALL SELECT 'peeking', symbol, idx, coalesce(sign(lead(close) OVER ({WS}) - close), 0) FROM b),
sz AS (SELECT symbol, count(*) AS n, greatest(2, count(*) // 10) AS lo FROM b GROUP BY symbol HAVING count(*) - 2 > greatest(2, count(*) // 10)), ev AS (SELECT signal, symbol, CAST(floor(lo + i * (n - 2 - lo) / 7) AS BIGINT) AS place FROM sz, (SELECT unnest(range(8)) AS i), (SELECT unnest(['causal', 'peeking']) AS signal)),
mv AS (SELECT * FROM (SELECT *, lag(p) OVER (PARTITION BY signal, symbol ORDER BY idx) AS old FROM ps) JOIN sz USING (symbol) WHERE old <> p AND idx BETWEEN lo AND n - 2), mk AS (SELECT *, row_number() OVER (PARTITION BY signal, symbol ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY signal, symbol) AS cnt FROM mv),
cp AS (SELECT * FROM ev UNION SELECT signal, symbol, idx FROM mk WHERE k % greatest(1, CAST(ceil(cnt / 8) AS BIGINT)) = 0), x AS (SELECT cp.*, signal = 'peeking' AND p <> 0 AS bad FROM cp JOIN ps USING (signal, symbol) WHERE ps.idx = cp.place)
SELECT symbol, count(*) AS checkpoints, count(*) FILTER (bad) AS mismatches, min(CASE WHEN bad THEN place END) AS first_bar, CASE WHEN bool_or(bad) THEN 'fail' ELSE 'pass' END AS status, signal FROM x GROUP BY symbol, signal"""


@query("probe_truncation", f"WITH {_PROBED}")
def probe_truncation(spark, d):
    b = hourly(spark, d)
    return probes.truncation(b, _cross).withColumn("signal", F.lit("causal")).unionByName(probes.truncation(b, _peek).withColumn("signal", F.lit("peeking")))


@query("probe_perturbation", f"WITH {_PROBED}")
def probe_perturbation(spark, d):
    b = hourly(spark, d)
    return probes.perturbation(b, _cross).withColumn("signal", F.lit("causal")).unionByName(probes.perturbation(b, _peek).withColumn("signal", F.lit("peeking")))


@query("probe_determinism", f"WITH {BARS} SELECT symbol, CAST(0 AS BIGINT) AS differing FROM b GROUP BY symbol")
def probe_determinism(spark, d):
    return probes.determinism(hourly(spark, d), _cross)


@query("probe_stored_answer", f"""WITH {BARS}, x AS (SELECT symbol, idx, close, ln(close / lag(close) OVER ({WS})) AS rr FROM b), y AS (SELECT *, least(coalesce(stddev_samp(rr) OVER (PARTITION BY symbol), 0.01), 0.05) * {normal.ppf_sql('((' + h("'1'", 'symbol', 'idx') + ' + 0.5) / 4294967296)')} AS l FROM x), z AS (SELECT *, 100 * exp(sum(l) OVER ({WS})) AS other FROM y),
q AS (SELECT symbol, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS p, CASE WHEN {full('avg', 'other', 5)} > {full('avg', 'other', 20)} THEN 1 ELSE 0 END AS o FROM z) SELECT symbol, round(avg(CASE WHEN p = o THEN 1.0 ELSE 0 END), 6) AS same, CASE WHEN avg(CASE WHEN p = o THEN 1.0 ELSE 0 END) >= 0.999 AND count(DISTINCT p) > 1 THEN 'fail' ELSE 'pass' END AS status FROM q GROUP BY symbol""")
def probe_stored_answer(spark, d):
    return probes.stored_answer(hourly(spark, d), _cross).withColumn("same", r("same"))


@query("implausible_accuracy", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN idx % 10 < 8 THEN sign(lead(close) OVER ({WS}) - lead(open) OVER ({WS})) ELSE -1 END AS t, lead(close) OVER ({WS}) - lead(open) OVER ({WS}) AS mv FROM b),
g AS (SELECT symbol, count(*) AS active, count(*) FILTER (sign(t) = sign(mv)) AS hits FROM s WHERE t <> 0 AND mv <> 0 GROUP BY symbol), z AS (SELECT *, hits / active AS rate, (hits / active - 0.5) / sqrt(0.25 / active) AS z FROM g)
SELECT symbol, active, hits, round(rate, 6) AS rate, round(z, 6) AS z, CASE WHEN rate >= 0.7 AND z >= 3.5 AND active >= 100 THEN 'fail' ELSE 'pass' END AS status FROM z""")
def implausible_accuracy(spark, d):
    w = fw.by()
    peek = F.signum(F.lead("close").over(w) - F.lead("open").over(w))
    rows = hourly(spark, d).withColumn("t", F.when(F.col("idx") % 10 < 8, peek).otherwise(-1.0))
    out = probes.implausible(rows, "t")
    return out.select("symbol", "active", "hits", r("rate").alias("rate"), r("z").alias("z"), "status")


# Orders


@query("l2_book_walk", f"""WITH {TICKS}, o AS (SELECT event_id, price, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, 1.0::DOUBLE + latency_ms / 7.0::DOUBLE AS qty FROM ticks), l AS (SELECT o.*, k, price * (1 + side * 0.0002::DOUBLE * (k + 0.5::DOUBLE)) AS px, 2.0::DOUBLE * (k + 1) AS size FROM o, (SELECT unnest(range(4)) AS k)),
t AS (SELECT *, CASE WHEN side * px <= side * price * (1 + side * 0.0006::DOUBLE) THEN least(size, greatest(0, qty - coalesce(sum(size) OVER (PARTITION BY event_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS take FROM l)
SELECT event_id, round(filled, 10) AS filled, round(cost / nullif(filled, 0), 10) AS vwap, round(cost * 5 / 10000, 10) AS fee, n_levels FROM (SELECT event_id, CAST(count(*) FILTER (take > 0) AS INTEGER) AS n_levels,
  {' + '.join(f'max(take) FILTER (k = {k})' for k in range(4))} AS filled, {' + '.join(f'max(take * px) FILTER (k = {k})' for k in range(4))} AS cost FROM t GROUP BY event_id)""")
def l2_book_walk(spark, d):
    e = F.col("event_id")
    side = F.when(e % 2 == 0, 1).otherwise(-1)
    rows = ticks(spark, d).select("event_id", "price", side.alias("side"), (1.0 + F.col("latency_ms") / 7.0).alias("qty"))
    up, down = (orders.book_levels(F.col("price"), 2.0, 4, F.lit(2.0), s) for s in (1, -1))
    rows = rows.withColumns({"levels": F.when(F.col("side") > 0, up).otherwise(down), "limit": F.col("price") * (1 + F.col("side") * 0.0006)})
    return _pick(orders.walk_book(rows, "levels", "limit"), ["event_id", "n_levels"], "filled", "vwap", "fee", digits=10)


def _order_rows(spark, d):
    """A limit order on every bar, some with a bracket, some immediate or cancel."""
    i, c = F.col("idx"), F.col("close")
    side = F.when(i % 2 == 0, 1).otherwise(-1)
    rows = hourly(spark, d).select("symbol", i.cast("long").alias("placed"), side.alias("side"), F.lit(10.0).alias("qty"), c.alias("c"), F.xxhash64("symbol", "idx").alias("order_id"))
    s = F.col("side")
    return rows.withColumns({
        "limit_px": F.when(F.col("placed") % 3 != 0, F.col("c") * (1 - s * 0.2)), "stop_px": F.when(F.col("placed") % 5 == 0, F.col("c") * (1 - s * 0.6)), "take_px": F.when(F.col("placed") % 5 == 0, F.col("c") * (1 + s * 0.6)),
        "tif": F.when(F.col("placed") % 4 == 0, "IOC").otherwise("GTC"),
    })


@query("order_matching")
def order_matching(spark, d):
    found = orders.match(_order_rows(spark, d), hourly(spark, d), most_per_bar=6.0)
    return found.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"), r(F.sum("qty"), 4).alias("qty"), r(F.sum("fee"), 4).alias("fee"))


_FILLED = "fl AS (SELECT l_suppkey AS account, CAST(l_partkey % 5 AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END AS qty, l_extendedprice / l_quantity AS price, l_tax AS fee FROM lineitem)"


def _account_fills(spark, d, *more):
    w = W.partitionBy("account").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")  # by its new name, so that what follows finds accounts together
    return table(spark, d, "lineitem").withColumn("account", F.col("l_suppkey")).select(
        "account", (F.col("l_partkey") % 5).cast("string").alias("symbol"), F.row_number().over(w).alias("seq"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fee"), *more,
    )


@query("account_netting", f"""WITH RECURSIVE {_FILLED}, nf AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY seq) AS k FROM fl), st AS (SELECT account, symbol, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS held, 0.0::DOUBLE AS px, 0.0::DOUBLE AS rl, 0.0::DOUBLE AS cash FROM nf WHERE k = 1
UNION ALL SELECT st.account, st.symbol, nf.k, held + qty, CASE WHEN held * qty >= 0 THEN CASE WHEN held + qty = 0 THEN 0 ELSE (abs(held) * px + abs(qty) * price) / abs(held + qty) END WHEN abs(held + qty) < 1e-12 THEN 0 WHEN (held + qty) * held < 0 THEN price ELSE px END,
  rl + CASE WHEN held * qty < 0 THEN least(abs(held), abs(qty)) * (price - px) * sign(held) ELSE 0 END, cash - qty * price - fee FROM st JOIN nf ON nf.account = st.account AND nf.symbol = st.symbol AND nf.k = st.k + 1)
SELECT account, symbol, round(arg_max(held, k), 4) + 0 AS qty, round(arg_max(px, k), 4) + 0 AS avg_px, round(arg_max(rl, k), 3) + 0 AS realized, round(arg_max(cash, k), 3) + 0 AS cash FROM st GROUP BY ALL""")
def account_netting(spark, d):
    out = orders.net(_account_fills(spark, d), "account", "seq")
    return out.select("account", "symbol", r("qty", 4).alias("qty"), r("avg_px", 4).alias("avg_px"), r("realized", 3).alias("realized"), r("cash", 3).alias("cash"))


@query("fill_reconciliation", """WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q1, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS p1 FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1),
v AS (SELECT l_orderkey AS k, sum(l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS q2, sum((l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END) * l_extendedprice * CASE WHEN l_orderkey % 17 = 0 THEN 1.01 ELSE 1 END) / sum(l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS p2 FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.k, v.k) AS k, q1, q2, p1, p2 FROM a FULL JOIN v ON a.k = v.k), p AS (SELECT k, CASE WHEN q1 IS NULL THEN 'missing_local' WHEN q2 IS NULL THEN 'missing_venue' WHEN abs(q1 - q2) > 1e-9 THEN 'qty' WHEN abs(p1 - p2) > 0.001 THEN 'price' END AS problem FROM j) SELECT problem, count(*) AS n, CAST(sum(k) AS BIGINT) AS mark FROM p WHERE problem IS NOT NULL GROUP BY problem""")
def fill_reconciliation(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    k = F.col("k")
    other = li.where(k % 7 != 0).withColumns({"qty": F.col("qty") + F.when(k % 13 == 0, 1).otherwise(0), "price": F.col("price") * F.when(k % 17 == 0, 1.01).otherwise(1.0)})
    found = orders.reconcile(li.where(k % 11 != 0), other, "k", px_tol=0.001)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("mark"))


# Evidence


_CHECKS = f"""{RETS}, g AS (SELECT symbol, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM rets WHERE ret IS NOT NULL GROUP BY symbol), e1 AS (SELECT symbol, exp(sum(ln(1 + ret)) OVER ({WS})) AS eq, idx FROM rets WHERE ret IS NOT NULL),
e2 AS (SELECT symbol, 1 - eq / greatest(1, max(eq) OVER ({WS})) AS dd FROM e1), mx AS (SELECT symbol, max(dd) AS dd FROM e2 GROUP BY symbol), sp AS (SELECT symbol, round(m / nullif(sd, 0), 9) AS sharpe, n, round(dd, 9) AS dd FROM g JOIN mx USING (symbol)),
ck AS (SELECT symbol, unnest(['drawdown', 'edge', 'length']) AS id, unnest(['economics', 'statistics', 'statistics']) AS category, unnest([CASE WHEN dd > 0.3 THEN 'fail' WHEN dd > 0.15 THEN 'warn' ELSE 'pass' END, CASE WHEN sharpe < -0.02 THEN 'fail' WHEN sharpe < 0.02 THEN 'warn' ELSE 'pass' END, CASE WHEN n < 100 THEN 'warn' ELSE 'pass' END]) AS status, unnest([dd, sharpe, n::DOUBLE]) AS v FROM sp)"""


def _checks(spark, d):
    rets = returns(spark, d)
    one = stats.moments(rets, ["symbol"]).join(stats.equity(rets, ["symbol"]).groupBy("symbol").agg(F.max("drawdown").alias("dd")), "symbol")
    one = one.withColumns({"dd": F.round("dd", 9), "sharpe": F.round("sharpe", 9)})
    dd, s, n = F.col("dd"), F.col("sharpe"), F.col("n")
    return evidence.rows(one, ["symbol"], [evidence.check("drawdown", "economics", dd, dd > 0.3, dd > 0.15), evidence.check("edge", "statistics", s, s < -0.02, s < 0.02), evidence.check("length", "statistics", n, warn=n < 100)])


@query("check_rows", f"WITH {_CHECKS} SELECT symbol, id, category, status, round(v, 6) + 0 AS value FROM ck")
def check_rows(spark, d):
    return _checks(spark, d).withColumn("value", r("value"))


@query("verdicts", f"WITH {_CHECKS} SELECT symbol, count(*) FILTER (status = 'fail' AND category IN ('integrity', 'lookahead', 'economics')) AS hard, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warned, count(*) AS checks, CASE WHEN bool_or(status = 'fail' AND category IN ('integrity', 'lookahead', 'economics')) THEN 'REJECT' WHEN bool_or(status = 'fail') THEN 'NEEDS_MORE_EVIDENCE' WHEN bool_or(status = 'warn') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM ck GROUP BY symbol")
def verdicts(spark, d):
    return evidence.verdicts(_checks(spark, d), ["symbol"])


@query("certificates", f"WITH {_CHECKS}, vd AS (SELECT symbol, CASE WHEN bool_or(status = 'fail' AND category IN ('integrity', 'lookahead', 'economics')) THEN 'REJECT' WHEN bool_or(status = 'fail') THEN 'NEEDS_MORE_EVIDENCE' WHEN bool_or(status = 'warn') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict, string_agg(id || '=' || status, ',' ORDER BY id) AS body FROM ck GROUP BY symbol) SELECT symbol, verdict, substr(sha256(symbol || '|' || verdict || '|' || body), 1, 16) AS certificate FROM vd")
def certificates(spark, d):
    return evidence.certificates(_checks(spark, d), ["symbol"])


@query("changed_checks", f"WITH {_CHECKS}, a AS (SELECT symbol, id, status FROM ck WHERE symbol <> 'view'), z AS (SELECT symbol, id, CASE WHEN id = 'edge' THEN 'pass' ELSE status END AS status FROM ck WHERE symbol <> 'error') SELECT coalesce(a.symbol, z.symbol) AS symbol, coalesce(a.id, z.id) AS id, a.status AS before, z.status AS after FROM a FULL JOIN z ON a.symbol = z.symbol AND a.id = z.id WHERE a.status IS DISTINCT FROM z.status")
def changed_checks(spark, d):
    c = _checks(spark, d)
    new = c.where("symbol <> 'error'").withColumn("status", F.when(F.col("id") == "edge", "pass").otherwise(F.col("status")))
    return evidence.changed(c.where("symbol <> 'view'"), new, ["symbol"])


@query("claim_check", f"WITH {RETS}, g AS (SELECT symbol, round(avg(ret), 9) AS v FROM rets WHERE ret IS NOT NULL GROUP BY symbol), c AS (SELECT symbol, CASE WHEN symbol IN ('view', 'click') THEN v ELSE v * 1.5 END AS c, v FROM g) SELECT symbol, round(c, 8) AS claimed, round(v, 8) AS verified, CASE WHEN abs(c - v) > 0.1 * greatest(abs(c), 1e-12) THEN 'fail' ELSE 'pass' END AS status FROM c")
def claim_check(spark, d):
    v = returns(spark, d).where("ret IS NOT NULL").groupBy("symbol").agg(F.round(F.avg("ret"), 9).alias("m"))
    out = evidence.claims(v.withColumn("m", F.col("m") * F.when(F.col("symbol").isin("view", "click"), 1.0).otherwise(1.5)), v, ["symbol"], "m", 0.1)
    return out.select("symbol", r("claimed", 8).alias("claimed"), r("verified", 8).alias("verified"), "status")


_CHAIN = """ev AS (SELECT user_id % 10 AS log, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS seq, event_type AS body FROM events), ch AS (SELECT log, seq, body, sha256(concat_ws('|', '', CAST(seq AS VARCHAR), body)) AS hash FROM ev WHERE seq = 1
UNION ALL SELECT ev.log, ev.seq, ev.body, sha256(concat_ws('|', ch.hash, CAST(ev.seq AS VARCHAR), ev.body)) FROM ch JOIN ev ON ev.log = ch.log AND ev.seq = ch.seq + 1)"""


@query("chain_check", f"WITH RECURSIVE {_CHAIN}, t AS (SELECT log, seq, CASE WHEN log = 3 AND seq = 5 THEN 'forged' ELSE body END AS body, hash FROM ch), w AS (SELECT *, sha256(concat_ws('|', coalesce(lag(hash) OVER (PARTITION BY log ORDER BY seq), ''), CAST(seq AS VARCHAR), body)) AS want FROM t) SELECT log, count(*) AS entries, min(CASE WHEN want <> hash THEN seq END) AS broken FROM w GROUP BY log")
def chain_check(spark, d):
    """Logs of events whose hashes were chained by a fold, one of them forged."""
    e = table(spark, d, "events")
    w = W.partitionBy("log").orderBy("event_id")
    rows = e.select((F.col("user_id") % 10).alias("log"), "event_id", F.col("event_type").alias("body")).withColumn("seq", F.row_number().over(w))
    # the fixture's fold over ten logs; the check itself is one window
    entries = evidence.chain(rows.drop("event_id"), "log", "seq", ["seq", "body"])
    entries = entries.withColumn("body", F.when((F.col("log") == 3) & (F.col("seq") == 5), "forged").otherwise(F.col("body")))
    return evidence.chained(entries, "log", "seq", ["seq", "body"])


@query("trial_ledger", "SELECT o_orderpriority AS data, count(*) AS runs, count(DISTINCT o_custkey) AS variants FROM orders GROUP BY 1")
def trial_ledger(spark, d):
    return evidence.ledger(table(spark, d, "orders").select(F.col("o_orderpriority").alias("data"), F.col("o_custkey").alias("variant")), "data", "variant")


@query("ledger_latest", "SELECT o_custkey AS variant, round(arg_max(o_totalprice, o_orderkey), 2) AS value FROM orders GROUP BY 1")
def ledger_latest(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("variant"), "o_orderkey", F.round("o_totalprice", 2).alias("value"))
    return evidence.latest(rows, ["variant"], "o_orderkey", "value")


@query("stage_funnel", "SELECT o_orderstatus AS stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def stage_funnel(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", r(F.col("n") / F.sum("n").over(W.partitionBy())))


@query("strategy_labels", "WITH f AS (SELECT p_partkey AS id, p_size % 4 AS a, p_size % 8 AS b, p_partkey % 16 AS c FROM part) SELECT id, lower(to_hex(a + b * 4 + c * 32)) AS mask, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM f")
def strategy_labels(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("x"), (F.col("p_size") % 8).alias("y"), (F.col("p_partkey") % 16).alias("z"))
    rows = rows.select("id", evidence.encode_flags({"a": (F.col("x"), 2), "b": (F.col("y"), 3), "c": (F.col("z"), 4)}).alias("mask"))
    return rows.select("id", "mask", *evidence.decode_flags(F.col("mask"), {"a": 2, "b": 3, "c": 4}))


@query("label_similarity", "WITH s AS (SELECT l_orderkey AS k, list_distinct(list(l_shipmode_)) AS a FROM (SELECT l_orderkey, CAST(l_partkey % 7 AS VARCHAR) AS l_shipmode_ FROM lineitem) GROUP BY 1) SELECT x.k, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) AS similarity FROM s x JOIN s y ON y.k = x.k + 1")
def label_similarity(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_partkey") % 7).cast("string")).alias("a"))
    other = s.select((F.col("k") - 1).alias("k"), F.col("a").alias("z"))
    return s.join(other, "k").select("k", r(evidence.jaccard(F.col("a"), F.col("z"))).alias("similarity"))


# Adapters


_TRADED = "tr AS (SELECT event_type AS symbol, epoch_us(ts) AS open_us, epoch_us(ts) + (1 + event_id % 5) * 3600000000 AS close_us, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS side FROM events)"


@query("positions_from_trades", f"""WITH {BARS}, {_TRADED}, bu AS (SELECT symbol, idx, bar * 3600000000 AS us, max(idx) OVER (PARTITION BY symbol) AS mx FROM b), fa AS (SELECT tr.*, row_number() OVER () AS id FROM tr),
a AS (SELECT fa.id, fa.symbol, fa.side, min(bu.idx) AS a FROM fa JOIN bu ON bu.symbol = fa.symbol AND bu.us >= fa.open_us GROUP BY ALL), z AS (SELECT fa.id, min(bu.idx) AS z FROM fa JOIN bu ON bu.symbol = fa.symbol AND bu.us >= fa.close_us GROUP BY ALL),
s AS (SELECT a.symbol, side, greatest(a.a - 1, 0) AS f, greatest(coalesce(z.z, (SELECT max(idx) + 1 FROM bu WHERE bu.symbol = a.symbol)) - 1, 0) AS t FROM a LEFT JOIN z USING (id)) SELECT bu.symbol, CAST(bu.idx AS BIGINT) AS idx, CAST(sign(coalesce(sum(side), 0)) AS INTEGER) AS position FROM bu LEFT JOIN s ON s.symbol = bu.symbol AND bu.idx >= f AND bu.idx < t GROUP BY ALL""")
def positions_from_trades(spark, d):
    e = ticks(spark, d)
    i = F.col("event_id")
    trades = e.select("symbol", F.col("us").alias("open_us"), (F.col("us") + (1 + i % 5) * HOUR).alias("close_us"), F.when(i % 3 == 0, -1).otherwise(1).alias("side"))
    return adapters.positions_from_trades(hourly(spark, d).withColumn("us", F.col("bar") * HOUR), trades)


@query("positions_from_fills", f"""WITH {BARS}, fl AS (SELECT event_type AS symbol, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (1 + event_id % 4) / 10.0::DOUBLE AS qty FROM events), bu AS (SELECT symbol, idx, bar * 3600000000 AS us FROM b), mx AS (SELECT symbol, max(idx) AS n FROM bu GROUP BY symbol),
a AS (SELECT fl.symbol, fl.us, qty, min(bu.idx) AS at FROM fl LEFT JOIN bu ON bu.symbol = fl.symbol AND bu.us >= fl.us GROUP BY ALL), st AS (SELECT a.symbol, least(n, greatest(coalesce("at", n + 1) - 1, 0)) AS idx, sum(qty) AS dq FROM a JOIN mx USING (symbol) GROUP BY ALL),
q AS (SELECT bu.symbol, bu.idx, sum(coalesce(dq, 0)) OVER (PARTITION BY bu.symbol ORDER BY bu.idx) AS q FROM bu LEFT JOIN st ON st.symbol = bu.symbol AND st.idx = bu.idx), m2 AS (SELECT *, max(abs(q)) OVER (PARTITION BY symbol) AS m FROM q) SELECT symbol, CAST(idx AS BIGINT) AS idx, CASE WHEN abs(q) <= 1e-9 * m THEN 0 ELSE CAST(sign(q) AS INTEGER) END AS position FROM m2""")
def positions_from_fills(spark, d):
    i = F.col("event_id")
    fills = ticks(spark, d).select("symbol", "us", (F.when(i % 3 == 0, -1).otherwise(1) * (1 + i % 4) / 10.0).alias("qty"))
    return adapters.positions_from_fills(hourly(spark, d).withColumn("us", F.col("bar") * HOUR), fills)


@query("epoch_units", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS BIGINT) AS us FROM events")
def epoch_units(spark, d):
    us, i = F.col("us"), F.col("event_id") % 4
    v = F.when(i == 0, F.floor(us / 1_000_000)).when(i == 1, F.floor(us / 1000)).when(i == 2, us).otherwise(us * F.lit(1000).cast("long"))
    return ticks(spark, d).select("event_id", adapters.epoch_micros(v).alias("us"))


@query("ticker_messages", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS event_ms, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type || '@X' END AS ticker, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(value * 0.9995, 6) END AS bid, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'X' END AS venue FROM events")
def ticker_messages(spark, d):
    t = ticks(spark, d)
    body = F.struct(F.floor(F.col("us") / 1000).alias("E"), F.concat("symbol", F.lit("@X")).alias("s"), F.round(F.col("price") * 0.9995, 6).cast("string").alias("b"), F.round(F.col("price") * 1.0005, 6).cast("string").alias("a"))
    text = F.when(F.col("event_id") % 9 == 0, "{broken").when(F.col("event_id") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("data"))))
    out = adapters.parse_tickers(t.select("event_id", text.alias("m")), "m")
    return out.select("event_id", "event_ms", "ticker", r("bid").alias("bid"), adapters.venue(F.col("ticker")).alias("venue"))


@query("legs_unpivoted", f"WITH {MONTHS}, w AS (SELECT bar, max(close) FILTER (symbol = 0) AS px_a, max(volume) FILTER (symbol = 0) AS qty_a, max(close) FILTER (symbol = 1) AS px_b, max(volume) FILTER (symbol = 1) AS qty_b FROM m GROUP BY bar) SELECT bar, 'a' AS leg, round(px_a, 6) AS px, round(qty_a, 6) AS qty FROM w UNION ALL SELECT bar, 'b', round(px_b, 6), round(qty_b, 6) FROM w")
def legs_unpivoted(spark, d):
    m = monthly(spark, d)
    pick = lambda c, k: F.max(F.when(F.col("symbol") == k, F.col(c)))
    wide = m.groupBy("bar").agg(pick("close", 0).alias("px_a"), pick("volume", 0).alias("qty_a"), pick("close", 1).alias("px_b"), pick("volume", 1).alias("qty_b"))
    return _pick(adapters.long_legs(wide, "bar"), ["bar", "leg"], "px", "qty")


@query("total_return_adjusted", f"""WITH {MONTHS}, ac AS (SELECT symbol, idx, 'dividend' AS kind, 0.02 * lag(close) OVER ({WS}) AS v FROM m QUALIFY idx % 6 = 5), sp AS (SELECT symbol, idx, 2.0::DOUBLE AS v FROM m WHERE idx % 20 = 10),
o AS (SELECT m.symbol, m.bar, m.idx, m.close, ln(1 - coalesce(ac.v, 0) / lag(m.close) OVER (PARTITION BY m.symbol ORDER BY m.idx)) - coalesce(ln(sp.v), 0) AS own FROM m LEFT JOIN ac ON ac.symbol = m.symbol AND ac.idx = m.idx LEFT JOIN sp ON sp.symbol = m.symbol AND sp.idx = m.idx)
SELECT symbol, bar, round(close * exp(coalesce(sum(coalesce(own, 0)) OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 5) AS adjusted FROM o""")
def total_return_adjusted(spark, d):
    m = monthly(spark, d)
    paid = m.withColumn("value", 0.02 * F.lag("close").over(fw.by())).where("idx % 6 = 5").select("symbol", "idx", F.lit("dividend").alias("kind"), "value")
    cut = m.where("idx % 20 = 10").select("symbol", "idx", F.lit("split").alias("kind"), F.lit(2.0).alias("value"))
    out = adapters.total_return_factors(m.select("symbol", "bar", "idx", "close"), paid.unionByName(cut))
    return out.select("symbol", "bar", r(F.col("close") * F.col("factor"), 5).alias("adjusted"))


@query("exchange_close", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS minutes FROM (SELECT o_orderdate, timezone('UTC', timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR)) AS t FROM orders)")
def exchange_close(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), adapters.close_minutes("America/New_York", F.col("day")).alias("minutes"))


# Streams


def _folder(spark) -> str:
    ensure_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/") + "/stream-" + uuid.uuid4().hex


@query("streaming_bars", f"""WITH {BARS}, mx AS (SELECT max(us) - 3600000000 AS mark FROM ticks) SELECT symbol, bar, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM b, mx WHERE (bar + 1) * 3600000000 <= mark""")
def streaming_bars(spark, d):
    """All events as a stream: hourly bars that the watermark (an hour behind) has closed."""
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")  # a stream reads folders or patterns
    rows = raw.select(F.col("event_type").alias("symbol"), "event_id", F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    at = _folder(spark)
    out = sb.run_available(sb.windowed_bars(rows, "1 hour", "1 hour"), at + "/out", at + "/checkpoint")
    return out.select("symbol", F.floor(F.unix_timestamp("start") / 3600).cast("long").alias("bar"), *[r(c).alias(c) for c in OHLC], "n")


@query("cusum_alarm", f"""WITH {RC}, x AS (SELECT symbol, idx, 0.1::DOUBLE * ((0.002::DOUBLE - mkt) / 0.02::DOUBLE - 0.5 * 0.1::DOUBLE) AS x FROM rc), c AS (SELECT symbol, idx, sum(x) OVER ({WS}) AS c FROM x), ss AS (SELECT symbol, idx, c - least(0, min(c) OVER ({WS})) AS s FROM c)
SELECT symbol, min(CASE WHEN round(s, 9) > 1.0 THEN idx END) AS alarm, round(arg_max(s, idx), 6) + 0 AS last FROM ss GROUP BY symbol""")
def cusum_alarm(spark, d):
    out = evidence.cusum(plain(spark, d), ["symbol"], "mkt", F.lit(0.002), F.lit(0.02), h=1.0)
    return out.select("symbol", "alarm", r("last").alias("last"))


_SPRT = "ln(0.95::DOUBLE / 0.05)"


@query("sprt_alarm", f"""WITH RECURSIVE {RC}, q AS (SELECT symbol, idx, 0.002::DOUBLE * (0.001::DOUBLE - mkt) / 0.0004::DOUBLE AS x FROM rc), st AS (SELECT symbol, CAST(-1 AS BIGINT) AS idx, 0.0::DOUBLE AS l, CAST(0 AS BIGINT) AS acc, CAST(NULL AS BIGINT) AS alarm FROM q WHERE idx = 0
UNION ALL SELECT st.symbol, q.idx, CASE WHEN alarm IS NOT NULL THEN l WHEN l + x <= -{_SPRT} THEN 0 ELSE l + x END, CASE WHEN alarm IS NULL AND l + x <= -{_SPRT} THEN acc + 1 ELSE acc END, CASE WHEN alarm IS NULL AND l + x >= {_SPRT} THEN q.idx ELSE alarm END FROM st JOIN q ON q.symbol = st.symbol AND q.idx = st.idx + 1)
SELECT symbol, max(alarm) AS alarm, arg_max(acc, idx) AS accepted FROM st GROUP BY symbol""")
def sprt_alarm(spark, d):
    """A repeated likelihood-ratio test has to start anew after each acceptance: one grouped map per symbol."""
    upper = float(np.log(0.95 / 0.05))

    def kernel(c):
        llr, accepted, alarm = 0.0, 0, np.nan
        for i, x in zip(c["idx"].tolist(), c["mkt"].tolist()):
            llr += 0.002 * (0.001 - x) / 0.0004
            if llr >= upper:
                alarm = i
                break
            if llr <= -upper:
                llr, accepted = 0.0, accepted + 1
        n = len(c["idx"])
        return {"alarm": np.full(n, float(alarm)), "accepted": np.full(n, float(accepted))}

    rows = recursive.per_group(plain(spark, d), ["symbol"], "idx", kernel, {"alarm": "double", "accepted": "double"})
    return rows.groupBy("symbol").agg(F.max("alarm").cast("long").alias("alarm"), F.max("accepted").cast("long").alias("accepted"))
