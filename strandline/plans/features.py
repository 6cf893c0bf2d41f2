"""Registered data-quality scans, position transforms, recursive features and the score library, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import positions as fp
from ..functions import recursive, signals
from ..functions import windows as fw
from ..operators import quality
from ..sources.tables import ticks
from .base import BARS, MONTHS, TICKS, WS, full, hourly, monthly, query, r, rank_sql
from .market import _SIGNAL, _WEIGHTS, OHLC, _signals
from .stats import _pick, _rounded

_MAD = """md AS (SELECT *, median({m}) OVER (PARTITION BY symbol) AS mid, count({m}) OVER (PARTITION BY symbol) AS cnt FROM {t}),
ml AS (SELECT *, greatest(0.05, CASE WHEN cnt >= 10 THEN 20 * 1.4826 * median(abs({m} - mid)) OVER (PARTITION BY symbol) ELSE 0 END) AS lim FROM md)"""


#: Monthly prices drawn together, with a jump every 17 bars that the next bar takes back, and one split.
_JUMPY = "jm AS (SELECT symbol, bar, idx, exp(ln(close) / 1000) * CASE WHEN idx % 17 = 9 THEN 1.5 ELSE 1 END * CASE WHEN idx >= 30 THEN 2 ELSE 1 END AS close FROM m)"


def _jumpy(spark, d):
    up = F.when(F.col("idx") % 17 == 9, 1.5).otherwise(1.0) * F.when(F.col("idx") >= 30, 2.0).otherwise(1.0)
    return monthly(spark, d).select("symbol", "bar", "idx", (F.exp(F.log("close") / 1000) * up).alias("close")).withColumn("open", F.col("close"))


@query("price_spikes", f"""WITH {MONTHS}, {_JUMPY}, mv AS (SELECT *, ln(close / nullif(lag(close) OVER ({WS}), 0)) AS move FROM jm), {_MAD.format(m='move', t='mv')}, bk AS (SELECT *, lead(move) OVER ({WS}) AS back FROM ml)
SELECT symbol, bar, round(move, 6) AS move, round(back, 6) AS back FROM bk WHERE abs(move) > lim AND sign(back) = -sign(move) AND abs(move + back) <= 0.25 * abs(move)""")
def price_spikes(spark, d):
    return _pick(quality.spikes(_jumpy(spark, d)), ["symbol", "bar"], "move", "back")


_SPLIT = "({x} IS NOT NULL AND abs(ln({x})) > lim AND (" + " OR ".join(f"abs({{x}} * {k} - 1) <= 0.03 OR abs({{x}} / {k} - 1) <= 0.03" for k in (2, 3, 4, 5, 10, 20)) + "))"


@query("split_jumps", f"""WITH {MONTHS}, {_JUMPY}, mv AS (SELECT *, ln(close / nullif(lag(close) OVER ({WS}), 0)) AS mm, close / nullif(lag(close) OVER ({WS}), 0) AS x FROM jm), {_MAD.format(m='mm', t='mv')}
SELECT symbol, bar, round(x, 6) AS ratio FROM ml WHERE {_SPLIT.format(x='x')}""")
def split_jumps(spark, d):
    return _pick(quality.split_jumps(_jumpy(spark, d)), ["symbol", "bar"], "ratio")


#: Whole prices, so that bars repeat.
_WHOLE = "bw AS (SELECT symbol, bar, idx, floor(open / 400) AS open, floor(high / 400) AS high, floor(low / 400) AS low, floor(close / 400) AS close FROM b)"


def _whole(spark, d):
    return hourly(spark, d).select("symbol", "bar", "idx", *[F.floor(F.col(c) / 400).cast("double").alias(c) for c in OHLC])


def _run_sql(source: str, hit: str) -> str:
    return f"""r0 AS (SELECT *, coalesce({hit}, false) AS hit FROM {source}), r1 AS (SELECT *, CASE WHEN lag(hit) OVER ({WS}) IS NOT DISTINCT FROM hit AND row_number() OVER ({WS}) > 1 THEN 0 ELSE 1 END AS nw FROM r0),
r2 AS (SELECT *, sum(nw) OVER ({WS}) AS run FROM r1), runs AS (SELECT symbol, min(idx) AS start, max(idx) AS finish, count(*) AS n FROM r2 WHERE hit GROUP BY symbol, run)"""


_LC = f"lag(close) OVER ({WS})"


@query("frozen_runs", f"WITH {BARS}, {_WHOLE}, {_run_sql('bw', f'open = {_LC} AND high = {_LC} AND low = {_LC} AND close = {_LC}')} SELECT symbol, start, finish, n FROM runs WHERE n >= 5")
def frozen_runs(spark, d):
    return quality.frozen_runs(_whole(spark, d)).select("symbol", "start", F.col("end").alias("finish"), F.col("rows").alias("n"))


@query("stale_runs", f"WITH {BARS}, {_WHOLE}, {_run_sql('bw', ' AND '.join(f'{c} = lag({c}) OVER ({WS})' for c in OHLC))} SELECT symbol, max(n) AS longest FROM runs GROUP BY symbol")
def stale_runs(spark, d):
    return quality.stale_runs(_whole(spark, d))


@query("time_gaps", f"""WITH {TICKS}, s AS (SELECT symbol, us / 1e6 AS s, us / 1e6 - lag(us / 1e6) OVER (PARTITION BY symbol ORDER BY us) AS d FROM ticks),
w AS (SELECT *, (max(s) OVER (PARTITION BY symbol) - min(s) OVER (PARTITION BY symbol)) / 604800 AS weeks FROM s), p AS (SELECT *, median(d) OVER (PARTITION BY symbol) AS mid FROM w WHERE d > 0),
g AS (SELECT symbol, count(*) AS steps, any_value(mid) AS mid, count(*) FILTER (d > 5 * mid) >= greatest(0.5 * any_value(weeks), 3) AS sessions, quantile_cont(CASE WHEN d > 5 * mid THEN d END, 0.95) AS p95,
  count(*) FILTER (d > 2.5 * mid AND d <= 5 * mid) >= greatest(0.5 * any_value(weeks), 3) AS closed, avg(CASE WHEN d > 1.5 * mid AND d <= 5 * mid THEN 1.0 ELSE 0 END) AS two FROM p GROUP BY symbol),
l AS (SELECT *, CASE WHEN steps >= 20 THEN CASE WHEN sessions THEN greatest(5 * mid, 1.5 * p95) ELSE 5 * mid END END AS lim FROM g)
SELECT l.symbol, steps, sessions, round(CASE WHEN NOT sessions AND NOT closed AND steps >= 20 THEN two ELSE 0 END, 6) AS missing_share, count(*) FILTER (d > lim) AS gaps, round(max(CASE WHEN d > lim THEN d END), 3) AS largest
FROM l JOIN p USING (symbol) GROUP BY ALL""")
def time_gaps(spark, d):
    rows = ticks(spark, d).select("symbol", (F.col("us") / 1e6).alias("s"))
    found = quality.time_gaps(rows, "symbol", "s")
    return found.select("symbol", "steps", "sessions", r("missing_share").alias("missing_share"), "gaps", r("largest", 3).alias("largest"))


@query("data_integrity", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN idx % 50 = 7 THEN NULL ELSE close END AS c, CASE WHEN idx % 40 = 3 THEN low / 2 ELSE high END AS h, lag(bar - idx % 2) OVER ({WS}) AS last FROM b)
SELECT symbol, count(*) AS n, count(*) FILTER (c IS NULL) AS null_prices, count(*) FILTER (open <= 0 OR h <= 0 OR low <= 0 OR coalesce(c <= 0, false)) AS not_positive,
count(*) FILTER (h < greatest(open, low, c) OR low > least(open, h, c)) AS high_low, count(*) FILTER (bar - idx % 2 < last) AS backward, count(*) FILTER (bar - idx % 2 = last) AS repeated FROM s GROUP BY symbol""")
def data_integrity(spark, d):
    rows = hourly(spark, d).withColumns({
        "close": F.when(F.col("idx") % 50 != 7, F.col("close")), "high": F.when(F.col("idx") % 40 == 3, F.col("low") / 2).otherwise(F.col("high")), "clock": F.col("bar") - F.col("idx") % 2,
    })
    return quality.integrity(rows, clock="clock").withColumnRenamed("rows", "n")


_QUOTES = f"{TICKS}, q AS (SELECT *, price * (1 - 0.0005) AS bid, price * (1 + CASE WHEN event_id % 97 = 0 THEN -0.001 WHEN event_id % 89 = 0 THEN -0.0005 ELSE 0.0005 END) AS ask FROM ticks)"


def quotes(spark, d):
    """The events as quotes: five basis points to each side of the value, some crossed or locked."""
    e = F.col("event_id")
    side = F.when(e % 97 == 0, -0.001).when(e % 89 == 0, -0.0005).otherwise(0.0005)
    return ticks(spark, d).withColumns({"bid": F.col("price") * (1 - 0.0005), "ask": F.col("price") * (1 + side)})


@query("quote_quality", f"""WITH {_QUOTES}, l AS (SELECT *, lag(us) OVER o AS u0, lag(bid) OVER o AS b0, lag(ask) OVER o AS a0, max(arrival_us) OVER o AS seen, row_number() OVER o AS rn FROM q WINDOW o AS (PARTITION BY symbol ORDER BY us, event_id)),
h AS (SELECT *, coalesce(bid = b0 AND ask = a0, false) AS held FROM l), i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, held ORDER BY us, event_id) AS run FROM h), k AS (SELECT symbol, max(n) AS longest FROM (SELECT symbol, count(*) AS n FROM i WHERE held GROUP BY symbol, run) GROUP BY symbol)
SELECT h.symbol, count(*) AS quotes, count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (bid = ask) AS locked, count(*) FILTER (bid <= 0 OR ask <= 0) AS not_positive, count(*) FILTER (latency_ms < 0) AS negative_latency,
count(*) FILTER (held AND us = u0) AS repeated, count(*) FILTER (arrival_us < seen) AS late, round(avg(CASE WHEN latency_ms > 50 THEN 1.0 ELSE 0 END), 6) AS stale_share, coalesce(any_value(longest), 0) AS longest_unchanged,
quantile_cont(latency_ms, 0.5) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM h LEFT JOIN k USING (symbol) GROUP BY h.symbol""")
def quote_quality(spark, d):
    one = quality.quote_quality(quotes(spark, d))
    return one.withColumns({c: r(c) for c in ("stale_share", "p50", "p95", "p99")})


@query("half_spread_bps", f"WITH {_QUOTES} SELECT symbol, round(median((ask - bid) / (ask + bid) * 10000), 6) AS half_spread FROM q WHERE ask > bid AND bid > 0 GROUP BY symbol")
def half_spread_bps(spark, d):
    rows = quotes(spark, d).where("ask > bid AND bid > 0")
    return rows.groupBy("symbol").agg(r(F.median((F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid")) * 10000)).alias("half_spread"))


@query("trading_capacity", f"""WITH {MONTHS}, {_WEIGHTS}, c AS (SELECT symbol, bar, close * volume AS v, weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY bar), 0) AS dw FROM w),
qq AS (SELECT symbol, quantile_cont(v / abs(dw), 0.1) AS room FROM c WHERE abs(dw) > 0 AND v > 0 GROUP BY symbol) SELECT symbol, s AS share, round(s * room, 6) AS capital FROM qq, (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS s)""")
def trading_capacity(spark, d):
    from ..functions import xsection as fx

    w = W.partitionBy("symbol").orderBy("bar")
    rows = fx.legs(monthly(spark, d).withColumn("ret", F.round("ret", 9)), "ret", 5)
    rows = rows.withColumns({"v": F.col("close") * F.col("volume"), "dw": F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))})
    return quality.capacity(rows, "symbol", "v", "dw").select("symbol", "share", r("capital").alias("capital"))


# Positions


_POS = f"{BARS}, {_SIGNAL}, ps AS (SELECT symbol, bar, idx, close, t, CASE WHEN idx % 13 = 0 THEN NULL ELSE (idx * 7 % 31 - 15) / 12.0::DOUBLE END AS x FROM s)"


def _positions(spark, d):
    rows = _signals(spark, d)
    return rows.select("symbol", "bar", "idx", "close", "t", F.when(F.col("idx") % 13 != 0, (F.col("idx") * 7 % 31 - 15) / 12.0).alias("x"))


@query("positions_cleaned", f"WITH {_POS} SELECT symbol, bar, round(greatest(-1, least(1, coalesce(x, 0))), 6) + 0 AS w, CAST(sign(coalesce(x, 0)) AS INTEGER) AS s FROM ps")
def positions_cleaned(spark, d):
    return _positions(spark, d).select("symbol", "bar", r(fp.clean(F.col("x"))).alias("w"), fp.sign(F.col("x")).alias("s"))


@query("positions_mode", f"WITH {_POS} SELECT 'x' AS col, CASE WHEN bool_and(abs(coalesce(x, 0)) <= 1) AND bool_or(coalesce(x, 0) <> rint(coalesce(x, 0))) THEN 'weight' ELSE 'sign' END AS mode FROM ps UNION ALL SELECT 'half', CASE WHEN bool_and(abs(t / 2) <= 1) AND bool_or(t / 2 <> rint(t / 2)) THEN 'weight' ELSE 'sign' END FROM ps".replace("rint(", "round("))
def positions_mode(spark, d):
    rows = _positions(spark, d).withColumn("half", F.col("t") / 2)
    one = lambda c: fp.mode(rows, c).select(F.lit(c if c != "x" else "x").alias("col"), "mode")
    return one("x").unionByName(one("half"))


@query("weights_normalised", f"""WITH {_POS}, c AS (SELECT symbol, bar, greatest(-1, least(1, coalesce(x, 0))) AS w FROM ps), g AS (SELECT *, sum(abs(w)) OVER (PARTITION BY bar) AS gross FROM c)
SELECT symbol, bar, gross > 1 + 1e-12 AS scaled, round(w * CASE WHEN gross > 1 + 1e-12 THEN 1 / gross ELSE 1 END, 6) + 0 AS w FROM g""")
def weights_normalised(spark, d):
    return fp.normalised(_positions(spark, d), "x", "bar").select("symbol", "bar", "scaled", r("x").alias("w"))


def _reb(k: int, o: int, x: str = "coalesce(x, 0)") -> str:
    return f"coalesce(last_value(CASE WHEN idx % {k} = {o} THEN {x} END IGNORE NULLS) OVER ({WS}), 0)"


@query("position_transforms", f"""WITH {_POS} SELECT symbol, bar, round(coalesce(lag(coalesce(x, 0), 2) OVER ({WS}), 0), 6) + 0 AS delayed, round(greatest(-0.5, least(0.5, coalesce(x, 0))), 6) + 0 AS capped, round({_reb(5, 1)}, 6) + 0 AS rebalanced,
round(({_reb(6, 0)} + {_reb(6, 2)} + {_reb(6, 4)}) / 3, 6) + 0 AS tranched, round(coalesce(x, 0) - avg(coalesce(x, 0)) OVER (PARTITION BY bar), 6) + 0 AS neutral FROM ps""")
def position_transforms(spark, d):
    w, x = fw.by(), F.coalesce("x", F.lit(0.0))
    return _positions(spark, d).select(
        "symbol", "bar", r(fp.delayed(x, 2, w)).alias("delayed"), r(fp.capped(x, 0.5)).alias("capped"), r(fp.rebalanced(x, 5, 1, w)).alias("rebalanced"),
        r(fp.tranches(x, 6, 3, w)).alias("tranched"), r(x - F.avg(x).over(W.partitionBy("bar"))).alias("neutral"),
    )


_Z = f"(close - {full('avg', 'close', 30)}) / nullif({full('stddev_samp', 'close', 30)}, 0)"


@query("hysteresis_positions", f"""WITH {BARS}, z AS (SELECT symbol, bar, idx, {_Z} AS z FROM b), mk AS (SELECT *, sum(CASE WHEN z IS NULL OR abs(z) < 0.5 THEN 1 ELSE 0 END) OVER ({WS}) AS spell, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 END AS mark FROM z)
SELECT symbol, bar, coalesce(first_value(mark IGNORE NULLS) OVER (PARTITION BY symbol, spell ORDER BY idx), 0) AS position FROM mk""")
def hysteresis_positions(spark, d):
    rows = hourly(spark, d).withColumn("z", fw.zscore(F.col("close"), 30, fw.by()))
    return fp.hysteresis(rows, "z", 1.0, 0.5).select("symbol", "bar", "position")


@query("rebalance_cadence", f"""WITH {_POS}, w AS (SELECT symbol, idx, {_reb(4, 0)} AS w FROM ps), mv AS (SELECT symbol, idx FROM (SELECT *, lag(w) OVER ({WS}) AS old FROM w) WHERE old IS NOT NULL AND old <> w),
g AS (SELECT symbol, idx - lag(idx) OVER ({WS}) AS gap FROM mv), c AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), t AS (SELECT symbol, arg_max(gap, (n, -gap)) AS every, max(n) AS n, sum(n) AS k FROM c GROUP BY symbol)
SELECT symbol, every FROM t WHERE k >= 5 AND every >= 2 AND n >= 0.5 * k""")
def rebalance_cadence(spark, d):
    rows = _positions(spark, d).withColumn("w", fp.rebalanced(F.coalesce("x", F.lit(0.0)), 4, 0, fw.by()))
    return fp.cadence(rows, "symbol", "w")


@query("membership_intervals", f"WITH {_POS}, i AS (SELECT *, idx - row_number() OVER ({WS}) AS g FROM ps WHERE t = 1) SELECT symbol, min(idx) AS start, max(idx) AS finish FROM i GROUP BY symbol, g")
def membership_intervals(spark, d):
    return fp.membership(_positions(spark, d), "symbol", F.col("t") == 1).select("symbol", "start", F.col("end").alias("finish"))


@query("risk_parity_weights", f"""WITH {MONTHS}, v AS (SELECT symbol, bar, round({full('stddev_samp', 'ret', 6)}, 9) AS sd FROM m), i AS (SELECT symbol, bar, 1 / nullif(sd, 0) AS k, sd FROM v WHERE sd IS NOT NULL)
SELECT symbol, bar, round(k / sum(k) OVER (PARTITION BY bar), 6) AS parity, round(least(1, 0.2 / nullif(sd, 0)), 6) AS targeted FROM i""")
def risk_parity_weights(spark, d):
    rows = monthly(spark, d).withColumn("sd", F.round(fw.rolling(F.stddev_samp, F.col("ret"), 6, fw.by()), 9)).where("sd IS NOT NULL")
    return rows.select("symbol", "bar", r(fp.risk_parity(F.col("sd"), "bar")).alias("parity"), r(fp.vol_target(F.lit(1.0), F.col("sd"), 0.2)).alias("targeted"))


# Recursive features


def _ema_sql(name: str, source: str, x: str, alpha: str) -> str:
    """Recursive CTE of an exponential mean from the first value."""
    return f"""{name} AS (SELECT symbol, idx, CAST({x} AS DOUBLE) AS y FROM {source} WHERE idx = 0 UNION ALL SELECT s.symbol, s.idx, {alpha} * s.{x} + (1 - {alpha}) * e.y FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.idx = e.idx + 1)"""


@query("ema_macd", f"""WITH RECURSIVE {BARS}, {_ema_sql('e12', 'b', 'close', '(2.0::DOUBLE / 13)')}, {_ema_sql('e26', 'b', 'close', '(2.0::DOUBLE / 27)')}, l AS (SELECT e12.symbol, e12.idx, e12.y AS fast, e12.y - e26.y AS line FROM e12 JOIN e26 USING (symbol, idx)),
{_ema_sql('e9', 'l', 'line', '(2.0::DOUBLE / 10)')} SELECT symbol, bar, round(fast, 6) AS ema, round(line, 6) + 0 AS macd, round(y, 6) + 0 AS signal, round(line - y, 6) + 0 AS hist FROM l JOIN e9 USING (symbol, idx) JOIN b USING (symbol, idx)""")
def ema_macd(spark, d):
    def kernel(c):
        line, smooth, hist = recursive.macd(c["close"])
        return {"ema": recursive.ema(c["close"], 12), "macd": line, "signal": smooth, "hist": hist}

    rows = hourly(spark, d).select("symbol", "bar", "idx", "close")
    return _pick(recursive.per_group(rows, ["symbol"], "idx", kernel, dict.fromkeys(("ema", "macd", "signal", "hist"), "double")), ["symbol", "bar"], "ema", "macd", "signal", "hist")


@query("rsi_wilder", f"""WITH RECURSIVE {BARS}, dd AS (SELECT symbol, idx, close - lag(close) OVER ({WS}) AS d FROM b), u AS (SELECT symbol, idx, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM dd WHERE d IS NOT NULL),
f AS (SELECT symbol, 14 AS idx, avg(up) AS a, avg(dn) AS z FROM u WHERE idx <= 14 GROUP BY symbol HAVING count(*) = 14), e AS (SELECT symbol, CAST(idx AS BIGINT) AS idx, a, z FROM f UNION ALL SELECT u.symbol, u.idx, up / 14 + (1 - 1 / 14.0::DOUBLE) * a, dn / 14 + (1 - 1 / 14.0::DOUBLE) * z FROM e JOIN u ON u.symbol = e.symbol AND u.idx = e.idx + 1)
SELECT b.symbol, b.bar, round(CASE WHEN z = 0 THEN 100 ELSE 100 - 100 / (1 + a / z) END, 6) AS rsi FROM b LEFT JOIN e USING (symbol, idx)""")
def rsi_wilder(spark, d):
    rows = hourly(spark, d).select("symbol", "bar", "idx", "close")
    return _pick(recursive.per_group(rows, ["symbol"], "idx", lambda c: {"rsi": recursive.rsi_wilder(c["close"])}, {"rsi": "double"}), ["symbol", "bar"], "rsi")


@query("position_smoothing", f"""WITH RECURSIVE {_POS}, x0 AS (SELECT symbol, idx, bar, coalesce(x, 0) AS x FROM ps), {_ema_sql('e5', 'x0', 'x', '(2.0::DOUBLE / 6)')},
bd AS (SELECT symbol, idx, CASE WHEN abs(x) > 0.6 THEN x ELSE 0 END AS h FROM x0 WHERE idx = 0 UNION ALL SELECT s.symbol, s.idx, CASE WHEN abs(s.x - h) > 0.6 THEN s.x ELSE h END FROM bd JOIN x0 s ON s.symbol = bd.symbol AND s.idx = bd.idx + 1),
hd AS (SELECT symbol, idx, CAST(sign(x) AS INTEGER) AS h, CASE WHEN sign(x) <> 0 THEN 1 ELSE 5 END AS since FROM x0 WHERE idx = 0 UNION ALL SELECT s.symbol, s.idx, CASE WHEN sign(s.x) <> h AND since >= 4 THEN CAST(sign(s.x) AS INTEGER) ELSE h END, CASE WHEN sign(s.x) <> h AND since >= 4 THEN 1 ELSE since + 1 END FROM hd JOIN x0 s ON s.symbol = hd.symbol AND s.idx = hd.idx + 1)
SELECT symbol, bar, round(y, 6) + 0 AS smooth, round(bd.h, 6) + 0 AS banded, CAST(hd.h AS DOUBLE) AS held FROM x0 JOIN e5 USING (symbol, idx) JOIN bd USING (symbol, idx) JOIN hd USING (symbol, idx)""")
def position_smoothing(spark, d):
    rows = _positions(spark, d).select("symbol", "bar", "idx", F.coalesce("x", F.lit(0.0)).alias("x"))
    made = lambda c: {"smooth": recursive.ema(c["x"], 5), "banded": recursive.band(c["x"], 0.6), "held": recursive.hold(np.sign(c["x"]), 4)}
    return _pick(recursive.per_group(rows, ["symbol"], "idx", made, dict.fromkeys(("smooth", "banded", "held"), "double")), ["symbol", "bar"], "smooth", "banded", "held")


# The score library on monthly supplier prices


_F6, _F12 = (f"OVER ({WS} ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)" for k in (5, 11))
_LIB = f"""mk AS (SELECT m.*, avg(ret) OVER (PARTITION BY bar) AS mkt, close * volume AS v FROM m),
x0 AS (SELECT *, lag(close, 1) OVER ({WS}) / nullif(lag(close, 7) OVER ({WS}), 0) - 1 AS mom, close / nullif(lag(close) OVER ({WS}), 0) - 1 AS rev, close / nullif(lag(close, 6) OVER ({WS}), 0) - 1 AS r6, {full('stddev_samp', 'ret', 6)} AS lowvol,
  CASE WHEN count(ret + mkt) {_F12} >= 12 THEN covar_samp(ret, mkt) {_F12} / nullif(var_samp(mkt) {_F12}, 0) END AS bab, {full('max', 'ret', 6)} AS maxl,
  CASE WHEN count(ret) {_F12} >= 12 THEN (avg(ret ** 3) {_F12} - 3 * avg(ret) {_F12} * avg(ret ** 2) {_F12} + 2 * avg(ret) {_F12} ** 3) / (avg(ret ** 2) {_F12} - avg(ret) {_F12} ** 2) ** 1.5 * sqrt(132::DOUBLE) / 10 END AS skewness,
  close / nullif({full('max', 'close', 12)}, 0) AS hi, abs(ret) / nullif(v, 0) AS ill, {full('avg', 'v', 6)} AS v6, {full('avg', 'v', 12)} AS v12, {full('max', 'close', 12)} - {full('min', 'close', 12)} AS span,
  CASE WHEN count(v) {_F12} >= 9 THEN median(v) {_F12} END AS eligible_value FROM mk),
x1 AS (SELECT *, ret - bab * mkt AS e, {full('avg', 'ill', 6)} AS illiq FROM x0),
lib AS (SELECT symbol, bar, idx, ret, mom, rev, r6 / nullif(lowvol * sqrt(6::DOUBLE), 0) AS vsmom, lowvol, bab, maxl, skewness, hi, illiq, ln(v6) AS size, r6 * v6 / nullif(v12, 0) AS voltrend, span / nullif(close, 0) AS range, sign(r6) / nullif(lowvol, 0) AS tstrend, rev * v12 / nullif(v, 0) AS strev, eligible_value,
  {full('stddev_samp', 'e', 6)} AS idiovol, {full('sum', 'e', 6)} / nullif({full('stddev_samp', 'e', 6)}, 0) AS resmom FROM x1)"""
_FAMILIES = ("mom", "rev", "vsmom", "lowvol", "bab", "maxl", "skewness", "hi", "size", "voltrend", "range", "tstrend", "strev", "idiovol", "resmom", "eligible_value")


def _library(spark, d):
    rows = monthly(spark, d)
    return signals.scores(rows.withColumn("mkt", F.avg("ret").over(W.partitionBy("bar"))))


@query("score_library", f"WITH {MONTHS}, {_LIB} SELECT symbol, bar, {_rounded(*_FAMILIES, digits=5)}, round(illiq, 12) AS illiq FROM lib")
def score_library(spark, d):
    return _library(spark, d).select("symbol", "bar", *[r(c, 5).alias(c) for c in _FAMILIES], r("illiq", 12).alias("illiq"))


def _zs(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY bar)) / nullif(stddev_samp({x}) OVER (PARTITION BY bar), 0)"


_COMP = f"{_LIB}, cp AS (SELECT symbol, bar, ret, round(({_zs('mom')} - {_zs('lowvol')} - {_zs('bab')}) / 3, 9) AS score FROM lib)"


@query("score_composite", f"WITH {MONTHS}, {_COMP} SELECT symbol, bar, round(score, 5) + 0 AS score FROM cp WHERE score IS NOT NULL")
def score_composite(spark, d):
    rows = _library(spark, d)
    return rows.select("symbol", "bar", r(signals.composite(rows, {"mom": 1, "lowvol": -1, "bab": -1}), 5).alias("score")).where("score IS NOT NULL")


@query("score_net_portfolio", f"""WITH {MONTHS}, {_COMP}, k AS (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY bar ORDER BY score NULLS LAST) / count(score) OVER (PARTITION BY bar) END AS p FROM cp),
h AS (SELECT *, CASE WHEN coalesce(p, 0.5) > 2.0 / 3 THEN 1 ELSE 0 END AS hi, CASE WHEN coalesce(p, 0.5) <= 1.0 / 3 THEN 1 ELSE 0 END AS lo FROM k),
wt AS (SELECT *, CASE WHEN bar % 3 = 0 THEN 0.5 * coalesce(hi / nullif(sum(hi) OVER (PARTITION BY bar), 0), 0) - 0.5 * coalesce(lo / nullif(sum(lo) OVER (PARTITION BY bar), 0), 0) END AS w FROM h),
hd AS (SELECT *, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM wt), mv AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY bar), 0)) AS moved FROM hd)
SELECT bar, round(sum(held * coalesce(ret, 0)), 6) + 0 AS gross, round(0.001 * sum(moved), 6) + 0 AS cost, round(sum(held * coalesce(ret, 0)) - 0.001 * sum(moved), 6) + 0 AS net FROM mv GROUP BY bar""")
def score_net_portfolio(spark, d):
    rows = _library(spark, d)
    rows = rows.withColumn("score", F.round(signals.composite(rows, {"mom": 1, "lowvol": -1, "bab": -1}), 9))
    return _pick(signals.net_portfolio(rows, "score", 3, 0.001), ["bar"], "gross", "cost", "net")
