"""Registered statistics of return series and trade lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal, xsection
from ..functions import windows as fw
from ..operators import backtest, stats
from .base import BARS, MONTHS, WS, full, hourly, monthly, query, r, rank_sql
from .market import _GRID, _KEYS, _LEGS, _SIGNAL, _SWEEP, _WEIGHTS, _signals, _sweep, trades_sql

#: Hourly returns of holding what the two averages said an hour before. Prices of the events jump, so log returns are scaled.
RETS = f"{BARS}, {_SIGNAL}, rets AS (SELECT symbol, bar, idx, close, t, ln(close / lag(close) OVER ({WS})) / 100 AS mkt, coalesce(lag(t) OVER ({WS}), 0) * ln(close / lag(close) OVER ({WS})) / 100 AS ret FROM s)"


def returns(spark, d, rows=None, by=("symbol",)):
    w = fw.W.partitionBy(*by).orderBy("idx")
    mkt = F.log(F.col("close") / F.lag("close").over(w)) / 100
    rows = (_signals(spark, d) if rows is None else rows).withColumns({"mkt": mkt, "ret": F.coalesce(F.lag("t").over(w), F.lit(0)) * mkt})
    return rows.select(*by, "bar", "idx", "close", "t", "mkt", "ret")


_MOM = """n, mean, sd, skew, kurt, coalesce(mean / nullif(sd, 0), 0) AS sharpe FROM (SELECT {k}, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd,
  (avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / nullif(var_pop(ret), 0) ** 1.5 AS skew,
  (avg(ret ** 4) - 4 * avg(ret) * avg(ret ** 3) + 6 * avg(ret) ** 2 * avg(ret ** 2) - 3 * avg(ret) ** 4) / nullif(var_pop(ret), 0) ** 2 AS kurt FROM {t} WHERE ret IS NOT NULL GROUP BY {k})"""


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0 AS {n}" for n in names)


def _pick(df, keep, *names, digits=6):
    return df.select(*keep, *[r(n, digits).alias(n) for n in names])


@query("return_moments", f"WITH {RETS}, o AS (SELECT symbol, {_MOM.format(k='symbol', t='rets')}) SELECT symbol, n, {_rounded('mean', 'sd', 'skew', 'kurt', 'sharpe')} FROM o")
def return_moments(spark, d):
    return _pick(stats.moments(returns(spark, d), ["symbol"]), ["symbol", "n"], "mean", "sd", "skew", "kurt", "sharpe")


@query("probabilistic_sharpe", f"WITH {RETS}, o AS (SELECT symbol, {_MOM.format(k='symbol', t='rets')}), z AS (SELECT *, {stats.psr_z('n', 'sharpe', 'skew', 'kurt')} AS z FROM o) SELECT symbol, n, round({normal.cdf_sql('z')}, 6) AS psr FROM z")
def probabilistic_sharpe(spark, d):
    return _pick(stats.probabilistic_sharpe(returns(spark, d), ["symbol"]), ["symbol", "n"], "psr")


_SWEEP_RETS = f"{BARS}, {_SWEEP}, rets AS (SELECT {_KEYS}, idx, coalesce(lag(t) OVER (PARTITION BY {_KEYS} ORDER BY idx), 0) * ln(close / lag(close) OVER (PARTITION BY {_KEYS} ORDER BY idx)) / 100 AS ret FROM s)"


@query("deflated_sharpe", f"""WITH {_SWEEP_RETS}, o AS (SELECT {_KEYS}, {_MOM.format(k=_KEYS, t='rets')}),
f AS (SELECT symbol, count(*) AS trials, var_samp(sharpe) AS v, arg_max({{'n': n, 'sharpe': sharpe, 'skew': skew, 'kurt': kurt}}, (sharpe, n)) AS b FROM o GROUP BY symbol),
g AS (SELECT symbol, trials, b.n AS n, b.sharpe AS sharpe, b.skew AS skew, b.kurt AS kurt, {stats.expected_max_sql('trials', 'coalesce(v, 1e0 / (b.n - 1))')} AS hurdle FROM f),
z AS (SELECT *, {stats.psr_z('n', 'sharpe', 'skew', 'kurt', 'hurdle')} AS z FROM g)
SELECT symbol, trials, round(sharpe, 6) AS best, round(hurdle, 6) AS hurdle, round({normal.cdf_sql('z')}, 6) AS dsr FROM z""")
def deflated_sharpe(spark, d):
    rows = returns(spark, d, _sweep(spark, d), ("symbol", "fast", "slow"))
    return _pick(stats.deflated_sharpe(stats.moments(rows, ["symbol", "fast", "slow"]), ["symbol"]), ["symbol", "trials"], "best", "hurdle", "dsr")


def _acov(lags: int) -> str:
    lagged = ", ".join(f"lag(c, {k}) OVER ({WS}) AS c{k}" for k in range(1, lags + 1))
    sums = ", ".join(f"coalesce(sum(c * c{k}), 0) AS g{k}" for k in range(1, lags + 1))
    return f"""c0 AS (SELECT symbol, idx, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS c FROM rets WHERE ret IS NOT NULL), c1 AS (SELECT *, {lagged} FROM c0),
g AS (SELECT symbol, count(*) AS n, avg(ret) AS mean, sum(c * c) AS g0, {sums} FROM c1 GROUP BY symbol)"""


@query("newey_west_t", f"""WITH {RETS}, {_acov(24)}, l AS (SELECT *, CAST(floor(4 * pow(n / 100, 2.0 / 9)) AS INTEGER) AS lag FROM g)
SELECT symbol, n, lag, round(mean / nullif(sqrt(greatest(0, g0 + {' + '.join(f'2 * greatest(0, 1 - {k} / (lag + 1)) * g{k}' for k in range(1, 25))})) / n, 0), 6) AS t FROM l""")
def newey_west_t(spark, d):
    return _pick(stats.newey_west(returns(spark, d), ["symbol"]), ["symbol", "n", "lag"], "t")


@query("lo_sharpe", f"""WITH {RETS}, {_acov(20)}, k AS (SELECT *, least(20, n // 4, 364) AS k FROM g WHERE n >= 30),
f AS (SELECT *, 1 / sqrt(greatest(0.05, 1 + 2 * ({' + '.join(f'CASE WHEN k >= {j} THEN (1 - {j} / 365.0::DOUBLE) * g{j} / nullif(g0, 0) ELSE 0 END' for j in range(1, 21))}))) AS factor, mean / nullif(sqrt(g0 / (n - 1)), 0) * sqrt(365.0::DOUBLE) AS sharpe FROM k)
SELECT symbol, n, round(sharpe, 6) AS sharpe, round(factor, 6) AS factor, round(sharpe * factor, 6) AS adjusted FROM f""")
def lo_sharpe(spark, d):
    return _pick(stats.lo_sharpe(returns(spark, d), ["symbol"], 365.0), ["symbol", "n"], "sharpe", "factor", "adjusted")


@query("return_ratios", f"""WITH {RETS} SELECT symbol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(8760::DOUBLE), 6) AS sharpe, round(avg(ret) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) * sqrt(8760::DOUBLE), 6) AS sortino,
  round(sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0), 6) AS profit_factor, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM rets WHERE ret IS NOT NULL GROUP BY symbol""")
def return_ratios(spark, d):
    return _pick(stats.ratios(returns(spark, d), ["symbol"], 8760), ["symbol"], "sharpe", "sortino", "profit_factor", "hit_rate", "total")


_EQUITY = f"""e0 AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({WS})) AS equity FROM rets WHERE ret IS NOT NULL), eq AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER ({WS})) AS drawdown FROM e0)"""


@query("equity_drawdown", f"WITH {RETS}, {_EQUITY} SELECT symbol, bar, round(equity, 6) AS equity, round(drawdown, 6) + 0 AS drawdown FROM eq")
def equity_drawdown(spark, d):
    return _pick(stats.equity(returns(spark, d), ["symbol"]), ["symbol", "bar"], "equity", "drawdown")


_EPISODES = f"""{_EQUITY}, u0 AS (SELECT *, round(drawdown, 12) > 0 AS under FROM eq), u1 AS (SELECT *, CASE WHEN lag(under) OVER ({WS}) IS NOT DISTINCT FROM under AND row_number() OVER ({WS}) > 1 THEN 0 ELSE 1 END AS nw FROM u0),
u2 AS (SELECT *, sum(nw) OVER ({WS}) AS run FROM u1), ep AS (SELECT symbol, min(idx) AS start, arg_min(idx, (-round(drawdown, 12), idx)) AS trough, max(idx) AS end_, count(*) AS n, max(drawdown) AS depth FROM u2 WHERE under GROUP BY symbol, run)"""


@query("drawdown_episodes", f"""WITH {RETS}, {_EPISODES}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(depth, 9) DESC, start) AS place FROM ep)
SELECT symbol, place, start AS first_idx, trough AS trough_idx, end_ AS last_idx, n, round(depth, 6) AS depth FROM p WHERE place <= 5""")
def drawdown_episodes(spark, d):
    rows = stats.episodes(returns(spark, d), ["symbol"])
    return rows.select("symbol", "place", F.col("start").alias("first_idx"), F.col("trough").alias("trough_idx"), F.col("end").alias("last_idx"), F.col("rows").alias("n"), r("depth").alias("depth"))


@query("drawdown_summary", f"""WITH {RETS}, {_EPISODES}, l AS (SELECT symbol, max(n) AS longest FROM ep GROUP BY symbol), x AS (SELECT symbol, max(drawdown) AS mx, avg(drawdown) AS mn FROM u0 WHERE under GROUP BY symbol)
SELECT symbol, round(mx, 6) AS max_drawdown, round(mn, 6) AS mean_drawdown, longest FROM x JOIN l USING (symbol)""")
def drawdown_summary(spark, d):
    return _pick(stats.drawdown_summary(returns(spark, d), ["symbol"]), ["symbol", "longest"], "max_drawdown", "mean_drawdown")


@query("var_cvar", f"""WITH {RETS}, q AS (SELECT symbol, unnest([0.05, 0.01])::DOUBLE AS level, unnest(quantile_cont(ret, [0.05, 0.01])) AS v, min(ret) AS worst FROM rets WHERE ret IS NOT NULL GROUP BY symbol)
SELECT q.symbol, level, round(v, 6) + 0 AS var, round(worst, 6) AS worst, round(avg(CASE WHEN ret <= v THEN ret END), 6) AS es FROM q JOIN rets ON q.symbol = rets.symbol AND ret IS NOT NULL GROUP BY ALL""")
def var_cvar(spark, d):
    return _pick(stats.tail(returns(spark, d), ["symbol"]), ["symbol", "level"], "var", "worst", "es")


@query("cvar_worst_share", f"""WITH {RETS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret, idx) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL)
SELECT symbol, CAST(greatest(1, ceil(n * 0.05)) AS BIGINT) AS k, round(avg(ret), 6) AS cvar FROM k WHERE i <= greatest(1, ceil(n * 0.05)) GROUP BY symbol, n""")
def cvar_worst_share(spark, d):
    return _pick(stats.cvar(returns(spark, d), ["symbol"]), ["symbol", "k"], "cvar")


@query("weekly_returns", f"""WITH {RETS} SELECT symbol, bar // 168 AS period, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) + 0 AS total, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0), 6) AS sharpe FROM rets WHERE ret IS NOT NULL GROUP BY symbol, rets.bar // 168""")
def weekly_returns(spark, d):
    return _pick(stats.by_period(returns(spark, d), ["symbol"], F.floor(F.col("bar") / 168).cast("long")), ["symbol", "period", "n"], "total", "sharpe")


@query("regime_breakdown", f"""WITH {RETS}, v AS (SELECT *, CASE WHEN count(mkt) OVER f >= 20 THEN sum(mkt) OVER f END AS trend, CASE WHEN count(mkt) OVER f >= 20 THEN stddev_samp(mkt) OVER f END AS vol FROM rets WINDOW f AS ({WS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, median(vol) OVER (PARTITION BY symbol) AS mid FROM v), x AS (SELECT symbol, ret, unnest([CASE WHEN trend > 0 THEN 'rising' ELSE 'falling' END, CASE WHEN vol > mid THEN 'wild' ELSE 'calm' END]) AS regime FROM m WHERE vol IS NOT NULL AND ret IS NOT NULL)
SELECT symbol, regime, count(*) AS n, round(avg(ret), 6) + 0 AS mean FROM x GROUP BY ALL""")
def regime_breakdown(spark, d):
    return _pick(stats.regimes(returns(spark, d), ["symbol"], "mkt"), ["symbol", "regime", "n"], "mean")


@query("returns_histogram", f"""WITH {RETS}, x AS (SELECT * FROM rets WHERE ret <> 0), q AS (SELECT symbol, quantile_cont(ret, 0.005) AS a, quantile_cont(ret, 0.995) AS z FROM x GROUP BY symbol)
SELECT x.symbol, CAST(least(19, floor((ret - a) / (z - a) * 20)) AS INTEGER) AS bin, count(*) AS n FROM x JOIN q USING (symbol) WHERE ret BETWEEN a AND z GROUP BY ALL""")
def returns_histogram(spark, d):
    return stats.histogram(returns(spark, d), ["symbol"])


_CORR = """c AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.mkt, y.mkt) AS corr FROM rets x JOIN rets y ON x.bar = y.bar AND x.symbol < y.symbol WHERE x.mkt IS NOT NULL AND y.mkt IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"""


@query("correlation_pairs", f"WITH {RETS}, {_CORR} SELECT a, b, n, round(corr, 6) AS corr FROM c")
def correlation_pairs(spark, d):
    return _pick(stats.correlations(returns(spark, d), "symbol", "bar", "mkt"), ["a", "b", "n"], "corr")


@query("effective_number", f"WITH {RETS}, {_CORR}, k AS (SELECT count(*) AS m FROM (SELECT a FROM c UNION SELECT b FROM c)) SELECT m, round(m * m / (m + 2 * sum(corr * corr)), 6) AS effective FROM c, k GROUP BY m")
def effective_number(spark, d):
    return _pick(stats.effective_number(stats.correlations(returns(spark, d), "symbol", "bar", "mkt")), ["m"], "effective")


@query("tail_dependence", f"""WITH {RETS}, u AS (SELECT symbol, bar, row_number() OVER (PARTITION BY symbol ORDER BY mkt, bar) / (count(*) OVER (PARTITION BY symbol) + 1) AS u FROM rets WHERE mkt IS NOT NULL)
SELECT x.symbol AS a, y.symbol AS b, round(count(*) FILTER (x.u <= 0.1 AND y.u <= 0.1) / nullif(count(*) FILTER (x.u <= 0.1), 0), 6) AS lower, round(count(*) FILTER (x.u >= 0.9 AND y.u >= 0.9) / nullif(count(*) FILTER (x.u >= 0.9), 0), 6) AS upper
FROM u x JOIN u y ON x.bar = y.bar AND x.symbol < y.symbol GROUP BY ALL""")
def tail_dependence(spark, d):
    return _pick(stats.tail_dependence(returns(spark, d), "symbol", "bar", "mkt"), ["a", "b"], "lower", "upper")


_TRADES = f"{BARS}, {_SIGNAL}, {trades_sql('s', 'symbol')}, tr AS (SELECT *, round(ln(factor), 9) AS pnl FROM trades WHERE factor > 0)"


def _trade_list(spark, d):
    return backtest.trades(_signals(spark, d), "t", ["symbol"]).where("factor > 0").withColumn("pnl", F.round(F.log("factor"), 9))


@query("trade_statistics", f"""WITH {_TRADES}, w AS (SELECT *, CASE WHEN lag(pnl > 0) OVER (PARTITION BY symbol ORDER BY entry_idx) IS NOT DISTINCT FROM (pnl > 0) AND row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) > 1 THEN 0 ELSE 1 END AS nw FROM tr),
x AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY entry_idx) AS run FROM w), kk AS (SELECT symbol, run, pnl > 0 AS won, count(*) AS k FROM x GROUP BY ALL), st AS (SELECT symbol, coalesce(max(k) FILTER (won), 0) AS most_wins, coalesce(max(k) FILTER (NOT won), 0) AS most_losses FROM kk GROUP BY symbol),
tg AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win, -avg(pnl) FILTER (pnl < 0) AS avg_loss, avg(pnl) AS expectancy, sum(greatest(pnl, 0)) / nullif(-sum(least(pnl, 0)), 0) AS profit_factor,
  max(pnl) AS best, min(pnl) AS worst, median(pnl) AS median, stddev_pop(pnl) AS sd, (avg(pnl ** 3) - 3 * avg(pnl) * avg(pnl ** 2) + 2 * avg(pnl) ** 3) / nullif(var_pop(pnl), 0) ** 1.5 AS skew, avg(exit_idx - entry_idx) AS holding FROM tr GROUP BY symbol),
th AS (SELECT *, avg_win / nullif(avg_loss, 0) AS win_loss FROM tg), o AS (SELECT *, win_rate - 1 / (1 + win_loss) AS edge, win_rate - (1 - win_rate) / nullif(win_loss, 0) AS kelly FROM th JOIN st USING (symbol))
SELECT symbol, n, most_wins, most_losses, {_rounded('win_rate', 'avg_win', 'avg_loss', 'expectancy', 'profit_factor', 'best', 'worst', 'median', 'sd', 'skew', 'holding', 'win_loss', 'edge', 'kelly')} FROM o""")
def trade_statistics(spark, d):
    found = stats.trade_statistics(_trade_list(spark, d), ["symbol"])
    return _pick(found, ["symbol", "n", "most_wins", "most_losses"], "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "best", "worst", "median", "sd", "skew", "holding", "win_loss", "edge", "kelly")


_TF = "OVER (PARTITION BY symbol ORDER BY entry_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("rolling_trade_ratios", f"""WITH {_TRADES} SELECT symbol, entry_idx, round(CASE WHEN count(pnl) {_TF} >= 10 THEN sum(greatest(pnl, 0)) {_TF} / nullif(-sum(least(pnl, 0)) {_TF}, 0) END, 6) AS profit_factor,
  round(CASE WHEN count(pnl) {_TF} >= 10 THEN avg(pnl) {_TF} / nullif(stddev_samp(pnl) {_TF}, 0) END, 6) AS sharpe FROM tr""")
def rolling_trade_ratios(spark, d):
    w, p = fw.by("symbol", "entry_idx"), F.col("pnl")
    gain = fw.rolling(F.sum, F.greatest(p, F.lit(0.0)), 10, w)
    loss = fw.rolling(F.sum, F.greatest(-p, F.lit(0.0)), 10, w)
    sharpe = fw.div(fw.rolling(F.avg, p, 10, w), fw.rolling(F.stddev_samp, p, 10, w))
    return _trade_list(spark, d).select("symbol", "entry_idx", r(fw.div(gain, loss)).alias("profit_factor"), r(sharpe).alias("sharpe"))


@query("hhi_concentration", f"""WITH {MONTHS}, {_WEIGHTS}, g AS (SELECT bar, sum(abs(weight)) AS gross, sum(weight) AS net, sum(weight * weight) AS s, max(abs(weight)) AS largest FROM w GROUP BY bar)
SELECT bar, round(gross, 6) AS gross, round(net, 6) + 0 AS net, round(s / nullif(gross * gross, 0), 6) AS hhi, round(1 / nullif(s / nullif(gross * gross, 0), 0), 6) AS effective, round(largest, 6) AS largest FROM g""")
def hhi_concentration(spark, d):
    rows = xsection.legs(monthly(spark, d).withColumn("ret", F.round("ret", 9)), "ret", 5)
    rows = stats.concentration(rows).withColumn("effective", fw.div(F.lit(1.0), F.col("hhi")))
    return _pick(rows, ["bar"], "gross", "net", "hhi", "effective", "largest")


@query("periods_per_year", f"""WITH {BARS}, d AS (SELECT symbol, bar * 3600 AS s, bar * 3600 - lag(bar * 3600) OVER ({WS}) AS dd FROM b), g AS (SELECT symbol, count(*) AS n, max(s) - min(s) AS span, median(CASE WHEN dd > 0 THEN dd END) AS step FROM d GROUP BY symbol)
SELECT symbol, round(CASE WHEN span >= 2592000 THEN (n - 1) / (span / 31557600.0::DOUBLE) ELSE coalesce(31557600.0::DOUBLE / step, 252) END, 6) AS periods FROM g""")
def periods_per_year(spark, d):
    return _pick(stats.periods_per_year(hourly(spark, d).withColumn("s", F.col("bar") * 3600), ["symbol"], "s"), ["symbol"], "periods")


@query("stress_replay", f"""WITH {RETS}, w AS (SELECT * FROM (VALUES ('first week', 473352, 473519), ('mid', 473600, 473650), ('late', 473900, 474000)) v(name, a, z))
SELECT symbol, name, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) + 0 AS total FROM rets JOIN w ON bar BETWEEN a AND z WHERE ret > -1 GROUP BY ALL""")
def stress_replay(spark, d):
    windows = [("first week", 473352, 473519), ("mid", 473600, 473650), ("late", 473900, 474000)]
    return _pick(stats.stress_replay(returns(spark, d), windows, ["symbol"], "bar"), ["symbol", "name", "n"], "total")


@query("rolling_sharpe", f"""WITH {RETS} SELECT symbol, bar, round(CASE WHEN count(ret) OVER f >= 72 THEN avg(ret) OVER f / nullif(stddev_samp(ret) OVER f, 0) * sqrt(8760::DOUBLE) END, 4) AS sharpe FROM rets
WINDOW f AS ({WS} ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, d):
    w, x = fw.by(), F.col("ret")
    s = fw.div(fw.rolling(F.avg, x, 72, w), fw.rolling(F.stddev_samp, x, 72, w)) * 8760**0.5
    return returns(spark, d).select("symbol", "bar", r(s, 4).alias("sharpe"))


@query("rolling_stability", f"""WITH {RETS}, k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1) * 8 / count(*) OVER (PARTITION BY symbol)) AS INTEGER) AS part FROM rets WHERE ret IS NOT NULL),
g AS (SELECT symbol, part, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS s FROM k GROUP BY ALL) SELECT symbol, count(*) AS parts, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END), 6) AS positive, round(min(s), 6) AS worst, round(stddev_samp(s), 6) AS spread FROM g GROUP BY symbol""")
def rolling_stability(spark, d):
    w = fw.W.partitionBy("symbol")
    rows = returns(spark, d).where("ret IS NOT NULL").withColumn("part", F.floor((F.row_number().over(w.orderBy("idx")) - 1) * 8 / F.count(F.lit(1)).over(w)).cast("int"))
    one = rows.groupBy("symbol", "part").agg(F.coalesce(fw.div(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("s"))
    return one.groupBy("symbol").agg(F.count(F.lit(1)).alias("parts"), r(F.avg((F.col("s") > 0).cast("double"))).alias("positive"), r(F.min("s")).alias("worst"), r(F.stddev_samp("s")).alias("spread"))
