"""Registered front-door checks and what they are made of, with their SQL twins."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal, xsection
from ..functions import windows as fw
from ..operators import evidence, front, robust, stats
from ..sources.tables import table, ticks
from .base import BARS, TICKS, WS, hourly, query, r
from .research import PANEL, _ic, kept_panel, panel
from .resampling import RC, h, plain
from .robust import COST, _net, _SHARPE
from .stats import RETS, _MOM, _acov, _pick, _SWEEP_RETS, returns
from .trading import _OPT, option_trades

_Z95, _Z80 = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.8)
_TRACK = f"mo AS (SELECT symbol, {_MOM.format(k='symbol', t='rets')}), tk AS (SELECT *, CASE WHEN sharpe > 0 THEN CAST(ceil(round(1 + greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12) * pow({_Z95!r} / sharpe, 2), 6)) AS BIGINT) END AS needed FROM mo)"


@query("min_track_record", f"WITH {RETS}, {_TRACK} SELECT symbol, n, needed FROM tk")
def min_track_record(spark, d):
    """Rows until the ratio beats zero with confidence, beside those there are."""
    return front.track_record(stats.moments(returns(spark, d), ["symbol"])).select("symbol", "n", "needed")


@query("search_power", f"""WITH {_SWEEP_RETS}, o AS (SELECT symbol, fast, slow, count(*) AS n, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS s FROM rets WHERE ret IS NOT NULL GROUP BY ALL), g AS (SELECT symbol, count(*) AS trials, max(n) AS n, round(max(s) * sqrt(8760::DOUBLE), 9) AS best FROM o GROUP BY symbol)
SELECT symbol, trials, round((-{normal.ppf_sql('(0.05e0 / trials)')} + {_Z80!r}) / sqrt(n) * sqrt(8760::DOUBLE), 6) AS detectable, round(CASE WHEN best > 0 THEN 2 * ln(trials) / (best * best) END, 5) AS years_needed, round(n / 8760, 6) AS years FROM g""")
def search_power(spark, d):
    """What a search could have told from luck, and how long a history its best result asks for."""
    from .market import _sweep

    one = stats.moments(returns(spark, d, _sweep(spark, d), ("symbol", "fast", "slow")), ["symbol", "fast", "slow"])
    g = one.groupBy("symbol").agg(F.count(F.lit(1)).alias("trials"), F.max("n").alias("n"), F.round(F.max("sharpe") * 8760**0.5, 9).alias("best"))
    return g.select("symbol", "trials", r(front.least_detectable("trials", F.col("n"), 8760)).alias("detectable"), r(front.least_years(F.col("best"), F.col("trials")), 5).alias("years_needed"), r(F.col("n") / 8760).alias("years"))


_NW = _acov(24) + ", nwl AS (SELECT *, CAST(floor(4 * pow(n / 100, 2.0 / 9)) AS INTEGER) AS lag FROM g), nw AS (SELECT symbol, mean / nullif(sqrt(greatest(0, g0 + " + " + ".join(f"2 * greatest(0, 1 - {k} / (lag + 1)) * g{k}" for k in range(1, 25)) + ")) / n, 0) AS t FROM nwl)"


@query("mean_hurdle", f"WITH {RETS}, {_NW} SELECT symbol, round(t, 6) AS t, CASE WHEN round(t, 9) IS NULL OR round(t, 9) < 2 THEN 'info' WHEN round(t, 9) < 3 THEN 'warn' ELSE 'pass' END AS status FROM nw")
def mean_hurdle(spark, d):
    one = stats.newey_west(returns(spark, d), ["symbol"])
    return one.select("symbol", r("t").alias("t"), front.hurdle_status(F.round("t", 9)).alias("status"))


_STRATEGY = f"""{RETS}, {_TRACK}, {_NW}, bd AS (SELECT symbol, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close) OR low <= 0) AS bad FROM b GROUP BY symbol),
x0 AS (SELECT *, ntile(2) OVER ({WS}) AS half, sum(ln(1 + ret)) OVER ({WS}) AS e, abs(t - coalesce(lag(t) OVER ({WS}), 0)) AS traded FROM rets WHERE ret IS NOT NULL), x1 AS (SELECT *, 1 - exp(e - greatest(0, max(e) OVER ({WS}))) AS dd FROM x0),
mr AS (SELECT symbol, max(dd) AS dd, sum(ret) AS total, sum(traded) AS traded, avg(ret) FILTER (half = 1) AS h1, avg(ret) FILTER (half = 2) AS h2 FROM x1 GROUP BY symbol),
al AS (SELECT symbol, bad, round(total - 0.0005 * traded, 9) AS net, round(dd, 9) AS dd, round(nw.t, 9) AS t, n / needed AS need, round(least(h1, h2), 9) AS gap FROM tk JOIN mr USING (symbol) JOIN bd USING (symbol) JOIN nw USING (symbol)),
ck AS (SELECT symbol, unnest(['prices_hold', 'net_of_costs', 'drawdown', 'mean_hurdle', 'track_record', 'both_halves']) AS id, unnest(['integrity', 'economics', 'economics', 'statistics', 'statistics', 'statistics']) AS category,
  unnest([CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN net <= -0.5 THEN 'fail' WHEN net <= 0 THEN 'warn' ELSE 'pass' END, CASE WHEN dd > 0.9 THEN 'fail' WHEN dd > 0.3 THEN 'warn' ELSE 'pass' END, CASE WHEN t IS NULL THEN 'skip' WHEN t < 0 THEN 'fail' WHEN t < 3 THEN 'warn' ELSE 'pass' END, CASE WHEN need IS NULL THEN 'skip' WHEN need < 1 THEN 'warn' ELSE 'pass' END, CASE WHEN gap <= 0 THEN 'warn' ELSE 'pass' END]) AS status,
  unnest([bad::DOUBLE, net, dd, t, round(need, 9), gap]) AS v FROM al),
vd AS (SELECT symbol, CASE WHEN bool_or(status = 'fail' AND category IN ('integrity', 'lookahead', 'economics')) THEN 'REJECT' WHEN bool_or(status = 'fail') THEN 'NEEDS_MORE_EVIDENCE' WHEN bool_or(status = 'warn') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict, string_agg(id || '=' || status, ',' ORDER BY id) AS body FROM ck GROUP BY symbol),
ce AS (SELECT symbol, verdict, substr(sha256(symbol || '|' || verdict || '|' || body), 1, 16) AS certificate FROM vd)"""


def _strategy(spark, d):
    return front.strategy_checks(returns(spark, d), hourly(spark, d), ["symbol"])


@query("strategy_checks", f"WITH {_STRATEGY} SELECT symbol, id, category, status, round(v, 6) + 0 AS value FROM ck")
def strategy_checks(spark, d):
    return _strategy(spark, d).withColumn("value", r("value"))


@query("verify_strategy", f"WITH {_STRATEGY} SELECT * FROM ce")
def verify_strategy(spark, d):
    """Signals and bars in, a verdict and a certificate for each symbol out."""
    return evidence.certificates(_strategy(spark, d), ["symbol"])


@query("recheck_certificates", f"WITH {_STRATEGY} SELECT symbol, CASE symbol WHEN 'view' THEN 'verdict' WHEN 'click' THEN 'content' ELSE 'match' END AS status FROM ce UNION ALL SELECT 'unknown', 'missing'")
def recheck_certificates(spark, d):
    """Stored certificates, two of them tampered with and one of nothing, against checks run again."""
    checks = _strategy(spark, d)
    stored = evidence.certificates(checks, ["symbol"])
    other = F.when(F.col("verdict") == "PASS", "REJECT").otherwise("PASS")
    stored = stored.withColumns({"verdict": F.when(F.col("symbol") == "view", other).otherwise(F.col("verdict")), "certificate": F.when(F.col("symbol") == "click", "0" * 16).otherwise(F.col("certificate"))})
    stored = stored.unionByName(spark.sql("SELECT 'unknown' AS symbol, 'PASS' AS verdict, 'ffff' AS certificate"))
    return front.rechecked(stored, checks, ["symbol"])


_ALPHA = f"""{PANEL}, vi AS (SELECT * FROM pn WHERE ret IS NOT NULL AND fwd IS NOT NULL), {_ic('ret', 'fwd', 'vi', 'bar')}, im AS (SELECT avg(ic) AS ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS ic_t FROM ic), {_net('pn')}, ws AS (SELECT {_SHARPE.format('net')} AS sharpe FROM net),
o AS (SELECT net, row_number() OVER (ORDER BY bar) - 1 AS i, count(*) OVER () AS n FROM net), z AS (SELECT *, n // 6 AS size, n % 6 AS more FROM o), g AS (SELECT *, CASE WHEN i < more * (size + 1) THEN i // (size + 1) ELSE more + (i - more * (size + 1)) // size END AS g FROM z),
pt AS (SELECT *, CASE WHEN g < more THEN i - g * (size + 1) ELSE i - more * (size + 1) - (g - more) * size END AS pos, CASE WHEN g < more THEN size + 1 ELSE size END AS len FROM g), pr AS (SELECT a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b),
ps AS (SELECT a, b, {_SHARPE.format('net')} AS s FROM pt JOIN pr ON g = a OR g = b WHERE pos >= 1 AND pos < len - 1 GROUP BY a, b), pa AS (SELECT avg(CASE WHEN round(s, 9) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS paths FROM ps),
sy AS (SELECT DISTINCT symbol FROM pn), sk AS (SELECT rep, symbol, row_number() OVER (PARTITION BY rep ORDER BY {h("'1'", 'rep', 'symbol')}, symbol) AS k, count(*) OVER (PARTITION BY rep) AS n FROM sy, (SELECT unnest(range(100)) AS rep)), sub AS (SELECT pn.*, rep FROM pn JOIN sk USING (symbol) WHERE k <= round(0.7 * n)), {_net('sub', 'rep', name='sn')},
sm AS (SELECT rep, avg(net) AS m FROM sn GROUP BY rep), su AS (SELECT avg(CASE WHEN round(m, 12) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS subsets FROM sm), al AS (SELECT round(ic, 6) AS ic, round(ic_t, 6) AS ic_t, round(sharpe, 6) AS sharpe, round(paths, 6) AS paths, round(subsets, 6) AS subsets FROM im, ws, pa, su),
ck AS (SELECT 'ret' AS score, unnest(['mean_ic', 'ic_significance', 'net_sharpe', 'purged_paths', 'subsets']) AS id, unnest(['statistics', 'statistics', 'economics', 'statistics', 'statistics']) AS category, unnest([CASE WHEN abs(ic) < 0.01 THEN 'warn' ELSE 'pass' END, CASE WHEN abs(ic_t) < 1 THEN 'fail' WHEN abs(ic_t) < 2 THEN 'warn' ELSE 'pass' END,
  CASE WHEN sharpe < -1 THEN 'fail' WHEN sharpe <= 0 THEN 'warn' ELSE 'pass' END, CASE WHEN paths < 0.6 THEN 'warn' ELSE 'pass' END, CASE WHEN subsets < 0.5 THEN 'fail' WHEN subsets < 0.8 THEN 'warn' ELSE 'pass' END]) AS status, unnest([ic, ic_t, sharpe, paths, subsets]) AS v FROM al)"""


@query("validate_alpha", f"WITH {_ALPHA} SELECT id, category, status, round(v, 5) + 0 AS value FROM ck")
def validate_alpha(spark, d):
    """A score in, evidence rows out: significance, costs, disjoint periods, subsets of names."""
    p = kept_panel(spark, d)
    return front.alpha_checks(p, xsection.rank_ic(p, "ret", "fwd"), "ret", 5, COST, 12).select("id", "category", "status", r("value", 5).alias("value"))


@query("live_against_backtest", f"WITH {RETS}, lv AS (SELECT symbol, bar, lag(ret) OVER ({WS}) * 0.9 - 0.00001 AS lr FROM rets), j AS (SELECT symbol, ret AS a, lr AS b FROM rets JOIN lv USING (symbol, bar) WHERE ret IS NOT NULL AND lr IS NOT NULL) SELECT symbol, count(*) AS n, round(corr(a, b), 6) + 0 AS corr, round(stddev_samp(b - a) * sqrt(8760::DOUBLE), 6) AS tracking, round(avg(b - a) * 8760, 6) + 0 AS gap FROM j GROUP BY symbol")
def live_against_backtest(spark, d):
    """A record that trails its backtest by a bar and pays for it."""
    rets = returns(spark, d)
    live = rets.withColumn("ret", F.lag("ret").over(fw.by()) * 0.9 - 0.00001)
    return _pick(front.live_against(rets.where("ret IS NOT NULL"), live.where("ret IS NOT NULL"), ["symbol"], "bar", 8760), ["symbol", "n"], "corr", "tracking", "gap")


@query("portfolio_risk", f"""WITH {PANEL}, v AS (SELECT symbol, bar, ret FROM pn WHERE ret IS NOT NULL), bk AS (SELECT bar, avg(ret) AS b FROM v GROUP BY bar), c AS (SELECT symbol, covar_samp(ret, b) AS c FROM v JOIN bk USING (bar) GROUP BY symbol), s AS (SELECT symbol, c / sum(c) OVER () AS share FROM c),
p AS (SELECT *, greatest(share, 1e-12) / sum(greatest(share, 1e-12)) OVER () AS p FROM s) SELECT symbol, round(share, 6) + 0 AS share, round(exp(-sum(p * ln(p)) OVER ()), 5) AS bets FROM p""")
def portfolio_risk(spark, d):
    out = front.portfolio_risk(panel(spark, d).where("ret IS NOT NULL"), "symbol", "bar", "ret")
    return out.select("symbol", r("share").alias("share"), r("bets", 5).alias("bets"))


@query("drawdown_plausibility", f"""WITH {RETS}, mo AS (SELECT symbol, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM rets WHERE ret IS NOT NULL GROUP BY symbol), pa AS (SELECT mo.*, rep, unnest(range(n)) AS idx FROM mo, (SELECT unnest(range(500)) AS rep)),
z AS (SELECT symbol, rep, idx, ln(1 + mean + sd * {normal.ppf_sql('((' + h("'1'", 'rep', 'symbol', 'idx') + ' + 0.5) / 4294967296)')}) AS l FROM pa), e AS (SELECT *, sum(l) OVER (PARTITION BY symbol, rep ORDER BY idx) AS e FROM z), dd AS (SELECT symbol, rep, 1 - exp(e - greatest(0, max(e) OVER (PARTITION BY symbol, rep ORDER BY idx))) AS d FROM e),
m AS (SELECT symbol, rep, max(d) AS d FROM dd GROUP BY ALL), q AS (SELECT symbol, quantile_cont(d, 0.05) AS p5, quantile_cont(d, 0.99) AS p99 FROM m GROUP BY symbol), oe AS (SELECT symbol, idx, sum(ln(1 + ret)) OVER ({WS}) AS e FROM rets WHERE ret IS NOT NULL), ob AS (SELECT symbol, 1 - exp(e - greatest(0, max(e) OVER ({WS}))) AS d FROM oe), om AS (SELECT symbol, max(d) AS seen FROM ob GROUP BY symbol)
SELECT symbol, round(seen, 6) AS seen, round(p5, 6) AS p5, round(p99, 6) AS p99, CASE WHEN round(seen, 9) < round(p5, 9) OR round(seen, 9) > round(p99, 9) THEN 'warn' ELSE 'pass' END AS status FROM q JOIN om USING (symbol)""")
def drawdown_plausibility(spark, d):
    """The greatest drawdown against those of normal returns of the same mean, deviation and length."""
    rets = returns(spark, d)
    draws = front.drawdown_draws(stats.moments(rets, ["symbol"]), ["symbol"], 500).groupBy("symbol").agg(F.percentile("dd", F.array(F.lit(0.05), F.lit(0.99))).alias("q"))
    w = fw.by().rowsBetween(W.unboundedPreceding, 0)
    seen = rets.where("ret IS NOT NULL").withColumn("e", F.sum(F.log1p("ret")).over(w)).withColumn("d", 1 - F.exp(F.col("e") - F.greatest(F.lit(0.0), F.max("e").over(w)))).groupBy("symbol").agg(F.max("d").alias("seen"))
    out = draws.join(seen, "symbol")
    odd = (F.round("seen", 9) < F.round(F.col("q")[0], 9)) | (F.round("seen", 9) > F.round(F.col("q")[1], 9))
    return out.select("symbol", r("seen").alias("seen"), r(F.col("q")[0]).alias("p5"), r(F.col("q")[1]).alias("p99"), F.when(odd, "warn").otherwise("pass").alias("status"))


@query("holdings", f"""WITH {RETS}, sg AS (SELECT *, sign(t) AS s FROM rets), n AS (SELECT *, CASE WHEN s <> coalesce(lag(s) OVER ({WS}), 0) THEN 1 ELSE 0 END AS nw FROM sg), u AS (SELECT *, sum(nw) OVER ({WS}) AS run FROM n), rl AS (SELECT symbol, run, count(*) AS len FROM u WHERE s <> 0 GROUP BY ALL), ra AS (SELECT symbol, count(*) AS runs, median(len) AS median_hold FROM rl GROUP BY symbol)
SELECT symbol, bars, round(exposure, 6) AS exposure, round(long_share, 6) AS long_share, runs, median_hold FROM (SELECT symbol, count(*) AS bars, avg(CASE WHEN s <> 0 THEN 1.0 ELSE 0 END) AS exposure, sum(greatest(t, 0)) / nullif(sum(abs(t)), 0) AS long_share FROM u GROUP BY symbol) LEFT JOIN ra USING (symbol)""")
def holdings(spark, d):
    out = front.holdings(returns(spark, d), ["symbol"], "t")
    return out.select("symbol", "bars", r("exposure").alias("exposure"), r("long_share").alias("long_share"), "runs", "median_hold")


@query("mirrored_future", f"WITH {BARS}, p AS (SELECT *, max(close) FILTER (idx = 100) OVER (PARTITION BY symbol) AS c FROM b) SELECT symbol, idx, round(CASE WHEN idx > 100 THEN c * c / open ELSE open END, 8) AS open, round(CASE WHEN idx > 100 THEN c * c / low ELSE high END, 8) AS high, round(CASE WHEN idx > 100 THEN c * c / high ELSE low END, 8) AS low, round(CASE WHEN idx > 100 THEN c * c / close ELSE close END, 8) AS close FROM p")
def mirrored_future(spark, d):
    out = front.mirrored(hourly(spark, d).select("symbol", "idx", "open", "high", "low", "close"), 100)
    return _pick(out, ["symbol", "idx"], "open", "high", "low", "close", digits=8)


@query("foreign_table", f"""WITH {BARS}, x AS (SELECT symbol, idx, close, ln(close / lag(close) OVER ({WS})) AS rr FROM b), y AS (SELECT *, stddev_samp(rr) OVER (PARTITION BY symbol) AS sd, first_value(close) OVER ({WS}) AS s FROM x), z AS (SELECT *, CASE WHEN idx > 0 THEN sd * {normal.ppf_sql('((' + h("'1'", 'symbol', 'idx') + ' + 0.5) / 4294967296)')} ELSE 0 END AS l FROM y)
SELECT symbol, idx, round(ln(s) + sum(l) OVER ({WS}), 5) + 0 AS log_close FROM z""")
def foreign_table(spark, d):
    return front.foreign(hourly(spark, d)).select("symbol", "idx", r(F.log("close"), 5).alias("log_close"))


_FEAT = f"{RC}, fe AS (SELECT symbol, idx - 1 AS idx, lag(mkt) OVER ({WS}) AS f, mkt AS l FROM rc), ft AS (SELECT * FROM fe WHERE f IS NOT NULL), fn AS (SELECT symbol, count(*) AS n, corr(f, l) AS ic FROM ft GROUP BY symbol)"


def _feature(spark, d):
    return plain(spark, d).select("symbol", (F.col("idx") - 1).alias("idx"), F.lag("mkt").over(fw.by()).alias("f"), F.col("mkt").alias("l")).where("f IS NOT NULL")


@query("feature_significance", f"""WITH {_FEAT}, dk AS (SELECT symbol, n, rep, 1 + {h("'1'", 'rep', 'symbol')} % (n - 1) AS k FROM fn, (SELECT unnest(range(200)) AS rep)), nl AS (SELECT a.symbol, rep, corr(a.f, o.l) AS c FROM ft a JOIN dk USING (symbol) JOIN ft o ON o.symbol = a.symbol AND o.idx = (a.idx - k + n) % n GROUP BY ALL)
SELECT symbol, round(ic, 6) + 0 AS ic, round((1 + count(*) FILTER (round(abs(c), 9) >= round(abs(ic), 9))) / (count(*) + 1), 6) AS p FROM nl JOIN fn USING (symbol) GROUP BY symbol, ic""")
def feature_significance(spark, d):
    return _pick(front.significance(_feature(spark, d), ["symbol"], "f", "l", 200), ["symbol"], "ic", "p")


@query("importance_stability", f"WITH {_FEAT}, fo AS (SELECT *, CAST(floor(idx * 5 / count(*) OVER (PARTITION BY symbol)) AS INTEGER) AS fold FROM ft), c AS (SELECT symbol, fold, corr(f, l) AS c FROM fo GROUP BY ALL) SELECT symbol, count(*) AS folds, round(avg(CASE WHEN sign(round(c, 9)) = sign(round(ic, 9)) THEN 1.0 ELSE 0 END), 6) AS same_sign, round(stddev_samp(c), 6) AS spread FROM c JOIN fn USING (symbol) GROUP BY symbol")
def importance_stability(spark, d):
    rows = _feature(spark, d)
    fold = F.floor(F.col("idx") * 5 / F.count(F.lit(1)).over(W.partitionBy("symbol"))).cast("int")
    c = rows.withColumn("fold", fold).groupBy("symbol", "fold").agg(F.corr("f", "l").alias("c")).join(rows.groupBy("symbol").agg(F.corr("f", "l").alias("ic")), "symbol")
    return c.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), r(F.avg((F.signum(F.round("c", 9)) == F.signum(F.round("ic", 9))).cast("double"))).alias("same_sign"), r(F.stddev_samp("c")).alias("spread"))


@query("history_splits", f"WITH {RETS}, a AS (SELECT *, (row_number() OVER ({WS}) - 1) / count(*) OVER (PARTITION BY symbol) AS part_of FROM rets) SELECT symbol, CASE WHEN part_of < 0.5 THEN 'discovery' WHEN part_of < 0.75 THEN 'validation' ELSE 'holdout' END AS part, count(*) AS n, min(idx) AS first, max(idx) AS last FROM a GROUP BY ALL")
def history_splits(spark, d):
    return front.splits(returns(spark, d), ["symbol"], 0.5, 0.25).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


_TRADES = "tm AS (SELECT o_custkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, avg(o_totalprice) AS p FROM orders GROUP BY ALL)"


def _traded(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("t")).agg(F.avg("o_totalprice").alias("p"))


@query("names_that_end", f'WITH {_TRADES} SELECT k, min(t) AS "first", max(t) AS "last", (SELECT max(t) FROM tm) - max(t) AS missing FROM tm GROUP BY k HAVING max(t) < (SELECT max(t) FROM tm)')
def names_that_end(spark, d):
    """Names that stop trading before the end, which a study of today's names leaves out."""
    return front.ended(_traded(spark, d), "k", "t")


@query("terminal_returns", f"WITH {_TRADES}, e AS (SELECT k, max(t) AS t FROM tm GROUP BY k HAVING max(t) < (SELECT max(t) FROM tm)) SELECT k, t, round(p, 4) AS p FROM tm UNION ALL SELECT k, t + 1, round(p * (1 - 0.3), 4) FROM tm JOIN e USING (k, t)")
def terminal_returns(spark, d):
    return _pick(front.terminal(_traded(spark, d), "k", "t", "p", -0.3), ["k", "t"], "p", digits=4)


@query("option_pnl", f"""WITH {_OPT} SELECT trade_id, round(qty * multiplier * (exit_price - fill_price), 3) + 0 AS reported, round(qty * multiplier * (CASE WHEN qty > 0 THEN exit_price - (ask - bid) / 2 ELSE exit_price + (ask - bid) / 2 END - CASE WHEN qty > 0 THEN ask ELSE bid END), 3) + 0 AS touch FROM opt""")
def option_pnl(spark, d):
    """Reported profit of each trade, and what it is when entries and exits pay the spread."""
    half = (F.col("ask") - F.col("bid")) / 2
    buy = F.col("qty") > 0
    touch = F.when(buy, F.col("exit_price") - half).otherwise(F.col("exit_price") + half) - F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    size = F.col("qty") * F.col("multiplier")
    return option_trades(spark, d).select("trade_id", r(size * (F.col("exit_price") - F.col("fill_price")), 3).alias("reported"), r(size * touch, 3).alias("touch"))


@query("latency_summary", f"WITH {TICKS} SELECT symbol, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, max(latency_ms) AS most FROM ticks GROUP BY symbol")
def latency_summary(spark, d):
    q = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = ticks(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.max("latency_ms").alias("most"))
    return out.select("symbol", "n", F.col("q")[0].alias("p50"), r(F.col("q")[1]).alias("p95"), r(F.col("q")[2]).alias("p99"), "most")


@query("worst_bars", f"WITH {RETS}, cw AS (SELECT symbol, bar, mkt, ret, row_number() OVER (PARTITION BY symbol ORDER BY round(mkt, 12), bar) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE mkt IS NOT NULL) SELECT symbol, count(*) AS bars, round(avg(ret), 8) + 0 AS mean, round(avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END), 6) AS losing FROM cw WHERE k <= ceil(n * 0.05) GROUP BY symbol")
def worst_bars(spark, d):
    """What the strategy earns on the twentieth of bars that are worst for its market: a crowd leaves together."""
    w = W.partitionBy("symbol")
    rows = returns(spark, d).where("mkt IS NOT NULL").withColumns({"k": F.row_number().over(w.orderBy(F.round("mkt", 12), "bar")), "n": F.count(F.lit(1)).over(w)}).where(F.col("k") <= F.ceil(F.col("n") * 0.05))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ret"), 8).alias("mean"), r(F.avg((F.col("ret") < 0).cast("double"))).alias("losing"))


@query("hidden_short_volatility", f"WITH {RETS}, {_NW.split(', nwl')[0]}, q AS (SELECT symbol, avg(ret) AS m, avg(mkt) AS mm, regr_slope(ret, mkt * mkt) AS gamma, corr(ret, mkt * mkt) AS bend FROM rets WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY symbol), mo AS (SELECT symbol, {_MOM.format(k='symbol', t='rets')}) SELECT symbol, round(skew, 5) + 0 AS skew, round(kurt, 5) AS kurt, round(gamma, 5) + 0 AS gamma, round(bend, 6) + 0 AS bend, CASE WHEN round(skew, 9) < -1 AND round(kurt, 9) > 6 AND round(gamma, 9) < 0 THEN 'warn' ELSE 'pass' END AS status FROM q JOIN mo USING (symbol)")
def hidden_short_volatility(spark, d):
    """Skew, tails and the slope on the market's squared moves: a strategy that sells insurance shows all three."""
    rows = returns(spark, d).where("ret IS NOT NULL AND mkt IS NOT NULL").withColumn("m2", F.col("mkt") * F.col("mkt"))
    q = rows.groupBy("symbol").agg(F.regr_slope("ret", "m2").alias("gamma"), F.corr("ret", "m2").alias("bend"))
    out = q.join(stats.moments(returns(spark, d), ["symbol"]), "symbol")
    warn = (F.round("skew", 9) < -1) & (F.round("kurt", 9) > 6) & (F.round("gamma", 9) < 0)
    return out.select("symbol", r("skew", 5).alias("skew"), r("kurt", 5).alias("kurt"), r("gamma", 5).alias("gamma"), r("bend").alias("bend"), F.when(warn, "warn").otherwise("pass").alias("status"))


@query("combined_equity", f"WITH {RC}, v AS (SELECT symbol, 1 / nullif(stddev_samp(mkt), 0) AS iv FROM rc GROUP BY symbol), w AS (SELECT symbol, iv / sum(iv) OVER () AS w FROM v), bk AS (SELECT bar, sum(w * mkt) AS ret FROM rc JOIN w USING (symbol) GROUP BY bar) SELECT bar, round(exp(sum(ln(1 + ret)) OVER (ORDER BY bar)), 6) AS equity FROM bk")
def combined_equity(spark, d):
    """The equity of strategies weighted by inverse volatility: a row a bar after they are added up."""
    rows = plain(spark, d)
    v = rows.groupBy("symbol").agg(fw.div(F.lit(1.0), F.stddev_samp("mkt")).alias("iv"))
    w = v.withColumn("w", F.col("iv") / F.sum("iv").over(W.partitionBy())).select("symbol", "w")
    book = rows.join(w, "symbol").groupBy("bar").agg(F.sum(F.col("w") * F.col("mkt")).alias("ret"))
    return book.select("bar", r(F.exp(F.sum(F.log1p("ret")).over(W.orderBy("bar").rowsBetween(W.unboundedPreceding, 0)))).alias("equity"))


@query("volatility_target", f"WITH {RETS} SELECT symbol, bar, round(least(10, 0.15 / nullif(stddev_samp(mkt) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) * sqrt(8760::DOUBLE), 0)) * 10000, 3) AS size FROM rets WHERE mkt IS NOT NULL")
def volatility_target(spark, d):
    """The size that brings a book of 10,000 to a volatility of 15 %, ten times the book at most."""
    vol = F.stddev_samp("mkt").over(fw.by().rowsBetween(-23, 0)) * 8760**0.5
    size = F.least(F.lit(10.0), fw.div(F.lit(0.15), vol)) * 10_000
    rows = returns(spark, d).where("mkt IS NOT NULL").withColumn("_v", vol)
    return rows.select("symbol", "bar", r(F.when(fw.div(F.lit(0.15), vol).isNotNull(), size).otherwise(F.lit(100_000.0)), 3).alias("size"))


_DIV = f"{BARS}, ac AS (SELECT symbol, idx, idx % 50 AS m, 0.01 * close AS div FROM b WHERE idx % 50 IN (7, 31)), ps AS (SELECT b.*, CASE WHEN idx % 20 < 10 THEN 1 ELSE -1 END AS pos FROM b)"


@query("dividend_income", f"WITH {_DIV}, h AS (SELECT *, lag(pos) OVER ({WS}) AS held, lag(close) OVER ({WS}) AS pc FROM ps) SELECT symbol, count(*) AS paid, round(sum(held * div / pc), 6) + 0 AS income FROM h JOIN ac USING (symbol, idx) WHERE held IS NOT NULL GROUP BY symbol")
def dividend_income(spark, d):
    """What positions held over a dividend receive or owe, as a return on the price before."""
    w, i = fw.by(), F.col("idx")
    rows = hourly(spark, d).withColumn("pos", F.when(i % 20 < 10, 1).otherwise(-1))
    rows = rows.withColumns({"held": F.lag("pos").over(w), "pc": F.lag("close").over(w)}).where((i % 50).isin(7, 31) & F.col("held").isNotNull())
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("paid"), r(F.sum(F.col("held") * 0.01 * F.col("close") / F.col("pc"))).alias("income"))


@query("ledger_t_values", "WITH l AS (SELECT o_orderpriority AS data, o_custkey AS variant, arg_max(o_totalprice, o_orderkey) AS sharpe FROM orders GROUP BY ALL) SELECT data, count(*) AS variants, round(max(sharpe / 100000 / sqrt(252::DOUBLE) * sqrt(500::DOUBLE)), 6) AS best, round(avg(sharpe / 100000 / sqrt(252::DOUBLE) * sqrt(500::DOUBLE)), 6) AS mean FROM l GROUP BY data")
def ledger_t_values(spark, d):
    """t values out of a ledger of annual ratios: the last entry of each variant counts."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("data"), F.col("o_custkey").alias("variant")).agg(F.max_by("o_totalprice", "o_orderkey").alias("s"))
    t = F.col("s") / 100_000 / 252**0.5 * 500**0.5
    return o.groupBy("data").agg(F.count(F.lit(1)).alias("variants"), r(F.max(t)).alias("best"), r(F.avg(t)).alias("mean"))
