"""Registered resampling and search statistics, with their SQL twins: draws are hashes, so both sides draw alike."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal
from ..functions import windows as fw
from ..operators import resample, search, stats
from .base import BARS, MONTHS, WS, full, hourly, monthly, query, r
from .market import _KEYS, _SWEEP, _sweep
from .stats import RETS, _MOM, _SWEEP_RETS, _pick, returns

#: Returns without the first row, numbered from 0.
RC = f"{RETS}, rc AS (SELECT symbol, bar, idx - 1 AS idx, mkt FROM rets WHERE mkt IS NOT NULL), nn AS (SELECT symbol, count(*) AS n FROM rc GROUP BY symbol)"


def plain(spark, d):
    return returns(spark, d).where("mkt IS NOT NULL").select("symbol", "bar", (F.col("idx") - 1).alias("idx"), "mkt")


def h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _boot_sql(method: str, seed: int, block: int, starts: str) -> str:
    at = f"({h(repr(str(seed)), 'rep', 'symbol', f'idx // {block}')} % {starts} + idx % {block}) % n"
    return f"""SELECT '{method}' AS method, x.symbol, rep, count(*) AS n, round(sum(rc.mkt), 6) + 0 AS total, round(sum(x.idx * rc.mkt), 4) + 0 AS moment FROM (SELECT symbol, n, rep, idx, {at} AS at FROM
  (SELECT symbol, n, unnest(range(n)) AS idx FROM nn), (SELECT unnest(range(1000)) AS rep)) x JOIN rc ON rc.symbol = x.symbol AND rc.idx = x.at GROUP BY ALL"""


def _marks(rows, method):
    one = rows.groupBy("symbol", "rep").agg(F.count(F.lit(1)).alias("n"), r(F.sum("mkt")).alias("total"), r(F.sum(F.col("idx") * F.col("mkt")), 4).alias("moment"))
    return one.select(F.lit(method).alias("method"), "*")


@query("resample_bootstrap", f"WITH {RC} {_boot_sql('iid', 1, 1, 'n')} UNION ALL {_boot_sql('circular', 2, 8, 'n')} UNION ALL {_boot_sql('block', 3, 8, 'greatest(1, n - 7)')}")
def resample_bootstrap(spark, d):
    rows = plain(spark, d)
    out = _marks(resample.bootstrap(rows, ["symbol"], 1000, 1), "iid").unionByName(_marks(resample.bootstrap(rows, ["symbol"], 1000, 2, 8), "circular"))
    return out.unionByName(_marks(resample.bootstrap(rows, ["symbol"], 1000, 3, 8, circular=False), "block"))


@query("resample_permuted", f"""WITH {RC}, rr AS (SELECT rc.*, rep, bar // 24 AS day FROM rc, (SELECT unnest(range(100)) AS rep)),
p1 AS (SELECT symbol, rep, mkt, row_number() OVER (PARTITION BY symbol, rep ORDER BY {h("'1'", 'rep', 'symbol', 'idx')}, idx) - 1 AS pos FROM rr),
bb0 AS (SELECT DISTINCT symbol, rep, idx // 8 AS blk FROM rr JOIN nn USING (symbol) WHERE idx // 8 < n // 8), bb1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, rep ORDER BY {h("'2'", 'rep', 'symbol', 'blk')}, blk) - 1 AS nb FROM bb0),
p2 AS (SELECT rr.symbol, rr.rep, mkt, coalesce(nb * 8 + idx % 8, idx) AS pos FROM rr LEFT JOIN bb1 ON bb1.symbol = rr.symbol AND bb1.rep = rr.rep AND bb1.blk = rr.idx // 8),
p3a AS (SELECT *, row_number() OVER (PARTITION BY symbol, rep, day ORDER BY {h("'3'", 'rep', 'symbol', 'idx')}, idx) AS k, row_number() OVER (PARTITION BY symbol, rep, day ORDER BY idx) AS j FROM rr),
p3 AS (SELECT x.symbol, x.rep, x.mkt, y.idx AS pos FROM p3a x JOIN p3a y ON x.symbol = y.symbol AND x.rep = y.rep AND x.day = y.day AND x.k = y.j),
u AS (SELECT 'rows' AS method, * FROM p1 UNION ALL SELECT 'blocks', * FROM p2 UNION ALL SELECT 'days', * FROM p3)
SELECT method, symbol, rep, count(*) AS n, round(sum(mkt), 6) + 0 AS total, round(sum(pos * mkt), 4) + 0 AS moment FROM u GROUP BY ALL""")
def resample_permuted(spark, d):
    rows = plain(spark, d)
    out = _marks(resample.permuted(rows, ["symbol"], 100, 1), "rows").unionByName(_marks(resample.permuted(rows, ["symbol"], 100, 2, 8), "blocks"))
    days = rows.withColumn("day", F.floor(F.col("bar") / 24))
    return out.unionByName(_marks(resample.permuted(days, ["symbol"], 100, 3, within=["day"]), "days"))


def _draws(series: str, source: str, shared: str, reps: int, values: str, length: str = "greatest(2, CAST(round(pow(count(*), 1.0 / 3)) AS BIGINT))") -> str:
    """CTEs up to ``sums``: block sums by drawing every row of every block."""
    return f"""zz AS (SELECT {series}, count(*) AS n, {length} AS len FROM {source} GROUP BY {series}),
dr AS (SELECT {series}, n, len, rep, blk, {h("'1'", 'rep', *shared.split(', '), 'blk')} % n AS st FROM (SELECT *, unnest(range(n // len)) AS blk FROM zz), (SELECT unnest(range({reps})) AS rep)),
ex AS (SELECT *, (st + j) % n AS idx FROM (SELECT *, unnest(range(len)) AS j FROM dr)), sums AS (SELECT {series}, rep, any_value(n) AS n, count(*) AS total, {values} FROM ex JOIN {source} USING ({series}, idx) GROUP BY {series}, rep)"""


@query("bootstrap_interval", f"""WITH {RC}, {_draws('symbol', 'rc', 'symbol', 1000, 'sum(mkt) AS a, sum(mkt * mkt) AS q, sum(ln(1 + mkt)) AS l')},
st AS (SELECT symbol, CASE WHEN greatest(0, q / total - (a / total) ** 2) * total / (total - 1) > 1e-30 THEN a / total / sqrt(greatest(0, q / total - (a / total) ** 2) * total / (total - 1)) ELSE 0 END * sqrt(8760::DOUBLE) AS s, exp(l * n / total) - 1 AS g FROM sums WHERE n >= 60)
SELECT symbol, round(quantile_cont(s, 0.025), 4) AS sharpe_low, round(quantile_cont(s, 0.975), 4) AS sharpe_high, round(quantile_cont(g, 0.025), 6) AS total_low, round(quantile_cont(g, 0.975), 6) AS total_high, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM st GROUP BY symbol""")
def bootstrap_interval(spark, d):
    found = resample.bootstrap_interval(plain(spark, d), ["symbol"], 1000, 8760.0, "mkt")
    return found.select("symbol", *[r(c, 4).alias(c) for c in ("sharpe_low", "sharpe_high")], *[r(c).alias(c) for c in ("total_low", "total_high", "positive")])


_TRIALS = f"{_SWEEP_RETS}, tr AS (SELECT symbol, fast * 100 + slow AS trial, idx - 1 AS idx, ret FROM rets WHERE ret IS NOT NULL)"


def trials(spark, d):
    rows = returns(spark, d, _sweep(spark, d), ("symbol", "fast", "slow")).where("ret IS NOT NULL")
    return rows.select("symbol", (F.col("fast") * 100 + F.col("slow")).alias("trial"), (F.col("idx") - 1).alias("idx"), "ret")


@query("reality_check", f"""WITH {_TRIALS}, {_draws('symbol, trial', 'tr', 'symbol', 1000, 'sum(ret) AS a')}, ow AS (SELECT symbol, trial, avg(ret) AS mean FROM tr GROUP BY ALL),
sp AS (SELECT *, sqrt(total) * (a / total - mean) AS spread, sqrt(total) * mean AS rc0 FROM sums JOIN ow USING (symbol, trial)), om AS (SELECT *, stddev_samp(spread) OVER (PARTITION BY symbol, trial) AS omega FROM sp),
zt AS (SELECT *, rc0 / omega AS t, (spread + CASE WHEN rc0 / omega <= -sqrt(2 * ln(ln(greatest(total, 3)))) THEN rc0 ELSE 0 END) / omega AS zz FROM om WHERE omega > 1e-12),
ea AS (SELECT symbol, rep, count(*) AS models, max(rc0) AS rc0, max(spread) AS nrc, greatest(0, max(t)) AS spa, greatest(0, max(zz)) AS nspa FROM zt GROUP BY ALL)
SELECT symbol, any_value(models) AS models, round((1 + count(*) FILTER (round(nrc, 12) >= round(rc0, 12))) / (count(*) + 1), 6) AS p_rc, round((1 + count(*) FILTER (round(nspa, 12) >= round(spa, 12))) / (count(*) + 1), 6) AS p_spa FROM ea GROUP BY symbol""")
def reality_check(spark, d):
    return _pick(search.reality_check(trials(spark, d), ["symbol"], "trial", 1000), ["symbol", "models"], "p_rc", "p_spa")


@query("romano_wolf", f"""WITH {_TRIALS}, {_draws('symbol, trial', 'tr', 'symbol', 500, 'sum(ret) AS a')}, ow AS (SELECT symbol, trial, avg(ret) AS mean, stddev_samp(ret) / sqrt(count(*)) AS se FROM tr GROUP BY ALL),
pl AS (SELECT *, coalesce(mean / nullif(se, 0), 0) AS t, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(coalesce(mean / nullif(se, 0), 0)), 9) DESC, trial) AS place FROM ow),
bt AS (SELECT symbol, rep, place, coalesce(abs((a / total - mean) / nullif(se, 0)), 0) AS bb FROM sums JOIN pl USING (symbol, trial)), mx AS (SELECT *, max(bb) OVER (PARTITION BY symbol, rep ORDER BY place DESC) AS mm FROM bt),
cr AS (SELECT symbol, place, quantile_cont(mm, 0.95) AS critical FROM mx GROUP BY ALL)
SELECT symbol, trial, place, round(t, 6) + 0 AS t, round(critical, 6) AS critical, min(CASE WHEN abs(t) > critical THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY place) = 1 AS rejected FROM pl JOIN cr USING (symbol, place)""")
def romano_wolf(spark, d):
    found = search.romano_wolf(trials(spark, d), ["symbol"], "trial", 500)
    return found.select("symbol", "trial", "place", r("t").alias("t"), r("critical").alias("critical"), "rejected")


@query("pbo_cscv", f"""WITH {_TRIALS}, ln0 AS (SELECT *, count(*) OVER (PARTITION BY symbol, trial) // 8 AS len FROM tr), sl AS (SELECT symbol, trial, idx // len AS slice, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS n FROM ln0 WHERE idx // len < 8 GROUP BY ALL),
mk AS (SELECT mask FROM (SELECT unnest(range(256)) AS mask) WHERE bit_count(mask) = 4), ce AS (SELECT symbol, trial, mask, sum(s) FILTER (mask & (1 << slice) > 0) AS i_s, sum(q) FILTER (mask & (1 << slice) > 0) AS i_q, sum(n) FILTER (mask & (1 << slice) > 0) AS i_n,
  sum(s) FILTER (mask & (1 << slice) = 0) AS o_s, sum(q) FILTER (mask & (1 << slice) = 0) AS o_q, sum(n) FILTER (mask & (1 << slice) = 0) AS o_n FROM (SELECT symbol, trial, CAST(slice AS INTEGER) AS slice, s, q, n FROM sl), (SELECT CAST(mask AS INTEGER) AS mask FROM mk) GROUP BY ALL),
sr AS (SELECT *, round(CASE WHEN greatest(0, i_q / i_n - (i_s / i_n) ** 2) * i_n / (i_n - 1) > 1e-30 THEN i_s / i_n / sqrt(greatest(0, i_q / i_n - (i_s / i_n) ** 2) * i_n / (i_n - 1)) ELSE 0 END, 12) AS sin_, round(CASE WHEN greatest(0, o_q / o_n - (o_s / o_n) ** 2) * o_n / (o_n - 1) > 1e-30 THEN o_s / o_n / sqrt(greatest(0, o_q / o_n - (o_s / o_n) ** 2) * o_n / (o_n - 1)) ELSE 0 END, 12) AS sout FROM ce),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, mask ORDER BY sin_ DESC, trial) AS pl, (rank() OVER (PARTITION BY symbol, mask ORDER BY sout) - 1 + 0.5 * (count(*) OVER (PARTITION BY symbol, mask, sout) - 1) + 1) / (count(*) OVER (PARTITION BY symbol, mask) + 1) AS rnk FROM sr)
SELECT symbol, count(*) AS splits, round(avg(CASE WHEN rnk <= 0.5 THEN 1.0 ELSE 0 END), 6) AS pbo, round(avg(CASE WHEN o_s <= 0 THEN 1.0 ELSE 0 END), 6) AS prob_loss, round(median(ln(rnk / (1 - rnk))), 6) + 0 AS median_logit FROM rk WHERE pl = 1 GROUP BY symbol""")
def pbo_cscv(spark, d):
    return _pick(search.overfitting(trials(spark, d), ["symbol"], "trial"), ["symbol", "splits"], "pbo", "prob_loss", "median_logit")


_TESTS = f"{_SWEEP_RETS}, o AS (SELECT {_KEYS}, {_MOM.format(k=_KEYS, t='rets')}), te AS (SELECT symbol, fast * 100 + slow AS trial, round(sharpe * sqrt(n), 9) AS t FROM o), pv AS (SELECT *, 1 - {normal.cdf_sql('t')} AS p FROM te)"


def _tests(spark, d):
    rows = stats.moments(trials(spark, d), ["symbol", "trial"])
    return search.p_values(rows.select("symbol", "trial", F.round(F.col("sharpe") * F.sqrt("n"), 9).alias("t")))


@query("fdr_q_values", f"""WITH {_TESTS}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, trial) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM pv), c AS (SELECT *, sum(1 / i) OVER (PARTITION BY symbol) AS c FROM i)
SELECT symbol, trial, round(p, 6) AS p, round(least(1, min(p * m / i) OVER w), 6) AS bh, round(least(1, min(p * m * c / i) OVER w), 6) AS bhy, round(least(1, min(p * m / i) OVER w), 6) AS storey FROM c WINDOW w AS (PARTITION BY symbol ORDER BY p, trial ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fdr_q_values(spark, d):
    return _pick(search.q_values(_tests(spark, d), ["symbol"]), ["symbol", "trial"], "p", "bh", "bhy", "storey")


@query("haircut_p_values", f"""WITH {_TESTS}, tw AS (SELECT *, least(1, 2 * least(p, 1 - p)) AS p2 FROM pv), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p2, trial) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM tw)
SELECT symbol, trial, round(p2, 6) AS p_two, round(least(1, p2 * m), 6) AS bonferroni, round(max(least(1, p2 * (m - i + 1))) OVER (PARTITION BY symbol ORDER BY p2, trial ROWS UNBOUNDED PRECEDING), 6) AS holm FROM i""")
def haircut_p_values(spark, d):
    return _pick(search.haircut(_tests(spark, d), ["symbol"]), ["symbol", "trial"], "p_two", "bonferroni", "holm")


@query("purged_folds", f"""WITH {RC}, f AS (SELECT rc.symbol, idx, idx + 5 AS finish, n, fold FROM rc JOIN nn USING (symbol), (SELECT unnest(range(5)) AS fold)), g AS (SELECT *, fold * n // 5 AS a, (fold + 1) * n // 5 - 1 AS z FROM f),
p AS (SELECT *, CASE WHEN idx BETWEEN a AND z THEN 'test' WHEN finish < a OR idx > z + 10 THEN 'train' END AS part FROM g) SELECT symbol, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, CAST(sum(idx) AS BIGINT) AS mark FROM p WHERE part IS NOT NULL GROUP BY ALL""")
def purged_folds(spark, d):
    rows = plain(spark, d).withColumns({"finish": F.col("idx") + 5, "n": F.count(F.lit(1)).over(W.partitionBy("symbol"))})
    return search.purged_folds(rows, 5, 10).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("mark"))


@query("correlation_clusters", f"""WITH RECURSIVE {MONTHS}, c AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr FROM m x JOIN m y ON x.bar = y.bar AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT a AS u, b AS v FROM c WHERE abs(corr) >= 0.4 UNION SELECT b, a FROM c WHERE abs(corr) >= 0.4), rch AS (SELECT DISTINCT symbol AS u, symbol AS v FROM m WHERE ret IS NOT NULL UNION SELECT rch.u, e.v FROM rch JOIN e ON rch.v = e.u)
SELECT u AS symbol, min(v) AS cluster FROM rch GROUP BY u""")
def correlation_clusters(spark, d):
    rows = monthly(spark, d).where("ret IS NOT NULL")
    return search.correlation_clusters(rows, "symbol", "bar", 0.4)


_NOISE = lambda c: f"{c} * (1 + 0.01 * {normal.ppf_sql('(' + h(repr('1'), repr(c), 'rep', 'symbol', 'idx') + ' + 0.5) / 4294967296')})"


@query("noisy_bars", f"""WITH {BARS}, nz AS (SELECT symbol, bar, rep, {', '.join(f'{_NOISE(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM b, (SELECT unnest(range(2)) AS rep))
SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, round(open, 5) AS open, round(greatest(open, high, low, close), 5) AS high, round(least(open, high, low, close), 5) AS low, round(close, 5) AS close FROM nz""")
def noisy_bars(spark, d):
    rows = resample.noisy_bars(hourly(spark, d).select("symbol", "bar", "idx", "open", "high", "low", "close"), 2, 0.01)
    return _pick(rows, ["symbol", "bar", "rep"], "open", "high", "low", "close", digits=5)


_WALK = f"""g AS (SELECT id // 200 AS symbol, id % 200 AS idx FROM (SELECT unnest(range(4000)) AS id)), zw AS (SELECT symbol, idx, {normal.ppf_sql('(' + h("'1'", 'symbol', 'idx') + ' + 0.5) / 4294967296')} AS z FROM g),
b AS (SELECT symbol, idx, 100 * exp(0.01 * sum(z) OVER ({WS})) AS close FROM zw)"""


@query("null_random_walks", f"""WITH {_WALK}, s AS (SELECT *, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS t FROM b), x AS (SELECT symbol, coalesce(lag(t) OVER ({WS}), 0) * ln(close / lag(close) OVER ({WS})) AS ret FROM s)
SELECT symbol, count(ret) AS n, round(sum(ret), 6) + 0 AS total, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret)), 6) AS t FROM x GROUP BY symbol""")
def null_random_walks(spark, d):
    """A strategy on markets without any edge: walks made of hashes, the same on every run."""
    w, c = fw.by(), F.col("close")
    rows = resample.random_walks(spark, 20, 200, 0.01)
    rows = rows.withColumn("t", F.when(fw.sma(c, 5, w) > fw.sma(c, 20, w), 1).otherwise(0))
    rows = rows.select("symbol", (F.coalesce(F.lag("t").over(w), F.lit(0)) * F.log(F.col("close") / F.lag("close").over(w))).alias("ret"))
    return rows.groupBy("symbol").agg(F.count("ret").alias("n"), r(F.sum("ret")).alias("total"), r(fw.div(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.count("ret"))).alias("t"))
