"""Registered score checks, econometrics, due diligence, drift and label statistics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal, positions, xsection
from ..functions import windows as fw
from ..operators import alpha, bars, series, stats
from ..sources.scratch import saved
from ..sources.tables import table
from .base import BARS, MONTHS, WS, full, hourly, monthly, query, r, rank_sql
from .market import _LEGS, _PAIR, _pair
from .resampling import RC, h, plain
from .stats import RETS, _acov, _pick, _rounded, returns

#: Monthly panel with a rounded score (last return) and forward return.
PANEL = f"{MONTHS}, pn AS (SELECT * REPLACE (round(ret, 9) AS ret, round(fwd, 9) AS fwd), round(volume, 3) AS vol FROM m)"


def panel(spark, d):
    return monthly(spark, d).withColumns({"ret": F.round("ret", 9), "fwd": F.round("fwd", 9), "vol": F.round("volume", 3)})


def kept_panel(spark, d):
    """The panel written once, for queries that read it several times: Spark would add up the trades anew for each set of its columns."""
    return saved(panel(spark, d), "panel")


def _ic(x: str, y: str, source: str, part: str, name: str = "ic") -> str:
    """CTEs {name}r, {name}: rank correlation of x and y within each part."""
    return f"""{name}r AS (SELECT {part}, {rank_sql(x, part)} AS rx, {rank_sql(y, part)} AS ry FROM {source}),
{name}g AS (SELECT {part}, count(*) AS n, sum(rx * ry) - sum(rx) * sum(ry) / count(*) AS c, sum(rx * rx) - sum(rx) * sum(rx) / count(*) AS vx, sum(ry * ry) - sum(ry) * sum(ry) / count(*) AS vy FROM {name}r GROUP BY {part}),
{name} AS (SELECT {part}, n, CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN c / sqrt(vx * vy) END AS ic FROM {name}g WHERE n >= 3)"""


_DECAY = PANEL + ", dc AS (" + " UNION ALL ".join(f"SELECT {k} AS horizon, bar, ret AS s, round(lead(close, {k}) OVER ({WS}) / nullif(close, 0) - 1, 9) AS f FROM pn" for k in (1, 2, 3, 4)) + "), dv AS (SELECT * FROM dc WHERE s IS NOT NULL AND f IS NOT NULL), " + _ic("s", "f", "dv", "horizon, bar")


@query("ic_decay", f"WITH {_DECAY} SELECT horizon, count(ic) AS dates, round(avg(ic), 6) AS mean_ic FROM ic GROUP BY horizon")
def ic_decay(spark, d):
    return _pick(alpha.ic_decay(panel(spark, d), "ret", [1, 2, 3, 4]), ["horizon", "dates"], "mean_ic")


@query("ic_half_life", f"WITH {_DECAY}, g AS (SELECT CAST(horizon AS DOUBLE) AS h, -avg(ic) AS i FROM ic GROUP BY horizon), k AS (SELECT count(*) AS n, regr_slope(ln(i), h) AS k FROM g WHERE i > 0) SELECT round(CASE WHEN n >= 3 AND k < 0 THEN -ln(2) / k END, 4) AS half_life FROM k")
def ic_half_life(spark, d):
    found = alpha.ic_decay(panel(spark, d), "ret", [1, 2, 3, 4]).withColumn("mean_ic", -F.col("mean_ic"))
    return _pick(alpha.ic_half_life(found), [], "half_life", digits=4)


_MEANS = f"{_LEGS.replace('FROM m WHERE', 'FROM pn WHERE')}, dm AS (SELECT bar, bucket, avg(fwd) AS x FROM q WHERE fwd IS NOT NULL GROUP BY ALL), bm AS (SELECT bucket, count(*) AS dates, avg(x) AS mean FROM dm GROUP BY bucket)"


@query("bucket_monotonicity", f"WITH {PANEL}, {_MEANS}, l AS (SELECT *, lag(mean) OVER (ORDER BY bucket) AS before FROM bm) SELECT round(avg(CASE WHEN mean > before THEN 1.0 ELSE 0 END) FILTER (before IS NOT NULL), 6) AS rising, round(max_by(mean, bucket) - min_by(mean, bucket), 6) AS spread FROM l")
def bucket_monotonicity(spark, d):
    return _pick(alpha.monotonicity(alpha.bucket_means(panel(spark, d), "ret", "fwd", 5)), [], "rising", "spread")


@query("leg_shares", f"""WITH {PANEL}, {_MEANS}, x AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY bar) AS x FROM q WHERE fwd IS NOT NULL), y AS (SELECT bar, avg(x) FILTER (bucket = 4) AS l, -avg(x) FILTER (bucket = 0) AS s FROM x GROUP BY bar),
z AS (SELECT avg(l) AS long, avg(s) AS short FROM y) SELECT round(long, 6) AS long, round(short, 6) AS short, round(short / nullif(long + short, 0), 6) AS short_share FROM z""")
def leg_shares(spark, d):
    return _pick(alpha.leg_shares(panel(spark, d), "ret", "fwd", 5), [], "long", "short", "short_share")


_FACTOR = {
    "momentum": f"lag(close, 2) OVER ({WS}) / nullif(lag(close, 13) OVER ({WS}), 0) - 1",
    "reversal": f"-(lag(close, 1) OVER ({WS}) / nullif(lag(close, 2) OVER ({WS}), 0) - 1)",
    "low_vol": f"-({full('stddev_samp', 'ret', 6, 1)})",
    "size": f"-({full('avg', 'close * volume', 6, 1)})",
}
_FACTORS = (PANEL + ", fs AS (SELECT bar, symbol, ret, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _FACTOR.items()) + " FROM pn), fp AS (SELECT *, "
            + ", ".join(f"{k} IS NOT NULL AND row_number() OVER (PARTITION BY bar ORDER BY {k} DESC NULLS LAST, symbol) <= greatest(1, floor(count({k}) OVER (PARTITION BY bar) * 0.2)) AS hi_{k}, {k} IS NOT NULL AND row_number() OVER (PARTITION BY bar ORDER BY {k} ASC NULLS LAST, symbol) <= greatest(1, floor(count({k}) OVER (PARTITION BY bar) * 0.2)) AS lo_{k}" for k in _FACTOR)
            + " FROM fs), fr AS (SELECT bar, avg(ret) AS market, " + ", ".join(f"avg(ret) FILTER (hi_{k}) - avg(ret) FILTER (lo_{k}) AS {k}" for k in _FACTOR) + " FROM fp GROUP BY bar)")


@query("factor_returns", f"WITH {_FACTORS} SELECT bar, {_rounded('market', *_FACTOR)} FROM fr")
def factor_returns(spark, d):
    return _pick(alpha.factors(panel(spark, d)), ["bar"], "market", *_FACTOR)


def _strategy(spark, d):
    return _book(kept_panel(spark, d))


def _book(panel):
    """The long-short book's return at each date beside the factors; written, as it is a row a date and read several times."""
    rows = xsection.legs(panel, "ret", 5).groupBy((F.col("bar") + 1).alias("bar")).agg(F.sum(F.col("weight") * F.col("fwd")).alias("r"))
    return saved(alpha.factors(panel).join(rows, "bar"), "book")


@query("factor_exposure")
def factor_exposure(spark, d):
    return _pick(alpha.ols(_strategy(spark, d), "r", ["market", *_FACTOR]), ["term", "n"], "coef", "t")


_STRAT = f"{_FACTORS}, {_MEANS}, sr AS (SELECT bar + 1 AS bar, sum(CASE WHEN bucket = 4 THEN 1.0 / c4 * fwd WHEN bucket = 0 THEN -1.0 / c4 * fwd ELSE 0 END) AS r FROM (SELECT *, count(*) OVER (PARTITION BY bar, bucket) AS c4 FROM q) GROUP BY bar), st AS (SELECT * FROM fr JOIN sr USING (bar))"


@query("up_down_beta", f"WITH {_STRAT} SELECT round(regr_slope(r, market) FILTER (market > 0), 6) AS up, round(regr_slope(r, market) FILTER (market <= 0), 6) AS down FROM st WHERE r IS NOT NULL")
def up_down_beta(spark, d):
    return _pick(alpha.up_down_beta(_strategy(spark, d), "r", "market"), [], "up", "down")


_BOOKS = f"{MONTHS}, bk AS (SELECT s_nationkey AS book, bar, count(*) AS n, avg(ret) AS r FROM m JOIN supplier ON s_suppkey = symbol WHERE ret IS NOT NULL GROUP BY ALL), al AS (SELECT bar, avg(ret) AS a FROM m WHERE ret IS NOT NULL GROUP BY bar), bb AS (SELECT bk.book, bk.bar, r, a, row_number() OVER (PARTITION BY book ORDER BY bk.bar) - 1 AS idx FROM bk JOIN al USING (bar))"


def _books(spark, d):
    m = monthly(spark, d).where("ret IS NOT NULL")
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("book"))
    by = m.join(nation, "symbol").groupBy("book", "bar").agg(F.avg("ret").alias("r"))
    rows = by.join(m.groupBy("bar").agg(F.avg("ret").alias("a")), "bar")
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("book").orderBy("bar")) - 1)


@query("book_correlation", f"""WITH {_BOOKS}, c AS (SELECT *, quantile_cont(a, 0.1) OVER (PARTITION BY book) AS cut FROM bb)
SELECT book, count(*) AS n, round(CASE WHEN count(*) > 2 THEN corr(r, a) END, 6) AS corr, round(CASE WHEN count(*) FILTER (a <= cut) > 2 THEN corr(r, a) FILTER (a <= cut) END, 6) AS tail_corr FROM c GROUP BY book""")
def book_correlation(spark, d):
    return _pick(alpha.book_relation(_books(spark, d), ["book"], "r", "a"), ["book", "n"], "corr", "tail_corr")


@query("drawdown_overlap", f"""WITH {_BOOKS}, e AS (SELECT book, idx, exp(sum(ln(1 + r)) OVER o) AS er, exp(sum(ln(1 + a)) OVER o) AS ea FROM bb WINDOW o AS (PARTITION BY book ORDER BY idx)),
u AS (SELECT book, round(1 - er / greatest(1, max(er) OVER o), 12) > 0 AS ur, round(1 - ea / greatest(1, max(ea) OVER o), 12) > 0 AS ua FROM e WINDOW o AS (PARTITION BY book ORDER BY idx))
SELECT book, round(count(*) FILTER (ur AND ua) / nullif(count(*) FILTER (ur), 0), 6) AS overlap FROM u GROUP BY book""")
def drawdown_overlap(spark, d):
    return _pick(alpha.drawdown_overlap(_books(spark, d), ["book"], "r", "a"), ["book"], "overlap")


@query("signal_orthogonality", f"""WITH {PANEL}, v AS (SELECT bar, ret AS s, vol AS e, fwd AS f FROM pn WHERE ret IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT bar, {rank_sql('s')} AS s, {rank_sql('e')} AS e, {rank_sql('f')} AS f FROM v),
c AS (SELECT bar, count(*) AS n, CASE WHEN var_pop(s) > 1e-12 AND var_pop(f) > 1e-12 THEN corr(s, f) END AS sf, CASE WHEN var_pop(s) > 1e-12 AND var_pop(e) > 1e-12 THEN corr(s, e) END AS se, CASE WHEN var_pop(e) > 1e-12 AND var_pop(f) > 1e-12 THEN corr(e, f) END AS ef FROM k GROUP BY bar)
SELECT bar, n, round(CASE WHEN (1 - se * se) * (1 - ef * ef) > 1e-9 THEN (sf - se * ef) / sqrt((1 - se * se) * (1 - ef * ef)) END, 6) + 0 AS ic FROM c WHERE n >= 5""")
def signal_orthogonality(spark, d):
    return _pick(alpha.partial_ic(panel(spark, d), "ret", "vol", "fwd"), ["bar", "n"], "ic")


@query("signal_placebo", f"""WITH {PANEL}, v AS (SELECT symbol, bar, ret AS s, fwd AS f FROM pn WHERE ret IS NOT NULL AND fwd IS NOT NULL), rp AS (SELECT v.*, rep FROM v, (SELECT unnest(range(200)) AS rep)),
o AS (SELECT *, row_number() OVER (PARTITION BY rep, bar ORDER BY symbol) AS a, row_number() OVER (PARTITION BY rep, bar ORDER BY {h("'1'", 'rep', 'bar', 'symbol')}, symbol) AS z FROM rp),
dl AS (SELECT x.rep, x.bar, x.f, y.s FROM o x JOIN o y ON x.rep = y.rep AND x.bar = y.bar AND x.a = y.z), {_ic('s', 'f', 'dl', 'rep, bar', 'nu')}, {_ic('s', 'f', 'v', 'bar', 'ow')},
nm AS (SELECT rep, avg(ic) AS ic FROM nu GROUP BY rep), om AS (SELECT avg(ic) AS ic FROM ow) SELECT round(om.ic, 6) AS mean_ic, count(*) AS draws, round((1 + count(*) FILTER (round(nm.ic, 9) >= round(om.ic, 9))) / (count(*) + 1), 6) AS p FROM nm, om GROUP BY om.ic""")
def signal_placebo(spark, d):
    return _pick(alpha.placebo(kept_panel(spark, d), "ret", "fwd", 200), ["draws"], "mean_ic", "p")


@query("class_lookahead", "WITH s AS (SELECT o_custkey AS symbol, o_orderpriority AS class, min(epoch(o_orderdate) // 86400) AS since FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), u AS (SELECT o_custkey AS symbol, o_orderpriority AS class, epoch(o_orderdate) // 86400 AS bar FROM orders) SELECT DISTINCT u.symbol, CAST(u.bar AS BIGINT) AS bar, u.class, CAST(since AS BIGINT) AS since FROM u LEFT JOIN s ON u.symbol = s.symbol AND u.class = s.class WHERE since IS NULL OR since > u.bar")
def class_lookahead(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("class"), day.alias("bar"))
    known = o.where("o_orderstatus = 'F'").groupBy("symbol", "class").agg(F.min("bar").alias("since"))
    return alpha.late_classes(known, o.select("symbol", "bar", "class"))


@query("post_discovery_decay", f"WITH {RETS}, pd AS (SELECT symbol, coalesce(avg(ret) FILTER (bar < 473700) / nullif(stddev_samp(ret) FILTER (bar < 473700), 0), 0) AS a, coalesce(avg(ret) FILTER (bar >= 473700) / nullif(stddev_samp(ret) FILTER (bar >= 473700), 0), 0) AS z FROM rets GROUP BY symbol) SELECT symbol, round(a, 6) AS before, round(z, 6) AS after, round(z / nullif(a, 0), 4) AS kept FROM pd")
def post_discovery_decay(spark, d):
    out = alpha.before_after(returns(spark, d), ["symbol"], 473700)
    return out.select("symbol", r("before").alias("before"), r("after").alias("after"), r("kept", 4).alias("kept"))


# Econometrics


_SX = f"{RC}, sx AS (SELECT symbol, idx, mkt AS ret FROM rc)"


@query("kpss", f"""WITH {RETS.replace('AS ret FROM s', 'AS ret0 FROM s').replace(' AS mkt,', ' AS ret,')}, {_acov(12)}, ps AS (SELECT symbol, sum(s * s) AS ss FROM (SELECT symbol, sum(c) OVER ({WS}) AS s FROM c0) GROUP BY symbol)
SELECT symbol, n, round(ss / (n * n * greatest(1e-300, (g0 + {' + '.join(f'2 * (1 - {k} / 13.0::DOUBLE) * g{k}' for k in range(1, 13))}) / n)), 6) AS stat FROM g JOIN ps USING (symbol) WHERE n >= 20""")
def kpss(spark, d):
    return _pick(series.kpss(plain(spark, d), ["symbol"], "mkt"), ["symbol", "n"], "stat")


_PHI = "greatest(-0.97, least(0.97, coalesce(cl / nullif(ll, 0), 0)))"
_LRV = f"(greatest(1e-300, greatest(0, cc - 2 * {_PHI} * cl + {_PHI} * {_PHI} * ll) / greatest(n - 1, 1)) / ((1 - {_PHI}) * (1 - {_PHI})))"
_SUMS = "sum(c * l) AS cl, sum(l * l) AS ll, sum(CASE WHEN l IS NOT NULL THEN c * c END) AS cc"


@query("cusum_break", f"""WITH {_SX}, c0 AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS c FROM sx), c1 AS (SELECT *, lag(c) OVER ({WS}) AS l, abs(sum(c) OVER ({WS})) AS s FROM c0),
g AS (SELECT symbol, count(*) AS n, {_SUMS}, max(s) AS top, arg_max(idx, (round(s, 9), -idx)) AS peak FROM c1 GROUP BY symbol) SELECT symbol, n, round(top / sqrt({_LRV} * n), 6) AS stat, peak FROM g WHERE n >= 60""")
def cusum_break(spark, d):
    return _pick(series.cusum_break(plain(spark, d), ["symbol"], "mkt").withColumnRenamed("at", "peak"), ["symbol", "n", "peak"], "stat")


@query("sup_wald", f"""WITH {_SX}, k AS (SELECT *, row_number() OVER o AS k, sum(ret) OVER o AS s, sum(ret * ret) OVER o AS q, count(*) OVER p AS n, sum(ret) OVER p AS ts, sum(ret * ret) OVER p AS tq FROM sx WINDOW o AS (PARTITION BY symbol ORDER BY idx), p AS (PARTITION BY symbol)),
e AS (SELECT *, q - s * s / k + tq - q - (ts - s) * (ts - s) / (n - k) AS ssr FROM k WHERE n >= 60 AND k BETWEEN greatest(2, floor(0.15 * n)) AND n - greatest(2, floor(0.15 * n))), bt AS (SELECT symbol, arg_min(k, (round(ssr, 9), k)) AS k FROM e GROUP BY symbol),
d0 AS (SELECT sx.*, row_number() OVER (PARTITION BY sx.symbol ORDER BY idx) > k AS rt, k FROM sx JOIN bt USING (symbol)), d1 AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol, rt) AS c FROM d0), d2 AS (SELECT *, lag(c) OVER ({WS}) AS l FROM d1),
g AS (SELECT symbol, k, count(*) AS n, {_SUMS}, avg(ret) FILTER (rt) - avg(ret) FILTER (NOT rt) AS shift FROM d2 GROUP BY symbol, k) SELECT symbol, k, round(shift, 6) + 0 AS shift, round(shift * shift / ({_LRV} * (1 / k + 1 / (n - k))), 6) AS stat FROM g""")
def sup_wald(spark, d):
    return _pick(series.sup_wald(plain(spark, d), ["symbol"], "mkt"), ["symbol", "k"], "shift", "stat")


@query("unit_roots")
def unit_roots(spark, d):
    return _pick(series.unit_roots(hourly(spark, d).withColumn("x", F.log("close")), ["symbol"], "x"), ["symbol", "n", "lag"], "stat", "p")


@query("cointegration")
def cointegration(spark, d):
    return _pick(series.cointegration(_pair(spark, d), ["symbol"], "y", "x"), ["symbol", "n", "lag"], "alpha", "beta", "stat")


@query("johansen_trace")
def johansen_trace(spark, d):
    out = series.johansen(_pair(spark, d), ["symbol"], ["y", "x"])
    return out.select("symbol", "n", F.transform("trace", lambda x: F.round(x, 6)).alias("trace"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("mean_breaks")
def mean_breaks(spark, d):
    rows = plain(spark, d).withColumn("x", F.col("mkt") + F.when(F.col("idx") > 120, 0.05).otherwise(0.0))
    return series.mean_breaks(rows, ["symbol"], "x")


_OF = f"OVER ({WS} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query("pair_phantom_pnl", f"""WITH {BARS}, {_PAIR}, ol AS (SELECT *, count(*) {_OF} AS n, covar_samp(y, x) {_OF} / nullif(var_samp(x) {_OF}, 0) AS bb0, avg(y) {_OF} AS my, avg(x) {_OF} AS mx, var_samp(y) {_OF} AS vy, covar_samp(y, x) {_OF} AS cv FROM p),
sp AS (SELECT *, CASE WHEN n >= 30 THEN y - bb0 * x - (my - bb0 * mx) END AS s, CASE WHEN n >= 30 THEN sqrt(greatest(1e-18, (vy - bb0 * cv) * 29 / 28)) END AS sd FROM ol), mk AS (SELECT *, s / sd AS z, sum(CASE WHEN s IS NULL OR abs(s / sd) < 0.5 THEN 1 ELSE 0 END) OVER ({WS}) AS spell, CASE WHEN s / sd > 1.5 THEN -1 WHEN s / sd < -1.5 THEN 1 END AS mark FROM sp),
ps AS (SELECT *, coalesce(first_value(mark IGNORE NULLS) OVER (PARTITION BY symbol, spell ORDER BY idx), 0) AS pos FROM mk), q AS (SELECT *, coalesce(lag(pos) OVER ({WS}), 0) AS qy, s - lag(s) OVER ({WS}) AS ds, y - lag(y) OVER ({WS}) AS dy, x - lag(x) OVER ({WS}) AS dx, lag(bb0) OVER ({WS}) AS b1 FROM ps)
SELECT bar, qy, round(coalesce(qy * ds, 0), 6) + 0 AS booked, round(coalesce(qy * (dy - b1 * dx), 0), 6) + 0 AS tradable FROM q""")
def pair_phantom_pnl(spark, d):
    """What a re-estimated spread seems to earn against what the held legs do."""
    w = fw.by()
    f = w.rowsBetween(-29, 0)
    rows = _pair(spark, d).withColumns({"n": F.count("y").over(f), "b": fw.div(F.covar_samp("y", "x").over(f), F.var_samp("x").over(f)), "my": F.avg("y").over(f), "mx": F.avg("x").over(f), "vy": F.var_samp("y").over(f), "cv": F.covar_samp("y", "x").over(f)})
    ready = F.col("n") >= 30
    rows = rows.withColumns({"s": F.when(ready, F.col("y") - F.col("b") * F.col("x") - (F.col("my") - F.col("b") * F.col("mx"))), "sd": F.when(ready, F.sqrt(F.greatest(F.lit(1e-18), (F.col("vy") - F.col("b") * F.col("cv")) * 29 / 28)))})
    rows = positions.hysteresis(rows.withColumn("z", F.col("s") / F.col("sd")), "z", 1.5, 0.5)
    q = F.coalesce(F.lag("position").over(w), F.lit(0))
    step = lambda c: F.col(c) - F.lag(c).over(w)
    booked, tradable = F.coalesce(q * step("s"), F.lit(0.0)), F.coalesce(q * (step("y") - F.lag("b").over(w) * step("x")), F.lit(0.0))
    return rows.select("bar", q.alias("qy"), r(booked).alias("booked"), r(tradable).alias("tradable"))


_CARRY = """mo AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS bar, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS ye, sum(l_quantity) FILTER (l_returnflag = 'R') AS yq, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS xe, sum(l_quantity) FILTER (l_returnflag = 'A') AS xq FROM lineitem GROUP BY 1),
  cm AS (SELECT bar, sum(ye) OVER w / sum(yq) OVER w AS y, sum(xe) OVER w / sum(xq) OVER w AS x FROM mo WINDOW w AS (ORDER BY bar)),
  p AS (SELECT *, row_number() OVER (ORDER BY bar) - 1 AS idx FROM cm WHERE y IS NOT NULL AND x IS NOT NULL)"""


@query("carry_index", f"""WITH {_CARRY}, c AS (SELECT *, y / lag(y) OVER (ORDER BY idx) - x / lag(x) OVER (ORDER BY idx) AS basis, ((idx * 7) % 11 - 5) / 10000.0::DOUBLE AS funding FROM p), i AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE basis / 2 + funding END AS ret FROM c)
SELECT bar, round(ret, 8) + 0 AS ret, round(100 * exp(sum(ln(1 + ret)) OVER (ORDER BY idx)), 6) AS close FROM i""")
def carry_index(spark, d):
    """A hedged book of one leg against the other that collects funding, as a compounded index. The legs are mean prices to date of two sorts of order
    lines, half the book in each, so no month can take all of it; a row a month."""
    of = lambda flag, c: F.sum(F.when(F.col("l_returnflag") == flag, F.col(c)))
    months = table(spark, d, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("bar"))
    months = months.agg(of("R", "l_extendedprice").alias("ye"), of("R", "l_quantity").alias("yq"), of("A", "l_extendedprice").alias("xe"), of("A", "l_quantity").alias("xq"))
    so_far = W.orderBy("bar").rowsBetween(W.unboundedPreceding, 0)
    months = months.select("bar", (F.sum("ye").over(so_far) / F.sum("yq").over(so_far)).alias("y"), (F.sum("xe").over(so_far) / F.sum("xq").over(so_far)).alias("x"))
    rows = bars.indexed(months.where("y IS NOT NULL AND x IS NOT NULL").withColumn("symbol", F.lit("R-A")))
    w = fw.by()
    grow = lambda c: F.col(c) / F.lag(c).over(w)
    rows = rows.withColumn("ret", F.when(F.col("idx") == 0, 0.0).otherwise((grow("y") - grow("x")) / 2 + ((F.col("idx") * 7) % 11 - 5) / 10000.0))
    return rows.select("bar", r("ret", 8).alias("ret"), r(100 * F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(W.unboundedPreceding, 0)))).alias("close"))


# Due diligence


@query("return_smoothing", f"""WITH {_SX}, rets2 AS (SELECT symbol, idx, ret FROM sx), {_acov(2).replace('FROM rets WHERE', 'FROM rets2 WHERE')}, rh AS (SELECT symbol, n, coalesce(g1 / nullif(g0, 0), 0) AS r1, coalesce(g2 / nullif(g0, 0), 0) AS r2 FROM g),
gr AS (SELECT i / 20.0::DOUBLE AS a, j / 20.0::DOUBLE AS bb, (20 - i - j) / 20.0::DOUBLE AS cc FROM (SELECT unnest(range(21)) AS i), (SELECT unnest(range(21)) AS j) WHERE i + j <= 20), er AS (SELECT *, a * a + bb * bb + cc * cc AS s FROM gr),
sc AS (SELECT symbol, n, r1, r2, a, bb, cc, s, round(((a * bb + bb * cc) / s - r1) ** 2 + (a * cc / s - r2) ** 2, 12) AS e FROM rh, er), pk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY e, a, bb, cc) AS k FROM sc)
SELECT symbol, n, round(r1, 6) + 0 AS rho1, round(r2, 6) + 0 AS rho2, a AS theta0, bb AS theta1, cc AS theta2, round(sqrt(s), 6) AS factor FROM pk WHERE k = 1""")
def return_smoothing(spark, d):
    out = series.smoothing(plain(spark, d), ["symbol"], "mkt", 0.05)
    return out.select("symbol", "n", "theta0", "theta1", "theta2", *[r(c).alias(c) for c in ("rho1", "rho2", "factor")])


@query("zero_kink", f"""WITH {RETS}, i AS (SELECT *, avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY symbol) AS idle FROM rets WHERE ret IS NOT NULL), u AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM i WHERE ret <> 0 OR idle < 0.2),
g AS (SELECT symbol, mu, sd, count(*) FILTER (ret >= -0.25 * sd AND ret < 0) AS below, count(*) FILTER (ret >= 0 AND ret < 0.25 * sd) AS above FROM u WHERE sd > 0 GROUP BY ALL),
k AS (SELECT *, ({normal.cdf_sql('-mu / sd')} - {normal.cdf_sql('-0.25e0 - mu / sd')}) / ({normal.cdf_sql('0.25e0 - mu / sd')} - {normal.cdf_sql('-0.25e0 - mu / sd')}) AS p FROM g)
SELECT symbol, below, above, round((below - (below + above) * p) / nullif(sqrt((below + above) * p * (1 - p)), 0), 5) AS z FROM k""")
def zero_kink(spark, d):
    return _pick(series.zero_kink(returns(spark, d), ["symbol"]), ["symbol", "below", "above"], "z", digits=5)


@query("return_consistency", f"""WITH {RETS}, g AS (SELECT symbol, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, count(*) FILTER (ret > 0) AS k FROM rets WHERE ret IS NOT NULL GROUP BY symbol), e AS (SELECT *, greatest(1e-6, least(1 - 1e-6, {normal.cdf_sql('mu / sd')})) AS p FROM g WHERE sd > 0)
SELECT symbol, n, round(k / n, 6) AS positive, round(p, 6) AS expected, round((k - n * p) / sqrt(n * p * (1 - p)), 5) AS z FROM e""")
def return_consistency(spark, d):
    out = series.consistency(returns(spark, d), ["symbol"])
    return out.select("symbol", "n", r("positive").alias("positive"), r("expected").alias("expected"), r("z", 5).alias("z"))


@query("round_numbers", f"WITH {MONTHS} SELECT symbol, count(*) AS n, round(avg(CASE WHEN abs(round(ret, 3) / 0.0005::DOUBLE - round_even(round(ret, 3) / 0.0005::DOUBLE, 0)) < 1e-9 AND symbol % 2 = 0 THEN 1.0 WHEN symbol % 2 = 1 AND abs(round(ret, 5) / 0.0005::DOUBLE - round_even(round(ret, 5) / 0.0005::DOUBLE, 0)) < 1e-9 THEN 1.0 ELSE 0 END), 6) AS share FROM m WHERE ret IS NOT NULL GROUP BY symbol")
def round_numbers(spark, d):
    rows = monthly(spark, d).withColumn("x", F.when(F.col("symbol") % 2 == 0, F.round("ret", 3)).otherwise(F.round("ret", 5)))
    return _pick(series.round_share(rows, ["symbol"], "x"), ["symbol", "n"], "share")


# Models


@query("stability_index", f"""WITH {RC}, t AS (SELECT mkt AS x FROM rc WHERE idx < 100), u AS (SELECT mkt + 0.002 AS x FROM rc WHERE idx >= 100), e AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM t),
b1 AS (SELECT len(list_filter(e, lambda v: v <= x)) AS bin, side FROM (SELECT x, 0 AS side FROM t UNION ALL SELECT x, 1 FROM u), e), c AS (SELECT bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS z FROM b1 GROUP BY bin),
sh AS (SELECT greatest(0.0001, a / sum(a) OVER ()) AS pa, greatest(0.0001, z / sum(z) OVER ()) AS pb FROM c) SELECT round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM sh""")
def stability_index(spark, d):
    rows = plain(spark, d)
    return _pick(series.stability_index(rows.where("idx < 100").select(F.col("mkt").alias("x")), rows.where("idx >= 100").select((F.col("mkt") + 0.002).alias("x")), "x"), [], "psi")


@query("kolmogorov_smirnov", f"""WITH {RC}, c AS (SELECT symbol, mkt AS x, count(*) FILTER (idx < 100) AS a, count(*) FILTER (idx >= 100) AS z FROM rc GROUP BY ALL), g AS (SELECT symbol, abs(sum(a) OVER (PARTITION BY symbol ORDER BY x) / nullif(sum(a) OVER (PARTITION BY symbol), 0) - sum(z) OVER (PARTITION BY symbol ORDER BY x) / nullif(sum(z) OVER (PARTITION BY symbol), 0)) AS g FROM c)
SELECT symbol, round(coalesce(max(g), 0), 6) AS ks FROM g GROUP BY symbol""")
def kolmogorov_smirnov(spark, d):
    return _pick(series.kolmogorov_smirnov(plain(spark, d).withColumn("first", F.col("idx") < 100), ["symbol"], "mkt", "first"), ["symbol"], "ks")


@query("label_uniqueness", f"""WITH {RC}, lb AS (SELECT symbol, idx AS a, idx + idx % 7 AS z FROM rc), t AS (SELECT symbol, unnest(range(min(a), max(z) + 1)) AS i FROM lb GROUP BY symbol), o AS (SELECT t.symbol, t.i, count(*) AS k FROM t JOIN lb ON lb.symbol = t.symbol AND t.i BETWEEN lb.a AND lb.z GROUP BY ALL),
l AS (SELECT lb.symbol, lb.a, avg(1.0::DOUBLE / k) AS u FROM lb JOIN o ON o.symbol = lb.symbol AND o.i BETWEEN lb.a AND lb.z GROUP BY ALL) SELECT symbol, count(*) AS labels, round(avg(u), 6) AS uniqueness FROM l GROUP BY symbol""")
def label_uniqueness(spark, d):
    spans = plain(spark, d).select("symbol", F.col("idx").alias("start"), (F.col("idx") + F.col("idx") % 7).alias("end"))
    return _pick(series.uniqueness(spans, ["symbol"]), ["symbol", "labels"], "uniqueness")


@query("probability_calibration", """WITH x AS (SELECT lang, (doc_id % 10) / 10.0::DOUBLE + 0.05::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT coalesce(lang, '?') AS lang, CAST(least(9, floor(round(p * 10, 9))) AS INTEGER) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS se, sum(y * y) AS yy FROM x GROUP BY ALL),
k AS (SELECT lang, sum(n) AS n, sum(se) / sum(n) AS brier, sum(yy) / sum(n) - (sum(sy) / sum(n)) ** 2 AS ref, sum(abs(sp - sy)) / sum(n) AS ece FROM g GROUP BY lang) SELECT lang, CAST(n AS BIGINT) AS n, round(brier, 6) AS brier, round(coalesce(1 - brier / nullif(ref, 0), 0), 5) AS skill, round(ece, 6) AS ece FROM k""")
def probability_calibration(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), ((F.col("doc_id") % 10) / 10.0 + 0.05).alias("p"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    out = series.calibration(rows, ["lang"], "p", "y")
    return out.select("lang", "n", r("brier").alias("brier"), r("skill", 5).alias("skill"), r("ece").alias("ece"))
