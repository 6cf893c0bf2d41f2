"""Registered checks of how far a result leans on its sample, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..functions import windows as fw
from ..functions import xsection as fx
from ..functions.draws import hashed
from ..operators import resample, robust, stats
from ..sources.tables import HOUR, ticks
from .base import BARS, TICKS, WS, hourly, query, r, rank_sql
from .research import PANEL, kept_panel, panel
from .resampling import RC, _draws, h, plain
from .stats import RETS, _pick, returns

COST = 0.001


def _net(source: str, by: str = "", q: int = 5, name: str = "net", score: str = "ret") -> str:
    """CTEs up to {name}: the net return of quantile legs by date, within each ``by``."""
    p = f"{by}, " if by else ""
    return f"""{name}r AS (SELECT *, {rank_sql(score, f'{p}bar')} AS rk, count(*) OVER (PARTITION BY {p}bar) AS ofn FROM {source} WHERE {score} IS NOT NULL), {name}q AS (SELECT *, least({q - 1}, CAST(floor((rk - 1) / ofn * {q}) AS INTEGER)) AS bucket FROM {name}r),
{name}w AS (SELECT *, CASE WHEN bucket = {q - 1} THEN 1.0::DOUBLE WHEN bucket = 0 THEN -1.0::DOUBLE ELSE 0 END / count(*) OVER (PARTITION BY {p}bar, bucket) AS weight FROM {name}q), {name}c AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY {p}symbol ORDER BY bar), 0) AS before FROM {name}w),
{name} AS (SELECT {p}bar, sum(before * ret) - {COST} * sum(abs(weight - before)) AS net FROM {name}c GROUP BY {p}bar)"""


_SHARPE = "coalesce(avg({0}) / nullif(stddev_samp({0}), 0), 0) * sqrt(12::DOUBLE)"


@query("net_spread", f"WITH {PANEL}, {_net('pn')} SELECT bar, round(net, 6) + 0 AS net FROM net")
def net_spread(spark, d):
    return _pick(robust.net_spread(panel(spark, d), "ret", 5, COST), ["bar"], "net")


@query("universe_subsampling", f"""WITH {PANEL}, sy AS (SELECT DISTINCT symbol FROM pn), sk AS (SELECT rep, symbol, row_number() OVER (PARTITION BY rep ORDER BY {h("'1'", 'rep', 'symbol')}, symbol) AS k, count(*) OVER (PARTITION BY rep) AS n FROM sy, (SELECT unnest(range(100)) AS rep)),
sub AS (SELECT pn.*, rep FROM pn JOIN sk USING (symbol) WHERE k <= round(0.7 * n)), {_net('sub', 'rep')}, one AS (SELECT rep, avg(net) AS m, {_SHARPE.format('net')} AS s FROM net GROUP BY rep)
SELECT count(*) AS subsets, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 6) AS positive, round(median(s), 5) AS sharpe FROM one""")
def universe_subsampling(spark, d):
    """Does the edge survive subsets of seven tenths of the names?"""
    net = robust.subset_spreads(kept_panel(spark, d), "ret", 5, COST, 0.7, 100)
    one = net.groupBy("rep").agg(F.avg("net").alias("m"), robust.ratio("net", 12).alias("s"))
    return one.agg(F.count(F.lit(1)).alias("subsets"), r(F.avg((F.col("m") > 0).cast("double"))).alias("positive"), r(F.median("s"), 5).alias("sharpe"))


@query("group_split", f"""WITH {PANEL}, gp AS (SELECT *, symbol % 3 AS part FROM pn), {_net('gp', 'part', 3)}, one AS (SELECT part, count(*) AS bars, avg(net) * 12 AS year, {_SHARPE.format('net')} AS s FROM net GROUP BY part)
SELECT part, bars, round(year, 6) AS year, round(s, 5) AS sharpe, round(greatest(year, 0) / nullif(sum(greatest(year, 0)) OVER (), 0), 6) AS share FROM one""")
def group_split(spark, d):
    """Each group of names ranked within itself, and its share of the profit of those that earn."""
    net = robust.net_spread(panel(spark, d).withColumn("part", F.col("symbol") % 3), "ret", 3, COST, ("part",))
    one = net.groupBy("part").agg(F.count(F.lit(1)).alias("bars"), (F.avg("net") * 12).alias("year"), robust.ratio("net", 12).alias("sharpe"))
    gain = F.greatest(F.col("year"), F.lit(0.0))
    return one.select("part", "bars", r("year").alias("year"), r("sharpe", 5).alias("sharpe"), r(fw.div(gain, F.sum(gain).over(fw.W.partitionBy()))).alias("share"))


@query("start_date_sensitivity", f"""WITH {PANEL}, {_net('pn')}, o AS (SELECT net, row_number() OVER (ORDER BY bar) - 1 AS i, count(*) OVER () AS n FROM net), st AS (SELECT o.*, st AS start, greatest(1, n // 40) AS step FROM o, (SELECT unnest(range(13)) AS st))
SELECT CAST(start AS INTEGER) AS start, count(*) AS bars, round(avg(net), 7) + 0 AS mean FROM st WHERE i >= start * step AND n - start * step >= 30 GROUP BY start""")
def start_date_sensitivity(spark, d):
    return _pick(robust.starts(robust.net_spread(panel(spark, d), "ret", 5, COST), 13, 40, 30), ["start", "bars"], "mean", digits=7)


@query("cpcv_paths", f"""WITH {PANEL}, {_net('pn')}, o AS (SELECT net, row_number() OVER (ORDER BY bar) - 1 AS i, count(*) OVER () AS n FROM net), z AS (SELECT *, n // 6 AS size, n % 6 AS more FROM o),
g AS (SELECT *, CASE WHEN i < more * (size + 1) THEN i // (size + 1) ELSE more + (i - more * (size + 1)) // size END AS g FROM z), pt AS (SELECT *, CASE WHEN g < more THEN i - g * (size + 1) ELSE i - more * (size + 1) - (g - more) * size END AS pos, CASE WHEN g < more THEN size + 1 ELSE size END AS len FROM g),
pr AS (SELECT a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) AS bars, round({_SHARPE.format('net')}, 5) + 0 AS sharpe FROM pt JOIN pr ON g = a OR g = b WHERE pos >= 1 AND pos < len - 1 GROUP BY a, b""")
def cpcv_paths(spark, d):
    return _pick(robust.purged_paths(robust.net_spread(panel(spark, d), "ret", 5, COST), 6, 1, 12), ["a", "b", "bars"], "sharpe", digits=5)


@query("bar_construction", f"""WITH {PANEL}, eo AS (SELECT *, idx % 2 AS part, close / nullif(lag(close) OVER (PARTITION BY symbol, idx % 2 ORDER BY bar), 0) - 1 AS r2 FROM pn), e2 AS (SELECT * REPLACE (round(r2, 9) AS ret) FROM eo WHERE r2 IS NOT NULL), {_net('e2', 'part')}
SELECT CAST(part AS INTEGER) AS part, count(*) AS bars, round(avg(net), 7) + 0 AS mean, round({_SHARPE.format('net')}, 5) + 0 AS sharpe FROM net GROUP BY part""")
def bar_construction(spark, d):
    """The same rule on every second bar, from the even and from the odd one."""
    rows = panel(spark, d).withColumn("part", (F.col("idx") % 2).cast("int"))
    rows = rows.withColumn("ret", F.round(fw.div(F.col("close"), F.lag("close").over(fw.W.partitionBy("symbol", "part").orderBy("bar"))) - 1, 9)).where("ret IS NOT NULL")
    net = robust.net_spread(rows, "ret", 5, COST, ("part",))
    return _pick(net.groupBy("part").agg(F.count(F.lit(1)).alias("bars"), F.avg("net").alias("mean"), robust.ratio("net", 12).alias("s")).withColumnRenamed("s", "sharpe").withColumn("mean", F.round("mean", 7)), ["part", "bars", "mean"], "sharpe", digits=5)


_HELD = f"{_net('pn', name='hw')}, hd AS (SELECT bar, symbol, before AS w, ret FROM hwc)"


def _held(spark, d):
    w = fw.W.partitionBy("symbol").orderBy("bar")
    return fx.legs(panel(spark, d), "ret", 5).withColumn("w", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))


@query("selection_timing", f"WITH {PANEL}, {_HELD}, t AS (SELECT bar, sum(w) * avg(ret) AS timing, sum(w * ret) AS total FROM hd GROUP BY bar) SELECT bar, round(timing, 6) + 0 AS timing, round(total - timing, 6) + 0 AS selection, round(total, 6) + 0 AS total FROM t")
def selection_timing(spark, d):
    return _pick(robust.selection_timing(_held(spark, d), "w", "ret"), ["bar"], "timing", "selection", "total")


@query("short_feasibility", f"""WITH {PANEL}, {_HELD}, av AS (SELECT symbol, bar, round(avg(close * volume) OVER ({WS} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS adv FROM pn), cu AS (SELECT bar, quantile_cont(adv, 0.2) AS lim FROM av GROUP BY bar),
x AS (SELECT hd.*, adv <= lim AS ill, greatest(-w, 0) AS short FROM hd JOIN av USING (symbol, bar) JOIN cu USING (bar)), b AS (SELECT bar, sum(short) AS s, sum(-short * ret) AS p FROM x GROUP BY bar)
SELECT round((SELECT sum(CASE WHEN ill THEN short ELSE 0 END) / nullif(sum(short), 0) FROM x), 6) AS illiquid, round(avg(s) * 0.03, 6) AS borrow, round(avg(p) * 12, 6) AS profit FROM b""")
def short_feasibility(spark, d):
    """Short exposure in the least liquid fifth of names, and the cost of borrowing against what the short legs earn, a year."""
    w = fw.by().rowsBetween(-5, 0)
    rows = _held(spark, d).withColumns({"short": F.greatest(-F.col("w"), F.lit(0.0))})
    adv = panel(spark, d).select("symbol", "bar", F.round(F.avg(F.col("close") * F.col("volume")).over(w), 4).alias("adv"))
    lim = adv.groupBy("bar").agg(F.percentile("adv", 0.2).alias("lim"))
    x = rows.join(adv, ["symbol", "bar"]).join(lim, "bar")
    b = x.groupBy("bar").agg(F.sum("short").alias("s"), F.sum(-F.col("short") * F.col("ret")).alias("p"), F.sum(F.when(F.col("adv") <= F.col("lim"), F.col("short")).otherwise(0.0)).alias("i"))
    return b.agg(r(fw.div(F.sum("i"), F.sum("s"))).alias("illiquid"), r(F.avg("s") * 0.03).alias("borrow"), r(F.avg("p") * 12).alias("profit"))


@query("turnover_vs_decay", f"WITH {PANEL}, {_net('pn', name='hw')}, t AS (SELECT bar, sum(abs(weight)) AS gross, sum(abs(weight - before)) AS traded FROM hwc GROUP BY bar) SELECT round(avg(traded), 6) AS traded, round(2 * avg(gross) / nullif(avg(traded), 0), 6) AS holding FROM t")
def turnover_vs_decay(spark, d):
    """Bars that a position is held on the average, from what is traded."""
    t = _held(spark, d).groupBy("bar").agg(F.sum(F.abs("weight")).alias("g"), F.sum(F.abs(F.col("weight") - F.col("w"))).alias("t"))
    return t.agg(r(F.avg("t")).alias("traded"), r(fw.div(2 * F.avg("g"), F.avg("t"))).alias("holding"))


@query("execution_price_sensitivity", f"""WITH {RETS}, fp AS (SELECT b.symbol, b.idx, t, open, b.close FROM b JOIN rets USING (symbol, idx)), l AS (SELECT *, lag(t, 2) OVER ({WS}) AS held, lag(open) OVER ({WS}) AS o1, lag(close) OVER ({WS}) AS c1 FROM fp)
SELECT symbol, round(sum(held * ln(close / c1)), 6) + 0 AS next_close, round(sum(held * ln(open / o1)), 6) + 0 AS next_open, round(sum(held * ln((open + close) / (o1 + c1))), 6) + 0 AS mid FROM l WHERE held IS NOT NULL GROUP BY symbol""")
def execution_price_sensitivity(spark, d):
    """A target decided on a bar, filled at the next close, the next open, or between, and held for a bar."""
    w = fw.by()
    rows = returns(spark, d).select("symbol", "idx", "t").join(hourly(spark, d).select("symbol", "idx", "open", "close"), ["symbol", "idx"])
    held, o, c = F.lag("t", 2).over(w), F.lag("open").over(w), F.lag("close").over(w)
    rows = rows.select("symbol", held.alias("h"), F.log(F.col("close") / c).alias("c"), F.log(F.col("open") / o).alias("o"), F.log((F.col("open") + F.col("close")) / (o + c)).alias("m")).where("h IS NOT NULL")
    earn = lambda x: r(F.sum(F.col("h") * F.col(x)))
    return rows.groupBy("symbol").agg(earn("c").alias("next_close"), earn("o").alias("next_open"), earn("m").alias("mid"))


# Regimes, cut-offs and the arrow of time


_UP = f"{RC}, up AS (SELECT symbol, idx - 24 AS idx, mkt, round(avg(mkt) OVER ({WS} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 9) > 0 AS label, idx AS i FROM rc QUALIFY i >= 24)"


def _labelled(spark, d):
    w = fw.by()
    rows = plain(spark, d).withColumn("label", F.round(F.avg("mkt").over(w.rowsBetween(-24, -1)), 9) > 0).where("idx >= 24")
    return rows.select("symbol", (F.col("idx") - 24).alias("idx"), "mkt", "label")


@query("regime_swap_null", f"""WITH {_UP}, un AS (SELECT symbol, count(*) AS n, avg(mkt) FILTER (label) - avg(mkt) FILTER (NOT label) AS gap FROM up GROUP BY symbol), dk AS (SELECT symbol, n, rep, greatest(10, n // 10) + {h("'1'", 'rep', 'symbol')} % (n - 2 * greatest(10, n // 10)) AS k FROM un, (SELECT unnest(range(500)) AS rep)),
nl AS (SELECT up.symbol, rep, avg(up.mkt) FILTER (o.label) - avg(up.mkt) FILTER (NOT o.label) AS nul FROM up JOIN dk USING (symbol) JOIN up o ON o.symbol = up.symbol AND o.idx = (up.idx - k + n) % n GROUP BY ALL)
SELECT symbol, round(gap, 8) + 0 AS gap, round((1 + count(*) FILTER (round(abs(nul), 12) >= round(abs(gap), 12))) / (count(*) + 1), 6) AS p FROM nl JOIN un USING (symbol) GROUP BY symbol, gap""")
def regime_swap_null(spark, d):
    out = robust.regime_swap(_labelled(spark, d), ["symbol"], "label", 500, "mkt")
    return out.select("symbol", r("gap", 8).alias("gap"), r("p").alias("p"))


@query("regime_mix_bootstrap", f"""WITH {_UP}, lr AS (SELECT symbol, label, mkt, row_number() OVER (PARTITION BY symbol, label ORDER BY idx) - 1 AS j, count(*) OVER (PARTITION BY symbol, label) AS m, count(*) OVER (PARTITION BY symbol) // 2 AS half FROM up), sd AS (SELECT DISTINCT symbol, label, m, half FROM lr),
dw AS (SELECT sd.*, rep, i, {h("'1'", 'rep', 'symbol', 'CASE WHEN label THEN 1 ELSE 0 END', 'i')} % m AS j FROM (SELECT *, unnest(range(half)) AS i FROM sd) sd, (SELECT unnest(range(500)) AS rep)), sm AS (SELECT dw.symbol, rep, coalesce(avg(mkt) / nullif(stddev_samp(mkt), 0), 0) AS s FROM dw JOIN lr USING (symbol, label, j) GROUP BY ALL)
SELECT symbol, round(quantile_cont(s, 0.05), 6) AS p5, round(median(s), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95 FROM sm GROUP BY symbol""")
def regime_mix_bootstrap(spark, d):
    """Histories of half one regime and half the other, whatever the share of each was."""
    whole, own = fw.W.partitionBy("symbol"), fw.W.partitionBy("symbol", "label")
    rows = _labelled(spark, d).withColumns({"j": (F.row_number().over(own.orderBy("idx")) - 1).cast("long"), "m": F.count(F.lit(1)).over(own), "half": F.floor(F.count(F.lit(1)).over(whole) / 2)})
    sides = rows.select("symbol", "label", "m", "half").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("half") - 1)))
    drawn = resample.replicates(sides, 500).withColumn("j", hashed(1, F.col("rep"), F.col("symbol"), F.col("label").cast("int"), F.col("i")) % F.col("m"))
    one = drawn.select("symbol", "label", "rep", "j").join(rows.select("symbol", "label", "j", "mkt"), ["symbol", "label", "j"]).groupBy("symbol", "rep").agg(F.coalesce(fw.div(F.avg("mkt"), F.stddev_samp("mkt")), F.lit(0.0)).alias("s"))
    out = one.groupBy("symbol").agg(F.percentile("s", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    return out.select("symbol", *[r(F.col("p")[k]).alias(f"p{n}") for k, n in enumerate((5, 50, 95))])


@query("reversed_bars", f"WITH {BARS} SELECT symbol, CAST(max(idx) OVER s - idx AS BIGINT) AS idx, CAST(min(bar) OVER s + max(bar) OVER s - bar AS BIGINT) AS bar, close AS open, high, low, open AS close FROM b WINDOW s AS (PARTITION BY symbol)")
def reversed_bars(spark, d):
    out = robust.reversed_bars(hourly(spark, d))
    return out.withColumns({"idx": F.col("idx").cast("long"), "bar": F.col("bar").cast("long")})


_CUT = 473700
_SIDES = f"{RC}, sd AS (SELECT symbol, CASE WHEN bar < {_CUT} THEN 0 ELSE 1 END AS side, mkt, bar FROM rc), si AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY bar) - 1 AS idx FROM sd)"


@query("cutoff_sharpe", f"""WITH {_SIDES}, {_draws('symbol, side', 'si', 'symbol, side', 500, 'sum(mkt) AS a, sum(mkt * mkt) AS q')},
sr AS (SELECT symbol, side, rep, CASE WHEN greatest(0, q / total - (a / total) ** 2) * total / (total - 1) > 1e-30 THEN a / total / sqrt(greatest(0, q / total - (a / total) ** 2) * total / (total - 1)) ELSE 0 END AS s FROM sums), pw AS (SELECT symbol, rep, max(s) FILTER (side = 0) AS s0, max(s) FILTER (side = 1) AS s1 FROM sr GROUP BY ALL),
pp AS (SELECT symbol, avg(CASE WHEN round(s0 - s1, 12) <= 0 THEN 1.0 ELSE 0 END) AS p FROM pw WHERE s0 IS NOT NULL AND s1 IS NOT NULL GROUP BY symbol), ob AS (SELECT symbol, avg(mkt) FILTER (side = 0) / stddev_samp(mkt) FILTER (side = 0) * sqrt(8760::DOUBLE) AS before, avg(mkt) FILTER (side = 1) / stddev_samp(mkt) FILTER (side = 1) * sqrt(8760::DOUBLE) AS after FROM si GROUP BY symbol)
SELECT symbol, round(before, 5) AS before, round(after, 5) AS after, round(p, 6) AS p, CASE WHEN p < 0.05 AND before > 0.5 AND after <= 0 THEN 'fail' WHEN p < 0.1 AND after < 0.5 * before THEN 'warn' ELSE 'pass' END AS status FROM pp JOIN ob USING (symbol)""")
def cutoff_sharpe(spark, d):
    """The ratio before and after a date that a model may have been trained up to, and how surely it fell, by block bootstrap of both sides."""
    side = F.when(F.col("bar") < _CUT, 0).otherwise(1)
    rows = plain(spark, d).withColumn("side", side)
    rows = rows.withColumns({"idx": (F.row_number().over(fw.W.partitionBy("symbol", "side").orderBy("bar")) - 1).cast("long"), "q": F.col("mkt") * F.col("mkt")})
    sums = resample.block_sums(rows, ["symbol", "side"], ["symbol", "side"], ["mkt", "q"], 500)
    mean = F.col("mkt") / F.col("total")
    var = F.greatest(F.col("q") / F.col("total") - mean * mean, F.lit(0.0)) * F.col("total") / (F.col("total") - 1)
    s = F.when(var > 1e-30, mean / F.sqrt(var)).otherwise(0.0)
    pair = sums.groupBy("symbol", "rep").agg(F.max(F.when(F.col("side") == 0, s)).alias("a"), F.max(F.when(F.col("side") == 1, s)).alias("z")).where("a IS NOT NULL AND z IS NOT NULL")
    p = pair.groupBy("symbol").agg(F.avg((F.round(F.col("a") - F.col("z"), 12) <= 0).cast("double")).alias("p"))
    of = lambda k: fw.div(F.avg(F.when(F.col("side") == k, F.col("mkt"))), F.stddev_samp(F.when(F.col("side") == k, F.col("mkt")))) * 8760**0.5
    one = rows.groupBy("symbol").agg(of(0).alias("before"), of(1).alias("after")).join(p, "symbol")
    status = F.when((F.col("p") < 0.05) & (F.col("before") > 0.5) & (F.col("after") <= 0), "fail").when((F.col("p") < 0.1) & (F.col("after") < 0.5 * F.col("before")), "warn").otherwise("pass")
    return one.select("symbol", r("before", 5).alias("before"), r("after", 5).alias("after"), r("p").alias("p"), status.alias("status"))


# Noise and shocks


_REP = "(SELECT unnest(range({})) AS rep)"
_U = lambda *a: f"(({h(*a)} + 0.5) / 4294967296)"


@query("slipped_bars", f"""WITH {BARS}, x AS (SELECT *, 1 + (2 * {_U("'1'", 'rep', 'symbol', 'idx')} - 1) * 5.0 / 10000 AS f FROM b, {_REP.format(3)}) SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, round(open * f, 6) AS open, round(high * f, 6) AS high, round(low * f, 6) AS low, round(close * f, 6) AS close FROM x""")
def slipped_bars(spark, d):
    return _pick(robust.slipped(hourly(spark, d), 3, 5.0), ["symbol", "bar", "rep"], "open", "high", "low", "close")


@query("gapped_bars", f"""WITH {BARS}, x AS (SELECT *, ln(1 + CASE WHEN {_U("'1'", "'gap'", 'rep', 'symbol', 'idx')} < 0.05 THEN (2 * {_U("'1'", "'size'", 'rep', 'symbol', 'idx')} - 1) * 0.02 ELSE 0 END) AS j FROM b, {_REP.format(3)}), f AS (SELECT *, exp(sum(j) OVER (PARTITION BY rep, symbol ORDER BY idx)) AS f FROM x)
SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, round(open * f, 5) AS open, round(high * f, 5) AS high, round(low * f, 5) AS low, round(close * f, 5) AS close FROM f""")
def gapped_bars(spark, d):
    return _pick(robust.gapped(hourly(spark, d), 3, 0.05, 0.02), ["symbol", "bar", "rep"], "open", "high", "low", "close", digits=5)


@query("noisy_volume", f"""WITH {PANEL}, x AS (SELECT symbol, bar, rep, volume * exp(0.3 * {normal.ppf_sql(_U("'1'", 'rep', 'symbol', 'idx'))}) AS volume FROM pn, {_REP.format(2)}) SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, round(volume, 4) AS volume FROM x""")
def noisy_volume(spark, d):
    return _pick(robust.noisy_volume(panel(spark, d), 2, 0.3), ["symbol", "bar", "rep"], "volume", digits=4)


@query("late_bars", f"""WITH {BARS}, x AS (SELECT symbol, bar, idx, close, rep, {h("'1'", 'rep', 'symbol')} % 3 AS k FROM b, {_REP.format(4)}), y AS (SELECT *, CASE k WHEN 0 THEN close WHEN 1 THEN lag(close) OVER w ELSE lag(close, 2) OVER w END AS c FROM x WINDOW w AS (PARTITION BY rep, symbol ORDER BY idx)) SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, CAST(k AS INTEGER) AS lag, c AS close FROM y""")
def late_bars(spark, d):
    return robust.late(hourly(spark, d).select("symbol", "bar", "idx", "close"), 4, 2, ["close"]).select("symbol", "bar", "rep", "lag", "close")


@query("widened_bars", f"""WITH {BARS}, v0 AS (SELECT *, coalesce(close / lag(close) OVER ({WS}) - 1, 0) AS rr FROM b), v1 AS (SELECT *, stddev_samp(rr) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM v0), v2 AS (SELECT *, v / avg(v) OVER (PARTITION BY symbol) AS nv FROM v1),
x AS (SELECT symbol, bar, rep, open, high, low, close * (1 + greatest(2.0, least(20.0, 2.0 * (1 + (coalesce(nv, 1) - 1) * 2.0))) / 10000 * CASE WHEN {h("'1'", 'rep', 'symbol', 'idx')} % 2 = 0 THEN 1 ELSE -1 END * 0.5) AS close FROM v2, {_REP.format(2)})
SELECT symbol, bar, CAST(rep AS INTEGER) AS rep, open, round(greatest(open, high, low, close), 6) AS high, round(least(open, high, low, close), 6) AS low, round(close, 6) AS close FROM x""")
def widened_bars(spark, d):
    return _pick(robust.widened(hourly(spark, d), 2, 2.0, 2.0), ["symbol", "bar", "rep", "open"], "high", "low", "close")


_SHOCKS = f"""{RETS}, rr AS (SELECT symbol, idx, ret, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM rets WHERE ret IS NOT NULL), kk AS (SELECT *, row_number() OVER (PARTITION BY symbol, rep ORDER BY {h("'1'", 'rep', 'symbol', 'idx')}, idx) AS k FROM rr, {_REP.format(100)}),
sh AS (SELECT symbol, rep, idx, CASE WHEN k <= 5 THEN CASE WHEN {h("'1'", "'side'", 'rep', 'symbol', 'idx')} % 2 = 0 THEN 1 ELSE -1 END * 5.0 * sd ELSE ret END AS ret FROM kk)"""


@query("shocked_returns", f"WITH {_SHOCKS}, a AS (SELECT symbol, rep, sum(ln(1 + greatest(ret, -0.999999))) AS l FROM sh GROUP BY ALL) SELECT symbol, count(*) AS n, round(avg(exp(l) - 1), 6) + 0 AS mean, round(quantile_cont(exp(l) - 1, 0.05), 6) + 0 AS p5, round(avg(CASE WHEN round(l, 12) < 0 THEN 1.0 ELSE 0 END), 6) AS losses FROM a GROUP BY symbol")
def shocked_returns(spark, d):
    """A hundred histories with five shocks of five deviations each."""
    rows = robust.shocked(returns(spark, d).where("ret IS NOT NULL").select("symbol", "idx", "ret"), ["symbol"], 100, 5, 5.0)
    one = rows.groupBy("symbol", "rep").agg(F.sum(F.log1p(F.greatest(F.col("ret"), F.lit(-0.999999)))).alias("l"))
    total = F.exp("l") - 1
    return one.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg(total)).alias("mean"), r(F.percentile(total, 0.05)).alias("p5"), r(F.avg((F.round("l", 12) < 0).cast("double"))).alias("losses"))


@query("scenario_pass_rates", f"""WITH {_SHOCKS}, o AS (SELECT symbol, rep, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(8760::DOUBLE) AS sharpe, sum(ret) AS total, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hits FROM sh GROUP BY ALL), lg AS (SELECT symbol, unnest(['sharpe', 'total', 'hits']) AS metric, unnest([sharpe, total, hits]) AS x FROM o)
SELECT symbol, metric, count(*) AS n, round(avg(x), 6) + 0 AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) + 0 AS low, round(max(x), 6) + 0 AS high, round(quantile_cont(x, 0.05), 6) + 0 AS p5, round(quantile_cont(x, 0.95), 6) + 0 AS p95 FROM lg GROUP BY ALL""")
def scenario_pass_rates(spark, d):
    """Metrics of a strategy over scenarios, summed up."""
    rows = robust.shocked(returns(spark, d).where("ret IS NOT NULL").select("symbol", "idx", "ret"), ["symbol"], 100, 5, 5.0)
    one = rows.groupBy("symbol", "rep").agg(robust.ratio("ret", 8760).alias("sharpe"), F.sum("ret").alias("total"), F.avg((F.col("ret") > 0).cast("double")).alias("hits"))
    return _pick(robust.summary(one, ["symbol"], ["sharpe", "total", "hits"]), ["symbol", "metric", "n"], "mean", "sd", "low", "high", "p5", "p95")


# Quotes that arrive late


def _arrived(source: str, keys: str, at: str, name: str) -> str:
    p = keys.replace("symbol", "").strip(", ")
    grid = f"(SELECT rc.symbol, rc.bar, mkt{', ' + p if p else ''} FROM rc JOIN (SELECT DISTINCT {keys} FROM {source}) kx USING (symbol))"
    return f"""{name}i AS (SELECT {keys}, ({at}) // {HOUR} AS bar, arg_max(price, ({at}, event_id)) AS seen FROM {source} GROUP BY ALL), {name}s AS (SELECT {keys}, bar, sign(seen - lag(seen) OVER (PARTITION BY {keys} ORDER BY bar)) AS s FROM {name}i),
{name}g AS (SELECT g.*, s FROM {grid} g LEFT JOIN {name}s USING ({keys}, bar)), {name}p AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM {name}g), {name} AS (SELECT {keys}, sum(pos * mkt) AS total FROM {name}p GROUP BY {keys})"""


_LATE = f"{RC}, lt AS (SELECT * REPLACE (latency_ms * 20000 AS latency_ms) FROM ticks)"


def _late_ticks(spark, d):
    """Ticks whose latency is long enough to matter to hourly bars: up to half an hour."""
    return ticks(spark, d).select("symbol", "us", "event_id", "price", (F.col("latency_ms") * 20_000).alias("latency_ms"))


@query("arrival_lookahead", f"""WITH {_LATE}, {_arrived('lt', 'symbol', 'us', 'ex')}, {_arrived('lt', 'symbol', 'us + 1000 * latency_ms', 'ar')}
SELECT symbol, round(ex.total, 6) + 0 AS exchange_clock, round(ar.total, 6) + 0 AS arrival_clock, CASE WHEN round(ex.total, 9) <= 0 THEN 'skip' WHEN round(ar.total, 9) <= 0 THEN 'warn' ELSE 'pass' END AS status FROM ex JOIN ar USING (symbol)""")
def arrival_lookahead(spark, d):
    """What a signal earns on the exchange's clock against on that of arrivals."""
    t, bars = _late_ticks(spark, d), plain(spark, d)
    a = robust.arrival_returns(t, F.lit(0), bars, ("symbol",), HOUR).withColumnRenamed("total", "a")
    z = robust.arrival_returns(t, 1000 * F.col("latency_ms"), bars, ("symbol",), HOUR).withColumnRenamed("total", "z")
    status = F.when(F.round("a", 9) <= 0, "skip").when(F.round("z", 9) <= 0, "warn").otherwise("pass")
    return a.join(z, "symbol").select("symbol", r("a").alias("exchange_clock"), r("z").alias("arrival_clock"), status.alias("status"))


@query("latency_monte_carlo", f"""WITH {_LATE}, li AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lt), dj AS (SELECT li.symbol, us, event_id, price, rep, {h("'1'", 'rep', 'symbol', 'i')} % n AS j FROM li, {_REP.format(20)}),
dr0 AS (SELECT dj.symbol, rep, dj.us, dj.event_id, dj.price, li.latency_ms AS latency_ms FROM dj JOIN li ON li.symbol = dj.symbol AND li.i = dj.j), {_arrived('dr0', 'rep, symbol', 'us + 1000 * latency_ms', 'mc')}
SELECT symbol, count(*) AS draws, round(quantile_cont(total, 0.05), 6) + 0 AS p5, round(median(total), 6) + 0 AS p50, round(quantile_cont(total, 0.95), 6) + 0 AS p95, round(avg(CASE WHEN round(total, 9) <= 0 THEN 1.0 ELSE 0 END), 6) AS loss FROM mc GROUP BY symbol""")
def latency_monte_carlo(spark, d):
    """The same with each tick's latency drawn anew from those of its symbol."""
    one = robust.redrawn_returns(_late_ticks(spark, d), 20, 1000, plain(spark, d), HOUR)
    out = one.groupBy("symbol").agg(F.count(F.lit(1)).alias("draws"), F.percentile("total", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"), r(F.avg((F.round("total", 9) <= 0).cast("double"))).alias("loss"))
    return out.select("symbol", "draws", *[r(F.col("p")[k]).alias(f"p{n}") for k, n in enumerate((5, 50, 95))], "loss")
