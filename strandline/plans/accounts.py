"""Registered accounts, records and what must line up, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import recursive, xsection
from ..functions import windows as fw
from ..operators import accounts, engine, resample, robust, stats
from ..sources.tables import HOUR, table, ticks
from .base import BARS, TICKS, WS, full, hourly, query, r
from .engines import _SD
from .research import PANEL, _ic, kept_panel
from .resampling import RC, _draws, h, plain
from .robust import COST, _net
from .stats import RETS, _pick, returns
from .trading import _FILLED, _account_fills

_HELD = f"{BARS}, sm AS (SELECT symbol, idx, close, high, ((idx * 7) % 11 - 4) / 10000.0::DOUBLE AS funding, idx % 40 BETWEEN 5 AND 24 AS held FROM b)"


@query("short_margin", f"""WITH {_HELD}, n0 AS (SELECT *, lag(close) OVER ({WS}) AS pc, CASE WHEN held AND NOT coalesce(lag(held) OVER ({WS}), false) THEN 1 ELSE 0 END AS nw FROM sm), n1 AS (SELECT *, sum(nw) OVER ({WS}) AS episode FROM n0), n2 AS (SELECT * FROM n1 WHERE held AND pc IS NOT NULL),
n3 AS (SELECT *, first_value(idx) OVER e AS entry, first_value(pc) OVER e AS p0 FROM n2 WINDOW e AS (PARTITION BY symbol, episode ORDER BY idx)), n4 AS (SELECT *, close / p0 AS up, greatest(high, close) / p0 AS hi, sum(funding * (close / p0)) OVER (PARTITION BY symbol, episode ORDER BY idx) AS paid, coalesce(sum(funding * (close / p0)) OVER (PARTITION BY symbol, episode ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS early FROM n3),
n5 AS (SELECT *, min(CASE WHEN round(0.05::DOUBLE + early - (hi - 1), 12) <= round(0.01::DOUBLE * hi, 12) THEN idx END) OVER (PARTITION BY symbol, episode) AS liquidated FROM n4)
SELECT symbol, CAST(episode AS BIGINT) AS episode, entry, liquidated, count(*) AS bars, round(max(hi - 1), 6) + 0 AS worst_rise, round(min(CASE WHEN liquidated IS NULL OR idx < liquidated THEN (0.05::DOUBLE + paid - (up - 1)) / up END), 6) + 0 AS least_ratio FROM n5 GROUP BY symbol, episode, entry, liquidated""")
def short_margin(spark, d):
    """Shorts at twenty times, on prices as they are: most spells do not last."""
    i = F.col("idx")
    rows = hourly(spark, d).withColumns({"funding": ((i * 7) % 11 - 4) / 10000.0, "held": (i % 40).between(5, 24)})
    return _pick(accounts.short_margin(rows, "symbol", 20, 0.01), ["symbol", "episode", "entry", "liquidated", "bars"], "worst_rise", "least_ratio")


def _margin_sql(name: str, first: float, maintenance: float, trigger: float, delay: int) -> str:
    """CTE {name} (recursive): the account of each symbol, bar by bar. mode: 0 flat, 1 held, 2 liquidated."""
    return f"""{name} AS (SELECT symbol, idx, 0 AS mode, 0::DOUBLE AS p0, 0::DOUBLE AS eq, 0::DOUBLE AS paid, NULL::BIGINT AS due, 0::DOUBLE AS amt, 0 AS entered, 0 AS liq, 0 AS late, NULL::DOUBLE AS ratio, NULL::DOUBLE AS rise, NULL::DOUBLE AS moved FROM mg WHERE idx = 0
UNION ALL SELECT symbol, idx, CASE WHEN NOT held THEN 0 WHEN dead OR hit THEN 2 ELSE 1 END, p0, eq, paid, CASE WHEN ordered THEN idx + 1 + {delay} ELSE due END, CASE WHEN ordered THEN {first}::DOUBLE * up - lft ELSE amt END, CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN hit THEN 1 ELSE 0 END,
  CASE WHEN hit AND due IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN ok THEN lft / up END, CASE WHEN held THEN top - 1 END, CASE WHEN ordered THEN {first}::DOUBLE * up - lft END
FROM (SELECT *, ok AND round(lft / up, 12) < {trigger}::DOUBLE AND due IS NULL AS ordered FROM (SELECT * REPLACE (CASE WHEN ok THEN paid + funding * up ELSE paid END AS paid), eq + CASE WHEN ok THEN paid + funding * up ELSE paid END - (up - 1) AS lft FROM
 (SELECT *, held AND NOT dead AND NOT hit AS ok FROM (SELECT *, held AND NOT dead AND round(eq + paid - (top - 1), 12) <= round({maintenance}::DOUBLE * top, 12) AS hit FROM (SELECT *, close / p0 AS up, hi / p0 AS top FROM
 (SELECT m.symbol, m.idx, held, close, hi, funding, held AND mode = 0 AS fresh, held AND mode = 2 AS dead, CASE WHEN held AND mode = 0 THEN pc ELSE p0 END AS p0, CASE WHEN held AND mode = 0 THEN {first}::DOUBLE WHEN due <= m.idx THEN eq + amt ELSE eq END AS eq,
   CASE WHEN held AND mode = 0 THEN 0 ELSE paid END AS paid, CASE WHEN held AND mode = 0 OR due <= m.idx OR NOT held THEN NULL ELSE due END AS due, amt FROM {name} x JOIN mg m ON m.symbol = x.symbol AND m.idx = x.idx + 1))))))),
"""


@query("margin_account", f"""WITH RECURSIVE {_HELD}, mg AS (SELECT symbol, idx, close, greatest(high, close) AS hi, funding, held, lag(close) OVER ({WS}) AS pc FROM sm), {_margin_sql('ma', 1.0, 0.05, 0.6, 1)} zz AS (SELECT 1)
SELECT symbol, sum(entered)::BIGINT AS episodes, sum(liq)::BIGINT AS liquidated, min(CASE WHEN liq = 1 THEN idx END) AS first_liquidation, count(moved) AS topups, round(coalesce(sum(moved), 0), 5) + 0 AS topup_total, round(coalesce(sum(moved), 0) * 0.001, 7) + 0 AS transfer_cost,
  sum(late)::BIGINT AS late, round(max(rise), 6) + 0 AS worst_rise, round(min(ratio), 6) + 0 AS least_ratio FROM ma GROUP BY symbol""")
def margin_account(spark, d):
    """Shorts without leverage that are topped up; transfers take a bar longer than the next, and some come too late."""
    i = F.col("idx")
    rows = hourly(spark, d).withColumns({"funding": ((i * 7) % 11 - 4) / 10000.0, "held": (i % 40).between(5, 24)})
    out = accounts.margin_account(rows, "symbol", 1, 0.05, 0.6, 1, 0.001)
    ints = ["symbol", "episodes", "liquidated", "first_liquidation", "topups", "late"]
    return out.select(*ints, r("topup_total", 5).alias("topup_total"), r("transfer_cost", 7).alias("transfer_cost"), r("worst_rise").alias("worst_rise"), r("least_ratio").alias("least_ratio"))


@query("net_asset_value", f"""WITH {_FILLED.replace('SELECT l_suppkey AS account', 'SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS account').replace('l_extendedprice / l_quantity AS price', 'floor(l_extendedprice / l_quantity * 10000) / 10000 AS price')}, dy AS (SELECT account, symbol, day, sum(qty) AS q, sum(qty * price + fee) AS o, arg_max(price, seq) AS px FROM fl GROUP BY ALL), gr AS (SELECT * FROM (SELECT DISTINCT account, day FROM dy) JOIN (SELECT DISTINCT account, symbol FROM dy) USING (account)),
g2 AS (SELECT account, symbol, day, o, sum(coalesce(q, 0)) OVER w AS hq, last_value(px IGNORE NULLS) OVER w AS p FROM gr LEFT JOIN dy USING (account, symbol, day) WINDOW w AS (PARTITION BY account, symbol ORDER BY day ROWS UNBOUNDED PRECEDING)), g3 AS (SELECT account, day, sum(coalesce(o, 0)) AS o, sum(coalesce(hq * p, 0)) AS value FROM g2 GROUP BY ALL)
SELECT account, CAST(day AS VARCHAR) AS day, round(-sum(o) OVER (PARTITION BY account ORDER BY day), 4) + 0 AS cash, round(value, 4) + 0 AS value FROM g3""")
def net_asset_value(spark, d):
    fills = _account_fills(spark, d, F.col("l_shipdate").cast("date").alias("day")).withColumn("price", F.floor(F.col("price") * 10_000) / 10_000)
    return _pick(accounts.net_asset_value(fills, "account", "symbol", "day").withColumn("day", F.col("day").cast("string")), ["account", "day"], "cash", "value", digits=4)


_ORACLE = f"{RETS}, hs AS (SELECT symbol, ret, ntile(2) OVER ({WS}) AS half FROM rets WHERE ret IS NOT NULL), ho AS (SELECT symbol, round(avg(ret) FILTER (half = 1) / stddev_samp(ret) FILTER (half = 1) * sqrt(8760::DOUBLE), 9) AS train, round(avg(ret) FILTER (half = 2) / stddev_samp(ret) FILTER (half = 2) * sqrt(8760::DOUBLE), 9) AS hold FROM hs GROUP BY symbol)"
_LAP = lambda scale, *a: f"(-{scale} * sign(({h(*a)} + 0.5) / 4294967296 - 0.5) * ln(1 - 2 * abs(({h(*a)} + 0.5) / 4294967296 - 0.5)))"


def _halves(spark, d):
    rows = returns(spark, d).where("ret IS NOT NULL").withColumn("half", F.ntile(2).over(fw.by()))
    of = lambda k: F.round(fw.div(F.avg(F.when(F.col("half") == k, F.col("ret"))), F.stddev_samp(F.when(F.col("half") == k, F.col("ret")))) * 8760**0.5, 9)
    return rows.groupBy("symbol").agg(of(1).alias("train"), of(2).alias("hold"))


@query("held_out_answers", f"""WITH {_ORACLE}, a AS (SELECT *, abs(train - hold) > 1.0 + {_LAP('1.0::DOUBLE', "'1'", "'gap'", 'symbol')} AS apart FROM ho) SELECT symbol, NOT apart AS consistent, round(CASE WHEN apart THEN hold + {_LAP('0.5::DOUBLE', "'1'", "'value'", 'symbol')} ELSE train END, 5) + 0 AS value FROM a""")
def held_out_answers(spark, d):
    out = accounts.held_out_answer(_halves(spark, d), "symbol", "train", "hold", 1.0, 0.5)
    return out.select("symbol", "consistent", r("value", 5).alias("value"))


@query("out_of_sample_ratio", f"WITH {_ORACLE} SELECT symbol, round(train, 5) AS train, round(hold, 5) AS hold, round(hold / nullif(train, 0), 4) + 0 AS ratio, CASE WHEN train > 0 AND hold < 0.5 * train THEN 'warn' ELSE 'pass' END AS status FROM ho")
def out_of_sample_ratio(spark, d):
    x = _halves(spark, d)
    worse = (F.col("train") > 0) & (F.col("hold") < 0.5 * F.col("train"))
    return x.select("symbol", r("train", 5).alias("train"), r("hold", 5).alias("hold"), r(fw.div(F.col("hold"), F.col("train")), 4).alias("ratio"), F.when(worse, "warn").otherwise("pass").alias("status"))


@query("aligned_signals", f"WITH {BARS}, sg AS (SELECT event_type AS symbol, epoch_us(ts) // {HOUR} AS bar, CASE WHEN value > 50 THEN 1 ELSE -1 END AS signal FROM events), o AS (SELECT symbol, bar, max(signal) AS signal, count(*) AS n FROM sg WHERE bar % 3 <> 0 GROUP BY ALL) SELECT b.symbol, b.bar, coalesce(signal, 0) AS signal, coalesce(o.n, 0) AS \"rows\" FROM b LEFT JOIN o ON o.symbol = b.symbol AND o.bar = b.bar")
def aligned_signals(spark, d):
    """Signals brought to the bars: flat where there are none, and how many rows a bar has."""
    sig = ticks(spark, d).select("symbol", F.floor(F.col("us") / HOUR).cast("long").alias("bar"), F.when(F.col("price") > 50, 1).otherwise(-1).alias("signal")).where("bar % 3 <> 0")
    return accounts.aligned(hourly(spark, d), sig, ["symbol", "bar"], "signal")


@query("data_contract", "WITH e AS (SELECT o_custkey AS k, o_orderdate AS t, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS known, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS v FROM orders), g AS (SELECT k, t, count(*) AS n FROM e GROUP BY ALL) SELECT 'null v' AS problem, count(*) FILTER (v IS NULL) AS n FROM e UNION ALL SELECT 'known before it happened', count(*) FILTER (known < t) FROM e UNION ALL SELECT 'repeated', CAST(sum(n - 1) AS BIGINT) FROM g")
def data_contract(spark, d):
    early = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    known = F.when(early, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), known.alias("known"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v"))
    return accounts.contract(rows, ["k"], "t", "known", ["v"])


@query("break_onset", f"""WITH {RC}, cs AS (SELECT symbol, idx, round(sum(mkt) OVER ({WS}), 9) AS x FROM rc), fd AS (SELECT symbol, n * 2 // 3 AS at0 FROM nn), dd AS (SELECT cs.*, at0, greatest(20, least(n // 4, at0 // 2)) AS ref FROM cs JOIN fd USING (symbol) JOIN nn USING (symbol)),
m AS (SELECT *, avg(x) FILTER (idx < ref) OVER (PARTITION BY symbol) AS m, stddev_samp(x) FILTER (idx < ref) OVER (PARTITION BY symbol) AS sd FROM dd), oo AS (SELECT *, coalesce(lead(idx) OVER ({WS}), at0) - idx - 1 AS gap FROM m WHERE abs(x - m) > 1.5 * sd AND idx >= ref AND idx < at0),
c AS (SELECT *, coalesce(max(CASE WHEN gap > 25 THEN idx END) OVER (PARTITION BY symbol), -1) AS cut FROM oo), f AS (SELECT symbol, min(idx) AS f FROM c WHERE idx > cut GROUP BY symbol) SELECT fd.symbol, at0 AS "at", coalesce(f, at0) AS onset FROM fd LEFT JOIN f USING (symbol)""")
def break_onset(spark, d):
    rows = plain(spark, d).withColumn("x", F.round(F.sum("mkt").over(fw.by().rowsBetween(W.unboundedPreceding, 0)), 9))
    found = rows.groupBy("symbol").agg(F.floor(F.count(F.lit(1)) * 2 / 3).alias("at"))
    return accounts.onset(rows, found, "symbol", "x", 1.5)


@query("position_variants", f"WITH {RETS} SELECT symbol, printf('%X', CAST(sum({h('idx', 't')}) AS BIGINT)) AS variant FROM rets GROUP BY symbol")
def position_variants(spark, d):
    return accounts.variants(returns(spark, d), ["symbol"], "t")


_PART = f"{TICKS}, pb AS (SELECT symbol, us // {HOUR} AS bar, arg_min(price, (us, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, event_id)) AS close, count(*) AS n FROM ticks WHERE us % {HOUR} < {HOUR // 2} GROUP BY ALL)"


@query("partial_bars", f"WITH {_PART} SELECT * FROM pb")
def partial_bars(spark, d):
    return accounts.partial_bars(ticks(spark, d), HOUR, 0.5)


@query("repaint_live", f"""WITH {BARS}, {_PART.split(TICKS + ', ', 1)[1]}, f AS (SELECT symbol, bar, idx, close, {full('avg', 'close', 20)} AS m, sum(close) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS s19 FROM b), j AS (SELECT f.*, pb.close AS pc FROM f JOIN pb USING (symbol, bar) WHERE m IS NOT NULL)
SELECT symbol, count(*) AS bars, count(*) FILTER ((close > m) <> (pc > (s19 + pc) / 20)) AS changed FROM j GROUP BY symbol""")
def repaint_live(spark, d):
    """Signals of half-formed bars that the finished bar takes back."""
    w = fw.by()
    b = hourly(spark, d)
    b = b.select("symbol", "bar", "close", fw.sma(F.col("close"), 20, w).alias("m"), F.sum("close").over(w.rowsBetween(-19, -1)).alias("s19")).where("m IS NOT NULL")
    j = b.join(accounts.partial_bars(ticks(spark, d), HOUR, 0.5).select("symbol", "bar", F.col("close").alias("pc")), ["symbol", "bar"])
    taken = (F.col("close") > F.col("m")) != (F.col("pc") > (F.col("s19") + F.col("pc")) / 20)
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum(taken.cast("long")).alias("changed"))


@query("breadth_consistency", f"WITH {PANEL}, vi AS (SELECT * FROM pn WHERE ret IS NOT NULL AND fwd IS NOT NULL), {_ic('ret', 'fwd', 'vi', 'bar')}, i AS (SELECT avg(ic) AS ic FROM ic), n AS (SELECT avg(n) AS names FROM (SELECT bar, count(ret) AS n FROM pn GROUP BY bar)) SELECT round(names, 6) AS names, round(ic * sqrt(names * 12), 6) + 0 AS implied, CASE WHEN round(ic, 9) <= 0 OR 1.5 > 2 * ic * sqrt(names * 12) THEN 'warn' ELSE 'pass' END AS status FROM i, n")
def breadth_consistency(spark, d):
    """A claimed ratio of 1.5 against what skill and breadth imply."""
    p = kept_panel(spark, d)
    one = xsection.rank_ic(p, "ret", "fwd").agg(F.avg("ic").alias("ic")).crossJoin(p.groupBy("bar").agg(F.count("ret").alias("n")).agg(F.avg("n").alias("names")))  # one row each
    implied = F.col("ic") * F.sqrt(F.col("names") * 12)
    return one.select(r("names").alias("names"), r(implied).alias("implied"), F.when((F.round("ic", 9) <= 0) | (F.lit(1.5) > 2 * implied), "warn").otherwise("pass").alias("status"))


@query("known_anomalies", f"WITH {PANEL}, {_net('pn', name='n0')}, {_net('pn', name='n1', score='vol')}, {_net('pn', name='n2', score='close')}, k AS (SELECT 'size' AS name, bar, net FROM n1 UNION ALL SELECT 'price', bar, net FROM n2) SELECT name, round(corr(n0.net, k.net), 6) + 0 AS corr, CASE WHEN abs(corr(n0.net, k.net)) > 0.7 THEN 'warn' ELSE 'pass' END AS status FROM n0 JOIN k USING (bar) GROUP BY name")
def known_anomalies(spark, d):
    """A score's net returns against those of plain scores that everyone knows."""
    p = kept_panel(spark, d)
    own = robust.net_spread(p, "ret", 5, COST).select("bar", F.col("net").alias("own"))
    known = robust.net_spread(p, "vol", 5, COST).withColumn("name", F.lit("size")).unionByName(robust.net_spread(p, "close", 5, COST).withColumn("name", F.lit("price")))
    c = known.join(own, "bar").groupBy("name").agg(F.corr("own", "net").alias("c"))
    return c.select("name", r("c").alias("corr"), F.when(F.abs("c") > 0.7, "warn").otherwise("pass").alias("status"))


@query("portfolio_monte_carlo", f"""WITH {RC}, bk0 AS (SELECT bar, avg(mkt) AS ret FROM rc GROUP BY bar), bk AS (SELECT 'book' AS symbol, row_number() OVER (ORDER BY bar) - 1 AS idx, ret FROM bk0), {_draws('symbol', 'bk', 'symbol', 1000, 'sum(ln(1 + ret)) AS l').replace('zz AS', 'zb AS').replace('FROM zz', 'FROM zb')}, x AS (SELECT exp(l * n / total) - 1 AS g FROM sums)
SELECT count(*) AS draws, round(quantile_cont(g, 0.05), 6) + 0 AS p5, round(median(g), 6) + 0 AS p50, round(quantile_cont(g, 0.95), 6) + 0 AS p95, round(avg(CASE WHEN round(g, 12) < 0 THEN 1.0 ELSE 0 END), 6) AS loss FROM x""")
def portfolio_monte_carlo(spark, d):
    """The equally weighted book's total over a thousand block resamples of its bars."""
    book = plain(spark, d).groupBy("bar").agg(F.avg("mkt").alias("ret"))
    book = book.select(F.lit("book").alias("symbol"), (F.row_number().over(W.orderBy("bar")) - 1).cast("long").alias("idx"), F.log1p("ret").alias("l"))  # a row a bar after the book is added up
    sums = resample.block_sums(book, ["symbol"], ["symbol"], ["l"], 1000)
    g = sums.select(F.expm1(F.col("l") * F.col("n") / F.col("total")).alias("g"))
    out = g.agg(F.count(F.lit(1)).alias("draws"), F.percentile("g", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg((F.round("g", 12) < 0).cast("double")).alias("loss"))
    return out.select("draws", *[r(F.col("q")[k]).alias(f"p{n}") for k, n in enumerate((5, 50, 95))], r("loss").alias("loss"))


@query("breaking_point", f"WITH {RETS}, x AS (SELECT symbol, ret, abs(t - coalesce(lag(t) OVER ({WS}), 0)) AS traded FROM rets), sx AS (SELECT symbol, sum(ret) AS total, sum(traded) AS traded FROM x GROUP BY symbol), l AS (SELECT *, unnest(range(0, 101, 5)) AS bps FROM sx) SELECT symbol, CAST(min(bps) FILTER (round(total - bps / 10000 * traded, 9) <= 0) AS BIGINT) AS bps, round(total, 6) + 0 AS total FROM l GROUP BY symbol, total")
def breaking_point(spark, d):
    """The first cost of a ladder, in basis points, at which nothing is left."""
    rows = returns(spark, d).withColumn("traded", F.abs(F.col("t") - F.coalesce(F.lag("t").over(fw.by()), F.lit(0))))
    s = rows.groupBy("symbol").agg(F.sum("ret").alias("total"), F.sum("traded").alias("traded")).withColumn("bps", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(5).cast("long"))))
    gone = F.round(F.col("total") - F.col("bps") / 10_000 * F.col("traded"), 9) <= 0
    return s.groupBy("symbol", "total").agg(F.min(F.when(gone, F.col("bps"))).alias("bps")).select("symbol", "bps", r("total").alias("total"))


@query("trailing_prior", f"WITH {BARS} SELECT symbol, bar, round(avg(close) OVER f, 6) AS mean, round(stddev_samp(close) OVER f, 6) AS sd FROM b WINDOW f AS ({WS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def trailing_prior(spark, d):
    f = fw.by().rowsBetween(-20, -1)
    return hourly(spark, d).select("symbol", "bar", r(F.avg("close").over(f)).alias("mean"), r(F.stddev_samp("close").over(f)).alias("sd"))


@query("decision_points", f"WITH {RETS}, c AS (SELECT symbol, bar, idx, t, t <> coalesce(lag(t) OVER ({WS}), 0) AS moved FROM rets), k AS (SELECT *, row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM c WHERE moved) SELECT symbol, bar, t FROM k WHERE i * 10 // n <> (i - 1) * 10 // n OR i = 0")
def decision_points(spark, d):
    """Ten of the bars on which a position changes, evenly spread over all of them: what a slow probe should look at."""
    w, part = fw.by(), W.partitionBy("symbol")
    rows = returns(spark, d).withColumn("moved", F.col("t") != F.coalesce(F.lag("t").over(w), F.lit(0))).where("moved")
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(part)})
    step = lambda i: F.floor(i * 10 / F.col("n"))
    return rows.where((F.col("i") == 0) | (step(F.col("i")) != step(F.col("i") - 1))).select("symbol", "bar", "t")


@query("liquidity_stress", f"""WITH RECURSIVE {RETS}, x AS (SELECT rets.symbol, rets.bar, rets.idx, CAST(t AS DOUBLE) AS t, 0.1::DOUBLE * b.n * 0.3::DOUBLE * b.close / 1000 AS room, {_SD} AS sd FROM rets JOIN b ON b.symbol = rets.symbol AND b.idx = rets.idx),
cp AS (SELECT symbol, CAST(-1 AS BIGINT) AS idx, 0.0::DOUBLE AS held, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS ling FROM x GROUP BY symbol
UNION ALL SELECT symbol, idx, held + dw, abs(dw) * (0.001::DOUBLE + imp + ling), (ling + imp) * 0.5 FROM (SELECT *, 0.3::DOUBLE * sd * sqrt(CASE WHEN room > 0 THEN abs(dw) / room * 0.1::DOUBLE ELSE 0 END) AS imp
  FROM (SELECT x.symbol, x.idx, held, ling, sd, room, greatest(-room, least(room, t - held)) AS dw FROM cp JOIN x ON x.symbol = cp.symbol AND x.idx = cp.idx + 1)))
SELECT symbol, round(avg(abs(held)), 6) AS held, round(sum(cost), 5) + 0 AS cost FROM cp JOIN x USING (symbol, idx) GROUP BY symbol""")
def liquidity_stress(spark, d):
    """The capped execution with three tenths of the volume, three times the impact and a wider spread."""

    def kernel(c):
        held, cost = engine.simulate_capped(c["t"], c["close"], c["n"] * 0.3, c["sd"], 1000.0, 0.1, 0.001, 0.3, 0.5)
        return {"held": held, "cost": cost}

    w = fw.by()
    rows = returns(spark, d).join(hourly(spark, d).select("symbol", "idx", "n"), ["symbol", "idx"])
    sd = F.coalesce(fw.rolling(F.stddev_samp, F.col("mkt"), 20, w, 1), F.lit(0.0))
    rows = rows.select("symbol", "idx", F.col("t").cast("double").alias("t"), "close", F.col("n").cast("double").alias("n"), sd.alias("sd"))
    out = recursive.per_group(rows, ["symbol"], "idx", kernel, {"held": "double", "cost": "double"})
    return out.groupBy("symbol").agg(r(F.avg(F.abs("held"))).alias("held"), r(F.sum("cost"), 5).alias("cost"))
