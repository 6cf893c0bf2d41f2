"""Option trades: prices and gamma by the closed formula, fills against the quoted spread, stress, margin and event checks.

``trades``: symbol, date, expiry, right (C or P), strike, qty (signed), fill_price, multiplier and, where a check needs
them, bid, ask, exit_price, iv_used, iv_asof, underlying_price, ex_div_date, dividend, underlying_at_expiry, style.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal

#: (move of the underlying, factor of the volatility). Fixed values.
SCENARIOS = ((-0.20, 2.0), (0.20, 2.0))


def d1_sql(s: str, k: str, t: str, vol: str, r: float = 0.0, q: float = 0.0) -> str:
    return f"(ln({s} / {k}) + ({r!r}e0 - {q!r}e0 + {vol} * {vol} / 2e0) * {t}) / ({vol} * sqrt({t}))"


def price_sql(s: str, k: str, t: str, vol: str, call: str, d1: str, r: float = 0.0, q: float = 0.0) -> str:
    """SQL of the price; ``d1`` names a column that holds :func:`d1_sql`. Without time or volatility: the intrinsic value."""
    up, down = f"{s} * exp(-{q!r}e0 * {t})", f"{k} * exp(-{r!r}e0 * {t})"
    d2 = f"({d1} - {vol} * sqrt({t}))"
    as_call = f"({up} * {normal.cdf_sql(d1)} - {down} * {normal.cdf_sql(d2)})"
    live = f"(CASE WHEN {call} THEN {as_call} ELSE {as_call} - {up} + {down} END)"
    return f"(CASE WHEN {t} > 0 AND {vol} > 0 THEN {live} WHEN {call} THEN greatest({s} - {k}, 0e0) ELSE greatest({k} - {s}, 0e0) END)"


def gamma_sql(s: str, t: str, vol: str, d1: str, q: float = 0.0) -> str:
    return f"(CASE WHEN {t} > 0 AND {vol} > 0 THEN exp(-{q!r}e0 * {t}) * exp(-{d1} * {d1} / 2e0) / 2.5066282746310002e0 / ({s} * {vol} * sqrt({t})) ELSE 0e0 END)"


def priced(trades: DataFrame, t: str = "t", s: str = "underlying_price", vol: str = "iv_used") -> DataFrame:
    """With d1, price and gamma at ``t`` years."""
    rows = trades.withColumn("d1", F.expr(f"CASE WHEN {t} > 0 AND {vol} > 0 THEN {d1_sql(s, 'strike', t, vol)} END"))
    return rows.withColumns({"price": F.expr(price_sql(s, "strike", t, vol, "right = 'C'", "d1")), "gamma": F.expr(gamma_sql(s, t, vol, "d1"))})


def priced_arrays(s: np.ndarray, k: np.ndarray, t: np.ndarray, vol: np.ndarray, call: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Price and d1 by the formulas of :func:`price_sql` and :func:`d1_sql`, without rates."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        spread = vol * np.sqrt(t)
        d1 = (np.log(s / k) + vol * vol / 2.0 * t) / spread
        price = s * normal.cdf_array(d1) - k * normal.cdf_array(d1 - spread)
        price = np.where(call, price, price - s + k)
        if not (live := (t > 0) & (vol > 0)).all():
            price = np.where(live, price, np.maximum(np.where(call, s - k, k - s), 0.0))
    return price, d1


def gamma_arrays(s: np.ndarray, t: np.ndarray, vol: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """:func:`gamma_sql` of arrays, without rates."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where((t > 0) & (vol > 0), np.exp(-d1 * d1 / 2.0) / 2.5066282746310002 / (s * vol * np.sqrt(t)), 0.0)


def fills(trades: DataFrame) -> DataFrame:
    """With reported and touch: dollar result as filled, and with buys at the ask and sells at the bid (an exit without a
    quote pays half the entry's spread); with better (than the mid) and at_mid (within a twentieth of half the spread)."""
    size, half, mid = F.col("qty") * F.col("multiplier"), (F.col("ask") - F.col("bid")) / 2, (F.col("ask") + F.col("bid")) / 2
    long = F.col("qty") > 0
    entry = F.when(long, F.col("ask")).otherwise(F.col("bid"))
    leave = F.when(long, F.col("exit_price") - half).otherwise(F.col("exit_price") + half)
    paid = F.when(long, F.col("fill_price") - mid).otherwise(mid - F.col("fill_price"))
    return trades.withColumns(
        {"reported": size * (F.col("exit_price") - F.col("fill_price")), "touch": size * (leave - entry), "better": paid < -1e-9, "at_mid": paid <= 0.05 * F.greatest(half, F.lit(1e-12))}
    )


def fill_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, reported, touch, better, at_mid, crossed and status: fail where profit needs fills inside the spread."""
    one = fills(trades).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("reported").alias("reported"), F.sum("touch").alias("touch"), F.avg(F.col("better").cast("double")).alias("better"),
        F.avg(F.col("at_mid").cast("double")).alias("at_mid"), F.sum((F.col("ask") < F.col("bid")).cast("long")).alias("crossed"),
    )
    bad = (F.col("crossed") > 0) | ((F.col("reported") > 0) & (F.col("touch") <= 0)) | (F.col("better") > 0.2)
    return one.withColumn("status", F.when(bad, "fail").when(F.col("at_mid") > 0.5, "warn").otherwise("pass"))


def future_volatility(trades: DataFrame) -> DataFrame:
    """Trades whose volatility was observed after the decision, with days ahead."""
    return trades.where("iv_used IS NOT NULL AND iv_asof > date").withColumn("days", F.datediff("iv_asof", "date"))


def paths(trades: DataFrame) -> DataFrame:
    """symbol, date, _path: the days (now) on which a trade of that symbol and entry date may be open, with s0, the latest underlying price
    that the book's open trades of the symbol know at the time.

    What is open is told by symbol, date and expiry alone, so the days and their prices are found on a row for each of these."""
    terms = trades.groupBy("symbol", "date", "expiry").agg(F.max("trade_id").alias("_id"), F.max_by("underlying_price", "trade_id").alias("_px"))
    days = terms.select(F.col("date").alias("now")).distinct()
    terms = terms.where("expiry > date")
    ahead = lambda rows: rows.withColumn("now", F.explode(F.sequence(F.col("date"), F.date_sub("expiry", 1))))
    known = ahead(terms).join(days, "now", "left_semi").groupBy("symbol", "now").agg(F.max_by("_px", F.struct("date", "_id")).alias("s0"))
    spans = ahead(terms.groupBy("symbol", "date").agg(F.max("expiry").alias("expiry")))
    return spans.join(known, ["symbol", "now"]).groupBy("symbol", "date").agg(F.collect_list(F.struct("now", "s0")).alias("_path"))


def snapshots(trades: DataFrame) -> DataFrame:
    """The open trades at each entry date of the book, as now, with s0 of :func:`paths`. A trade meets the array of its symbol and entry date
    once and is spread over its days afterwards, so the days of a trade are never shuffled."""
    rows = trades.where("expiry > date").join(paths(trades), ["symbol", "date"])
    return rows.withColumn("_path", F.filter("_path", lambda p: p["now"] < F.col("expiry"))).select(*trades.columns, F.inline("_path"))


def stress(trades: DataFrame) -> DataFrame:
    """now, gamma (dollars for one percent) and worst: the loss of the open book in the worse of two tail scenarios.

    The underlying is the latest price that the book's trades of the symbol know at the time. A task spreads its trades over their days, prices
    them and adds up by day, so a trade is one row outside; the tasks are as many as asked for, as few bytes make much work."""
    trades = trades.where("underlying_price IS NOT NULL AND iv_used IS NOT NULL")
    ahead = paths(trades).select("symbol", "date", F.transform("_path", lambda p: F.unix_date(p["now"])).alias("_now"), F.col("_path.s0").alias("_s0"))
    rows = trades.where("expiry > date").select(
        "symbol", "date", F.unix_date("expiry").alias("_end"), (F.col("qty") * F.col("multiplier")).cast("double").alias("_size"), F.col("strike").cast("double").alias("_k"),
        F.col("iv_used").cast("double").alias("_v"), F.coalesce(F.col("right") == "C", F.lit(False)).alias("_call"),
    )
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "date")
    rows = rows.join(ahead, ["symbol", "date"]).select("_end", "_size", "_k", "_v", "_call", "_now", F.col("_s0").cast("array<double>").alias("_s0"))
    sums = [f"v{j}" for j in range(len(SCENARIOS) + 1)]
    parts = rows.mapInArrow(_stressed, f"now int, gamma double, {', '.join(f'{c} double' for c in sums)}")
    total = parts.groupBy("now").agg(F.sum("gamma").alias("gamma"), *[F.sum(c).alias(c) for c in sums])
    return total.select(F.date_from_unix_date("now").alias("now"), "gamma", F.least(F.lit(0.0), *[F.col(c) - F.col(sums[0]) for c in sums[1:]]).alias("worst"))


def _stressed(batches: Iterator[pa.RecordBatch], step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """now, gamma and the value of trades as it is and in each scenario, added up by day for a batch; null where no trade has a value."""
    cases = [(0.0, 1.0), *SCENARIOS]
    for b in batches:
        if not len(b):
            continue
        end, size, k, v = (pc.fill_null(b.column(c).cast(pa.float64()), np.nan).to_numpy() for c in ("_end", "_size", "_k", "_v"))
        call = b.column("_call").to_numpy(zero_copy_only=False)
        day, s0 = pc.list_flatten(b.column("_now")).to_numpy(), pc.fill_null(pc.list_flatten(b.column("_s0")), np.nan).to_numpy()
        own = np.repeat(np.arange(len(b)), pc.list_value_length(b.column("_now")).to_numpy())
        open_ = np.flatnonzero(day < end[own])
        if not len(open_):
            continue
        first = int(day[open_].min())
        span = int(day[open_].max()) - first + 1
        met, known = np.zeros(span, bool), np.zeros(span, np.int64)
        sums = np.zeros((1 + len(cases), span))
        for p in range(0, len(open_), step):  # what a processor's cache holds
            at = open_[p : p + step]
            i, s, now = own[at], s0[at], day[at] - first
            held, strike, vol, kind, t = size[i], k[i], v[i], call[i], (end[i] - day[at]) / 365.0
            there = ~(np.isnan(held) | np.isnan(strike))
            met[now] = True
            known += np.bincount(now, there, span).astype(np.int64)
            for j, (move, factor) in enumerate(cases):
                moved, wide = s * (1 + move), vol * factor
                price, d1 = priced_arrays(moved, strike, t, wide, kind)
                sums[1 + j] += np.bincount(now, np.where(there, held * price, 0.0), span)
                if not j:
                    sums[0] += np.bincount(now, np.where(there, held * gamma_arrays(moved, t, wide, d1) * s * s * 0.01, 0.0), span)
        days = np.flatnonzero(met)
        none = known[days] == 0
        names = ["now", "gamma", *[f"v{j}" for j in range(len(cases))]]
        yield pa.RecordBatch.from_arrays([pa.array((days + first).astype(np.int32)), *[pa.array(x[days], mask=none) for x in sums]], names)


def margin(trades: DataFrame) -> DataFrame:
    """now, margin of the short options open at each entry date: a fifth of the underlying less what it is out of the money,
    a tenth of underlying or strike at least, and the premium."""
    rows = snapshots(trades.where("underlying_price IS NOT NULL AND qty < 0"))
    call = F.col("right") == "C"
    out = F.greatest(F.lit(0.0), F.when(call, F.col("strike") - F.col("s0")).otherwise(F.col("s0") - F.col("strike")))
    floor = 0.10 * F.when(call, F.col("s0")).otherwise(F.col("strike"))
    each = (F.greatest(0.20 * F.col("s0") - out, floor) + F.col("fill_price")) * -F.col("qty") * F.col("multiplier")
    return rows.groupBy("now").agg(F.sum(each).alias("margin"))


def event_risks(trades: DataFrame) -> DataFrame:
    """One row: short trades and how many of them are calls over an ex-dividend date (and without its amount), expired
    within half a percent of the strike, or American puts deep in the money."""
    short = trades.where("qty < 0")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    over = (F.col("right") == "C") & F.col("ex_div_date").between(F.col("date"), F.col("expiry"))
    return short.agg(
        F.count(F.lit(1)).alias("short_trades"), n(over).alias("over_dividend"), n(over & F.col("dividend").isNull()).alias("amount_missing"),
        n(F.abs(F.col("underlying_at_expiry") - F.col("strike")) / F.col("strike") < 0.005).alias("pinned"),
        n((F.col("right") == "P") & (F.lower("style") == "american") & (F.col("underlying_price") < 0.8 * F.col("strike"))).alias("deep_puts"),
    )
