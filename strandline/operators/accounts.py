"""Accounts and records: short margin, journals folded to net asset value, held-out answers with noise, tables that must line up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import recursive
from ..functions.draws import hashed, uniform


def short_margin(rows: DataFrame, key: str, leverage: float, maintenance: float) -> DataFrame:
    """key, episode, entry, bars, worst_rise, least_ratio, liquidated (first idx at which the bar's high leaves no more than the maintenance
    margin; null if none), of each spell in which a short is held. rows: key, idx, close, high, funding, held (boolean: held over the bar).

    Nothing is added to the account, so its equity is a function of the entry and a running sum: no state is carried."""
    w = W.partitionBy(key).orderBy("idx")
    d = rows.withColumn("_before", F.lag("close").over(w)).withColumn("_new", (F.col("held") & ~F.coalesce(F.lag("held").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("episode", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("held AND _before IS NOT NULL")
    e = W.partitionBy(key, "episode").orderBy("idx")
    d = d.withColumns({"entry": F.first("idx").over(e), "_p0": F.first("_before").over(e)}).where("_p0 > 0")
    up, hi = F.col("close") / F.col("_p0"), F.greatest("high", "close") / F.col("_p0")
    paid = F.coalesce(F.col("funding"), F.lit(0.0)) * up
    d = d.withColumns({"_up": up, "_hi": hi, "_paid": F.sum(paid).over(e.rowsBetween(W.unboundedPreceding, 0)), "_early": F.coalesce(F.sum(paid).over(e.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
    dead = F.round(1 / leverage + F.col("_early") - (F.col("_hi") - 1), 12) <= F.round(maintenance * F.col("_hi"), 12)
    d = d.withColumn("liquidated", F.min(F.when(dead, F.col("idx"))).over(W.partitionBy(key, "episode")))
    ratio = (1 / leverage + F.col("_paid") - (F.col("_up") - 1)) / F.col("_up")
    alive = F.col("liquidated").isNull() | (F.col("idx") < F.col("liquidated"))
    return d.groupBy(key, "episode", "entry", "liquidated").agg(F.count(F.lit(1)).alias("bars"), F.max(F.col("_hi") - 1).alias("worst_rise"), F.min(F.when(alive, ratio)).alias("least_ratio"))


def net_asset_value(fills: DataFrame, book: str, symbol: str, time: str) -> DataFrame:
    """book, time, cash, value: after each time's fills (qty signed, price, fee), positions at the last price that the book has seen of each symbol."""
    day = fills.groupBy(book, symbol, time).agg(F.sum("qty").alias("_q"), F.sum(F.col("qty") * F.col("price") + F.col("fee")).alias("_out"), F.max_by("price", "seq").alias("_px"))
    w = W.partitionBy(book, symbol).orderBy(time)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    worth = F.coalesce(F.sum(F.coalesce("_q", F.lit(0.0))).over(so_far) * F.last("_px", True).over(so_far), F.lit(0.0))
    # a position's worth changes at its own fills alone: changes are added up, days without a fill of a symbol make no row of it
    day = day.withColumn("_w", worth).withColumn("_d", F.col("_w") - F.lag("_w", 1, 0.0).over(w))
    one = day.groupBy(book, time).agg(F.sum(F.coalesce("_out", F.lit(0.0))).alias("_out"), F.sum("_d").alias("_d"))
    past = W.partitionBy(book).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    return one.select(book, time, (-F.sum("_out").over(past)).alias("cash"), F.sum("_d").over(past).alias("value"))


def laplace(scale: float, *parts: Column | str | int) -> Column:
    """A Laplace draw as a hash of where it is used."""
    u = uniform(*parts) - 0.5
    return -scale * F.signum(u) * F.log1p(-2 * F.abs(u))


def held_out_answer(rows: DataFrame, key: str, train: str, hold: str, threshold: float, sigma: float, seed: int = 1) -> DataFrame:
    """key, consistent, value: the training figure where the hold-out agrees within a noisy threshold, else the hold-out's with noise."""
    apart = F.abs(F.col(train) - F.col(hold)) > threshold + laplace(2 * sigma, seed, "gap", F.col(key))
    return rows.select(key, (~apart).alias("consistent"), F.when(apart, F.col(hold) + laplace(sigma, seed, "value", F.col(key))).otherwise(F.col(train)).alias("value"))


def aligned(keys: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """``keys`` with value (0 where the table has no row) and rows, how many the table has: more than one is for the caller to reject."""
    one = table.groupBy(*on).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("rows"))
    return keys.select(*on).join(one, on, "left").select(*on, F.coalesce(value, F.lit(0)).alias(value), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def contract(rows: DataFrame, key: list[str], time: str, known: str, not_null: list[str]) -> DataFrame:
    """problem, n: what a table breaks of its contract: null values, repeated keys, rows known before they happened, time going back."""
    n = rows.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"null {c}") for c in not_null], F.sum((F.col(known) < F.col(time)).cast("long")).alias("known before it happened"))
    twice = rows.groupBy(*key, time).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    both = n.crossJoin(twice)  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("long")).alias("n")) for c in both.columns])))


def onset(rows: DataFrame, found: DataFrame, key: str, x: str, sigmas: float = 3.5, most_gap: int = 25) -> DataFrame:
    """key, at, onset: a break found at row ``at`` taken back to where the series first left its early range, over gaps of at most
    ``most_gap`` rows inside the range. rows: key, idx, x; found: key, at."""
    d = rows.join(found, key)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    size = F.greatest(F.lit(20), F.least(F.floor(n / 4), F.floor(F.col("at") / 2)))
    d = d.withColumn("_ref", size)
    early = F.when(F.col("idx") < F.col("_ref"), F.col(x))
    w = W.partitionBy(key)
    d = d.withColumns({"_m": F.avg(early).over(w), "_s": F.stddev_samp(early).over(w)})
    out = d.where((F.abs(F.col(x) - F.col("_m")) > sigmas * F.col("_s")) & (F.col("idx") >= F.col("_ref")) & (F.col("idx") < F.col("at")))
    o = w.orderBy("idx")
    out = out.withColumn("_gap", F.coalesce(F.lead("idx").over(o), F.col("at")) - F.col("idx") - 1)
    # the last gap that is too wide cuts off what lies before it
    cut = F.max(F.when(F.col("_gap") > most_gap, F.col("idx"))).over(w)
    first = out.withColumn("_cut", F.coalesce(cut, F.lit(-1))).where(F.col("idx") > F.col("_cut")).groupBy(key).agg(F.min("idx").alias("_first"))
    return found.join(first, key, "left").select(key, "at", F.coalesce("_first", "at").alias("onset"))


def variants(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, variant: a name for a series of positions, the same whatever the order of rows: a sum of hashes, so no list is gathered."""
    return rows.groupBy(*keys).agg(F.hex(F.sum(hashed(F.col("idx"), F.col(position)))).alias("variant"))


def partial_bars(ticks: DataFrame, size: int, fraction: float) -> DataFrame:
    """symbol, bar, open, high, low, close, n of the ticks in the first ``fraction`` of each bar: what a live chart shows before it closes."""
    seen = ticks.where(F.pmod(F.col("us"), F.lit(size)) < fraction * size)
    at = F.struct("us", "event_id")
    return seen.groupBy("symbol", F.floor(F.col("us") / size).cast("long").alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n")
    )


def margin_account(rows: DataFrame, key: str, leverage: float, maintenance: float, trigger: float | None = None, delay: int = 0, cost: float = 0.0) -> DataFrame:
    """key, episodes, liquidated, first_liquidation, topups, topup_total, transfer_cost, late, worst_rise, least_ratio of a short's margin account.

    rows: key, idx, close, high, funding, held (over the bar). A spell opens with 1 / leverage of its entry's worth. It is liquidated on the bar whose
    high leaves no more than the maintenance margin. With a ``trigger``, an account below it at a close orders what brings it back to 1 / leverage;
    the transfer arrives ``delay`` bars after the next, one at a time, and may come too late (``late``). Amounts are shares of the entry's worth.
    What has been ordered and what has arrived feed on the bars before, so a key's bars are one task's work."""
    first = 1 / leverage

    def account(c: dict) -> dict:
        n = len(c["idx"])
        out = {k: np.zeros(n) for k in ("entered", "liquidated", "late", "moved")} | {k: np.full(n, np.nan) for k in ("ratio", "rise")}
        spell = None  # entry price, equity put in, funding so far, (arrival, amount) on its way; an entry price alone once liquidated
        for t in range(1, n):
            if not c["held"][t]:
                spell = None
                continue
            if spell is None:
                spell = {"entry": c["close"][t - 1], "equity": first, "paid": 0.0, "coming": None}
                out["entered"][t] = 1
            up, top = c["close"][t] / spell["entry"], max(c["high"][t], c["close"][t]) / spell["entry"]
            out["rise"][t] = top - 1
            if "equity" not in spell:
                continue
            if spell["coming"] and spell["coming"][0] <= t:
                spell["equity"] += spell["coming"][1]
                spell["coming"] = None
            if round(spell["equity"] + spell["paid"] - (top - 1), 12) <= round(maintenance * top, 12):
                out["liquidated"][t], out["late"][t] = 1, float(spell["coming"] is not None)
                spell = {"entry": spell["entry"]}
                continue
            spell["paid"] += c["funding"][t] * up
            left = spell["equity"] + spell["paid"] - (up - 1)
            out["ratio"][t] = left / up
            if trigger is not None and round(left / up, 12) < trigger and spell["coming"] is None:
                spell["coming"] = (t + 1 + delay, first * up - left)
                out["moved"][t] = first * up - left
        return out

    made = {k: "double" for k in ("entered", "liquidated", "late", "moved", "ratio", "rise")}
    own = rows.select(key, "idx", "close", "high", F.coalesce("funding", F.lit(0.0)).alias("funding"), F.coalesce("held", F.lit(False)).cast("double").alias("held"))
    bars = recursive.per_group(own, [key], "idx", account, made)
    count = lambda c: F.sum(c).cast("long")
    return bars.groupBy(key).agg(
        count("entered").alias("episodes"), count("liquidated").alias("liquidated"), F.min(F.when(F.col("liquidated") > 0, F.col("idx"))).cast("long").alias("first_liquidation"),
        count((F.col("moved") != 0).cast("int")).alias("topups"), F.sum("moved").alias("topup_total"), (F.sum("moved") * cost).alias("transfer_cost"), count("late").alias("late"),
        F.max("rise").alias("worst_rise"), F.min("ratio").alias("least_ratio"),
    )
