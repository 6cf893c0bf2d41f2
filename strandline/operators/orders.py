"""Order matching: book walks as expressions, resting orders against bars, netting of fills, and reconciliation.

An order's life needs its symbol's bars in sequence, so orders and bars of a symbol meet in one cogrouped map.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import div

FILLS = "order_id bigint, symbol string, idx bigint, side int, qty double, price double, fee double, status string"


def book_levels(mid: Column, spread_bps: float, levels: int, size: Column, side: int) -> Column:
    """A synthetic side of a book: ``levels`` prices one spread apart, deeper levels larger."""
    step = lambda k: F.struct((mid * (1 + side * spread_bps / 1e4 * (k + 0.5))).alias("price"), (size * (k + 1)).alias("size"))
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), step)


def walk(levels: Column, need: Column, side: Column, limit: Column | None = None) -> Column:
    """struct(qty, cost, levels): what an order takes from the levels, best first; a limit leaves worse prices alone."""

    def take(a: Column, x: Column) -> Column:
        ok = F.lit(True) if limit is None else (side * x["price"] <= side * limit)
        q = F.when(ok, F.least(x["size"], need - a["qty"])).otherwise(0.0)
        return F.struct((a["qty"] + q).alias("qty"), (a["cost"] + q * x["price"]).alias("cost"), (a["levels"] + (q > 0).cast("int")).alias("levels"))

    return F.aggregate(levels, F.struct(F.lit(0.0).alias("qty"), F.lit(0.0).alias("cost"), F.lit(0).alias("levels")), take)


def walk_book(orders: DataFrame, levels: str, limit: str | None = None, fee_bps: float = 5.0) -> DataFrame:
    """``orders`` (qty, side and an array of levels) with filled, vwap, fee and n_levels."""
    w = walk(F.col(levels), F.col("qty"), F.col("side"), F.col(limit) if limit else None)
    rows = orders.withColumn("_w", w)
    return rows.select(*orders.columns, F.col("_w.qty").alias("filled"), div(F.col("_w.cost"), F.col("_w.qty")).alias("vwap"), (F.col("_w.cost") * fee_bps / 1e4).alias("fee"), F.col("_w.levels").alias("n_levels"))


def _match(order: dict, bars: dict[str, np.ndarray], fee: float, slip: float, most: float) -> list[tuple]:
    """Fills of one order: market orders at the next open, limits where the bar's range reaches them. IOC ends with its
    first bar. A bracket's exits are one-cancels-other: the stop is looked at first."""
    side, left, out = order["side"], order["qty"], []

    def fill(i: int, raw: float, q: float, s: int, status: str) -> None:
        px = raw * (1 + s * slip)
        out.append((order["order_id"], order["symbol"], int(bars["idx"][i]), s, q, px, q * px * fee, status))

    entry = None
    for i in np.flatnonzero(bars["idx"] > order["placed"]):
        if left > 0:
            limit = order["limit_px"]
            hit = limit is None or (bars["low"][i] <= limit if side > 0 else bars["high"][i] >= limit)
            if hit:
                q = min(left, most) if most > 0 else left
                left -= q
                fill(i, bars["open"][i] if limit is None else limit, q, side, "filled" if left <= 1e-15 else "partial")
            if left > 1e-15 and order["tif"] == "IOC":
                out.append((order["order_id"], order["symbol"], int(bars["idx"][i]), side, left, None, 0.0, "canceled"))
                break
            entry = i if left <= 1e-15 else None
            continue
        if entry is None or (order["stop_px"] is None and order["take_px"] is None):
            break
        stop, take = order["stop_px"], order["take_px"]
        if stop is not None and (bars["low"][i] <= stop if side > 0 else bars["high"][i] >= stop):
            fill(i, min(stop, bars["open"][i]) if side > 0 else max(stop, bars["open"][i]), order["qty"], -side, "stop")
            break
        if take is not None and (bars["high"][i] >= take if side > 0 else bars["low"][i] <= take):
            fill(i, take, order["qty"], -side, "take")
            break
    return out


def match(orders: DataFrame, bars: DataFrame, fee_bps: float = 5.0, slip_bps: float = 5.0, most_per_bar: float = 0.0) -> DataFrame:
    """The fills of ``orders`` (order_id, symbol, placed, side, qty, limit_px, stop_px, take_px, tif) on ``bars`` (symbol,
    idx, open, high, low). placed: the bar after which an order is live. limit_px null: a market order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("idx", "ascending")]))
        cols = {c: right.column(c).to_numpy(zero_copy_only=False) for c in ("idx", "open", "high", "low")}
        found = [f for o in left.sort_by("order_id").to_pylist() for f in _match(o, cols, fee_bps / 1e4, slip_bps / 1e4, most_per_bar)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        return pa.table({n.split()[0]: pa.array([f[k] for f in found], t) for k, (n, t) in enumerate(zip(FILLS.split(", "), kinds))})

    o = orders.select("order_id", "symbol", "placed", "side", "qty", "limit_px", "stop_px", "take_px", "tif")
    return o.groupBy("symbol").cogroup(bars.select("symbol", "idx", "open", "high", "low").groupBy("symbol")).applyInArrow(run, FILLS)


def net(fills: DataFrame, account: str, order: str) -> DataFrame:
    """account, symbol, qty, avg_px, realized, cash: signed fills netted at average price, in ``order``. fills: account,
    symbol, signed qty, price, fee. One account and symbol is one sequence."""
    types = {f.name: f.dataType.simpleString() for f in fills.schema}
    schema = f"{account} {types[account]}, symbol {types['symbol']}, qty double, avg_px double, realized double, cash double"

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(order, "ascending")]))
        held = avg = realized = cash = 0.0
        for q, px, fee in zip(*[group.column(c).to_pylist() for c in ("qty", "price", "fee")]):
            cash -= q * px + fee
            closed = min(abs(held), abs(q)) if held * q < 0 else 0.0
            realized += closed * (px - avg) * np.sign(held)
            new = held + q
            if held * q >= 0:
                avg = (abs(held) * avg + abs(q) * px) / abs(new) if new else 0.0
            elif abs(new) < 1e-12:
                new = avg = 0.0
            elif new * held < 0:
                avg = px
            held = new
        out = {account: group.column(account).slice(0, 1), "symbol": group.column("symbol").slice(0, 1)}
        return pa.table({**out, **{k: pa.array([float(v)]) for k, v in (("qty", held), ("avg_px", avg), ("realized", realized), ("cash", cash))}})

    return fills.select(account, "symbol", order, "qty", "price", "fee").groupBy(account, "symbol").applyInArrow(run, schema)


def mark(positions: DataFrame, marks: DataFrame, account: str) -> DataFrame:
    """account, equity: cash and positions at the marks (symbol, px)."""
    rows = positions.join(marks, "symbol", "left")
    return rows.groupBy(account).agg(F.sum(F.col("cash") + F.col("qty") * F.coalesce("px", "avg_px")).alias("equity"))


def reconcile(local: DataFrame, venue: DataFrame, key: str, qty_tol: float = 1e-9, px_tol: float = 1e-9) -> DataFrame:
    """key and problem of every order that both sides do not agree on: missing_local, missing_venue, qty or price."""
    a = local.groupBy(key).agg(F.sum("qty").alias("q1"), div(F.sum(F.col("qty") * F.col("price")), F.sum("qty")).alias("p1"))
    b = venue.groupBy(key).agg(F.sum("qty").alias("q2"), div(F.sum(F.col("qty") * F.col("price")), F.sum("qty")).alias("p2"))
    rows = a.join(b, key, "full")
    problem = F.when(F.col("q1").isNull(), "missing_local").when(F.col("q2").isNull(), "missing_venue").when(F.abs(F.col("q1") - F.col("q2")) > qty_tol, "qty").when(F.abs(F.col("p1") - F.col("p2")) > px_tol, "price")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")
