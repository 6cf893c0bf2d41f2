"""How far a result leans on its sample: subsets of names, groups, start dates, disjoint periods, shifted regimes, redrawn latencies, injected shocks.

Replicates are a column, so every check is one plan; draws are hashes (:mod:`strandline.functions.draws`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import xsection as fx
from ..functions.draws import gaussian, hashed, hashes, uniform
from ..functions.windows import div
from . import resample


def net_spread(panel: DataFrame, score: str, q: int, cost: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bar, net: the return of the weights of the row before less ``cost`` times what is traded. panel: symbol, bar, score, ret."""
    w = W.partitionBy(*by, "symbol").orderBy("bar")
    rows = fx.legs(panel, score, q, (*by, "bar")).withColumn("_before", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    net = F.sum(F.col("_before") * F.col("ret")) - cost * F.sum(F.abs(F.col("weight") - F.col("_before")))
    return rows.groupBy(*by, "bar").agg(net.alias("net"))


def ratio(x: str, periods: float) -> Column:
    """Annual Sharpe ratio inside groupBy; 0 without variation."""
    return F.coalesce(div(F.avg(x), F.stddev_samp(x)), F.lit(0.0)) * periods**0.5


def subsets(panel: DataFrame, share: float, n: int, seed: int = 1) -> DataFrame:
    """``panel`` once for each rep, with that share of the symbols: those of least hash."""
    names = resample.replicates(panel.select("symbol").distinct(), n)
    w = W.partitionBy("rep")
    names = names.withColumns({"_k": F.row_number().over(w.orderBy(hashed(seed, F.col("rep"), F.col("symbol")), "symbol")), "_n": F.count(F.lit(1)).over(w)})
    kept = names.where(F.col("_k") <= F.round(share * F.col("_n"))).select("rep", "symbol")
    return panel.join(kept, "symbol")


#: Subsets whose marks share a number.
WORD = 62


def subset_spreads(panel: DataFrame, score: str, q: int, cost: float, share: float, n: int, seed: int = 1) -> DataFrame:
    """rep, bar, net: :func:`net_spread` of each of the :func:`subsets`, without a row for a subset and a row of the panel.

    A name carries its subsets as bits. A date's rows are ranked within all of its subsets in one task, which leaves two limits of the score a
    subset; a second pass meets each row with the limits of its date and of its name's date before, and only sums by subset and date are left."""
    if q < 2:
        raise ValueError("two buckets at least")
    words = range(-(-n // WORD))
    bit = lambda k: F.bit_or(F.when(F.floor(F.col("rep") / WORD) == k, F.expr(f"shiftleft(1L, rep % {WORD})")).otherwise(F.lit(0).cast("long")))
    marks = subsets(panel.select("symbol").distinct(), share, n, seed).groupBy("symbol").agg(*[bit(k).alias(f"_w{k}") for k in words])
    w = W.partitionBy("symbol").orderBy("bar")
    rows = panel.where(F.col(score).isNotNull()).select("symbol", "bar", F.col(score).cast("double").alias("_s"), F.col("ret").cast("double").alias("_ret"))
    rows = rows.join(marks, "symbol").withColumns({"_ps": F.lag("_s").over(w), "_pbar": F.coalesce(F.lag("bar").over(w), F.col("bar"))})
    kind = panel.schema["bar"].dataType.simpleString()
    ends = ("lo", "hi", "wlo", "whi")

    def chosen(group: pa.Table) -> list[np.ndarray]:
        bits = [group.column(f"_w{k}").to_numpy() for k in words]
        return [(bits[rep // WORD] >> (rep % WORD)) & 1 == 1 for rep in range(n)]

    def cut(group: pa.Table) -> pa.Table:
        values, code = np.unique(group.column("_s").to_numpy(), return_inverse=True)
        found = {e: np.full(n, np.nan) for e in ends}
        for rep, mine in enumerate(chosen(group)):
            count = np.bincount(code[mine], minlength=len(values))
            of = int(count.sum())
            if not of:
                continue
            rank = np.cumsum(count) - count + 1 + (count - 1) / 2
            bucket = np.minimum(q - 1, np.floor((rank - 1) / of * q))
            for e, weigh, held in (("lo", "wlo", (bucket == 0) & (count > 0)), ("hi", "whi", (bucket == q - 1) & (count > 0))):
                if held.any():
                    at = np.flatnonzero(held)
                    found[e][rep], found[weigh][rep] = at[-1] if e == "lo" else at[0], 1 / count[held].sum()
        for e in ("lo", "hi"):  # as values of the score; none: a weight of NaN
            there = ~np.isnan(found[e])
            found[e][there] = values[found[e][there].astype(int)]
        return pa.table({"bar": group.column("bar").slice(0, 1), **{f"_{e}": pa.array([found[e]], pa.list_(pa.float64())) for e in ends}})

    def weights(s: np.ndarray, limits: dict[str, np.ndarray], rep: int) -> np.ndarray:
        out = np.zeros(len(s))
        for held, side, size in (((s <= limits["lo"][rep]) | np.isnan(limits["lo"][rep]), -1, limits["wlo"][rep]), ((s >= limits["hi"][rep]) | np.isnan(s), 1, limits["whi"][rep])):
            if size == size:  # NaN is the greatest score
                out[held] = side * size
        return out

    def spread(group: pa.Table, limits: pa.Table) -> pa.Table:
        now, before = ({e: np.asarray(limits.column(f"{p}{e}")[0].values) for e in ends} for p in ("_", "_p"))
        s, r = group.column("_s").to_numpy(), group.column("_ret")
        first, known = np.asarray(group.column("_ps").is_null()), np.asarray(r.is_valid())
        ps, r = np.where(first, 0.0, group.column("_ps").fill_null(0.0).to_numpy()), np.where(known, r.fill_null(0.0).to_numpy(), 0.0)
        made = []
        for rep, mine in enumerate(chosen(group)):
            if mine.any():
                old = np.where(first, 0.0, weights(ps, before, rep))
                made.append((rep, float((old * r)[mine].sum()) if known[mine].any() else None, float(np.abs(weights(s, now, rep) - old)[mine].sum())))
        reps, gains, traded = zip(*made) if made else ((), (), ())
        bar = group.column("bar")
        return pa.table({"rep": pa.array(reps, pa.int32()), "bar": pa.array([bar[0].as_py()] * len(reps), bar.type), "_gain": pa.array(gains, pa.float64()), "_traded": pa.array(traded, pa.float64())})

    marked = [f"_w{k}" for k in words]
    limits = rows.select("bar", "_s", *marked).groupBy("bar").applyInArrow(cut, f"bar {kind}, " + ", ".join(f"_{e} array<double>" for e in ends))
    both = rows.select("bar", "_pbar").distinct().join(limits, "bar").join(limits.select(F.col("bar").alias("_pbar"), *[F.col(f"_{e}").alias(f"_p{e}") for e in ends]), "_pbar")
    own = rows.select("bar", "_pbar", "_s", "_ps", "_ret", *marked).groupBy("bar", "_pbar")
    both = both.select(F.col("bar").alias("_at"), F.col("_pbar").alias("_pat"), *[f"{p}{e}" for p in ("_", "_p") for e in ends])
    sums = own.cogroup(both.groupBy("_at", "_pat")).applyInArrow(spread, f"rep int, bar {kind}, _gain double, _traded double")
    return sums.groupBy("rep", "bar").agg((F.sum("_gain") - cost * F.sum("_traded")).alias("net"))


def starts(net: DataFrame, steps: int, of: int, least: int) -> DataFrame:
    """start, bars, mean of series (bar, net) that begin 0 to ``steps - 1`` times a ``of``-th of the history later."""
    w = W.partitionBy()  # one series of dates: a row a bar, after the panel is added up
    rows = net.withColumns({"_i": F.row_number().over(w.orderBy("bar")) - 1, "_n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / of)))
    rows = rows.where((F.col("_i") >= F.col("start") * F.col("_step")) & (F.col("_n") - F.col("start") * F.col("_step") >= least))
    return rows.groupBy("start").agg(F.count(F.lit(1)).alias("bars"), F.avg("net").alias("mean"))


def purged_paths(net: DataFrame, groups: int, purge: int, periods: float) -> DataFrame:
    """a, b, bars, sharpe of every choice of two of ``groups`` equal periods, ``purge`` bars taken off both ends of each."""
    w = W.partitionBy()
    rows = net.withColumns({"_i": F.row_number().over(w.orderBy("bar")) - 1, "_n": F.count(F.lit(1)).over(w)})
    size, more = F.floor(F.col("_n") / groups), F.col("_n") % groups
    edge = more * (size + 1)  # the first periods have one bar more
    early = F.col("_i") < edge
    rows = rows.withColumn("_g", F.when(early, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - edge) / size)).cast("int"))
    rows = rows.withColumn("_at", F.when(early, F.col("_i") - F.col("_g") * (size + 1)).otherwise(F.col("_i") - edge - (F.col("_g") - more) * size))
    rows = rows.where((F.col("_at") >= purge) & (F.col("_at") < F.when(early, size + 1).otherwise(size) - purge))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(groups) for b in range(a + 1, groups)])
    rows = rows.withColumn("_p", F.explode(pairs)).where((F.col("_g") == F.col("_p.a")) | (F.col("_g") == F.col("_p.b")))
    return rows.groupBy("_p.a", "_p.b").agg(F.count(F.lit(1)).alias("bars"), ratio("net", periods).alias("sharpe"))


def selection_timing(rows: DataFrame, weight: str, ret: str) -> DataFrame:
    """bar, timing, selection, total: the net exposure times the mean return, and what choosing names adds to it."""
    valid = rows.where(F.col(ret).isNotNull()).groupBy("bar").agg(F.sum(weight).alias("_w"), F.avg(ret).alias("_r"), F.sum(F.col(weight) * F.col(ret)).alias("total"))
    return valid.select("bar", (F.col("_w") * F.col("_r")).alias("timing"), (F.col("total") - F.col("_w") * F.col("_r")).alias("selection"), "total")


def regime_swap(rets: DataFrame, keys: list[str], label: str, n: int, x: str = "ret", seed: int = 1) -> DataFrame:
    """keys, gap, p: the difference of mean returns inside and outside a regime against ``n`` circular shifts of its labels by a tenth of
    the rows at least. rets: keys, idx from 0 without holes, x and a boolean label."""
    whole = W.partitionBy(*keys)
    rows = rets.withColumn("_n", F.count(F.lit(1)).over(whole))
    draws = resample.replicates(rows.select(*keys, "_n").distinct(), n)
    low = F.greatest(F.lit(10), F.floor(F.col("_n") / 10))
    draws = draws.withColumn("_k", low + F.pmod(hashed(seed, F.col("rep"), *[F.col(k) for k in keys]), F.col("_n") - 2 * low)).drop("_n")
    shifted = rows.join(draws, keys).select(*keys, "rep", x, F.pmod(F.col("idx") - F.col("_k"), F.col("_n")).alias("_at"))
    labels = rets.select(*keys, F.col("idx").alias("_at"), F.col(label).alias("_l"))
    side = lambda c, on: F.avg(F.when(on, F.col(c)))
    null = shifted.join(labels, [*keys, "_at"]).groupBy(*keys, "rep").agg((side(x, F.col("_l")) - side(x, ~F.col("_l"))).alias("_null"))
    seen = rets.groupBy(*keys).agg((side(x, F.col(label)) - side(x, ~F.col(label))).alias("gap"))
    hit = F.round(F.abs("_null"), 12) >= F.round(F.abs("gap"), 12)
    return null.join(seen, keys).groupBy(*keys, "gap").agg(((1 + F.sum(hit.cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))


def reversed_bars(bars: DataFrame) -> DataFrame:
    """The history backwards as valid bars: order reversed, open and close swapped, clock mirrored."""
    w = W.partitionBy("symbol")
    rows = bars.withColumns({"_last": F.max("idx").over(w), "_a": F.min("bar").over(w), "_z": F.max("bar").over(w)})
    return rows.select("symbol", (F.col("_last") - F.col("idx")).alias("idx"), (F.col("_a") + F.col("_z") - F.col("bar")).alias("bar"), F.col("close").alias("open"), "high", "low", F.col("open").alias("close"))


def slipped(bars: DataFrame, n: int, bps: float, seed: int = 1) -> DataFrame:
    """rep and the bars, all prices of a bar moved by one uniform slippage of at most ``bps``."""
    rows = resample.replicates(bars, n).withColumn("_f", 1 + (2 * uniform(seed, F.col("rep"), F.col("symbol"), F.col("idx")) - 1) * bps / 1e4)
    return rows.withColumns({c: F.col(c) * F.col("_f") for c in ("open", "high", "low", "close")}).drop("_f")


def gapped(bars: DataFrame, n: int, chance: float, most: float, seed: int = 1) -> DataFrame:
    """rep and the bars with random gaps that stay: all later prices carry them."""
    rows = resample.replicates(bars, n)
    at = (F.col("rep"), F.col("symbol"), F.col("idx"))
    jump = F.when(uniform(seed, "gap", *at) < chance, (2 * uniform(seed, "size", *at) - 1) * most).otherwise(0.0)
    w = W.partitionBy("rep", "symbol").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_j", F.log1p(jump)).withColumn("_f", F.exp(F.sum("_j").over(w)))
    return rows.withColumns({c: F.col(c) * F.col("_f") for c in ("open", "high", "low", "close")}).drop("_j", "_f")


def noisy_volume(rows: DataFrame, n: int, level: float, volume: str = "volume", seed: int = 1) -> DataFrame:
    out = gaussian(resample.replicates(rows, n), "_z", seed, F.col("rep"), F.col("symbol"), F.col("idx"))
    return out.withColumn(volume, F.greatest(F.lit(0.0), F.col(volume) * F.exp(level * F.col("_z")))).drop("_z")


def late(rows: DataFrame, n: int, most: int, columns: list[str], seed: int = 1) -> DataFrame:
    """rep and the rows, ``columns`` as they were 0 to ``most`` bars before; one lag for each rep and symbol."""
    out = resample.replicates(rows, n).withColumn("lag", (hashed(seed, F.col("rep"), F.col("symbol")) % (most + 1)).cast("int"))
    w = W.partitionBy("rep", "symbol").orderBy("idx")
    pick = lambda c: F.coalesce(*[F.when(F.col("lag") == k, F.lag(c, k).over(w) if k else F.col(c)) for k in range(most + 1)])
    return out.withColumns({c: pick(c) for c in columns})


def widened(bars: DataFrame, n: int, bps: float, more: float, window: int = 20, seed: int = 1) -> DataFrame:
    """rep and the bars, close moved by half a spread up or down; the spread grows with trailing volatility, 1 to 10 times its base."""
    w = W.partitionBy("symbol").orderBy("idx")
    rows = bars.withColumn("_r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    rows = rows.withColumn("_v", F.stddev_samp("_r").over(w.rowsBetween(1 - window, 0))).withColumn("_v", F.col("_v") / F.avg("_v").over(W.partitionBy("symbol")))
    spread = F.greatest(F.lit(bps), F.least(F.lit(10 * bps), bps * (1 + (F.coalesce("_v", F.lit(1.0)) - 1) * more))) / 1e4
    rows = resample.replicates(rows, n)
    side = F.when(hashed(seed, F.col("rep"), F.col("symbol"), F.col("idx")) % 2 == 0, 1).otherwise(-1)
    rows = rows.withColumn("close", F.col("close") * (1 + spread * side * 0.5)).drop("_r", "_v")
    return resample.mended(rows)


def shocked(rets: DataFrame, keys: list[str], n: int, events: int, sigmas: float, x: str = "ret", seed: int = 1) -> DataFrame:
    """rep and the returns with ``events`` rows a key, those of least hash, replaced by shocks of so many deviations, up or down."""
    rows = resample.replicates(rets.withColumn("_sd", F.stddev_samp(x).over(W.partitionBy(*keys))), n)
    draw = hashed(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("idx"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "rep").orderBy(draw, "idx")))
    side = F.when(hashed(seed, "side", F.col("rep"), *[F.col(k) for k in keys], F.col("idx")) % 2 == 0, 1).otherwise(-1)
    return rows.withColumn(x, F.when(F.col("_k") <= events, side * sigmas * F.col("_sd")).otherwise(F.col(x))).drop("_sd", "_k")


def summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, n, mean, sd, low, high, p5, p95: one row for each metric."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])))
    ends = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    out = long.where("x IS NOT NULL").groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), ends.alias("_e"))
    return out.select(*keys, "metric", "n", "mean", "sd", "low", "high", F.col("_e")[0].alias("p5"), F.col("_e")[1].alias("p95"))


def arrival_returns(ticks: DataFrame, latency: Column, bars: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """keys, total: what the sign of the last change earns when bars are built from the ticks that had arrived, against the market's own bars.

    ticks: keys (with symbol), us, event_id, price. bars: symbol, bar, mkt (the market's return into the bar)."""
    at = F.col("us") + latency
    seen = ticks.groupBy(*keys, F.floor(at / size).cast("long").alias("bar")).agg(F.max_by("price", F.struct(at.alias("at"), "event_id")).alias("seen"))
    return seen_returns(seen, ticks.select(*keys).distinct(), bars, keys)


def seen_returns(seen: DataFrame, series: DataFrame, bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, total of :func:`arrival_returns` from the price last seen in each bar. seen: keys, bar, seen; series: the keys that there are."""
    w = W.partitionBy(*keys).orderBy("bar")
    info = seen.withColumn("_s", F.signum(F.col("seen") - F.lag("seen").over(w))).select(*keys, "bar", "_s")
    grid = bars.select("symbol", "bar", "mkt")
    if [k for k in keys if k != "symbol"]:
        grid = grid.join(series, "symbol")
    known = F.last("_s", True).over(w.rowsBetween(W.unboundedPreceding, -1))  # bars without a tick keep the last signal
    rows = grid.join(info, [*keys, "bar"], "left").withColumn("_p", F.coalesce(known, F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("mkt")).alias("total"))


#: Stretches that a symbol's ticks are cut into where latencies are drawn anew.
STRETCHES = 32


def redrawn_returns(ticks: DataFrame, n: int, scale: int, bars: DataFrame, size: int, seed: int = 1, stretches: int = STRETCHES) -> DataFrame:
    """rep, symbol, total: :func:`arrival_returns` of the :func:`redrawn` ticks, whose latencies of type long count ``scale`` microseconds, without a
    row for a draw.

    A symbol's ticks are cut into stretches. A task has the ticks of one and the latencies of all, packed; it makes the stretch's draws and
    leaves the last tick of each bar alone. So what is shuffled is a number for each tick and stretch, whatever the number of draws."""
    rows = ticks.where(F.col("symbol").isNotNull()).withColumns({"_i": F.row_number().over(W.partitionBy("symbol").orderBy("us", "event_id")) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy("symbol"))})
    rows = rows.select("symbol", "us", "event_id", "price", "latency_ms", F.col("_i").cast("long").alias("_i"), F.floor(F.col("_i") * stretches / F.col("_n")).cast("int").alias("_part"))
    price = ticks.schema["price"].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        at, late = group.column("_i").to_numpy(), group.column("latency_ms").to_numpy()
        late = late[np.argsort(at)]
        kind = next(k for k in map(np.dtype, ("i1", "i2", "i4", "i8")) if np.iinfo(k).min <= late.min() and late.max() <= np.iinfo(k).max)
        return pa.table({"symbol": group.column("symbol").slice(0, 1), "_at": pa.array([int(at.min())]), "_kind": pa.array([kind.str]), "_late": pa.array([late.astype(kind).tobytes()], pa.binary())})

    packed = rows.select("symbol", "_part", "_i", "latency_ms").groupBy("symbol", "_part").applyInArrow(pack, "symbol string, _at long, _kind string, _late binary")
    packed = packed.select(F.col("symbol").alias("_whose"), "_at", "_kind", "_late", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))).alias("_to"))

    def deal(group: pa.Table, late: pa.Table) -> pa.Table:
        if not len(group):  # more stretches than ticks
            return pa.table({"rep": pa.array([], pa.int32()), "symbol": pa.array([], pa.string()), "bar": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "event_id": pa.array([], group.schema.field("event_id").type), "price": pa.array([], group.schema.field("price").type)})
        pieces = sorted(zip(late.column("_at").to_pylist(), late.column("_kind").to_pylist(), late.column("_late")))
        whole = np.concatenate([np.frombuffer(b.as_buffer(), k) for _, k, b in pieces])
        us, ids = group.column("us").to_numpy(), group.column("event_id").to_numpy()
        name, texts = group.column("symbol")[0].as_py(), [str(i).encode() for i in group.column("_i").to_pylist()]
        found = []
        for rep in range(n):
            at = us + scale * whole[hashes(texts, seed, rep, name) % len(whole)].astype(np.int64)
            order = np.lexsort((ids, at))
            bar = at[order] // size
            last = order[np.append(bar[1:] != bar[:-1], True)]
            chosen = group.take(pa.array(last))
            found.append(pa.table({"rep": pa.array(np.full(len(last), rep), pa.int32()), "symbol": chosen.column("symbol"), "bar": pa.array(at[last] // size), "at": pa.array(at[last]), "event_id": chosen.column("event_id"), "price": chosen.column("price")}))
        return pa.concat_tables(found)

    own = rows.where(F.col("us").isNotNull()).select("symbol", "_part", "us", "event_id", "price", "_i").groupBy("symbol", "_part")
    last = own.cogroup(packed.groupBy("_whose", "_to")).applyInArrow(deal, f"rep int, symbol string, bar long, at long, event_id {ticks.schema['event_id'].dataType.simpleString()}, price {price}")
    seen = last.groupBy("rep", "symbol", "bar").agg(F.max_by("price", F.struct("at", "event_id")).alias("seen"))
    return seen_returns(seen, resample.replicates(ticks.select("symbol").distinct(), n), bars, ("rep", "symbol"))


def redrawn(ticks: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """rep and the ticks, each with the latency of a tick of its symbol that a hash draws."""
    rows = ticks.withColumns({"_i": F.row_number().over(W.partitionBy("symbol").orderBy("us", "event_id")) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy("symbol"))})
    drawn = resample.replicates(rows, n).withColumn("_j", F.pmod(hashed(seed, F.col("rep"), F.col("symbol"), F.col("_i")), F.col("_n")))
    given = rows.select("symbol", F.col("_i").alias("_j"), F.col("latency_ms").alias("latency"))
    return drawn.drop("_i", "_n", "latency_ms").join(given, ["symbol", "_j"]).drop("_j").withColumnRenamed("latency", "latency_ms")
