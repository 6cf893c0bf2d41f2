"""Resampling that gives the same draws on any cluster: indices are hashes of (seed, replicate, position), not a generator's state.

Replicates are rows, so a thousand draws are one plan. Sums over blocks come from prefix sums and two equality joins; a
permutation is the order of hashes. ``keys`` name the series, ``idx`` its rows from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import gaussian, hashed, uniform  # noqa: F401
from ..functions.windows import div

#: Rows of a series table that are looked up by broadcast; more are shuffled.
MOST_BROADCAST = 2_000_000


def replicates(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sizes(rets: DataFrame, keys: list[str]) -> DataFrame:
    return rets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def bootstrap(rets: DataFrame, keys: list[str], n: int, seed: int = 1, block: int = 1, circular: bool = True) -> DataFrame:
    """rep, idx and the columns of ``rets`` at a drawn place: rows (block 1), circular blocks, or blocks that do not wrap."""
    of = sizes(rets, keys)
    blocks = of.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))))
    starts = F.col("n") if circular or block == 1 else F.greatest(F.lit(1), F.col("n") - block + 1)
    # a block's rows come out of a few rows a key: they are dealt out before replicates are made of them
    blocks = replicates(blocks.repartition(int(rets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_b"), n)
    blocks = blocks.withColumn("_s", hashed(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("_b")) % starts)
    slots = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block).cast("long"), F.col("n") - F.col("_b") * block) - 1)))
    slots = slots.select(*keys, (F.col("_b") * block + F.col("_o")).alias("idx"), "rep", ((F.col("_s") + F.col("_o")) % F.col("n")).alias("_at"))
    source = rets.withColumnRenamed("idx", "_at")
    # slots look small to the planner, as a row is a thousand: they must never be what is broadcast
    small = rets.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return slots.join(F.broadcast(source) if small else source.hint("merge"), [*keys, "_at"]).drop("_at")


def permuted(rets: DataFrame, keys: list[str], n: int, seed: int = 1, block: int = 1, within: list[str] | None = None) -> DataFrame:
    """rep, idx and the other columns of ``rets`` in a shuffled order: single rows, whole blocks (a short last one stays), or
    rows within the groups that ``within`` names."""
    rows = replicates(rets, n)
    own = [*keys, "rep", *(within or [])]
    if block == 1:
        order = W.partitionBy(*own)
        rows = rows.withColumns(
            {"_to": F.row_number().over(order.orderBy(hashed(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("idx")), "idx")), "_from": F.row_number().over(order.orderBy("idx"))}
        )
        slots = rows.select(*own, F.col("_from").alias("_to"), F.col("idx").alias("_idx"))
        return rows.drop("_from").join(slots, [*own, "_to"]).withColumn("idx", F.col("_idx")).drop("_to", "_idx")
    last = F.floor(F.max("idx").over(W.partitionBy(*own)) + 1).cast("long")
    rows = rows.withColumns({"_b": F.floor(F.col("idx") / block).cast("long"), "_blocks": F.floor(last / block).cast("long")})
    whole = rows.where(F.col("_b") < F.col("_blocks"))
    order = whole.select(*own, "_b").distinct()
    order = order.withColumn("_to", F.row_number().over(W.partitionBy(*own).orderBy(hashed(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("_b")), "_b")) - 1)
    moved = whole.join(order, [*own, "_b"]).withColumn("idx", F.col("_to") * block + F.col("idx") % block).drop("_to")
    return moved.unionByName(rows.where(F.col("_b") >= F.col("_blocks"))).drop("_b", "_blocks")


def block_length(n: Column) -> Column:
    return F.greatest(F.lit(2), F.round(F.pow(n, 1 / 3))).cast("long")


def block_sums(rets: DataFrame, series: list[str], shared: list[str], values: list[str], n: int, seed: int = 1, block: int | None = None) -> DataFrame:
    """series, rep, total (rows drawn) and the sums of ``values`` over circular blocks of ``block`` rows, else of about the cube root of the rows.

    Series that agree on ``shared`` (a part of ``series``) get the same starts, as comparisons between them need."""
    w = W.partitionBy(*series).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*series)
    pre = rets.select(*series, (F.col("idx") + 1).alias("at"), *[F.sum(v).over(w).alias(v) for v in values])
    zero = rets.select(*series).distinct().select(*series, F.lit(0).cast("long").alias("at"), *[F.lit(0.0).alias(v) for v in values])
    pre = pre.unionByName(zero).withColumns({f"_all_{v}": F.max_by(v, "at").over(whole) for v in values})
    of = rets.groupBy(*series).agg(F.count(F.lit(1)).alias("n")).withColumn("len", block_length(F.col("n")) if block is None else F.least(F.lit(block), F.col("n")))
    draws = of.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("len")).cast("long") - 1)))
    draws = replicates(draws, n).withColumn("s", hashed(seed, F.col("rep"), *[F.col(k) for k in shared], F.col("_b")) % F.col("n"))
    draws = draws.withColumn("_e", F.col("s") + F.col("len")).withColumns({"_wrap": F.col("_e") > F.col("n"), "e": F.when(F.col("_e") > F.col("n"), F.col("_e") - F.col("n")).otherwise(F.col("_e"))})
    a = pre.select(*series, F.col("at").alias("s"), *[F.col(v).alias(f"_a_{v}") for v in values])
    z = pre.select(*series, F.col("at").alias("e"), *[F.col(v).alias(f"_z_{v}") for v in values], *[f"_all_{v}" for v in values])
    rows = draws.join(a, [*series, "s"]).join(z, [*series, "e"])
    parts = [F.sum(F.col(f"_z_{v}") - F.col(f"_a_{v}") + F.when(F.col("_wrap"), F.col(f"_all_{v}")).otherwise(0.0)).alias(v) for v in values]
    return rows.groupBy(*series, "rep").agg(F.sum("len").alias("total"), F.first("n").alias("n"), *parts)


def shared_block_sums(rets: DataFrame, family: list[str], trial: str, x: str, n: int, seed: int = 1, width: int = 64) -> DataFrame:
    """The sums of ``x`` of :func:`block_sums` for all trials of a family, whose draws are shared: family, trial, rep, total, n and ``x``.

    Trials of one length stand beside each other in arrays of ``width``, so a family's blocks are drawn and looked up once for each array and not
    for each trial; what differs by trial is added up element by element before it is shuffled."""
    series = [*family, trial]
    w = W.partitionBy(*series).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    of = rets.groupBy(*series).agg(F.count(F.lit(1)).alias("n"))
    of = of.withColumn("_c", F.floor((F.row_number().over(W.partitionBy(*family, "n").orderBy(trial)) - 1) / width).cast("int"))  # a row a trial
    pre = rets.select(*series, (F.col("idx") + 1).alias("at"), F.sum(x).over(w).alias("_v")).join(of, series)
    pre = pre.unionByName(of.select(*series, "n", "_c", F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("_v")))
    group = [*family, "n", "_c"]
    beside = pre.groupBy(*group, "at").agg(F.array_sort(F.collect_list(F.struct(trial, "_v"))).alias("_a"))  # ``width`` trials at most
    names = beside.where("at = 0").select(*group, F.posexplode(F.transform("_a", lambda a: a[trial])).alias("_pos", trial))
    value = F.transform("_a", lambda a: a["_v"])
    side = lambda a, v: beside.select(*group, F.col("at").alias(a), value.alias(v))
    whole = beside.where(F.col("at") == F.col("n")).select(*group, value.alias("_all"))
    draws = of.select(*family, "n").distinct().withColumn("len", block_length(F.col("n")))
    draws = draws.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("len")).cast("long") - 1)))
    draws = replicates(draws, n).withColumn("s", hashed(seed, F.col("rep"), *[F.col(k) for k in family], F.col("_b")) % F.col("n"))
    end = F.col("s") + F.col("len")
    draws = draws.withColumns({"_wrap": end > F.col("n"), "e": F.when(end > F.col("n"), end - F.col("n")).otherwise(end)})
    rows = draws.join(side("s", "_p"), [*family, "n", "s"]).join(side("e", "_q"), [*group, "e"]).join(whole, group)
    each = F.transform("_q", lambda q, i: q - F.get("_p", i) + F.when(F.col("_wrap"), F.get("_all", i)).otherwise(0.0))
    sums = rows.select(*group, "rep", "len", F.posexplode(each).alias("_pos", "_x")).groupBy(*group, "rep", "_pos").agg(F.sum("len").alias("total"), F.sum("_x").alias(x))
    return sums.join(names, [*group, "_pos"]).select(*series, "rep", "total", "n", x)


def bootstrap_interval(rets: DataFrame, keys: list[str], n: int, periods: float, x: str = "ret", seed: int = 1, level: float = 0.95) -> DataFrame:
    """keys, sharpe and total return at the level's ends and the share of draws with a positive ratio; 60 rows at least."""
    rows = rets.withColumns({"_r": F.col(x), "_rr": F.col(x) * F.col(x), "_l": F.log1p(F.greatest(F.col(x), F.lit(-0.999999)))})
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 60").select(*keys)
    sums = block_sums(rows.join(enough, keys, "left_semi"), keys, keys, ["_r", "_rr", "_l"], n, seed)
    mean = F.col("_r") / F.col("total")
    var = F.greatest(F.col("_rr") / F.col("total") - mean * mean, F.lit(0.0)) * F.col("total") / (F.col("total") - 1)
    sums = sums.withColumns({"s": F.when(var > 1e-30, mean / F.sqrt(var)).otherwise(0.0) * periods**0.5, "g": F.expm1(F.col("_l") * F.col("n") / F.col("total"))})
    ends = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    out = sums.groupBy(*keys).agg(F.percentile("s", ends).alias("s"), F.percentile("g", ends).alias("g"), F.avg((F.col("s") > 0).cast("double")).alias("positive"))
    return out.select(*keys, F.col("s")[0].alias("sharpe_low"), F.col("s")[1].alias("sharpe_high"), F.col("g")[0].alias("total_low"), F.col("g")[1].alias("total_high"), "positive")


def noisy_bars(bars: DataFrame, n: int, scale: float, seed: int = 1) -> DataFrame:
    """rep and the bars with normal noise on each price; high and low are then spread to hold open and close."""
    rows = replicates(bars, n)
    for c in ("open", "high", "low", "close"):
        rows = gaussian(rows, "_z", seed, c, F.col("rep"), F.col("symbol"), F.col("idx")).withColumn(c, F.col(c) * (1 + scale * F.col("_z"))).drop("_z")
    return mended(rows)


def mended(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})


def random_walks(spark, n: int, bars: int, sd: float, seed: int = 1) -> DataFrame:
    """symbol (walk), idx, close: independent walks of normal log steps from 100."""
    rows = spark.range(n * bars).select(F.floor(F.col("id") / bars).cast("long").alias("symbol"), (F.col("id") % bars).alias("idx"))
    rows = gaussian(rows, "_z", seed, F.col("symbol"), F.col("idx"))
    path = F.sum("_z").over(W.partitionBy("symbol").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("symbol", "idx", (100 * F.exp(sd * path)).alias("close"))


def placed(rows: DataFrame, value: str, key: str, ranges: int = 200) -> DataFrame:
    """``rows`` with place and of: the exact rank by value, then key, over all rows, and their number, without one task that sorts
    them all: approximate quantiles cut the values into ranges, ranks within a range are added to the rows of the ranges before."""
    if value == key:
        raise ValueError("ties are told apart by the key")
    edges = rows.agg(F.percentile_approx(value, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000))).first()[0] or []
    cut = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    rows = rows.withColumn("_r", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(cut, lambda e: e < F.col(value)))))
    # rows of one value may fill a range: its keys are cut as well
    counts = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_m"), F.count_distinct(value).alias("_d"))
    w = W.partitionBy()  # a few rows a range
    full = counts.where(F.col("_m") > 4 * F.greatest(F.lit(1), F.ceil(F.lit(rows.count() / ranges)))).where("_d <= 1").select("_r")
    tied = rows.join(F.broadcast(full), "_r", "left_semi")
    inner = tied.groupBy("_r").agg(F.percentile_approx(key, F.array(*[F.lit(k / 64) for k in range(1, 64)]), F.lit(10_000)).alias("_keys"))
    rows = rows.join(F.broadcast(inner), "_r", "left")
    rows = rows.withColumn("_q", F.when(F.col("_keys").isNull() | F.col(key).isNull(), 0).otherwise(1 + F.size(F.filter(F.array_distinct("_keys"), lambda e: e < F.col(key))))).drop("_keys")
    counts = rows.groupBy("_r", "_q").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_m").over(w.orderBy("_r", "_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "of": F.sum("_m").over(w)}).drop("_m")
    own = F.row_number().over(W.partitionBy("_r", "_q").orderBy(value, key))
    return rows.withColumn("_own", own).join(F.broadcast(counts), ["_r", "_q"]).withColumn("place", F.col("_before") + F.col("_own")).drop("_r", "_q", "_own", "_before")


def stratified(rows: DataFrame, value: str, key: str, strata: int | Column, each: int, seed: int = 1) -> DataFrame:
    """``each`` rows of every of ``strata`` equal parts by value, those of least hash of their key. A column names the parts itself."""
    if isinstance(strata, Column):
        rows = rows.withColumn("stratum", strata)
    else:
        size, more = F.floor(F.col("of") / strata), F.col("of") % strata  # the first parts have one row more
        at, edge = F.col("place") - 1, more * (size + 1)
        part = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1))))
        rows = placed(rows, value, key).withColumn("stratum", (part + 1).cast("int")).drop("place", "of")
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("stratum").orderBy(hashed(seed, F.col(key)), key))).where(F.col("_k") <= each).drop("_k")


def relative(a: Column, b: Column) -> Column:
    return div(a, b) - 1
