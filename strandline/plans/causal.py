"""Registered causality queries: what a plan's analysis says beside what the data show, and repainting over history."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal
from ..functions import windows as fw
from ..operators import causality, repaint
from .base import BARS, WS, full, hourly, query, r
from .resampling import h
from .trading import _cross

_DAY = "PARTITION BY symbol, bar // 24"
#: name: (what the analysis must say, SQL over the bars)
_FEATURES = {
    "mean_5": ("", full("avg", "close", 5)),
    "lagged": ("", f"lag(close, 2) OVER ({WS})"),
    "running_high": ("", f"max(high) OVER ({WS})"),
    "next_close": ("negative_shift", f"lead(close) OVER ({WS})"),
    "centred": ("centered_window", f"avg(close) OVER ({WS} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "above_mean": ("full_sample_stat", "close - avg(close) OVER (PARTITION BY symbol)"),
    "day_high": ("htf_without_shift", f"max(high) OVER ({_DAY})"),
    "rank_of_all": ("full_sample_rank", "rank() OVER (PARTITION BY symbol ORDER BY close)"),
    "left_to_come": ("reverse_count", "row_number() OVER (PARTITION BY symbol ORDER BY idx DESC)"),
}


def _features(b):
    w, own = fw.by(), W.partitionBy("symbol")
    return {
        "mean_5": fw.sma(F.col("close"), 5, w), "lagged": F.lag("close", 2).over(w), "running_high": F.max("high").over(w), "next_close": F.lead("close").over(w),
        "centred": F.avg("close").over(w.rowsBetween(-2, 2)), "above_mean": F.col("close") - F.avg("close").over(own), "day_high": F.max("high").over(W.partitionBy("symbol", F.floor(F.col("bar") / 24))),
        "rank_of_all": F.rank().over(own.orderBy("close")), "left_to_come": F.row_number().over(own.orderBy(F.desc("idx"))),
    }


def _values(part: str) -> str:
    return f"SELECT symbol, idx, bar, unnest({list(_FEATURES)}) AS feature, unnest([{', '.join(f'round(({sql})::DOUBLE, 9)' for _, sql in _FEATURES.values())}]) AS v FROM {part}"


@query("causal_evidence", f"""WITH {BARS}, sz AS (SELECT symbol, CAST(floor(count(*) * 0.6) AS BIGINT) AS upto FROM b GROUP BY symbol), pb AS (SELECT b.* FROM b JOIN sz USING (symbol) WHERE idx <= upto), va AS ({_values('b')}), vp AS ({_values('pb')}),
ru AS (SELECT unnest({list(_FEATURES)}) AS feature, unnest({[k for k, _ in _FEATURES.values()]}) AS rule) SELECT feature, rule, count(*) AS seen, count(*) FILTER (va.v IS DISTINCT FROM vp.v) AS changed FROM vp JOIN va USING (symbol, idx, feature) JOIN ru USING (feature) GROUP BY feature, rule""")
def causal_evidence(spark, d):
    """Features by name: the rule that the analysis of their plan finds broken, and on how many bars of a prefix their value is another than with the
    future at hand. What has no finding must not change."""
    b = hourly(spark, d)
    made = _features(b)
    at = b.groupBy("symbol").agg(F.floor(F.count(F.lit(1)) * 0.6).cast("long").alias("at"))
    value = lambda df: df.select("symbol", "idx", *[F.round(c.cast("double"), 9).alias(k) for k, c in made.items()])
    long = lambda df, name: value(df).select("symbol", "idx", F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias(name)) for k in made])))
    both = long(b.join(at, "symbol").where("idx <= at"), "before").join(long(b, "after"), ["symbol", "idx", "feature"])
    found = {k: ",".join(sorted({f.rule for f in causality.findings(b.withColumn(k, c), ("idx", "bar")) if f.column == k})) for k, c in made.items()}
    rule = F.coalesce(*[F.when(F.col("feature") == k, F.lit(v)) for k, v in found.items()])
    return both.withColumn("rule", rule).groupBy("feature", "rule").agg(F.count(F.lit(1)).alias("seen"), F.sum((~F.col("before").eqNullSafe(F.col("after"))).cast("long")).alias("changed"))


def _above(c):
    """A repainting signal: above the mean of all that is known."""
    return (np.round(c["close"] - c["close"].mean(), 9) > 0).astype(float)


def _points(name: str, source: str) -> str:
    """CTEs up to {name}pt: where prefixes of the positions ``source`` (symbol, idx, p) end."""
    return f"""{name}mv AS (SELECT * FROM (SELECT *, lag(p) OVER ({WS}) AS old FROM {source}) JOIN sz USING (symbol) WHERE old <> p AND idx BETWEEN lo AND n - 2), {name}mk AS (SELECT *, row_number() OVER ({WS}) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS cnt FROM {name}mv),
{name}pt AS (SELECT symbol, CAST(floor(lo + i * (n - 2 - lo) / 11) AS BIGINT) AS upto FROM sz, (SELECT unnest(range(12)) AS i) UNION SELECT symbol, idx FROM {name}mk WHERE k % greatest(1, CAST(ceil(cnt / 12) AS BIGINT)) = 0 UNION SELECT symbol, unnest([n - 3, n - 2, n - 1]) FROM nz WHERE n >= 5)"""


_REPAINT = f"""{BARS}, nz AS (SELECT symbol, count(*) AS n, avg(close) AS m, arg_max(close, idx) AS c FROM b GROUP BY symbol), sz AS (SELECT symbol, n, greatest(2, n // 10) AS lo FROM nz WHERE n - 2 > greatest(2, n // 10)),
fp AS (SELECT symbol, idx, CASE WHEN round(close - m, 9) > 0 THEN 1 ELSE 0 END AS p FROM b JOIN nz USING (symbol)), cp AS (SELECT symbol, idx, CASE WHEN {full('avg', 'close', 5)} > {full('avg', 'close', 20)} THEN 1 ELSE 0 END AS p FROM b), {_points('f', 'fp')}, {_points('c', 'cp')},
pm AS (SELECT symbol, upto, avg(close) AS m FROM fpt JOIN b USING (symbol) WHERE idx <= upto GROUP BY ALL), kn AS (SELECT symbol, idx, upto, round(close - m, 9) > 0 AS v FROM pm JOIN b USING (symbol) WHERE idx <= upto),
ch AS (SELECT symbol, idx, seen FROM (SELECT *, lag(v) OVER w AS old, lag(upto) OVER w AS seen FROM kn WINDOW w AS (PARTITION BY symbol, idx ORDER BY upto)) WHERE old <> v),
lr AS (SELECT symbol, idx, close, ln(close / nullif(lag(close) OVER ({WS}), 0)) AS rr FROM b), sd AS (SELECT symbol, CASE WHEN stddev_pop(rr) > 0 THEN stddev_pop(rr) ELSE 1e-3 END AS sd FROM lr JOIN nz USING (symbol) WHERE idx > n - 256 GROUP BY symbol),
xj AS (SELECT symbol, n, c, sd, unnest(range(greatest(3, least(50, n // 20)))) AS j FROM nz JOIN sd USING (symbol)), xc AS (SELECT symbol, c * exp(sum(sd * {normal.ppf_sql('((' + h("'1'", 'symbol', 'j') + ' + 0.5) / 4294967296)')}) OVER (PARTITION BY symbol ORDER BY j)) AS close FROM xj),
xm AS (SELECT symbol, avg(close) AS m FROM (SELECT symbol, close FROM b UNION ALL SELECT symbol, close FROM xc) GROUP BY symbol), rm AS (SELECT symbol, avg(CASE WHEN idx > nz.n - 4 THEN close * 1.001::DOUBLE ELSE close END) AS m FROM b JOIN nz USING (symbol) GROUP BY symbol),
ex AS (SELECT symbol, count(*) FILTER ((round(close - xm.m, 9) > 0) <> (p = 1)) AS e, count(*) FILTER (idx <= nz.n - 4 AND (round(close - rm.m, 9) > 0) <> (p = 1)) AS v FROM b JOIN fp USING (symbol, idx) JOIN nz USING (symbol) JOIN xm USING (symbol) JOIN rm USING (symbol) GROUP BY symbol),
fs AS (SELECT symbol, count(*) AS checkpoints, max(upto) + 1 AS compared FROM fpt JOIN nz USING (symbol) WHERE upto < n - 1 GROUP BY symbol), cs AS (SELECT symbol, count(*) AS checkpoints FROM cpt JOIN nz USING (symbol) WHERE upto < n - 1 GROUP BY symbol),
mv AS (SELECT symbol, count(DISTINCT idx) AS moved, max(seen - idx) AS depth, min(idx) AS first_bar FROM ch GROUP BY symbol)"""


@query("repaint_history", f"""WITH {_REPAINT} SELECT 'above mean' AS signal, symbol, checkpoints, coalesce(moved, 0) AS moved_bars, round(coalesce(moved, 0) / compared, 6) AS repaint_rate, coalesce(depth, 0) AS max_depth, first_bar, e AS extension_changed, v AS revision_changed,
  CASE WHEN coalesce(moved, 0) + e + v > 0 THEN 'fail' ELSE 'pass' END AS status FROM fs LEFT JOIN mv USING (symbol) JOIN ex USING (symbol) UNION ALL SELECT 'means crossed', symbol, checkpoints, 0, 0, 0, NULL, 0, 0, 'pass' FROM cs""")
def repaint_history(spark, d):
    """A signal that reads the mean of all that is known repaints; crossed trailing means do not."""
    b = hourly(spark, d)
    found = lambda fn, name: repaint.repaint_history(b, fn).select(F.lit(name).alias("signal"), "*")
    out = found(_above, "above mean").unionByName(found(_cross, "means crossed"))
    return out.withColumn("repaint_rate", r("repaint_rate"))
