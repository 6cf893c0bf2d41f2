"""Registered queries on moments (spanning, exposures, marginal ratios, stressed tails), with their SQL twins: systems are solved there by sweeping pivots."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import alpha, gram
from .base import SQL, query, r
from .research import _BOOKS, _FACTOR, _FACTORS, _STRAT, _books, _strategy, panel
from .resampling import _draws

_TERMS = ["market", *_FACTOR]


def _swept(name: str, source: str, pivots: range, key: str = "g") -> str:
    """CTEs {name}0 .. {name}n: ``source`` (key, i, j, v), a symmetric matrix for each key, swept at each pivot in turn.

    Sweeping a bordered matrix [[X'X, X'y], [y'X, y'y]] at all rows of X leaves minus the inverse, the slopes and the rest's square sum."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT {key}, i, j, v FROM {source})"]
    for n, p in enumerate(pivots):
        steps.append(
            f"{name}{n + 1} AS MATERIALIZED (SELECT a.{key}, a.i, a.j, CASE WHEN a.i = {p} AND a.j = {p} THEN -1 / d.v WHEN a.i = {p} OR a.j = {p} THEN a.v / d.v ELSE a.v - x.v * y.v / d.v END AS v FROM {name}{n} a "
            f"JOIN {name}{n} x ON x.{key} = a.{key} AND x.i = a.i AND x.j = {p} JOIN {name}{n} y ON y.{key} = a.{key} AND y.i = {p} AND y.j = a.j JOIN {name}{n} d ON d.{key} = a.{key} AND d.i = {p} AND d.j = {p})"
        )
    return ", ".join(steps)


def _long(name: str, source: str, cols: list[str], key: str) -> str:
    """CTE {name} (key, bar, i, x) of the rows of ``source`` without nulls."""
    return f"{name} AS (SELECT {key} AS g, bar, unnest(range({len(cols)})) AS i, unnest([{', '.join(f'{c}::DOUBLE' for c in cols)}]) AS x FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})"


_SPAN = f"""{_STRAT}, {_long('lg', 'st', [*_TERMS, 'r'], "'all'")}, mu AS (SELECT g, i, avg(x) AS m, count(*) AS n FROM lg GROUP BY g, i), cv AS (SELECT a.g, a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM lg a JOIN lg b ON a.g = b.g AND a.bar = b.bar GROUP BY a.g, a.i, b.i)"""


def _bordered(name: str, k: int) -> str:
    """CTE {name}: ridged covariances of the first k columns with their means as border."""
    return f"""{name}d AS (SELECT g, 1e-6 * avg(v) AS ridge FROM cv WHERE i = j AND i < {k} GROUP BY g), {name} AS (SELECT g, i, j, v + CASE WHEN i = j THEN ridge ELSE 0 END AS v FROM cv JOIN {name}d USING (g) WHERE i < {k} AND j < {k}
UNION ALL SELECT g, i, 99, m FROM mu WHERE i < {k} UNION ALL SELECT g, 99, i, m FROM mu WHERE i < {k} UNION ALL SELECT g, 99, 99, 0 FROM mu WHERE i = 0)"""


_K = len(_TERMS)


@query("factor_spanning", f"""WITH {_SPAN}, {_bordered('ba', _K)}, {_swept('sa', 'ba', range(_K))}, {_bordered('bz', _K + 1)}, {_swept('sz', 'bz', range(_K + 1))},
x AS (SELECT n, sqrt(greatest(-a.v, 0) * 12) AS f, sqrt(greatest(-z.v, 0) * 12) AS w FROM sa{_K} a JOIN sz{_K + 1} z ON a.g = z.g AND a.i = 99 AND a.j = 99 AND z.i = 99 AND z.j = 99 JOIN mu ON mu.g = a.g AND mu.i = 0)
SELECT n, CASE WHEN n >= 60 THEN round(f, 4) END AS factors, CASE WHEN n >= 60 THEN round(w, 4) END AS with_target, CASE WHEN n >= 60 THEN round(w - f, 4) + 0 END AS gain, CASE WHEN n < 60 THEN 'skip' WHEN round(w - f, 9) < 0.05 THEN 'warn' ELSE 'info' END AS status FROM x""")
def factor_spanning(spark, d):
    """What the long-short book adds to the best that the factors can do."""
    out = gram.spanning(_strategy(spark, d), [], "r", _TERMS, 12)
    return out.select("n", *[r(c, 4).alias(c) for c in ("factors", "with_target", "gain")], "status")


def _regressed(source: str, terms: list[str], y: str, key: str) -> str:
    """CTEs up to rg (g, term number k, coef, t, n): least squares with a constant of ``source`` for each key."""
    cols = ["1", *terms, y]
    k = len(terms) + 1
    long = _long("lg", source, cols, key).replace("1 IS NOT NULL AND ", "")
    return f"""{long}, xx AS (SELECT a.g, a.i, b.i AS j, sum(a.x * b.x) AS v FROM lg a JOIN lg b ON a.g = b.g AND a.bar = b.bar GROUP BY a.g, a.i, b.i), nn0 AS (SELECT g, count(*) AS n FROM lg WHERE i = 0 GROUP BY g), {_swept('sw', 'xx', range(k))},
rg AS (SELECT c.g, c.i AS k, c.v AS coef, CASE WHEN greatest(s.v, 0) / (n - {k}) * -v.v > 0 THEN c.v / sqrt(greatest(s.v, 0) / (n - {k}) * -v.v) END AS t, n FROM sw{k} c JOIN sw{k} s ON s.g = c.g AND s.i = {k} AND s.j = {k} JOIN sw{k} v ON v.g = c.g AND v.i = c.i AND v.j = c.i JOIN nn0 ON nn0.g = c.g WHERE c.j = {k} AND c.i < {k})"""


_NAMES = "[" + ", ".join(f"'{t}'" for t in ["const", *_TERMS]) + "]"
#: The twin of a query that is registered with the score checks: there its system is solved by a pseudo-inverse.
SQL["factor_exposure"] = f"WITH {_STRAT}, {_regressed('st', _TERMS, 'r', repr('all'))} SELECT {_NAMES}[k + 1] AS term, n, round(coef, 6) + 0 AS coef, round(t, 6) + 0 AS t FROM rg"


def _book_rows(spark, d):
    return _books(spark, d).join(alpha.factors(panel(spark, d)), "bar")


@query("book_exposures", f"WITH {_FACTORS}, {_BOOKS[_BOOKS.index('bk AS'):]}, br AS (SELECT book, bk.bar, r, fr.* EXCLUDE (bar) FROM bk JOIN fr USING (bar)), {_regressed('br', _TERMS, 'r', 'book')} SELECT g AS book, {_NAMES}[k + 1] AS term, n, round(coef, 6) + 0 AS coef, round(t, 4) + 0 AS t FROM rg WHERE n > {_K + 1}")
def book_exposures(spark, d):
    """Each nation's book regressed on the market and the factors: one pass over all books, a small system a book."""
    out = gram.regression(_book_rows(spark, d), ["book"], "r", _TERMS)
    return out.where("coef IS NOT NULL").select("book", "term", "n", r("coef").alias("coef"), r("t", 4).alias("t"))


def _ratios(total: str, p: str = "") -> str:
    """SQL of alone, book and combined ratios from five sums over ``total`` rows."""
    m = {k: f"({p}{k} / {total})" for k in ("r", "b", "rr", "bb", "rb")}
    cov = lambda xy, x, y: f"(({m[xy]} - {m[x]} * {m[y]}) * {total} / ({total} - 1))"
    return f"{m['r']} AS mr, {m['b']} AS mb, greatest({cov('rr', 'r', 'r')}, 0) AS vr, greatest({cov('bb', 'b', 'b')}, 0) AS vb, {cov('rb', 'r', 'b')} AS c"


_Y = "sqrt(12::DOUBLE)"
_SR = "CASE WHEN {v} > 1e-30 THEN {m} / sqrt({v}) ELSE 0 END * " + _Y
_TANGENT = f"""(SELECT *, {_SR.format(m='mr', v='vr')} AS alone, {_SR.format(m='mb', v='vb')} AS book_sr, {_SR.format(m='(wb * mb + wr * mr)', v='(wb * wb * vb + wr * wr * vr + 2 * wb * wr * c)')} AS combined FROM (SELECT *, (d * mb - c * mr) / (a * d - c * c) AS wb, (a * mr - c * mb) / (a * d - c * c) AS wr FROM (SELECT *, vb + 0.005 * (vr + vb) AS a, vr + 0.005 * (vr + vb) AS d FROM {{}})))"""


@query("marginal_ratio", f"""WITH {_BOOKS}, {_draws('book', 'bb', 'book', 1000, 'sum(bb.r) AS r, sum(a) AS b, sum(bb.r * bb.r) AS rr, sum(a * a) AS bb, sum(bb.r * a) AS rb', 'least(10, count(*))')},
ow AS (SELECT book, count(*) AS n, sum(r) AS r, sum(a) AS b, sum(r * r) AS rr, sum(a * a) AS bb, sum(r * a) AS rb FROM bb GROUP BY book), o1 AS (SELECT book, n, {_ratios('n')} FROM ow), o2 AS (SELECT * FROM {_TANGENT.format('o1')}),
d1 AS (SELECT book, {_ratios('total')} FROM sums), d2 AS (SELECT book, quantile_cont(combined - book_sr, 0.05) AS lo, quantile_cont(combined - book_sr, 0.95) AS hi FROM {_TANGENT.format('d1')} GROUP BY book)
SELECT o2.book, n, round(alone, 5) + 0 AS alone, round(book_sr, 5) + 0 AS book_sharpe, round(combined, 5) + 0 AS combined, round(combined - book_sr, 5) + 0 AS gain, round(lo, 5) + 0 AS gain_low, round(hi, 5) + 0 AS gain_high,
  CASE WHEN round(combined - book_sr, 9) <= 0.05 OR (round(lo, 9) <= 0 AND round(hi, 9) >= 0) THEN 'warn' ELSE 'pass' END AS status FROM o2 JOIN d2 ON o2.book = d2.book""")
def marginal_ratio(spark, d):
    """What each nation's book adds to the book of all, with an interval on 1,000 draws."""
    out = gram.marginal_ratio(_books(spark, d).withColumnRenamed("book", "name"), ["name"], "r", "a", 12)
    return out.select(F.col("name").alias("book"), "n", r("alone", 5).alias("alone"), r("book", 5).alias("book_sharpe"), *[r(c, 5).alias(c) for c in ("combined", "gain", "gain_low", "gain_high")], "status")


_Z = NormalDist().inv_cdf(0.05)
_TAIL = math.exp(-0.5 * _Z * _Z) / math.sqrt(2 * math.pi) / 0.05


@query("stressed_tail", f"""WITH {_BOOKS}, nm AS (SELECT count(DISTINCT book) AS k FROM bb), b0 AS (SELECT bar, avg(r) AS b FROM bb GROUP BY bar HAVING count(*) = (SELECT k FROM nm)), b1 AS (SELECT bar, b, round(b, 12) <= round(quantile_cont(b, 0.1) OVER (), 12) AS tail FROM b0), v AS (SELECT book, bb.bar, r, tail FROM bb JOIN b1 USING (bar)),
oe AS (SELECT book, stddev_samp(r) AS s, avg(r) AS m FROM v GROUP BY book), pr AS (SELECT x.book AS i, y.book AS j, coalesce(corr(x.r, y.r), 0) AS c, coalesce(corr(x.r, y.r) FILTER (x.tail), 0) AS ct, count(*) FILTER (x.tail) AS nt FROM v x JOIN v y ON x.bar = y.bar AND x.book < y.book GROUP BY ALL),
lv AS (SELECT greatest(CASE WHEN max(nt) >= 3 THEN avg(ct) ELSE avg(c) END, 0.8 * max(c)) AS level FROM pr), qf AS (SELECT level, sum(2 * a.s * z.s * c) AS q, sum(2 * a.s * z.s * greatest(c, level)) AS qs FROM pr JOIN oe a ON a.book = i JOIN oe z ON z.book = j, lv GROUP BY level),
ow AS (SELECT count(*) AS k, sum(s * s) AS v, avg(m) AS m FROM oe), e AS (SELECT k AS names, (SELECT count(*) FROM b0) AS times, level, -m + sqrt(greatest(v + q, 0)) / k * {_TAIL!r} AS ne, -m + sqrt(greatest(v + qs, 0)) / k * {_TAIL!r} AS se FROM ow, qf)
SELECT names, times, round(level, 6) AS level, round(ne, 7) AS normal_es, round(se, 7) AS stressed_es, round(CASE WHEN ne > 0 THEN se / ne END, 5) AS ratio FROM e""")
def stressed_tail(spark, d):
    """Expected shortfall of the nations' books held together, and when they fall together."""
    out = gram.stressed_tail(_books(spark, d), "book", "bar", "r")
    return out.select("names", "times", r("level").alias("level"), *[r(c, 7).alias(c) for c in ("normal_es", "stressed_es")], r("ratio", 5).alias("ratio"))
