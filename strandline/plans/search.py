"""The registered expression search, with its SQL twin: trees write their own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import discover
from .base import BARS, WS, hourly, query, r
from .market import trades_sql
from .resampling import h

_SEARCHED = dsl.generation(11, 24, 2, ("open", "high", "low", "close", "ret", "range"))
_NULLS = 19


def _levels(trees: list[dsl.Tree], first: str, window: str) -> str:
    """CTEs lv0 .. lvN over ``first`` and, last, lv: every different subtree as a column."""
    steps, last = [], first
    for k, level in enumerate(dsl.sources(trees, window)):
        steps.append(f"lv{k} AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in level)} FROM {last})")
        last = f"lv{k}"
    return ", ".join(steps) + f", lv AS (SELECT * FROM {last})"


def _columns(trees: list[dsl.Tree]) -> dict[str, str]:
    keys = [k for level in dsl.levels(trees) for k in level]
    return {k: f"_n{n}" for n, k in enumerate(keys)}


_PAIRS = discover.candidates(_SEARCHED)
_ALL = [t for p in _PAIRS for t in p]
_NAME = _columns(_ALL)
_OWN = "symbol, market, candidate"
_MARKETS = f"""mv AS (SELECT symbol, idx - 1 AS idx, ln(close / nullif(lag(close) OVER ({WS}), 0)) AS rr, ln(high / nullif(greatest(open, close), 0)) AS u, ln(low / nullif(least(open, close), 0)) AS d, first_value(close) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM b QUALIFY idx > 0),
pm AS (SELECT symbol, rep, c, rr, u, d, row_number() OVER (PARTITION BY symbol, rep ORDER BY {h("'1'", 'rep', 'symbol', 'idx')}, idx) - 1 AS pos FROM mv, (SELECT unnest(range({_NULLS})) AS rep)), mc AS (SELECT *, c * exp(sum(rr) OVER (PARTITION BY symbol, rep ORDER BY pos)) AS close FROM pm), mo AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, rep ORDER BY pos), c) AS open FROM mc),
mk AS MATERIALIZED (SELECT symbol, 0 AS market, idx, open, high, low, close FROM b UNION ALL SELECT symbol, rep + 1, pos + 1, open, greatest(open, close) * exp(coalesce(u, 0)), least(open, close) * exp(coalesce(d, 0)), close FROM mo)"""
_RULES = " UNION ALL ".join(f"SELECT symbol, market, {k} AS candidate, idx, open, close, CASE WHEN round({_NAME[dsl.key(a)]} - {_NAME[dsl.key(b)]}, 6) > 0 THEN 1 ELSE 0 END AS t FROM lv" for k, (a, b) in enumerate(_PAIRS))


@query("expression_search", f"""WITH {BARS}, {_MARKETS}, {_levels(_ALL, 'mk', 'PARTITION BY symbol, market ORDER BY idx')}, s AS ({_RULES}), {trades_sql('s', _OWN)},
sc AS (SELECT market, candidate, count(*) AS n, avg(ln(CASE WHEN factor > 0 THEN factor END)) AS m, stddev_samp(ln(CASE WHEN factor > 0 THEN factor END)) AS sd, count(*) FILTER (factor > 0) AS k FROM trades GROUP BY market, candidate),
st AS (SELECT market, candidate, n, CASE WHEN n >= 10 AND k = n AND sd > 1e-12 THEN m / sd * sqrt(n) END AS score FROM sc), hm AS (SELECT market, max(score) AS b FROM st WHERE market > 0 GROUP BY market), hu AS (SELECT max(b) AS hurdle, count(b) AS cnt FROM hm)
SELECT candidate, n AS n_trades, round(score, 5) + 0 AS score, round(hurdle, 5) + 0 AS hurdle, round(CASE WHEN score IS NOT NULL THEN (1 + (SELECT count(*) FROM hm WHERE round(b, 9) >= round(score, 9))) / (1 + cnt) END, 6) AS p, coalesce(round(score, 9) > round(hurdle, 9), false) AS named FROM st, hu WHERE market = 0""")
def expression_search(spark, d):
    """A generation of trees on the bars and on nineteen markets of the same moves in another order: which of them beat the best that luck found."""
    rows = discover.markets(hourly(spark, d), _NULLS)
    out = discover.named(discover.scored(rows, _SEARCHED))
    return out.select("candidate", "n_trades", r("score", 5).alias("score"), r("hurdle", 5).alias("hurdle"), F.round("p", 6).alias("p"), "named")
