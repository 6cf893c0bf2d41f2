"""The whole verification as one query. Its SQL twin is made of the twins of its parts."""

from __future__ import annotations

from ..operators import evidence, verify
from .base import BARS, SQL, WS, query, r
from .market import _SIGNAL, _signals, trades_sql
from .moments import _TERMS
from .research import _book, kept_panel
from .resampling import _draws, trials
from .robust import COST
from .stats import RETS, returns
from .trading import _cross

_RQ = f"{RETS}, rq AS (SELECT symbol, idx - 1 AS idx, ret FROM rets WHERE ret IS NOT NULL)"
_LOGS = "SELECT symbol, round(sum(ln(CASE WHEN factor > 0 THEN factor END)), 6) AS v, count(*) FILTER (factor <= 0) AS ruined, count(*) AS n FROM {t} GROUP BY symbol"
_LATE = f"WITH {BARS}, {_SIGNAL}, {', '.join(trades_sql('s', 'symbol', delay=str(k), prefix=f'd{k}') for k in verify.DELAYS)}, {', '.join(f'l{k} AS ({_LOGS.format(t=f'd{k}trades')})' for k in verify.DELAYS)}, lt AS (SELECT symbol, l1.v AS d1, l1.n, greatest(coalesce(l2.v, 0), coalesce(l3.v, 0), coalesce(l5.v, 0)) AS later FROM l1 LEFT JOIN l2 USING (symbol) LEFT JOIN l3 USING (symbol) LEFT JOIN l5 USING (symbol))"
_COST = f"WITH {BARS}, {_SIGNAL}, {trades_sql('s', 'symbol', '0', '0', prefix='a')}, {trades_sql('s', 'symbol', '0.002', '0', prefix='z')}, ca AS ({_LOGS.format(t='atrades')}), cz AS ({_LOGS.format(t='ztrades')})"
_BOOT = f"""WITH {_RQ}, {_draws('symbol', 'rq', 'symbol', 1000, 'sum(ret) AS a, sum(ret * ret) AS q')}, st AS (SELECT symbol, CASE WHEN greatest(0, q / total - (a / total) ** 2) * total / (total - 1) > 1e-30 THEN a / total / sqrt(greatest(0, q / total - (a / total) ** 2) * total / (total - 1)) ELSE 0 END * sqrt(8760::DOUBLE) AS s FROM sums WHERE n >= 60)
SELECT symbol, round(quantile_cont(s, 0.025), 4) AS lo, round(quantile_cont(s, 0.975), 4) AS hi FROM st GROUP BY symbol"""
_HALF = f"""WITH {_RQ}, hv AS (SELECT symbol, ret, ntile(2) OVER ({WS}) AS half FROM rq) SELECT symbol, round(avg(ret) FILTER (half = 1) / nullif(stddev_samp(ret) FILTER (half = 1), 0) * sqrt(8760::DOUBLE), 5) AS a, round(avg(ret) FILTER (half = 2) / nullif(stddev_samp(ret) FILTER (half = 2), 0) * sqrt(8760::DOUBLE), 5) AS z FROM hv GROUP BY symbol"""


def _part(name: str, category: str, value: str, source: str, fail: str = "false", warn: str = "false") -> str:
    return f"SELECT symbol, '{name}' AS id, '{category}' AS category, CASE WHEN ({value}) IS NULL THEN 'skip' WHEN {fail} THEN 'fail' WHEN {warn} THEN 'warn' ELSE 'pass' END AS status, ({value})::DOUBLE AS value FROM ({source})"


_CAUSAL = SQL["probe_truncation"]
_EVIDENCE = " UNION ALL ".join([
    _part("prefixes", "lookahead", "mismatches", f"SELECT * FROM ({_CAUSAL}) WHERE signal = 'causal'", "mismatches > 0"),
    _part("mirrored_future", "lookahead", "mismatches", f"SELECT * FROM ({SQL['probe_perturbation']}) WHERE signal = 'causal'", "mismatches > 0"),
    _part("two_runs", "lookahead", "differing", SQL["probe_determinism"], "differing > 0"),
    _part("stored_answer", "lookahead", "same", SQL["probe_stored_answer"].replace("AS status", "AS said"), "said = 'fail'"),
    _part("repainting", "lookahead", "repaint_rate", f"SELECT symbol, repaint_rate, status AS said FROM ({SQL['repaint_history']}) WHERE signal = 'means crossed'", "said = 'fail'"),
    f"SELECT symbol, id, category, status, value FROM ({SQL['strategy_checks']})",
    _part("needs_the_next_fill", "economics", "later", f"{_LATE} SELECT * FROM lt", "d1 > 0 AND later <= 0", "d1 <= 0"),
    _part("trades", "statistics", "n", f"{_LATE} SELECT * FROM lt", "n < 1", "n < 30"),
    _part("lives_with_costs", "economics", "v", f"{_COST} SELECT cz.*, ca.v AS free FROM ca LEFT JOIN cz USING (symbol)", "ruined > 0 OR free > 0 AND v <= 0", "v <= 0"),
    _part("probabilistic_ratio", "statistics", "psr", SQL["probabilistic_sharpe"], "psr < 0.5", "psr < 0.95"),
    _part("bootstrap_interval", "statistics", "lo", _BOOT, "hi < 0", "lo <= 0"),
    _part("second_half", "statistics", "z", _HALF, "false", "a > 0 AND z < 0.5 * a"),
    _part("deflated_ratio", "statistics", "dsr", SQL["deflated_sharpe"], "dsr < 0.5", "dsr < 0.95"),
    _part("overfitting", "statistics", "pbo", SQL["pbo_cscv"], "pbo > 0.5", "pbo > 0.2"),
    _part("better_than_cash", "statistics", "p_spa", SQL["reality_check"], "p_spa > 0.5", "p_spa > 0.1"),
])
_VERDICT = f"""WITH ck AS ({_EVIDENCE}), vd AS (SELECT symbol, count(*) AS checks, count(*) FILTER (status = 'fail') AS failed, CASE WHEN bool_or(status = 'fail' AND category IN ('integrity', 'lookahead', 'economics')) THEN 'REJECT' WHEN bool_or(status = 'fail') THEN 'NEEDS_MORE_EVIDENCE' WHEN bool_or(status = 'warn') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict,
  string_agg(id || '=' || status, ',' ORDER BY id) AS body FROM ck GROUP BY symbol) SELECT symbol, checks, failed, verdict, substr(sha256(symbol || '|' || verdict || '|' || body), 1, 16) AS certificate FROM vd"""


def _evidence(spark, d):
    bars = _signals(spark, d)
    return verify.strategy(bars, _cross, returns(spark, d), trials(spark, d))


@query("strategy_evidence", f"SELECT symbol, id, category, status, round(value, 6) + 0 AS value FROM ({_EVIDENCE})")
def strategy_evidence(spark, d):
    """Every check of a strategy: probes, repainting, prices, later fills, costs, returns and the search it came from."""
    return _evidence(spark, d).select("symbol", "id", "category", "status", r("value").alias("value"))


@query("strategy_verdicts", _VERDICT)
def strategy_verdicts(spark, d):
    """A verdict and a certificate for each symbol, from all evidence."""
    checks = _evidence(spark, d)
    one = evidence.verdicts(checks, ["symbol"]).select("symbol", "checks", "failed")
    return one.join(evidence.certificates(checks, ["symbol"]), "symbol").select("symbol", "checks", "failed", "verdict", "certificate")


def _score_part(name: str, category: str, value: str, source: str, fail: str = "false", warn: str = "false") -> str:
    return _part(name, category, value, source, fail, warn).replace("SELECT symbol,", "SELECT", 1)


_SCORE = " UNION ALL ".join([
    f"SELECT id, category, status, value FROM ({SQL['validate_alpha']})",
    _score_part("placebo", "statistics", "p", SQL["signal_placebo"], "p > 0.5", "p > 0.1"),
    _score_part("rising_buckets", "statistics", "rising", SQL["bucket_monotonicity"], "false", "rising < 0.75"),
    _score_part("short_leg", "economics", "short_share", SQL["leg_shares"], "false", "short_share > 0.8"),
    _score_part("spanned_by_factors", "statistics", "gain", SQL["factor_spanning"], "false", "gain < 0.05"),
    _score_part("residual_return", "statistics", "t", f"SELECT * FROM ({SQL['factor_exposure']}) WHERE term = 'const'", "t < 0", "t < 2"),
    _score_part("falls_with_the_market", "statistics", "round(down - up, 5)", SQL["up_down_beta"], "false", "round(down - up, 5) > 0.5"),
])


@query("score_evidence", f"SELECT id, category, status, round(value, 5) + 0 AS value FROM ({_SCORE})")
def score_evidence(spark, d):
    """Every check of a score and of the book that it makes."""
    panel = kept_panel(spark, d)
    out = verify.score(panel, "ret", "fwd", _book(panel), "r", _TERMS, 5, COST)
    return out.select("id", "category", "status", r("value", 5).alias("value"))
