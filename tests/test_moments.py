"""Operators on moments and repainting, against numpy on the series themselves."""

import math
from statistics import NormalDist

import numpy as np

from strandline.operators import gram, repaint


def series(seed, n=240, k=3):
    rng = np.random.default_rng(seed)
    f = rng.normal(0.01, 0.05, (n, k))
    return f, 0.004 + f @ np.array([0.5, -0.2, 0.0])[:k] + rng.normal(0, 0.03, n)


def table(spark, made):
    rows = [(key, i, *map(float, x), float(y)) for key, (f, r) in made.items() for i, (x, y) in enumerate(zip(f, r))]
    return spark.createDataFrame(rows, "key string, idx long, a double, b double, c double, r double")


def test_spanning_and_regression(spark):
    made = {k: series(i) for i, k in enumerate("xyz")}
    made["short"] = series(9, 40)
    df = table(spark, made)
    got = {r["key"]: r for r in gram.spanning(df, ["key"], "r", ["a", "b", "c"], 12).collect()}
    for key, (f, r) in made.items():
        if key == "short":
            assert got[key]["status"] == "skip" and got[key]["gain"] is None
            continue
        both = np.column_stack([f, r])
        want = []
        for x in (f, both):
            cov = np.cov(x, rowvar=False)
            cov += 1e-6 * np.diag(cov).mean() * np.eye(len(cov))
            want.append(math.sqrt(x.mean(0) @ np.linalg.solve(cov, x.mean(0)) * 12))
        assert np.allclose([got[key]["factors"], got[key]["with_target"], got[key]["gain"]], [*want, want[1] - want[0]])
    terms = {(r["key"], r["term"]): (r["coef"], r["t"]) for r in gram.regression(df, ["key"], "r", ["a", "b", "c"]).collect()}
    for key, (f, r) in made.items():
        x = np.column_stack([np.ones(len(r)), f])
        beta = np.linalg.lstsq(x, r, rcond=None)[0]
        rest = r - x @ beta
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (rest @ rest) / (len(r) - 4))
        assert np.allclose([terms[key, t] for t in ("const", "a", "b", "c")], np.column_stack([beta, beta / se]))


def test_marginal_ratio(spark):
    made = {"own": series(1), "new": series(2)}
    made["own"] = (made["own"][0], made["own"][0][:, 0] * 0.7 + 1e-4)  # the book itself, smaller
    df = table(spark, made)
    got = {r["key"]: r for r in gram.marginal_ratio(df, ["key"], "r", "a", 12, n=1000).collect()}
    for key, (f, r) in made.items():
        x = np.column_stack([f[:, 0], r])
        mu, cov = x.mean(0), np.cov(x.T)
        w = np.linalg.solve(cov + 0.01 * np.mean(np.diag(cov)) * np.eye(2), mu)
        sr = lambda y: y.mean() / y.std(ddof=1) * math.sqrt(12)
        assert np.allclose([got[key]["alone"], got[key]["book"], got[key]["combined"]], [sr(r), sr(f[:, 0]), sr(x @ w)])
        assert got[key]["gain_low"] <= got[key]["gain_high"]
        draws = np.random.default_rng(3)
        gains = []
        for _ in range(400):
            at = ((draws.integers(0, len(r), 24)[:, None] + np.arange(10)) % len(r)).ravel()
            y = x[at]
            m, c = y.mean(0), np.cov(y.T)
            v = np.linalg.solve(c + 0.01 * np.mean(np.diag(c)) * np.eye(2), m)
            gains.append(sr(y @ v) - sr(y[:, 0]))
        assert abs(np.quantile(gains, 0.05) - got[key]["gain_low"]) < 0.25 and abs(np.quantile(gains, 0.95) - got[key]["gain_high"]) < 0.35
    assert got["own"]["status"] == "warn"


def test_stressed_tail(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(0, 0.02, 300)
    m = np.stack([common * w + rng.normal(0, 0.02, 300) for w in (0.2, 0.5, 1.0, 0.0)])
    rows = [(f"s{i}", t, float(m[i, t])) for i in range(4) for t in range(300)] + [("s0", 900, 0.5), ("s1", 901, None)]  # times that not all names have
    got = gram.stressed_tail(spark.createDataFrame(rows, "name string, t long, x double"), "name", "t", "x").first()
    corr, sd = np.corrcoef(m), m.std(1, ddof=1)
    off = ~np.eye(4, dtype=bool)
    book = m.mean(0)
    tail = book <= np.quantile(book, 0.1)
    level = max(np.corrcoef(m[:, tail])[off].mean(), 0.8 * corr[off].max())
    raised = np.where(off, np.maximum(corr, level), 1.0)
    z = NormalDist().inv_cdf(0.05)
    es = lambda c: -m.mean() + math.sqrt(sd @ c @ sd) / 4 * math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / 0.05
    assert got["names"] == 4 and got["times"] == 300
    assert np.allclose([got["level"], got["normal_es"], got["stressed_es"], got["ratio"]], [level, es(corr), es(raised), es(raised) / es(corr)])
    fixed = gram.stressed_tail(spark.createDataFrame(rows, "name string, t long, x double"), "name", "t", "x", level=0.9).first()
    assert np.allclose(fixed["stressed_es"], es(np.where(off, np.maximum(corr, 0.9), 1.0)))


def test_repainting_is_dated(spark):
    """A signal that changes its mind about bar 20 once bar 30 is there, and one that never does."""
    rows = [("a", i, 10.0, 10.0, 10.0, 10.0 + i % 3) for i in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double")

    def late(c):
        out = np.zeros(len(c["close"]))
        if len(out) > 30:
            out[20:22] = 1.0
        return out

    got = repaint.repaint_history(bars, late, checks=55).first()
    assert (got["moved_bars"], got["first_bar"], got["status"]) == (2, 20, "fail") and got["max_depth"] in (8, 9, 10) and got["extension_changed"] == got["revision_changed"] == 0
    found = repaint.changes(repaint.history(bars, late, 55).where("view = 'prefix'")).collect()
    assert {(r["idx"], r["known_at"] >= 30, r["seen_at"] < 30) for r in found} == {(20, True, True), (21, True, True)}
    fine = repaint.repaint_history(bars, lambda c: (c["close"] > 11).astype(float)).first()
    assert fine["status"] == "pass" and fine["moved_bars"] == 0 and fine["first_bar"] is None
    peeks = repaint.repaint_history(bars, lambda c: np.append(np.diff(c["close"]) > 0, False).astype(float)).first()
    assert peeks["extension_changed"] <= 1 and peeks["status"] == "fail"
