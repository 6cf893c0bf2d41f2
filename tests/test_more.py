"""Ranges, strata, trial counts and the front door on small cases worked out by hand or by force."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandline.operators import front, joins, resample, robust
from strandline.sources import trials


def test_bucketed_intervals_by_force(spark):
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), rng.randint(-50, 400)) for i in range(200)] + [(900, "c", 5), (901, None, 5)]
    spans = [(rng.choice("ab"), s := rng.randint(-50, 400), None if k % 7 == 0 else s + rng.randint(-5, 90)) for k in range(40)]
    p, i = spark.createDataFrame(points, "id long, k string, t long"), spark.createDataFrame(spans, "k string, s long, e long")
    held = sorted((a, s, e) for a, k, t in points for q, s, e in spans if k == q and s <= t and (e is None or t <= e))
    got = sorted(((r.id, r.s, r.e) for r in joins.within(p, i, ["k"], "t", "s", "e").collect()), key=str)
    assert got == sorted(held, key=str)
    assert {r.id for r in joins.outside(p, i, ["k"], "t", "s", "e").collect()} == {x[0] for x in points} - {x[0] for x in held}
    assert joins.within(p, i.limit(0), ["k"], "t", "s", "e").count() == 0 and joins.outside(p, i.limit(0), ["k"], "t", "s", "e").count() == len(points)


@pytest.mark.parametrize("strata", [1, 4, 7])
def test_strata_are_equal_parts(spark, strata):
    rng = random.Random(strata)
    rows = [(k, float(rng.choice([1, 2, 2, 3, rng.random()]))) for k in range(103)] + [(500, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [r.k for r in resample.placed(df, "v", "k", 10).orderBy("place").collect()] == [k for k, _ in order]
    size, more = divmod(len(rows), strata)
    want, at = {}, 0
    for s in range(strata):
        n = size + (s < more)
        want |= {k: s + 1 for k, _ in order[at : at + n]}
        at += n
    got = resample.stratified(df, "v", "k", strata, 1000).collect()
    assert {r.k: r.stratum for r in got} == want
    assert resample.stratified(df, "v", "k", strata, 3).count() == 3 * strata
    assert resample.stratified(df.limit(0), "v", "k", strata, 3).count() == 0


def test_trials_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trial,state\n1,COMPLETE\n2,FAIL\n3,COMPLETE\n4,\n")
    assert {r.state: r.n for r in trials.from_csv(spark, str(tmp_path / "t.csv")).collect()} == {"COMPLETE": 2, "FAIL": 1, "unknown": 1}
    for k in range(3):
        (tmp_path / "ray").mkdir(exist_ok=True)
        (tmp_path / "ray" / f"{k}.json").write_text('{"status": "%s"}' % ("done" if k else "error"))
        (tmp_path / f"ml/0/run{k}").mkdir(parents=True)
        (tmp_path / f"ml/0/run{k}/meta.yaml").write_text("name: x\nlifecycle_stage: %s\n" % ("active" if k else "deleted"))
    assert {r.state: r.n for r in trials.from_json(spark, str(tmp_path / "ray")).collect()} == {"done": 2, "error": 1}
    assert {r.state: r.n for r in trials.from_run_folders(spark, str(tmp_path / "ml")).collect()} == {"active": 2, "deleted": 1}
    con = sqlite3.connect(tmp_path / "o.db")
    con.execute("CREATE TABLE trials (state TEXT, study_id INTEGER)")
    con.executemany("INSERT INTO trials VALUES (?, ?)", [("COMPLETE", 1), ("COMPLETE", 1), ("PRUNED", 2)])
    con.commit()
    con.close()
    assert {r.state: r.n for r in trials.from_sqlite(spark, str(tmp_path / "o.db"), "optuna").collect()} == {"COMPLETE": 2, "PRUNED": 1}
    assert {r.state: r.n for r in trials.from_sqlite(spark, str(tmp_path / "o.db"), "optuna", 2).collect()} == {"PRUNED": 1}


def test_legs_pay_for_what_they_trade(spark):
    """Four names, two buckets: the weights of a bar earn on the next one and every change costs."""
    score = {1: [1, 2, 3, 4], 2: [4, 3, 2, 1], 3: [4, 3, 2, 1]}
    ret = {1: [0, 0, 0, 0], 2: [0.1, 0.0, 0.2, 0.3], 3: [0.4, 0.1, 0.0, 0.0]}
    rows = [(s, b, float(score[b][s]), float(ret[b][s])) for b in score for s in range(4)]
    got = {r.bar: r.net for r in robust.net_spread(spark.createDataFrame(rows, "symbol long, bar long, score double, ret double"), "score", 2, 0.01).collect()}
    assert got[1] == pytest.approx(-0.02) and got[2] == pytest.approx(0.25 - 0.05 - 0.04) and got[3] == pytest.approx(0.25 - 0.0)


def test_mirror_keeps_the_past_and_turns_the_future(spark):
    rows = [("a", k, c, c + 1, c - 1, c) for k, c in enumerate([10.0, 20.0, 40.0])]
    got = front.mirrored(spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double"), 1).orderBy("idx").collect()
    assert [r.close for r in got] == [10.0, 20.0, 10.0] and got[2].high == pytest.approx(400 / 39) and got[2].low == pytest.approx(400 / 41)


def test_names_end_and_get_a_last_price(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, 7.0), ("b", 1, 10.0)], "k string, t long, p double")
    assert [tuple(r) for r in front.ended(rows, "k", "t").collect()] == [("b", 1, 1, 2)]
    assert sorted(tuple(r) for r in front.terminal(rows, "k", "t", "p", -0.5).where("k = 'b'").collect()) == [("b", 1, 10.0), ("b", 2, 5.0)]


def test_track_record_by_hand(spark):
    one = spark.createDataFrame([(100, 0.1, 0.0, 3.0), (100, -0.1, 0.0, 3.0)], "n long, sharpe double, skew double, kurt double")
    got = [r.needed for r in front.track_record(one).collect()]
    assert got == [-(-(1 + 1.005 * (1.6448536269514722 / 0.1) ** 2) // 1), None]
    assert one.select(front.least_years(F.lit(1.0), F.lit(10))).first()[0] == pytest.approx(4.605170186)
