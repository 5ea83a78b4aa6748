"""Operators that SQL can't express, against replays; joins, state changes and edge cases on small frames."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import joins as J
from touchline.operators import metrics as M
from touchline.operators import models as L
from touchline.operators import score_matrix as S
from touchline.operators import selection as C
from touchline.operators import upsert as U
from touchline.operators import windows as W

D = dt.date


def test_exposure_fold_equals_replay(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), D(2024, 1, 1 + int(rng.integers(0, 9))), "L%d" % rng.integers(0, 3), float(rng.uniform(0, 0.012))) for i in range(400)]
    got = {r.bet_id: r.accepted for r in C.exposure_fold(spark.createDataFrame(rows, "bet_id long, day date, comp string, stake_pct double"), "day", "comp", ["bet_id"], "stake_pct").collect()}
    day, league = defaultdict(float), defaultdict(float)
    for b, d, c, s in sorted(rows):
        ok = day[d] + s <= 0.05 + 1e-12 and league[d, c] + s <= 0.03 + 1e-12
        if ok:
            day[d] += s
            league[d, c] += s
        assert got[b] == ok


def test_missing_stats_skip_or_poison(spark):
    rows = [(1, D(2024, 1, i + 1), "c", 2024, v) for i, v in enumerate([10, None, 4, 6])]
    df = spark.createDataFrame([(m, d, c, s, v, 1) for m, (_, d, c, s, v) in enumerate(rows)], "match_id int, match_date date, comp string, season int, v int, team int")
    got = df.select("match_id", W.mean_last(F.col("v"), 2, True).alias("skip"), W.mean_last(F.col("v"), 2, False).alias("strict")).orderBy("match_id").collect()
    assert [r.skip for r in got] == [None, 10.0, 10.0, 4.0]
    assert [r.strict for r in got] == [None, 10.0, None, None]


def test_imputation_uses_earlier_days_only(spark):
    rows = [(D(2024, 1, 1), 4.0), (D(2024, 1, 2), None), (D(2024, 1, 3), 6.0), (D(2024, 1, 4), None), (D(2024, 1, 4), 50.0)]
    got = W.imputed_by_earlier_days(spark.createDataFrame(rows, "day date, v double"), "day", "v").orderBy("day", "v").collect()
    assert [r.imputed for r in got] == [4.0, 4.0, 6.0, 5.0, 50.0]


def test_exact_bin_edges(spark):
    df = spark.createDataFrame([(0.3, 2), (0.6, 5), (0.7, 6), (0.0, 0), (1.0, 9), (0.1, 1)], "p double, b int")
    assert df.where(M.bin_of(F.col("p")) != F.col("b")).count() == 0
    assert M.reliability(df.where("p < 0"), "p", "b").where("n = 0").count() == 10


def test_as_of_is_inclusive_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 10, "c"), (1, 1, "d")], "k int, t int, id string")
    right = spark.createDataFrame([(1, 5, 100, 1), (1, 10, 200, 2), (1, 10, 300, 3), (3, 1, 400, 4)], "k int, u int, v int, n int")
    got = {r.id: r.v for r in J.as_of(left, right, "k", "t", "u", ["v"], "n").collect()}
    assert got == {"a": 300, "b": 100, "c": None, "d": None}


def test_band_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [(int(rng.integers(0, 3)), int(rng.integers(0, 100))) for _ in range(200)]
    rgs = [(int(rng.integers(0, 3)), lo := int(rng.integers(0, 90)), lo + int(rng.integers(1, 40))) for _ in range(40)]
    got = J.within_bands(spark.createDataFrame(pts, "k int, at int"), spark.createDataFrame(rgs, "k int, lo int, hi int"), "k", "at", "lo", "hi", 16).count()
    assert got == sum(k == q and lo <= at < hi for k, at in pts for q, lo, hi in rgs)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in U.upsert(old, new, ["k"], ["n"]).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {r.k for r in U.insert_absent(old, new.select("k", "v"), ["k"], ["v"]).collect()} == {3}
    done = {(r.k, r.v, r.changed) for r in U.compare_and_set(old, spark.createDataFrame([(1, "c"), (2, "c")], "k int, v string"), "k", "v", "a").collect()}
    assert done == {(1, "c", True), (2, "b", False)}
    assert U.replace_partition(old, old.limit(0), "k").count() == 2
    assert U.replace_partition(old, old.limit(0), "k", allow_empty=True).count() == 2


def test_score_matrix_sums_and_symmetry(spark):
    pairs = spark.createDataFrame([(1, 2, 1.4, 1.4), (3, 4, 2.0, 0.7)], "home int, away int, lh double, la double")
    got = {r.home: r for r in S.outcome(S.scores(pairs)).collect()}
    assert got[1].ph == pytest.approx(got[1].pa) and got[3].ph > got[3].pa
    for r in got.values():
        assert r.ph + r.pd + r.pa == pytest.approx(1.0)
    table = S.masses(S.scores(pairs), F.col("x") + F.col("y"), (2.25,)).collect()
    assert all(r.win + r.half_win + r.push + r.half_loss + r.lose == pytest.approx(1.0) and r.half_win == 0 for r in table)


def test_negative_binomial_masses(spark):
    from math import lgamma

    row = spark.createDataFrame([(9.0, 0.1)], "m double, a double").select(S.negative_binomial(F.col("m"), F.col("a"), 60).alias("p")).first().p
    size, q = 10.0, 9.0 / 19.0
    want = [np.exp(lgamma(k + size) - lgamma(size) - lgamma(k + 1) + size * np.log(1 - q) + k * np.log(q)) for k in range(61)]
    assert row == pytest.approx(want)


def test_strengths_are_recovered(spark):
    rng = np.random.default_rng(3)
    att, dfn = rng.normal(0, 0.3, 12), rng.normal(0, 0.2, 12)
    dfn -= dfn.mean()
    rows = [("c", D(2024, 1, 1), h, a, int(rng.poisson(np.exp(att[h] - dfn[a] + 0.3))), int(rng.poisson(np.exp(att[a] - dfn[h])))) for _ in range(60) for h in range(12) for a in range(12) if h != a]
    fit = L.fit_strengths(spark.createDataFrame(rows, "comp string, match_date date, home int, away int, fthg int, ftag int"), 0.0).toPandas().sort_values("team")
    assert np.abs(fit["att"].to_numpy() - att).max() < 0.12 and np.abs(fit["def"].to_numpy() - dfn).max() < 0.12
    assert abs(fit["advantage"].iloc[0] - 0.3) < 0.05 and abs(fit["rho"].iloc[0]) <= 0.05


def test_calibrators_need_rows_of_both_classes(spark):
    few = spark.createDataFrame([(0.5, 1)] * 100, "p double, y int")
    assert L.platt(few, "p", "y") is None and L.isotonic(few, "p", "y") is None
    rng = np.random.default_rng(4)
    p = rng.uniform(0.05, 0.95, 400)
    rows = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.uniform(size=400) < p**2).astype(int)}))
    assert L.platt(rows, "p", "y") is not None
    cal = L.isotonic(rows, "p", "y").transform(rows.withColumn("features", F.col("p")))
    err = cal.agg(F.avg(F.abs(F.col("prediction") - F.col("p") * F.col("p")))).first()[0]
    assert err < 0.12


def test_empty_tables(spark):
    m = spark.createDataFrame([], "match_id long, match_date date, home int, away int, fthg int, ftag int, comp string, season int, hs int, hst int, aws int, awst int, hc int, ac int")
    assert W.team_rows(m).count() == 0
    assert L.fit_strengths(m).count() == 0
