"""Fits: gradients against differences, likelihoods against a search, folds as rows against one fold at a time, direct least squares."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import backtest as B
from touchline.operators import models as L
from touchline.operators.quasi_newton import bounded_minimum
from touchline.projection import domain

SMALL = "/root/testdata/sf0.001"
DDL = "comp string, match_date date, home int, away int, fthg int, ftag int, hc int, ac int"


def low_scores(rng, lh, la, rho, n):
    """Scores drawn with the low-score factor, by rejection."""
    out = []
    while len(out) < n:
        x, y = int(rng.poisson(lh)), int(rng.poisson(la))
        factor = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
        if rng.random() < factor / 2:
            out.append((x, y))
    return out


def planted(spark, rounds=40, teams=8, rho=-0.15, seed=1):
    rng = np.random.default_rng(seed)
    att, dfn = rng.normal(0.1, 0.3, teams), rng.normal(0, 0.2, teams)
    dfn -= dfn.mean()
    rows = []
    for h in range(teams):
        for a in range(teams):
            if h != a:
                for k, (x, y) in enumerate(low_scores(rng, np.exp(att[h] - dfn[a] + 0.3), np.exp(att[a] - dfn[h]), rho, rounds)):
                    rows.append(("c", dt.date(2020, 1, 1) + dt.timedelta(37 * k), h, a, x, y, int(rng.poisson(3 + h / 2)), int(rng.poisson(2 + a / 4))))
    return spark.createDataFrame(rows, DDL), att, dfn


def test_quasi_newton_within_bounds():
    f = lambda x: ((x[0] - 3) ** 2 + 10 * (x[1] - x[0] ** 2) ** 2, np.array([2 * (x[0] - 3) - 40 * x[0] * (x[1] - x[0] ** 2), 20 * (x[1] - x[0] ** 2)]))
    x, _ = bounded_minimum(f, np.zeros(2), np.full(2, -20.0), np.full(2, 20.0))
    assert x == pytest.approx([3, 9], abs=1e-4)
    x, v = bounded_minimum(f, np.zeros(2), np.full(2, -20.0), np.array([1.0, 20.0]))
    assert x == pytest.approx([1, 1], abs=1e-5) and v == pytest.approx(4)


def test_likelihood_gradient_equals_differences(spark):
    m, _, _ = planted(spark, 3)
    like = L.PairLikelihood(L.pair_statistics(m, "fthg", "ftag").toPandas())
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.2, 15), 0.2, -0.1]
    _, g = like.loss(x)
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-6
        assert (like.loss(x + step)[0] - like.loss(x - step)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-4)


def test_joint_fit_beats_a_search_and_recovers_what_was_planted(spark):
    m, att, dfn = planted(spark)
    stats = L.pair_statistics(m, "fthg", "ftag", decay=0.0).toPandas()
    like = L.PairLikelihood(stats)
    x, best = like.fitted()
    rng = np.random.default_rng(3)
    for scale in (1e-4, 1e-3, 1e-2, 0.1):
        for _ in range(50):
            other = x + rng.normal(0, scale, len(x))
            other[-2:] = np.clip(other[-2:], (L.ADVANTAGE[0], L.RHO[0]), (L.ADVANTAGE[1], L.RHO[1]))
            assert like.loss(other)[0] >= best - 1e-6
    for rho in np.linspace(*L.RHO, 7):  # strengths fitted anew at each fixed low-score parameter
        assert like.fitted((rho, rho))[1] >= best - 1e-6
    fit = L.fit_strengths(m, 0.0).toPandas().sort_values("team")
    assert np.abs(fit["att"].to_numpy() - att).max() < 0.15 and np.abs(fit["def"].to_numpy() - dfn).max() < 0.15
    assert abs(fit["rho"].iloc[0] + 0.15) < 0.06 and abs(fit["advantage"].iloc[0] - 0.3) < 0.08


def plan_lines(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_folds_as_rows_equal_one_fold_at_a_time(spark):
    m = domain(spark, SMALL, "matches")
    windows = B.folds_of(m, 2, 6)
    got = B.fit_folds(m, windows).toPandas()
    assert set(got["fold"]) == set(range(1, len(windows) + 1)) and len(windows) > 5
    for k in (1, 4, len(windows)):
        one = L.fit_strengths(m.where(F.col("match_date") < F.lit(windows[k - 1][0]))).toPandas()
        both = one.merge(got[got["fold"] == k], on=["comp", "team"], suffixes=("", "_row"))
        assert len(both) == len(one) == (got["fold"] == k).sum()
        for c in ("att", "def", "advantage", "rho"):
            assert np.abs(both[c] - both[f"{c}_row"]).max() < 2e-3
        assert both["n"].to_numpy() == pytest.approx(both["n_row"].to_numpy())
    short = B.priced_folds(m, windows[:2])
    assert plan_lines(short) == plan_lines(B.priced_folds(m, windows))
    priced = B.priced_folds(m, windows).toPandas()
    assert (priced["ph"] + priced["pd"] + priced["pa"]).to_numpy() == pytest.approx(1.0)
    assert (priced["match_date"] >= windows[0][0]).all()


def test_fold_numbers(spark):
    days = [dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(2021, 6, 30), dt.date(2021, 7, 1), dt.date(2022, 1, 1)]
    m = spark.createDataFrame([(d,) for d in days], "match_date date")
    windows = [(dt.date(2021, 1, 1), dt.date(2021, 7, 1)), (dt.date(2021, 7, 1), dt.date(2022, 1, 1))]
    assert {r.match_date: r.fold for r in B.fold_of(m, windows).collect()} == dict(zip(days, (0, 1, 1, 2)))


def test_count_rates_equal_direct_least_squares(spark):
    m, _, _ = planted(spark, 5)
    got = L.count_rates(m).toPandas()
    rows = m.toPandas()
    x = pd.get_dummies(rows[["home", "away"]].astype("category")).to_numpy(float)
    total = 0
    for side, col in (("hc", "rate_home"), ("ac", "rate_away")):
        y = rows[side].to_numpy(float)
        eta = np.log(y + 0.5)
        for _ in range(60):  # match by match
            mu = np.exp(eta)
            eta = x @ np.linalg.lstsq(x * np.sqrt(mu)[:, None], (eta + (y - mu) / mu) * np.sqrt(mu), rcond=None)[0]
        both = rows.assign(mu=np.exp(eta)).merge(got, on=["home", "away"])
        assert both["mu"].to_numpy() == pytest.approx(both[col].to_numpy(), rel=1e-6)
        total = total + np.exp(eta)
    y = (rows["hc"] + rows["ac"]).to_numpy(float)
    assert got["dispersion"].iloc[0] == pytest.approx(min(1.0, max(0.0, ((y - total) ** 2 - total).sum() / (total**2).sum())), abs=1e-9)


def interacting(spark, n=3000, seed=4):
    """Results that hang on the product of two features, of which a linear model sees nothing."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    home = 1 / (1 + np.exp(-3 * np.sign(a * b)))
    draw = 0.2
    u = rng.random(n)
    label = np.where(u < draw, "D", np.where(u < draw + (1 - draw) * home, "H", "A"))
    rows = [(int(i), dt.date(2020, 1, 1) + dt.timedelta(int(i) // 10), str(x), float(p), float(q), float(r) if i % 9 else None) for i, (x, p, q, r) in enumerate(zip(label, a, b, c))]
    return spark.createDataFrame(rows, "match_id long, match_date date, ftr string, a double, b double, c double")


def log_loss(rows):
    return -np.mean([np.log({"H": r.ph, "D": r.pd, "A": r.pa}[r.ftr]) for r in rows])


def test_boosted_outcomes_beat_a_linear_model_on_interactions(spark):
    data = interacting(spark)
    fit, held = data.where("match_id < 2400"), data.where("match_id >= 2400")
    model = L.boosted_outcomes(fit, ["a", "b", "c"])
    got = model.transform(held).collect()
    assert all(r.ph + r.pd + r.pa == pytest.approx(1.0) for r in got) and len(got) == 600
    linear = L.outcome_classifier(fit, ["a", "b", "c"], "ftr").transform(held).select("ftr", "probability").collect()
    assert log_loss(got) < -np.mean([np.log(r.probability["HDA".index(r.ftr)]) for r in linear]) - 0.1
    weights = {(r.outcome, r.feature): r.importance for r in model.importances(spark).collect()}
    assert sum(v for (o, _), v in weights.items() if o == "H") == pytest.approx(1.0)
    assert weights["H", "c"] < min(weights["H", "a"], weights["H", "b"])


def test_no_row_after_the_split_reaches_the_trees(spark):
    data = interacting(spark, 800)
    model = L.boosted_outcomes(data, ["a", "b", "c"], trees=3)
    changed = data.withColumn("late", F.datediff("match_date", F.lit("1970-01-01")) > model.split)
    changed = changed.withColumn("a", F.when(F.col("late"), -F.col("a") * 5 + 1).otherwise(F.col("a"))).withColumn("c", F.when(F.col("late"), 99.0).otherwise(F.col("c")))
    again = L.boosted_outcomes(changed, ["a", "b", "c"], trees=3)
    grown = lambda x: [t.toDebugString.partition("\n")[2] for t in x.trees]
    assert grown(model) == grown(again)
    assert [c.coefficients for c in model.calibrators] != [c.coefficients for c in again.calibrators]
    with pytest.raises(ValueError):
        L.boosted_outcomes(data.where("ftr <> 'D'"), ["a", "b"])
