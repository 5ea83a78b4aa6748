"""Bulk enrichment against a lookup row by row; one shuffle of the merged table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import enrich as E

D0 = dt.date(2024, 1, 1)


def test_enrichment_equals_a_lookup_row_by_row(spark):
    rng = random.Random(1)
    matches = [(i, D0 + dt.timedelta(rng.randrange(60)), f"t{rng.randrange(6)}", f"t{rng.randrange(6, 12)}", None if rng.random() < 0.3 else rng.random(), rng.random()) for i in range(150)]
    bets = [(i, f"t{rng.randrange(7)}", f"t{rng.randrange(6, 14)}", D0 + dt.timedelta(rng.randrange(-5, 80))) for i in range(120)]
    frame = spark.createDataFrame(matches, "match_id long, match_date date, home string, away string, xh double, xa double")
    asked = spark.createDataFrame(bets, "bet_id long, home string, away string, day date")
    rows = E.enriched(asked, E.team_history(frame, F.col("xh"), F.col("xa")))
    got = {r.bet_id: r for r in rows.collect()}
    assert set(got) == set(range(120))
    for i, home, away, day in bets:
        for side, team in (("home", home), ("away", away)):
            past = sorted((d, m, xh if h == team else xa) for m, d, h, a, xh, xa in matches if team in (h, a) and d < day)
            xs = [x for *_, x in past if x is not None][-5:]
            near = sum(d >= day - dt.timedelta(14) for d, *_ in past)
            r = got[i]
            assert r[f"{side}_rest_days"] == ((day - past[-1][0]).days if past else None)
            assert r[f"{side}_matches_in_lookback"] == near and r[f"{side}_rotation_risk"] == (near >= 3)
            assert r[f"{side}_rolling_xg"] == (pytest.approx(sum(xs) / len(xs)) if xs else None)
    assert E.enriched(asked, E.team_history(frame.limit(0), F.col("xh"), F.col("xa"))).where("home_rest_days IS NULL AND home_matches_in_lookback = 0 AND fatigue = ' / '").count() == 120


def test_all_features_share_one_shuffle_by_team(spark):
    frame = spark.createDataFrame([(1, D0, "a", "b", 1.0, 1.0)], "match_id long, match_date date, home string, away string, xh double, xa double")
    asked = spark.createDataFrame([(1, "a", "b", D0)], "bet_id long, home string, away string, day date")
    plan = E.enriched(asked, E.team_history(frame, F.col("xh"), F.col("xa")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(team") == 1
