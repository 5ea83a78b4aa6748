"""Priced legs: versions chosen as of the day, caps of unknown teams, legs by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions.pricing import settlement_kelly, settlement_kellys
from touchline.operators import recommend as R
from touchline.plans import value as V
from touchline.registry import QUERIES

D = dt.date
SMALL = "/root/testdata/sf0.001"
FIX = "match_id long, comp string, match_date date, home int, away int, h double, d double, a double, total double, over double, under double, handicap double, ah_home double, ah_away double"
BUNDLE = "comp string, version date, team int, att double, def double, advantage double, rho double"


def fixture(i, day, comp="c", home=1, away=2, prices=(2.5, 3.2, 3.0), total=2.25, handicap=-0.25):
    return (i, comp, day, home, away, *prices, total, 1.9, 2.0, handicap, 2.1, 1.8)


def bundle(spark, *versions):
    return spark.createDataFrame([("c", v, t, a + t / 10, -t / 10, 0.2, -0.05) for v, a in versions for t in (1, 2, 3)], BUNDLE)


def test_the_newest_version_begun_on_or_before_the_day(spark):
    days = {1: D(2023, 12, 31), 2: D(2024, 1, 1), 3: D(2024, 6, 30), 4: D(2025, 1, 1), 5: D(2024, 6, 1)}
    fixtures = spark.createDataFrame([fixture(i, d, "x" if i == 5 else "c") for i, d in days.items()], FIX)
    got = R.versions_as_of(fixtures, bundle(spark, (D(2024, 1, 1), 0.0), (D(2024, 7, 1), 0.1))).collect()
    assert {r.match_id: r.version for r in got} == {1: None, 2: D(2024, 1, 1), 3: D(2024, 1, 1), 4: D(2024, 7, 1), 5: None}


def test_legs_settle_as_their_masses_say(spark):
    fits = bundle(spark, (D(2024, 1, 1), 0.0))
    fixtures = R.versions_as_of(spark.createDataFrame([fixture(1, D(2024, 2, 1)), fixture(2, D(2024, 2, 1), away=9), fixture(3, D(2024, 2, 1), prices=(None, 1.0, 3.0), total=None, handicap=None)], FIX), fits)
    rates = R.rates_of(fixtures, fits)
    assert {(r.away, r.is_new) for r in rates.collect()} == {(2, False), (9, True)}
    keys = ["comp", "version", "home", "away"]
    legs = {(r.match_id, r.leg): r for r in R.priced_legs(fixtures, rates, keys).collect()}
    assert {leg for m, leg in legs if m == 1} == {"H", "D", "A", "Over", "Under", "AH home", "AH away"} and {leg for m, leg in legs if m == 3} == {"A"}
    assert sum(legs[1, x].p for x in "HDA") == pytest.approx(1.0)
    assert legs[1, "Over"].p + legs[1, "Under"].p == pytest.approx(1.0) and legs[1, "AH home"].p + legs[1, "AH away"].p == pytest.approx(1.0)
    cells = R.S.scores(rates.where("NOT is_new"), F.col("rho")).collect()
    w = sum(c.w for c in cells)
    mass = lambda f: sum(c.w for c in cells if f(c.x, c.y)) / w
    three, two = mass(lambda x, y: x + y >= 3), mass(lambda x, y: x + y == 2)
    assert legs[1, "Over"].ev == pytest.approx(three * 0.9 - two / 2 - (1 - three - two))  # 2.25: two goals lose half
    home, level = mass(lambda x, y: x > y), mass(lambda x, y: x == y)
    assert legs[1, "AH home"].ev == pytest.approx(home * 1.1 - level / 2 - (1 - home - level))
    assert legs[1, "AH away"].ev == pytest.approx((1 - home - level) * 0.8 + level * 0.4 - home)
    assert all(legs[2, x].stake <= R.NEW_TEAM_CAP for x in ("H", "D", "A", "Over", "AH home"))
    assert all(r.recommended == (r.ev >= R.LEAST_EV) and r.fair == pytest.approx(1 / r.p) for r in legs.values())


def test_fits_and_fixtures_are_made_once_and_meet_one_row_a_pair(spark, monkeypatch):
    runs = {name: spark.sparkContext.accumulator(0) for name in ("fits", "fixtures")}

    def counted(rows, name):
        def run(batches):
            for b in batches:
                runs[name].add(len(b))
                yield b

        return rows.mapInPandas(run, rows.schema)

    fit_folds, priced_fixtures = V.B.fit_folds, V._priced_fixtures
    monkeypatch.setattr(V.B, "fit_folds", lambda *a: counted(fit_folds(*a), "fits"))
    monkeypatch.setattr(V, "_priced_fixtures", lambda *a: counted(priced_fixtures(*a), "fixtures"))
    legs = QUERIES["legs_by_fitted_version"](spark, SMALL)
    assert legs.count() > 0
    matches = spark.read.parquet(f"{SMALL}/orders.parquet")
    windows = V.B.folds_of(V.domain(spark, SMALL, "matches"), 1, 6)
    assert runs["fixtures"].value == matches.count() and runs["fits"].value == fit_folds(V.domain(spark, SMALL, "matches"), windows).count()
    assert legs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_level_handicaps_and_unlined_fixtures_find_their_masses(spark):
    fits = bundle(spark, (D(2024, 1, 1), 0.0))
    rows = [fixture(1, D(2024, 2, 1), handicap=0.0), fixture(2, D(2024, 2, 1), handicap=-0.0), fixture(3, D(2024, 2, 1), total=None, handicap=0.25), fixture(4, D(2024, 2, 1), comp=None)]
    fixtures = R.versions_as_of(spark.createDataFrame(rows, FIX), fits)
    keys = ["comp", "version", "home", "away"]
    legs = {(r.match_id, r.leg): r for r in R.priced_legs(fixtures, R.rates_of(fixtures, fits), keys).collect()}
    assert len(legs) == 7 + 7 + 5 and all(legs[1, x].p == legs[2, x].p for x in ("AH home", "AH away"))


def test_fractions_beyond_the_cap_are_not_solved_and_others_stay_as_they_were(spark):
    rows = spark.createDataFrame([(w / 40, hw / 40, hl / 40, (36 - w - hw - hl) / 40, o) for w in range(0, 34, 3) for hw, hl in ((0, 0), (2, 0), (0, 2)) for o in (None, -9.0, 1.0, 1.3, 2.0, 2.4, 7.0)], "w double, hw double, hl double, lo double, o double")
    side = tuple(F.col(c) for c in ("w", "hw", "hl", "lo", "o"))
    got = rows.select(settlement_kelly(*side).alias("f"), *settlement_kellys([side, (*side[3::-1], side[4])], R.MOST_KELLY)).toDF("f", "g", "back").collect()
    assert any(r.f and r.f > R.MOST_KELLY for r in got) and any(r.f and 0 < r.f < R.MOST_KELLY for r in got)
    assert all(r.g == (None if r.f is None else min(r.f, R.MOST_KELLY)) for r in got) and any(r.back for r in got)
