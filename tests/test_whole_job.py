"""Queries do their whole job: every row is asked, every window tested, every signal kept."""

import datetime as dt
import random

import pandas as pd
from difflib import SequenceMatcher

from touchline.operators import backtest as B
from touchline.operators import names as N
from touchline.projection import domain
from touchline.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_names_are_compared_across_first_letters(spark):
    known = spark.createDataFrame([(1, "Manchester United"), (2, "Arsenal London"), (3, "Xavi")], "entity long, alias string")
    asked = spark.createDataFrame([("anchester United",), ("Xarsenal London",), ("rsenl",), (None,)], "name string")
    got = {r.name: r for r in N.resolve(asked, known).collect()}
    assert got["anchester United"][1:4:2] == (1, "fuzzy") and got["Xarsenal London"][1:4:2] == (2, "fuzzy")
    best = max(SequenceMatcher(None, "rsenl", k).ratio() for k in ("manchesterunited", "arsenallondon", "xavi"))
    assert got["rsenl"].step == "staged" and abs(got["rsenl"].score - best) < 1e-9
    assert got[None].step == "staged" and got[None].score == 0
    assert [r.step for r in N.resolve(asked, known.limit(0)).collect()] == ["staged"] * 4


def test_every_match_asks_for_a_result_and_its_rest(spark):
    rows = domain(spark, SMALL, "matches").select("match_id", "home", "away", "match_date").collect()
    near, rest = {}, {}
    for r in rows:
        day = r.match_date + dt.timedelta(r.match_id % 3 - 1)
        found = [(m.match_id % 6 == 0, abs((m.match_date - day).days), m.match_id) for m in rows if (m.home, m.away) == (r.home, r.away) and abs((m.match_date - day).days) <= 1]
        if found:
            near[r.match_id] = min(found)[2]
        rest[r.match_id] = min(((r.match_date - m.match_date).days for m in rows if r.home in (m.home, m.away) and m.match_date < r.match_date), default=None)
    assert {r.bet_id: r.match_id for r in QUERIES["nearest_result_of_every_match"](spark, SMALL).collect()} == near and len(near) == len(rows)
    assert {r.match_id: r.rest for r in QUERIES["rest_lookup_of_every_match"](spark, SMALL).collect()} == rest


def test_every_quote_opens_a_window(spark):
    rows = domain(spark, SMALL, "quotes").select("quote_id", "match_id", "observed_at").collect()
    at = [(r.quote_id, r.match_id, int((r.observed_at - dt.datetime(1970, 1, 1)).total_seconds() // 1)) for r in rows]
    by_match = {}
    for _, m, t in at:
        by_match.setdefault(m, []).append(t)
    want = {q: sum(t <= u < t + 7200 for u in by_match[m]) for q, m, t in at}
    assert {r.w_id: r.n for r in QUERIES["range_join_windows_of_every_quote"](spark, SMALL).collect()} == want


def test_folds_follow_the_dates_of_the_matches(spark):
    day = lambda *d: spark.createDataFrame([(x,) for x in d], "match_date date")
    got = B.folds_of(day(dt.date(1995, 1, 1), dt.date(2001, 8, 1)), 1, 6)
    assert got[0] == (dt.date(1996, 1, 1), dt.date(1996, 7, 1)) and got[-1] == (dt.date(2001, 7, 1), dt.date(2002, 1, 1)) and len(got) == 12
    assert B.folds_of(day(dt.date(2020, 1, 1), dt.date(2021, 1, 1)), 1, 6) == [(dt.date(2021, 1, 1), dt.date(2021, 7, 1))]
    assert B.folds_of(day(), 1, 6) == [(dt.date.max, dt.date.max)]


def test_signals_of_many_files_out_of_order(spark, tmp_path):
    order = list(range(30))
    random.Random(3).shuffle(order)
    assert order[0] < 27
    for k, d in enumerate([29, *[x for x in order if x != 29]]):
        row = {"event_id": [399], "ts": [pd.Timestamp(2024, 1, 1 + d, 12)], "user_id": [d], "event_type": ["view"], "value": [1.0], "props": ["{}"]}
        pd.DataFrame(row).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"events-{k:02d}.parquet")
    assert QUERIES["stream_signals_once"](spark, str(tmp_path)).count() == 30
