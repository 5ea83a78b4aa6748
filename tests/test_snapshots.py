"""Odds payloads of every nesting, against what they say."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import snapshots as S


def quotes(spark, *payloads):
    rows = S.quotes_of(spark.createDataFrame([(p if isinstance(p, str) or p is None else json.dumps(p),) for p in payloads], "payload string")).collect()
    return sorted((r.match_id, r.branch, r.bookmaker or "", r.market, r.selection, r.price) for r in rows)


def test_every_branch(spark):
    got = quotes(
        spark,
        {"match_id": "a", "bookmaker": "B", "odds": [{"home": 2.1, "draw": "3.4", "away": 1.0}, {"bookmaker": "P", "market": "OU", "odds": {"Over": 1.9, "Under": 1.95}}, 5]},
        {"canonical_match_id": "b", "bookmakers": [{"name": "X", "markets": {"1X2": {"1": 2, "X": 3, "2": 4}, "OU": {"odds": {"over": 1.8}}}}, {"markets": [{"market_type": "AH", "ah_home": 1.9, "AHA": 2.0, "line": 5}]}, {"bookmaker": "own", "H": 5.5, "market": "ML"}]},
        {"fixture_id": 3, "source": "S", "markets": [{"market": "1X2", "odds": {"H": 2.5, "special": 7, "line": 3}}]},
        {"match_id": "d", "markets": {"1X2": {"home": 1.5}, "CS": {"2-1": 9, "bad": "x"}}},
        {"match_id": "e", "odds_home": 2.2, "H": 2.0, "over": 1.7, "line": 2.5},
    )
    assert got == sorted(
        [("a", "odds", "B", "1X2", "H", 2.1), ("a", "odds", "B", "1X2", "D", 3.4), ("a", "odds", "P", "OU", "over", 1.9), ("a", "odds", "P", "OU", "under", 1.95)]
        + [("b", "bookmakers", "X", "1X2", s, p) for s, p in (("H", 2.0), ("D", 3.0), ("A", 4.0))]
        + [("b", "bookmakers", "X", "OU", "over", 1.8), ("b", "bookmakers", "unknown", "AH", "ah_home", 1.9), ("b", "bookmakers", "unknown", "AH", "ah_away", 2.0), ("b", "bookmakers", "own", "ML", "H", 5.5)]
        + [("3", "markets", "S", "1X2", "H", 2.5), ("3", "markets", "S", "1X2", "special", 7.0), ("d", "markets", "", "1X2", "H", 1.5), ("d", "markets", "", "CS", "2-1", 9.0)]
        + [("e", "flat", "", "1X2", "H", 2.0), ("e", "flat", "", "1X2", "odds_home", 2.2), ("e", "flat", "", "1X2", "over", 1.7)]
    )


def test_payloads_without_rows(spark):
    assert quotes(spark, None, "", "not json", "[]", "7", {"home": 2.0}, {"match_id": " "}, {"match_id": "a", "odds": {}}, {"match_id": "a", "odds": [{"home": 1.0}]}, {"match_id": "a", "bookmakers": "x"}) == []


def test_times_come_from_the_nearest_level(spark):
    p = {"match_id": "a", "timestamp": "2026-01-01T00:00:00Z", "bookmakers": [{"name": "X", "H": 2.0, "timestamp": "2026-01-02T00:00:00+00:00"}, {"name": "Y", "H": 3.0}]}
    got = {r.bookmaker: r.observed for r in S.quotes_of(spark.createDataFrame([(json.dumps(p),)], "payload string")).collect()}
    assert got == {"X": dt.datetime(2026, 1, 2), "Y": dt.datetime(2026, 1, 1)}


@pytest.mark.parametrize(
    "payload,market,selection,price,whole",
    [
        ({"odds": {"H": 2.0, "D": 3.0, "A": 4.0}}, "1X2", "Draw", 3.0, [2.0, 3.0, 4.0]),
        ({"markets": {"1X2": {"home": "2.0", "draw": 3.1, "away": 4.0}}}, "1X2", "Home", 2.0, [2.0, 3.1, 4.0]),
        ({"prices": {"ou": {"Over": 1.9, "U": 2.0}}}, "OU", "Under 2.5", 2.0, [1.9, 2.0]),
        ({"odds": {"AH": {"Home": 1.9, "Away": 1.95}}}, "AH", "Away +0.5", 1.95, [1.9, 1.95]),
        ({"closing_odds": 2.4}, "1X2", "Home", 2.4, None),
        ({"odds": 1.85}, "1X2", "A", 1.85, None),
        ({"H": 2.0, "A": 3.0}, "1X2", "Away", 3.0, None),
        ({"odds": {"1x2": {"H": 1.0, "D": "x"}}}, "1X2", "H", None, None),
        (None, "1X2", "H", None, None),
    ],
)
def test_closing_prices_of_any_nesting(spark, payload, market, selection, price, whole):
    row = spark.createDataFrame([(payload and json.dumps(payload), market, selection)], "p string, m string, s string")
    got = row.select(S.closing_price(F.col("p"), F.col("m"), F.col("s")).alias("one"), S.closing_prices(F.col("p"), F.col("m"), F.col("s")).alias("all")).first()
    assert (got.one, got["all"]) == (price, whole)
