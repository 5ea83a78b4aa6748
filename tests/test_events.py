"""Event feeds read as batch and as stream, aliases, finished results and price tabs."""

import datetime as dt
import json

import pytest

from touchline.sources import events as E
from touchline.streaming.jobs import run_to_table

FIRST = "SA÷1¬~ZA÷JAPAN: J1 League¬ZL÷/j1/¬~AA÷e1¬AD÷1700000000¬AB÷3¬AE÷Ulsan (Kor)¬AF÷Kobe¬AG÷2¬AH÷1¬~AA÷e2¬AD÷1700003600¬AB÷1¬AE÷A¬AF÷B¬PX÷hh¬PY÷¬WU÷/a-slug/¬~ZK÷WSL¬~AA÷e3¬AD÷1700007200¬AB÷3¬AE÷C¬AF÷D¬AG÷0¬AH÷0¬~junk~AA÷e4¬AB÷3¬AE÷C¬AF÷D¬AG÷0¬AH÷0¬~AA÷e5¬AD÷17¬AB÷3¬AE÷C¬AF÷D¬AG÷x¬AH÷0¬"
SECOND = "AA÷e1¬AD÷1700000000¬AB÷3¬AE÷Ulsan¬AF÷Kobe¬AG÷3¬AH÷1¬~AA÷e6¬AD÷1700000000¬AB÷2¬AE÷X¬AF÷Y¬"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text(FIRST)
    (tmp_path / "b.txt").write_text(SECOND)
    return str(tmp_path)


def test_finished_events_carry_their_competition(spark, folder):
    got = {r.event_id: r for r in E.team_results(spark, folder).collect()}
    assert set(got) == {"e1", "e3"}
    assert (got["e1"].fthg, got["e1"].home, got["e1"].competition) == (3, "Ulsan", "Unknown")  # the last file's row
    assert (got["e3"].competition, got["e3"].comp, got["e3"].path, got["e3"].kickoff) == ("WSL", "WSL", None, dt.datetime(2023, 11, 15, 0, 13, 20))
    first = {r.event_id: r for r in E.events(E.feed_files(spark, f"{folder}/a.txt"), True).collect()}
    assert (first["e1"].home, first["e1"].comp, first["e1"].path) == ("Ulsan", "J1", "/j1/")
    assert [r.event_id for r in E.season_results(spark, folder, "WSL").collect()] == ["e3"]


def test_fixtures_keep_hashes_and_slugs(spark, folder):
    got = {r.event_id: r for r in E.fixture_events(spark, folder).collect()}
    assert set(got) == {"e2", "e6"} and (got["e2"].home_hash, got["e2"].away_hash, got["e2"].home_slug, got["e2"].away_slug) == ("hh", None, "a-slug", None)


def test_a_stream_reads_a_folder_alike(spark, folder):
    batch = E.events(E.feed_files(spark, folder), True)
    streamed = run_to_table(E.events(E.feed_files(spark, folder, stream=True), True), "events")
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_newest_cup_seasons_with_results(spark, tmp_path):
    match = lambda i, score, done=True: {"id": str(i), "home": {"name": "A"}, "away": {"name": "B"}, "status": {"utcTime": "2024-02-03T15:00:00Z", "finished": done, "scoreStr": score}}
    for season, found in (("2020", [match(1, "1 - 0")]), ("2021", [match(1, "2 - 0"), match(2, "0 - 0")]), ("2022", [match(3, "4 - 1")]), ("2023", [match(9, None, False)])):
        (tmp_path / f"{season}.json").write_text(json.dumps({"fixtures": {"allMatches": found}}))
    assert {r.id: (r.fthg, r.ftag) for r in E.cup_seasons(spark, str(tmp_path), 2).collect()} == {"1": (2, 0), "2": (0, 0), "3": (4, 1)}
    assert E.cup_seasons(spark, str(tmp_path), 9).count() == 3


def test_aliases_and_finished_rows(spark):
    rows = spark.createDataFrame([(1, "OH Leuven", "Genk", "H", "c"), (2, "Gent", None, " ", "c"), (3, "Gent", "Oud-Heverlee", "D", "x")], "id int, home string, away string, ftr string, comp string")
    aliases = spark.createDataFrame([("OH Leuven", "Leuven"), ("Oud-Heverlee", "Leuven")], "alias string, name string")
    got = {r.id: (r.home, r.away) for r in E.canonical_teams(rows, aliases).collect()}
    assert got == {1: ("Leuven", "Genk"), 2: ("Gent", None), 3: ("Gent", "Leuven")}
    assert [r.id for r in E.finished_results(rows).orderBy("id").collect()] == [1, 3] and [r.id for r in E.finished_results(rows, "x").collect()] == [3]


def tab(*markets, sides=True):
    people = [{"id": "p1", "type": {"side": "HOME"}}, {"id": "p2", "type": {"side": "AWAY"}}] if sides else []
    return json.dumps({"data": {"findOddsByEventId": {"settings": {"bookmakers": [{"bookmaker": {"id": "16", "name": "Sixteen"}}, {"bookmaker": {"id": "5", "name": "Five"}}]}, "eventParticipants": people, "odds": list(markets)}}})


def market(book, kind, *odds, scope="FULL_TIME"):
    return {"bookmakerId": book, "bettingType": kind, "bettingScope": scope, "odds": [{"eventParticipantId": p, "value": v, "selection": s, "handicap": {"value": h} if h else None} for p, v, s, h in odds]}


def three(book, h, d, a, scope="FULL_TIME"):
    return market(book, "HOME_DRAW_AWAY", ("p1", h, None, None), (None, d, None, None), ("p2", a, None, None), scope=scope)


def test_price_tabs_walk_books_by_preference(spark):
    totals = market("5", "OVER_UNDER", (None, "1.50", "OVER", "1.5"), (None, "2.60", "UNDER", "1.5"), (None, "1.95", "OVER", "2.5"), (None, "1.90", "UNDER", "2.5"))
    spread = market("5", "ASIAN_HANDICAP", ("p1", "1.90", None, "-0.5"), ("p2", "2.00", None, "0.5"), ("p1", "1.5", None, "0"), ("p2", "2.6", None, "0"))
    rows = [
        ("a", tab(three("5", "2.0", "3.0", "4.0"), three("16", "2.1", "1.0", "3.9"), three("99", "9", "9", "9"), totals, spread)),
        ("b", tab(three("99", "2.5", "3.5", "3.0", scope="FIRST_HALF"), three("77", "2.2", "3.2", "3.3"))),
        ("c", tab()),
        ("d", "{}"),
        ("e", "no json"),
    ]
    got = {r.event_id: r for r in E.tab_prices(spark.createDataFrame(rows, "event_id string, value string"), ["16", "5"]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].bookmaker, got["a"].h, got["a"].d, got["a"].a) == ("Five", 2.0, 3.0, 4.0)  # the preferred book lacks a draw price
    assert (got["a"].total, got["a"].over, got["a"].under) == (2.5, 1.95, 1.9) and (got["a"].handicap, got["a"].ah_home, got["a"].ah_away) == (-0.5, 1.9, 2.0)
    assert (got["b"].bookmaker, got["b"].h, got["b"].total) == ("77", 2.2, None) and got["c"].h is None
