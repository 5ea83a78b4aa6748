"""Readers on small files, streams against batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from touchline.sources import files as R
from touchline.sources import sinks
from touchline.streaming import settlement


def test_season_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,B365>2.5,Extra\nE0,12/08/23,15:00, Alpha  FC,Beta,2,1,,2.10,1.9,x\nE0,13/08/2023,,Gamma,Delta,-,1,H,abc,,y\nE0,bad,,A,B,1,1,D,,,z\n")
    rows = R.clean_matches(R.season_csv(spark, str(p)), 2023, {"Alpha FC": "Alpha"}).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.HomeTeam, r.FTR, r.B365H, r.B365_O25, str(r.Date), r.Season, r.HC) == ("Alpha", "H", 2.1, 1.9, "2023-08-12", "2023-24", None)
    fixtures = R.fixtures_csv(spark, str(p), "E0").collect()
    assert str(fixtures[0].Kickoff) == "2023-08-12 14:00:00"


def test_league_and_odds_feeds(spark, tmp_path):
    match = lambda i, done, score: {"id": str(i), "home": {"name": "A"}, "away": {"name": "B"}, "status": {"utcTime": "2024-02-03T15:00:00Z", "finished": done, "scoreStr": score}}
    feed = tmp_path / "f.json"
    feed.write_text(json.dumps({"fixtures": {"firstUnplayedMatch": 1, "allMatches": [match(0, True, "3 - 0"), match(1, False, None), match(2, True, "?")]}}))
    assert [(r.id, r.fthg, r.ftag) for r in R.league_feed(spark, str(feed), True).collect()] == [("0", 3, 0)]
    assert [r.id for r in R.league_feed(spark, str(feed), False).collect()] == ["1"]
    event = lambda i, a: {"id": str(i), "competitions": [{"competitors": [{"homeAway": "home", "team": {"displayName": "H"}}, {"homeAway": "away", "team": {"displayName": "W"}}], "odds": [{"homeTeamOdds": {"moneyLine": a}, "awayTeamOdds": {"moneyLine": 200}, "drawOdds": {"moneyLine": 0}}]}]}
    odds = tmp_path / "o.json"
    odds.write_text(json.dumps({"events": [event(1, 100), event(2, -200)]}))
    r = R.odds_feed(spark, str(odds)).first()
    assert (r.id, r.h, r.d, r.a) == ("2", 1.5, None, 3.0)


def test_delimited_feed_and_registry(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("AA÷1¬AB÷2¬~AA÷3¬AA÷4¬junk¬~")
    assert [r.fields for r in R.delimited_feed(spark, str(p)).orderBy("place").collect()] == [{"AA": "1", "AB": "2"}, {"AA": "4"}]
    g = tmp_path / "l.json"
    g.write_text(json.dumps({"_note": "x", "E0": {"name": "One", "weight": 1.0, "cup": False}}))
    assert [(r.code, r.name, r.weight) for r in R.league_registry(spark, str(g)).collect()] == [("E0", "One", 1.0)]
    html = spark.createDataFrame([("<script>__DATA__ = {\"a\": 5};</script>",), ("none",)], "html string")
    assert [r.v for r in html.select(R.embedded_json(F.col("html"), "a int")["a"].alias("v")).collect()] == [5, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.export_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.replace_table(rows, str(tmp_path / "t"), "k")
    sinks.replace_table(rows.where("k = 1"), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_settlement_is_idempotent(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 7, "OU", "Over", 2.5, 2.0, 10.0), (2, 8, "1X2", "H", None, 3.0, 10.0)]
    bets = spark.createDataFrame([(*r, day, day) for r in rows], "bet_id long, match_id long, market string, selection string, line double, odds double, stake double, placed_at timestamp, kickoff timestamp")
    bets.write.parquet(str(tmp_path / "bets"))
    results = spark.createDataFrame([(m, day + dt.timedelta(hours=3), "FINISHED", h, a, None, None) for m, h, a in ((7, 2, 1), (8, 0, 0))], "match_id long, known_at timestamp, status string, fthg long, ftag long, hc long, ac long")
    results.write.parquet(str(tmp_path / "results"))
    for _ in range(2):
        streams = [spark.readStream.schema(t.schema).parquet(str(tmp_path / n)) for n, t in (("bets", bets), ("results", results))]
        settlement.settle_to(settlement.settled(settlement.paired(*streams, buckets=2)), str(tmp_path / "journal"), str(tmp_path / "log"))
    got = sorted((r.bet_id, r.pnl) for r in spark.read.parquet(str(tmp_path / "journal")).collect())
    assert got == [(1, 10.0), (2, -10.0)]
