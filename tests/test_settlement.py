"""Bets settled by results that come before, with, after and never, against a replay; closing prices; a hot match."""

import datetime as dt
import math

import pytest

from touchline.streaming import settlement as S
from touchline.streaming.jobs import shared_folder

BETS = "bet_id long, match_id long, placed_at timestamp, kickoff timestamp, market string, selection string, line double, odds double, stake double"
RESULTS = "match_id long, known_at timestamp, status string, fthg long, ftag long, hc long, ac long"
QUOTES = "match_id long, observed_at timestamp, kickoff timestamp, market string, line double, prices map<string,double>"
T0 = dt.datetime(2024, 3, 1, 15)
H, D = dt.timedelta(hours=1), dt.timedelta(days=1)


class Feed:
    """Folders that grow between runs of one stream."""

    def __init__(self, spark, **how):
        self.spark, self.how = spark, how
        self.paths = {k: shared_folder(spark, k) for k in ("bets", "results", "quotes", "journal", "log")}

    def run(self, bets=(), results=(), quotes=()):
        for name, rows, ddl in (("bets", bets, BETS), ("results", results, RESULTS), ("quotes", quotes, QUOTES)):
            self.spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(self.paths[name])
        streams = [self.spark.readStream.schema(ddl).parquet(self.paths[name]) for name, ddl in (("bets", BETS), ("results", RESULTS), ("quotes", QUOTES))]
        S.settle_to(S.settled(S.paired(*streams, buckets=3, **self.how)), self.paths["journal"], self.paths["log"])
        return {r.bet_id: r for r in self.spark.read.parquet(self.paths["journal"]).collect()}


def bet(i, match, market="1X2", selection="H", line=None, odds=2.0, stake=10.0, kickoff=T0, placed=None):
    return (i, match, placed or kickoff - D, kickoff, market, selection, line, odds, stake)


def test_results_before_with_after_and_never(spark):
    feed = Feed(spark, patience="10 days")
    got = feed.run(
        bets=[bet(1, 1), bet(2, 2), bet(3, 3), bet(4, 4, selection="A"), bet(9, 2, odds=1.0), bet(10, 2, stake=0.0)],
        results=[(1, T0 + 3 * H, "FINISHED", 2, 0, None, None), (5, T0 + 3 * H, "FT", 0, 1, None, None), (2, T0 + H, "LIVE", 1, 0, None, None)],
        quotes=[(1, T0 - 2 * H, T0, "1X2", None, {"H": 3.0, "D": 3.0, "A": 3.0}), (1, T0 - H / 6, T0, "1X2", None, {"H": 1.8, "D": 3.6, "A": 5.0}), (1, T0 + H / 2, T0, "1X2", None, {"H": 9.0})],
    )
    assert set(got) == {1}  # a live score settles nothing
    assert (got[1].status, got[1].pnl, got[1].closing_odds, got[1].settled_at) == ("WON", 10.0, 1.8, T0 + 3 * H)
    assert got[1].clv == pytest.approx(math.log(2.0 / (1.8 * (1 / 1.8 + 1 / 3.6 + 1 / 5.0))))
    got = feed.run(bets=[bet(5, 5, selection="H"), bet(6, 5, "OU", "Under", 1.25)], results=[(2, T0 + 2 * D, "FINISHED", 1, 1, None, None)])
    assert {i: (r.status, r.pnl) for i, r in got.items()} == {1: ("WON", 10.0), 2: ("LOST", -10.0), 5: ("LOST", -10.0), 6: ("HALF_WIN", 5.0)}
    assert got[2].settled_at == T0 + 2 * D and got[5].closing_odds is None and got[5].clv is None
    got = feed.run(results=[(4, T0 + 3 * D, "POSTPONED", None, None, None, None), (77, T0 + 20 * D, "FT", 1, 1, None, None)])
    assert (got[4].status, got[4].pnl) == ("VOID", 0.0) and (got[3].status, got[3].settled_at) == ("VOID", T0 + 10 * D)
    got = feed.run(results=[(3, T0 + 21 * D, "FT", 1, 0, None, None)])
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[3].status == "VOID"


def test_grace_waits_for_the_clock_and_corners_for_counts(spark):
    feed = Feed(spark)
    early = [(1, T0 + H, "FINISHED", 1, 0, None, None)]
    assert feed.run(bets=[bet(1, 1), bet(2, 1, "CORNERS", "Over", 9.5)], results=early) == {}
    got = feed.run(results=[(8, T0 + 6 * H, "FINISHED", 0, 0, None, None)])
    assert set(got) == {1} and got[1].settled_at == T0 + 2 * H
    got = feed.run(results=[(1, T0 + 90 * D, "FINISHED", 1, 0, 6, 4)])  # months late, long behind the clock or not
    assert got[2].status == "WON" and got[2].settled_at == T0 + 90 * D
    got = feed.run(bets=[bet(3, 1, selection="A", placed=T0 - D)])
    assert got[3].status == "LOST"


def test_a_hot_match_is_dealt_over_slots_and_batches_do_not_matter(spark):
    bets = [bet(i, 1 if i % 3 == 0 else i, "AH", "Home", -0.25 * (i % 5), odds=1.5 + i % 7 / 10) for i in range(1, 200)]
    results = [(m, T0 + (3 + m % 9) * H, "FT", m % 4, m % 3, None, None) for m in range(1, 200)]
    whole = Feed(spark, slots=5).run(bets, results)
    parts = Feed(spark, slots=2)
    parts.run(bets[:70], results[100:])
    parts.run(bets[70:130], results[40:100])
    assert parts.run(bets[130:], results[:40]) == whole and len(whole) == 199
