"""Name resolution, walk-forward folds and ledger, text and date columns, streamed exposure against a replay."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.functions import dates as D
from touchline.functions import payloads as J
from touchline.functions import scaling as X
from touchline.functions import strings as S
from touchline.operators import backtest as B
from touchline.operators import names as N
from touchline.registry import QUERIES
from touchline.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_names_resolve_by_key_then_similarity(spark):
    known = spark.createDataFrame([(1, "Málaga CF"), (2, "Manchester United"), (3, "Twin"), (4, "twin")], "entity long, alias string")
    asked = spark.createDataFrame([("malaga cf",), ("FC Manchester United",), ("Manchester Unted",), ("Twin",), ("Zzz",)], "name string")
    got = {r.name: (r.entity, r.step) for r in N.resolve(asked, known).collect()}
    assert got["malaga cf"] == (1, "key") and got["FC Manchester United"] == (2, "key")
    assert got["Manchester Unted"] == (2, "fuzzy") and got["Zzz"] == (None, "staged")
    assert got["Twin"][1] == "fuzzy"  # a key that two entities share decides nothing


def test_folds_are_half_open_and_months_clamp():
    got = B.folds(dt.date(2019, 1, 1), dt.date(2024, 1, 1), 3, 6)
    assert got[0] == (dt.date(2022, 1, 1), dt.date(2022, 7, 1)) and len(got) == 4
    assert B.folds(dt.date(2019, 8, 31), dt.date(2022, 3, 1), 2, 6)[0] == (dt.date(2021, 8, 31), dt.date(2022, 2, 28))


def test_ledger_compounds_between_days(spark):
    rows = [(1, dt.date(2024, 1, 1), "H", "H", 0.9, 2.0), (2, dt.date(2024, 1, 1), "A", "H", 0.9, 2.0), (3, dt.date(2024, 1, 2), "H", "H", 0.9, 3.0)]
    bets = spark.createDataFrame([(m, d, r, s, p, o) for m, d, s, r, p, o in rows], "match_id int, match_date date, ftr string, selection string, p double, odds double")
    got = [r.bankroll for r in B.ledger(bets, 1000.0).orderBy("match_date").collect()]
    assert got == pytest.approx([1000.0, 1020.0])


def test_strings_and_dates(spark):
    L = F.lit
    assert one(spark, S.team_key(L("FC Köln & Söhne"), L("M"))) == "koln-and-sohne_M"
    assert one(spark, S.humanise(L("JP_VISSEL_KOBE"))) == "Vissel Kobe"
    label, line = S.parse_selection(L("AH Home -0.25"))
    assert (one(spark, label), one(spark, line)) == ("AH Home", -0.25)
    assert one(spark, S.is_sharp(L(" Pinnacle  Sports"))) and not one(spark, S.is_sharp(L("corner shop")))
    assert str(one(spark, D.uk_to_utc(F.to_date(L("2024-07-01")), L(None).cast("string")))) == "2024-07-01 14:00:00"
    low, high = D.local_window(F.to_timestamp(L("2026-03-14 17:30:00")))
    assert (str(one(spark, low)), str(one(spark, high))) == ("2026-03-14 17:00:00", "2026-03-16 17:30:00")
    assert one(spark, D.season_code(D.season_start(F.to_date(L("2025-03-01"))))) == "2425"
    assert one(spark, D.day_first(L("31/02/2024"))) is None


def test_payloads_and_scaling(spark):
    L = F.lit
    a, b = F.create_map(L("x"), L("1"), L("a"), L("2")), F.create_map(L("a"), L("2"), L("x"), L("1"))
    assert one(spark, J.canonical_hash(a)) == one(spark, J.canonical_hash(b))
    assert one(spark, X.ev_fraction(L(12.0))) == pytest.approx(0.12) and one(spark, X.ev_fraction(L(0.12))) == pytest.approx(0.12)
    assert one(spark, X.normal_label(L("refund"))) == "VOID"
    assert sum(one(spark, p) for p in X.tempered([L(0.5), L(0.3), L(0.2)], 1.5)) == pytest.approx(1.0)


def test_streamed_exposure_equals_replay(spark):
    rows = QUERIES["stream_exposure"](spark, SMALL).collect()
    from touchline.functions.pricing import capped_kelly
    from touchline.projection import domain

    stake = {r.bet_id: r.s for r in domain(spark, SMALL, "bets").select("bet_id", capped_kelly(F.col("p_model"), F.col("odds")).alias("s")).collect()}
    used = defaultdict(float)
    for r in sorted(rows, key=lambda r: (r.day, r.bet_id)):
        ok = used[r.day] + stake[r.bet_id] <= 0.05 + 1e-12
        used[r.day] += stake[r.bet_id] if ok else 0.0
        assert r.accepted == ok
    assert jobs.WATERMARK
