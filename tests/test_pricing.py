"""Hand-computed pricing and settlement values."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import pricing as P


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first().v


def bet(spark, market, selection, line, home, away, odds=1.9, stake=100.0):
    df = spark.createDataFrame([(market, selection, line, home, away, odds, stake)], "market string, selection string, line double, h int, a int, odds double, stake double")
    r = P.rank_of_bet(F.col("market"), F.col("selection"), F.col("line"), F.col("h"), F.col("a"))
    row = df.select(P.label(r).alias("label"), P.profit(r, F.col("odds"), F.col("stake")).alias("pnl"), P.payout(r, F.col("odds"), F.col("stake")).alias("payout")).first()
    return row.label, round(row.pnl, 9), round(row.payout, 9)


@pytest.mark.parametrize(
    "args,want",
    [
        (("AH", "Home", -0.25, 1, 1, 1.95), ("HALF_LOSS", -50.0, 50.0)),
        (("AH", "Home", -0.75, 1, 0, 1.90), ("HALF_WIN", 45.0, 145.0)),
        (("AH", "Home", -0.75, 0, 0, 1.90), ("LOSS", -100.0, 0.0)),
        (("AH", "Away", 0.0, 1, 1, 1.90), ("PUSH", 0.0, 100.0)),
        (("OU", "Over", 2.25, 1, 1, 2.0), ("HALF_LOSS", -50.0, 50.0)),
        (("OU", "Under", 2.25, 1, 1, 2.0), ("HALF_WIN", 50.0, 150.0)),
        (("OU", "Over", 2.0, 1, 1, 2.0), ("PUSH", 0.0, 100.0)),
        (("1X2", "H", None, 2, 1, 2.5), ("WIN", 150.0, 250.0)),
        (("1X2", "D", None, 2, 1, 2.5), ("LOSS", -100.0, 0.0)),
    ],
)
def test_settlement(spark, args, want):
    assert bet(spark, *args) == want


def test_known_values(spark):
    L = F.lit
    assert value(spark, P.clv_log(L(2.20), L(2.00))) == pytest.approx(math.log(1.1))
    assert value(spark, P.clv_ratio(L(2.10), L(2.00))) == pytest.approx(0.05)
    assert value(spark, P.commission(L(10.0), 0.02)) == pytest.approx(9.8)
    assert value(spark, P.commission(L(-5.0), 0.02)) == -5
    assert value(spark, P.settlement_ev(L(0.437), L(0.0), L(0.0), L(0.300), L(2.0))) == pytest.approx(0.137)
    assert value(spark, 1 / P.push_adjusted(L(0.437), L(0.0), L(0.0), L(0.300))) == pytest.approx(1 + 0.300 / 0.437)
    assert value(spark, P.xg_proxy(L(10), L(4))) == pytest.approx(2.2)
    assert value(spark, P.xg_strict(L(10), L(None).cast("int"))) is None
    assert value(spark, P.expected_value(L(1.2), L(2.0))) is None
    assert value(spark, P.capped_kelly(L(0.9), L(5.0))) == pytest.approx(0.01)
    assert value(spark, P.american_to_decimal(L(-150))) == pytest.approx(1.667)
    assert value(spark, P.american_to_decimal(L(0))) is None


def test_shin_against_known_values(spark):
    got = value(spark, P.devig_shin(F.lit(2.10), F.lit(3.40), F.lit(3.50)))
    assert got == pytest.approx([0.4558147, 0.2762347, 0.2679506], abs=1e-7)
    assert value(spark, P.devig_shin(F.lit(2.10), F.lit(None).cast("double"), F.lit(3.5))) is None


def test_devig_sums_to_one(spark):
    for kind in (P.devig_multiplicative, P.devig_additive):
        parts = kind(F.lit(1.5), F.lit(4.2), F.lit(7.0))
        assert sum(value(spark, p) for p in parts) == pytest.approx(1.0)
