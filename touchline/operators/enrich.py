"""Bulk enrichment of bets with both teams' recent history, as one merge in place of a join for each feature.

What a side's history says depends on its team and day only, so days are asked once, and a day's matches are reduced to their
count and to the last measured ones, of which no later day reaches back to more.  These rows are one table, dealt by team and
sorted by day, asked days before matches of the same day: its length grows with days, not with bets or matches.  Running counts
carry the history along: the last day played, the matches within the lookback, and a running number of measured matches, of
which a range reaches back exactly so many measured matches.  Bets then meet the answers to their pair of teams and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK_DAYS, BUSY, MEASURED = 14, 3, 5
FEATURES = ("rest_days", "matches_in_lookback", "rolling_xg", "rotation_risk")


def fatigue_label(rest: Column, played: Column, busy: int = BUSY) -> Column:
    """How tired a side is: busy from so many matches on, short of rest up to three days; empty without history."""
    return F.when(rest.isNull(), "").when(played >= busy, "busy").when(rest <= 3, "short rest").otherwise("fresh")


def team_history(matches: DataFrame, xg_home: Column, xg_away: Column) -> DataFrame:
    """``team, day, tie, xg`` of each side of each match."""
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), xg_home.alias("xg")), F.struct(F.col("away").alias("team"), xg_away.alias("xg")))).alias("s")
    return matches.select(F.col("match_date").alias("day"), F.col("match_id").cast("long").alias("tie"), sides).select("s.team", "day", "tie", F.col("s.xg").cast("double").alias("xg"))


def enriched(bets: DataFrame, history: DataFrame, lookback: int = LOOKBACK_DAYS, busy: int = BUSY, measured: int = MEASURED) -> DataFrame:
    """``bets(bet_id, home, away, day)`` with ``FEATURES`` of both sides, from ``history`` before the bet's day.

    A side without earlier matches has null rest and measure and no matches; matches without a measure count for rest only.
    """
    pairs = bets.select("home", "away", "day").distinct()
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away").alias("team")))).alias("s")).select("home", "away", "day", "s.*")
    asked = sides.select("day", "team").distinct()
    latest = Window.partitionBy("day", "team").orderBy(F.desc("tie"))
    measures = history.where("xg IS NOT NULL").withColumn("k", F.row_number().over(latest)).where(F.col("k") <= measured)
    days = history.groupBy("day", "team").agg(F.count("*").alias("n"))
    as_tall = lambda rows, played, n=F.lit(0), tie=None, xg=None: rows.select("team", "day", F.lit(played).alias("played"), n.cast("long").alias("n"), F.lit(tie).cast("long").alias("tie"), F.lit(xg).cast("double").alias("xg"))
    tall = as_tall(asked, 0).unionByName(as_tall(days, 1, F.col("n"))).unionByName(as_tall(measures, 1, tie=F.col("tie"), xg=F.col("xg"))).withColumn("number", F.unix_date("day"))
    team = Window.partitionBy("team")
    order = team.orderBy("number", "played", "tie")
    before, near = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), team.orderBy("number").rangeBetween(-lookback, -1)
    tall = tall.withColumns(
        {
            "last": F.max(F.when(F.col("played") == 1, F.col("number"))).over(before),
            "in_lookback": F.coalesce(F.sum("n").over(near), F.lit(0).cast("long")),
            "measures": F.count("xg").over(before),
        }
    )
    recent = F.avg("xg").over(team.orderBy("measures").rangeBetween(-(measured - 1), 0))  # asked rows have none of their own
    rows = tall.withColumn("recent", recent).where("played = 0")
    rows = rows.withColumns({"rest_days": (F.col("number") - F.col("last")).cast("int"), "matches_in_lookback": F.col("in_lookback"), "rolling_xg": F.col("recent"), "rotation_risk": F.col("in_lookback") >= busy})
    rows = rows.select(F.col("team").alias("_team"), F.col("day").alias("_day"), *FEATURES)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    both = sides.join(rows, F.col("team").eqNullSafe(F.col("_team")) & F.col("day").eqNullSafe(F.col("_day"))).groupBy("home", "away", "day").agg(*(pick(side, c) for side in ("home", "away") for c in FEATURES))
    both = both.withColumnsRenamed({c: f"_{c}" for c in ("home", "away", "day")})
    out = bets.join(both, F.col("home").eqNullSafe(F.col("_home")) & F.col("away").eqNullSafe(F.col("_away")) & F.col("day").eqNullSafe(F.col("_day")))
    label = F.concat(*(x for side in ("home", "away") for x in ((F.lit(" / "),) if side == "away" else ()) + (fatigue_label(F.col(f"{side}_rest_days"), F.col(f"{side}_matches_in_lookback"), busy),)))
    rest = [c for c in bets.columns if c != "bet_id"]
    return out.select("bet_id", *rest, *(f"{side}_{c}" for side in ("home", "away") for c in FEATURES), label.alias("fatigue"))
