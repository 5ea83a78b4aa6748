"""Team histories: unpivoted matches, rolling means, rest, density, imputation, equity and streaks.

Frames are keyed by team, so work spreads over teams; the order is (date, match) and rows see earlier rows of their day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = ("match_id", "match_date", "comp", "season")


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for each side: team, opponent, goals for and against, and side statistics."""
    home = F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit(1).alias("at_home"), F.col("fthg").alias("gf"), F.col("ftag").alias("ga"), F.col("hst").alias("sot"), F.col("hc").alias("corners"), F.col("hs").alias("shots"))
    away = F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit(0).alias("at_home"), F.col("ftag").alias("gf"), F.col("fthg").alias("ga"), F.col("awst").alias("sot"), F.col("ac").alias("corners"), F.col("aws").alias("shots"))
    return matches.select(*HISTORY, F.explode(F.array(home, away)).alias("side")).select(*HISTORY, "side.*")


def by_team() -> Window:
    return Window.partitionBy("team").orderBy("match_date", "match_id")


def mean_last(value: Column, n: int, skip_missing: bool) -> Column:
    """Mean over the last ``n`` earlier rows; one missing value makes it null unless skipped."""
    frame = by_team().rowsBetween(-n, -1)
    mean = F.avg(value).over(frame)
    return mean if skip_missing else F.when(F.count(value).over(frame) == F.count(F.lit(1)).over(frame), mean)


def sum_last(value: Column, n: int) -> Column:
    return F.sum(value).over(by_team().rowsBetween(-n, -1))


def rest_days(cap: int | None = None, default: int = 14) -> Column:
    """Days since the team's previous match; beyond ``cap`` the default.  A debut is null."""
    gap = F.date_diff("match_date", F.lag("match_date").over(by_team()))
    return gap if cap is None else F.when(gap > cap, default).otherwise(gap)


def density(days: int = 14) -> Column:
    """Earlier rows (of the day too) dated within ``days`` before."""
    day = F.unix_date("match_date")
    within = F.count(F.lit(1)).over(Window.partitionBy("team").orderBy(day).rangeBetween(-days, 0))
    of_day = Window.partitionBy("team", "match_date")
    return within - F.count(F.lit(1)).over(of_day) + F.row_number().over(of_day.orderBy("match_id")) - 1


def result_points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def imputed_by_earlier_days(rows: DataFrame, day: str, value: str) -> DataFrame:
    """Missing values become the mean over strictly earlier days, else zero: column ``imputed``.

    Values are first summed by day, so the running frame has one row a day however many rows a day has.
    """
    daily = rows.groupBy(day).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    means = daily.select(day, F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("prior"))
    return rows.join(means, day).withColumn("imputed", F.coalesce(F.col(value), F.col("prior"), F.lit(0.0)))


def equity(daily: DataFrame, day: str, pnl: str, initial: float) -> DataFrame:
    """One row a day: equity after it, and the running peak that starts at the initial bankroll."""
    upto = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("equity", F.lit(initial) + F.sum(pnl).over(upto))
    return curve.withColumn("peak", F.greatest(F.lit(initial), F.max("equity").over(upto)))
