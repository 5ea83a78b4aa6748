"""Walk-forward backtest: strengths fitted before each fold, fixtures priced, gated, staked by day and settled.

Folds are rows.  Sums by pair of teams are kept by the half-year in which their matches lie and scaled to one origin, so the sums
before every fold are a running total over half-years, decayed to the fold's last training day; one plan fits all folds and
competitions, however many years there are.
Stakes of a day are shares of the bankroll at its opening, so the bankroll is a running product over days.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import capped_kelly, expected_value
from ..streaming.jobs import stored
from . import models, score_matrix

ODDS_BAND = (1.40, 3.50)
EV_BAND = (0.05, 0.50)
SLOTS = 5


def plus(d: dt.date, m: int) -> dt.date:
    """``m`` months later, at most the month's last day."""
    y, mo = divmod(d.year * 12 + d.month - 1 + m, 12)
    days = (dt.date(y + (mo == 11), (mo + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, mo + 1, min(d.day, days))


def folds(first: dt.date, last: dt.date, train_years: int = 2, months: int = 6) -> list[tuple[dt.date, dt.date]]:
    """Half-open test windows; a fold trains on all before it."""
    out, k = [], 0
    while (b := plus(first, 12 * train_years + months * (k + 1))) <= last:
        out.append((plus(first, 12 * train_years + months * k), b))
        k += 1
    return out


def folds_of(matches: DataFrame, train_years: int = 2, months: int = 6) -> list[tuple[dt.date, dt.date]]:
    """Test windows that hold every match after the first training span; the last may reach beyond the last match."""
    first, last = matches.agg(F.min("match_date"), F.max("match_date")).first()
    if first is None or last < plus(first, 12 * train_years):
        return [(dt.date.max, dt.date.max)]  # nothing to test: one empty window
    windows = folds(first, last, train_years, months)
    begin = windows[-1][1] if windows else plus(first, 12 * train_years)
    return windows + ([(begin, plus(first, 12 * train_years + months * (len(windows) + 1)))] if last >= begin else [])


SUMS = ("w", "gh", "ga", "n00", "n01", "n10", "n11")


def fold_of(matches: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """``matches`` with ``fold``: 0 before the first test window, then the window's number; later matches go."""
    spark = matches.sparkSession
    begins = spark.createDataFrame([(b,) for b, _ in windows], "begin date").agg(F.sort_array(F.collect_list("begin")).alias("begins"), F.lit(windows[-1][1]).alias("end"))
    rows = matches.crossJoin(F.broadcast(begins))  # one row
    return rows.where(F.col("match_date") < F.col("end")).withColumn("fold", F.size(F.filter("begins", lambda b: b <= F.col("match_date")))).drop("begins", "end")


def fold_statistics(dated: DataFrame, last: int, decay: float = models.DECAY) -> DataFrame:
    """``comp, home, away, fold`` and decayed sums over all matches before the fold, for folds 1 to ``last``."""
    origin = dated.agg(F.min("match_date").alias("origin"))
    rows = dated.where("fthg IS NOT NULL AND ftag IS NOT NULL AND fold < " + str(last)).crossJoin(F.broadcast(origin))  # one row
    grown = rows.withColumn("g", F.exp(decay * F.date_diff("match_date", "origin")))
    cell = lambda x, y: F.sum(F.when((F.col("fthg") == x) & (F.col("ftag") == y), F.col("g")).otherwise(0.0)).alias(f"n{x}{y}")
    pair = ("comp", "home", "away")
    sums = grown.groupBy(*pair, "fold").agg(F.sum("g").alias("w"), F.sum(F.col("fthg") * F.col("g")).alias("gh"), F.sum(F.col("ftag") * F.col("g")).alias("ga"), cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), F.max(F.date_diff("match_date", "origin")).alias("end"))
    sums = stored(sums.withColumn("fold", F.col("fold") + 1), "half-years")  # a half-year's matches count from the next fold on; matches are summed once
    later = lambda t, *by: t.groupBy(*by).agg(F.min("fold").alias("first")).select(*by, F.explode(F.sequence("first", F.lit(last))).alias("fold"))
    before = lambda *by: Window.partitionBy(*by).orderBy("fold")
    running = later(sums, *pair).join(sums, [*pair, "fold"], "left").select(*pair, "fold", *(F.sum(F.coalesce(c, F.lit(0.0))).over(before(*pair)).alias(c) for c in SUMS))
    ends = sums.groupBy("comp", "fold").agg(F.max("end").alias("end"))
    ends = later(ends, "comp").join(ends, ["comp", "fold"], "left").select("comp", "fold", F.exp(-decay * F.max("end").over(before("comp"))).alias("shrink"))
    return running.join(ends, ["comp", "fold"]).select(*pair, "fold", *((F.col(c) * F.col("shrink")).alias(c) for c in SUMS))


def _fit_fold(stats: pd.DataFrame) -> pd.DataFrame:
    return models.fit_group(stats).assign(fold=int(stats["fold"].iloc[0]))


def fit_folds(matches: DataFrame, windows: list[tuple[dt.date, dt.date]], decay: float = models.DECAY) -> DataFrame:
    """Strengths by competition and fold, from all matches before the fold."""
    return fold_statistics(fold_of(matches, windows), len(windows), decay).groupBy("comp", "fold").applyInPandas(_fit_fold, models.FIT + ", fold int")


def priced_folds(matches: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """Matches of all folds with outcome probabilities by strengths of the matches before their fold."""
    dated = fold_of(matches, windows)
    fit = fold_statistics(dated, len(windows)).groupBy("comp", "fold").applyInPandas(_fit_fold, models.FIT + ", fold int")
    test = dated.where("fold > 0")
    side = lambda k: fit.select("comp", "fold", F.col("team").alias(k), F.col("att").alias(f"{k}_att"), F.col("def").alias(f"{k}_def"), F.col("advantage").alias(f"{k}_adv"), F.col("rho").alias(f"{k}_rho"))
    of = ["comp", "fold"]
    pairs = test.select(*of, "home", "away").distinct().join(side("home"), [*of, "home"]).join(side("away").drop("away_adv", "away_rho"), [*of, "away"])
    pairs = pairs.select(*of, "home", "away", F.exp(F.col("home_att") - F.col("away_def") + F.col("home_adv")).alias("lh"), F.exp(F.col("away_att") - F.col("home_def")).alias("la"), F.col("home_rho").alias("rho"))
    cells = score_matrix.scores(pairs, F.col("rho"))
    part = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0)) / F.sum("w")
    probs = cells.groupBy(*of, "home", "away").agg(part(F.col("x") > F.col("y")).alias("ph"), part(F.col("x") == F.col("y")).alias("pd"), part(F.col("x") < F.col("y")).alias("pa"))
    return test.join(probs, [*of, "home", "away"])


def candidates(priced: DataFrame, odds: DataFrame) -> DataFrame:
    """Legs within the odds and value bands, the best of each match, then the day's slots."""
    legs = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), F.col(p).alias("p"), F.col(o).alias("odds")) for s, p, o in (("H", "ph", "h"), ("D", "pd", "d"), ("A", "pa", "a"))))).alias("leg")
    rows = priced.join(odds, "match_id").select("match_id", "match_date", "ftr", legs).select("match_id", "match_date", "ftr", "leg.*")
    rows = rows.withColumn("ev", expected_value(F.col("p"), F.col("odds"))).where(F.col("odds").between(*ODDS_BAND) & F.col("ev").between(*EV_BAND))
    order = (F.desc("ev"), F.col("match_id"), F.col("selection"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("match_id").orderBy(*order))).where("k = 1")
    return best.withColumn("k", F.row_number().over(Window.partitionBy("match_date").orderBy(*order))).where(F.col("k") <= SLOTS).drop("k")


def ledger(bets: DataFrame, bankroll: float = 10_000.0) -> DataFrame:
    """One row a day: bets, the day's return on its opening bankroll, and the bankroll after it."""
    pct = capped_kelly(F.col("p"), F.col("odds"))
    gain = pct * F.when(F.col("selection") == F.col("ftr"), F.col("odds") - 1).otherwise(-1.0)
    days = bets.groupBy("match_date").agg(F.count("*").alias("bets"), F.sum(gain).alias("r"))
    return days.withColumn("bankroll", bankroll * F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(Window.orderBy("match_date"))))


def walk_forward(matches: DataFrame, odds: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """Bets of all test windows."""
    return candidates(priced_folds(matches, windows), odds)
