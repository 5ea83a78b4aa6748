"""Prices from the joint distribution of goals: one row a fixture and score, summed by map-side combined aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import push_adjusted, quarter_split

MAX_GOALS = 10
HOME_ADVANTAGE, RHO = 0.25, -0.05
#: Over/under and handicap grids, by quarters.
TOTAL_LINES = tuple(1.5 + 0.25 * i for i in range(13))
HANDICAP_LINES = tuple(-3.0 + 0.25 * i for i in range(25))


def poisson(k: Column, rate: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))


def low_score_factor(x: Column, y: Column, lh: Column, la: Column, rho: Column | float) -> Column:
    """The four-cell correction of low scores."""
    return (
        F.when((x == 0) & (y == 0), 1 - lh * la * rho)
        .when((x == 0) & (y == 1), 1 + lh * rho)
        .when((x == 1) & (y == 0), 1 + la * rho)
        .when((x == 1) & (y == 1), F.lit(1.0) - rho)
        .otherwise(1.0)
    )


def rates(fixtures: DataFrame, strengths: DataFrame, advantage: float = HOME_ADVANTAGE) -> DataFrame:
    """``lh, la`` of distinct (home, away) pairs from a table of team, att, def; unknown teams take the mean less 0.3."""
    prior = strengths.agg((F.avg("att") - 0.3).alias("pa"), (F.avg("def") - 0.3).alias("pd"))
    side = lambda k: strengths.select(F.col("team").alias(k), F.col("att").alias(f"{k}_att"), F.col("def").alias(f"{k}_def"))
    pairs = fixtures.select("home", "away").distinct().join(side("home"), "home", "left").join(side("away"), "away", "left").crossJoin(F.broadcast(prior))  # one row is broadcast
    get = lambda c, d: F.coalesce(F.col(c), F.col(d))
    lh = F.exp(get("home_att", "pa") - get("away_def", "pd") + advantage)
    la = F.exp(get("away_att", "pa") - get("home_def", "pd"))
    return pairs.select("home", "away", lh.alias("lh"), la.alias("la"))


def scores(pairs: DataFrame, rho: Column | float = RHO, top: int = MAX_GOALS) -> DataFrame:
    """``home, away, x, y, w``: unnormalised mass of each score."""
    goals = F.sequence(F.lit(0), F.lit(top))
    cells = pairs.select("*", F.explode(goals).alias("x")).select("*", F.explode(goals).alias("y"))
    x, y = F.col("x"), F.col("y")
    w = F.greatest(poisson(x, F.col("lh")) * poisson(y, F.col("la")) * low_score_factor(x, y, F.col("lh"), F.col("la"), rho), F.lit(0.0))
    return cells.withColumn("w", w)


def outcome(cells: DataFrame) -> DataFrame:
    """Home, draw and away probabilities, renormalised after truncation."""
    part = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0)) / F.sum("w")
    return cells.groupBy("home", "away").agg(part(F.col("x") > F.col("y")).alias("ph"), part(F.col("x") == F.col("y")).alias("pd"), part(F.col("x") < F.col("y")).alias("pa"))


def masses(cells: DataFrame, value: Column, lines: tuple[float, ...]) -> DataFrame:
    """Win, half-win, push, half-loss and loss masses of ``value`` over each line.

    Scores of equal ``value`` are summed first, so lines multiply a few rows a fixture and not all scores.
    """
    grouped = cells.groupBy("home", "away", value.alias("v")).agg(F.sum("w").alias("w"))
    lined = grouped.withColumn("line", F.explode(F.array(*map(F.lit, lines))))
    low, high = quarter_split(F.col("line"))
    r = F.signum(F.col("v") - low) + F.signum(F.col("v") - high)
    part = lambda k: (F.sum(F.when(r == k, F.col("w")).otherwise(0.0)) / F.sum("w"))
    names = ((2, "win"), (1, "half_win"), (0, "push"), (-1, "half_loss"), (-2, "lose"))
    return lined.groupBy("home", "away", "line").agg(*(part(k).alias(n) for k, n in names))


def fair_line(table: DataFrame) -> DataFrame:
    """The line whose push-adjusted probability is nearest one half; ties go to the smaller line."""
    cover = push_adjusted(*(F.col(c) for c in ("win", "half_win", "half_loss", "lose")))
    gap = F.round(F.abs(cover - 0.5), 12)
    best = table.groupBy("home", "away").agg(F.min_by(F.struct("line", cover.alias("cover")), F.struct(gap, F.col("line"))).alias("b"))
    return best.select("home", "away", "b.line", "b.cover")


def negative_binomial(rate: Column, dispersion: Column, top: int) -> Column:
    """Array of NB2 masses 0 .. top by the recurrence over counts; no dispersion gives Poisson masses."""
    size = 1.0 / dispersion
    q = rate / (rate + size)
    start = F.struct(F.pow(1.0 - q, size).alias("p"), F.array(F.pow(1.0 - q, size)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * (size + k - 1) / k * q
        return F.struct(p.alias("p"), F.concat(s["all"], F.array(p)).alias("all"))

    over = F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step, lambda s: s["all"])
    plain = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: poisson(k, rate))
    return F.when(dispersion > 1e-6, over).otherwise(plain)
