"""Priced legs of fixtures: probability, value, fair price and stake of every side of three markets, from versioned strengths.

Score masses are made once for each pair of teams and version, and of all lines that its fixtures have; a fixture meets its pair's row
in one equi-join, and takes its own lines out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import KELLY_MULTIPLIER, STAKE_CAP, capped_kelly, expected_value, push_adjusted, settlement_ev, settlement_kellys
from ..streaming.jobs import stored
from . import score_matrix as S

LEAST_EV = 0.05
#: Stakes on teams without a fit are capped at half.
NEW_TEAM_CAP = STAKE_CAP / 2
#: Fractions from here on are staked at the cap and need not be solved.
MOST_KELLY = STAKE_CAP / KELLY_MULTIPLIER
MASSES = ("win", "half_win", "push", "half_loss", "lose")


def versions_as_of(fixtures: DataFrame, bundle: DataFrame) -> DataFrame:
    """``fixtures(comp, match_date)`` with ``version``: the newest of ``bundle(comp, version)`` begun on or before the day, else null.

    Versions are few, so they are one row that comes to the fixtures, which stay where they are.
    """
    begun = bundle.where("comp IS NOT NULL").groupBy("comp").agg(F.collect_set("version").alias("begun"))
    begun = begun.agg(F.map_from_entries(F.collect_list(F.struct("comp", "begun"))).alias("_begun"))
    newest = F.array_max(F.filter(F.try_element_at("_begun", F.col("comp")), lambda v: v <= F.col("match_date")))
    return fixtures.crossJoin(F.broadcast(begun)).select(*fixtures.columns, newest.alias("version"))  # one row is broadcast


def rates_of(fixtures: DataFrame, bundle: DataFrame) -> DataFrame:
    """``comp, version, home, away, lh, la, rho, is_new`` of the distinct pairs of fixtures with a version.

    Teams that a version doesn't know take its mean strengths less 0.3.
    """
    of = ["comp", "version"]
    prior = bundle.groupBy(*of).agg((F.avg("att") - 0.3).alias("prior_att"), (F.avg("def") - 0.3).alias("prior_def"), F.max("advantage").alias("advantage"), F.max("rho").alias("rho"))
    side = lambda k: bundle.select(*of, F.col("team").alias(k), F.col("att").alias(f"{k}_att"), F.col("def").alias(f"{k}_def"))
    pairs = fixtures.select(*of, "home", "away").distinct().join(prior, of)
    pairs = pairs.join(side("home"), [*of, "home"], "left").join(side("away"), [*of, "away"], "left")
    get = lambda c, d: F.coalesce(F.col(c), F.col(d))
    lh = F.exp(get("home_att", "prior_att") - get("away_def", "prior_def") + F.col("advantage"))
    la = F.exp(get("away_att", "prior_att") - get("home_def", "prior_def"))
    return pairs.select(*of, "home", "away", lh.alias("lh"), la.alias("la"), "rho", (F.col("home_att").isNull() | F.col("away_att").isNull()).alias("is_new"))


def line_masses(cells: DataFrame, keys: list[str], value: Column, lines: DataFrame) -> DataFrame:
    """Settlement masses of ``value`` over the lines that fixtures of a pair have: ``lines`` holds ``keys, line``."""
    grouped = cells.groupBy(*keys, value.alias("v")).agg(F.sum("w").alias("w"))
    low, high = F.floor(F.col("line") * 2) / 2, F.ceil(F.col("line") * 2) / 2
    r = F.signum(F.col("v") - low) + F.signum(F.col("v") - high)
    part = lambda k: F.sum(F.when(r == k, F.col("w")).otherwise(0.0)) / F.sum("w")
    met = lines.select(*keys, "line").distinct().join(grouped, keys)
    return met.groupBy(*keys, "line").agg(*(part(k).alias(n) for k, n in zip((2, 1, 0, -1, -2), MASSES)))


def _leg(name: str, line: Column, price: Column, masses: list[Column], kelly: Column) -> Column:
    return F.struct(F.lit(name).alias("leg"), line.alias("line"), price.alias("price"), *(m.alias(n) for m, n in zip(masses, MASSES)), kelly.alias("kelly"))


def pair_masses(rates: DataFrame, keys: list[str], fixtures: DataFrame) -> DataFrame:
    """``keys, is_new, ph, pd, pa, totals, margins``: a row a pair, with the masses of each of its fixtures' lines by line."""
    cells = S.scores(rates, F.col("rho"))
    part = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0)) / F.sum("w")
    x, y = F.col("x"), F.col("y")
    outcome = cells.groupBy(*keys).agg(part(x > y).alias("ph"), part(x == y).alias("pd"), part(x < y).alias("pa"), F.max("is_new").alias("is_new"))
    lines = fixtures.select(*keys, "total", (0.0 - F.col("handicap")).alias("margin")).distinct()
    of = lambda line: lines.where(F.col(line).isNotNull()).select(*keys, F.col(line).alias("line"))
    pack = lambda t, name: t.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct(*MASSES)))).alias(name))
    totals = pack(line_masses(cells, keys, x + y, of("total")), "totals")
    return outcome.join(totals, keys, "left").join(pack(line_masses(cells, keys, x - y, of("margin")), "margins"), keys, "left")


def priced_legs(fixtures: DataFrame, rates: DataFrame, keys: list[str], least_ev: float = LEAST_EV) -> DataFrame:
    """``match_id, leg, line, price, p, ev, fair, stake, recommended`` of the legs that have a price, up to seven a fixture.

    ``fixtures``: match_id, ``keys``, prices h, d, a, line and prices total, over, under, handicap of the home side and prices
    ah_home, ah_away; ``rates``: ``keys``, lh, la, rho, is_new.  ``p`` counts half-settled stakes by half and leaves pushes out.
    Fixtures are read twice, once for their lines: give a stored table, if they are dear to make.
    """
    pairs = stored(pair_masses(rates, keys, fixtures), "pair-masses")  # bounded by teams and lines; joined by its known size
    rows = fixtures.join(pairs, keys).withColumns({"t": F.try_element_at("totals", F.col("total")), "m": F.try_element_at("margins", 0.0 - F.col("handicap"))}).drop("totals", "margins")
    one = lambda p: [F.col(p), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0 - F.col(p)]
    of = lambda s, back=False: [F.col(f"{s}.{n}") for n in (MASSES[::-1] if back else MASSES)]
    none = F.lit(None).cast("double")
    sides = (("Over", F.col("total"), F.col("over"), of("t")), ("Under", F.col("total"), F.col("under"), of("t", True)), ("AH home", F.col("handicap"), F.col("ah_home"), of("m")), ("AH away", -F.col("handicap"), F.col("ah_away"), of("m", True)))
    kellys = settlement_kellys([(w, hw, hl, lo, price) for _, _, price, (w, hw, _, hl, lo) in sides], MOST_KELLY)
    legs = [_leg(n, none, F.col(c), one(p), none) for n, c, p in (("H", "h", "ph"), ("D", "d", "pd"), ("A", "a", "pa"))]
    legs += [_leg(*side, kelly) for side, kelly in zip(sides, kellys)]
    each = rows.select("match_id", "is_new", F.explode(F.array(*legs)).alias("l")).select("match_id", "is_new", "l.*").where("price > 1 AND win IS NOT NULL")
    w, hw, _, hl, lo = (F.col(m) for m in MASSES)
    p, side = push_adjusted(w, hw, hl, lo), F.col("line").isNotNull()
    ev = F.when(side, settlement_ev(w, hw, hl, lo, F.col("price"))).otherwise(expected_value(w, F.col("price")))
    growth = F.when(F.col("kelly") >= MOST_KELLY, F.lit(STAKE_CAP)).otherwise(F.least(F.col("kelly") * KELLY_MULTIPLIER, F.lit(STAKE_CAP)))
    stake = F.when(side, growth).otherwise(capped_kelly(w, F.col("price")))
    stake = F.when(F.col("is_new"), F.least(stake, F.lit(NEW_TEAM_CAP))).otherwise(stake)
    priced = each.select("match_id", "leg", "line", "price", p.alias("p"), ev.alias("ev"), (1.0 / p).alias("fair"), stake.alias("stake")).where("p > 0")
    return priced.withColumn("recommended", F.col("ev") >= least_ev)
