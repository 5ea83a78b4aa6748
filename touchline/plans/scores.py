"""Queries over score distributions and model fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.pricing import push_adjusted, settlement_ev, stake_at_risk
from ..operators import models as L
from ..operators import score_matrix as S
from ..operators import windows as W
from ..projection import domain
from ..registry import query

CELLS_SQL = """
pairs AS (SELECT home, away, exp(h.att - a.def + 0.25e0) AS lh, exp(a.att - h.def) AS la FROM (SELECT DISTINCT home, away FROM matches) m JOIN strengths h ON m.home = h.team JOIN strengths a ON m.away = a.team),
g AS (SELECT unnest(range(0, 11)) AS k), cells AS (SELECT home, away, x.k AS x, y.k AS y, exp(-lh) * pow(lh, x.k) / factorial(CAST(x.k AS INT)) * exp(-la) * pow(la, y.k) / factorial(CAST(y.k AS INT))
  * CASE WHEN x.k = 0 AND y.k = 0 THEN 1 + lh * la * 0.05e0 WHEN x.k = 0 AND y.k = 1 THEN 1 - lh * 0.05e0 WHEN x.k = 1 AND y.k = 0 THEN 1 - la * 0.05e0 WHEN x.k = 1 AND y.k = 1 THEN 1.05e0 ELSE 1e0 END AS w FROM pairs, g x, g y)"""


def mass_sql(value: str, first: str, n: int) -> str:
    return f"""{CELLS_SQL.strip()}, lines AS (SELECT {first} + 0.25e0 * unnest(range(0, {n})) AS line), r AS (SELECT home, away, line, w, sign({value} - floor(line * 2) / 2) + sign({value} - ceil(line * 2) / 2) AS r FROM cells, lines),
masses AS (SELECT home, away, line, sum(CASE WHEN r = 2 THEN w ELSE 0 END) / sum(w) AS win, sum(CASE WHEN r = 1 THEN w ELSE 0 END) / sum(w) AS half_win, sum(CASE WHEN r = 0 THEN w ELSE 0 END) / sum(w) AS push,
  sum(CASE WHEN r = -1 THEN w ELSE 0 END) / sum(w) AS half_loss, sum(CASE WHEN r = -2 THEN w ELSE 0 END) / sum(w) AS lose FROM r GROUP BY home, away, line)"""


def cells(spark, sf_dir):
    return S.scores(S.rates(domain(spark, sf_dir, "matches"), domain(spark, sf_dir, "strengths")))


@query(
    "score_matrix_1x2",
    f"WITH {CELLS_SQL.strip()} SELECT home, away, round(sum(CASE WHEN x > y THEN w ELSE 0 END) / sum(w), 8) AS ph, round(sum(CASE WHEN x = y THEN w ELSE 0 END) / sum(w), 8) AS pd, round(sum(CASE WHEN x < y THEN w ELSE 0 END) / sum(w), 8) AS pa FROM cells GROUP BY home, away",
    ("matches", "strengths"),
)
def score_matrix_1x2(spark, sf_dir):
    return S.outcome(cells(spark, sf_dir)).select("home", "away", *(F.round(c, 8).alias(c) for c in ("ph", "pd", "pa")))


def _rounded(table):
    return table.select("home", "away", "line", *(F.round(c, 8).alias(c) for c in ("win", "half_win", "push", "half_loss", "lose")))


_ROUND = "SELECT home, away, line, round(win, 8) AS win, round(half_win, 8) AS half_win, round(push, 8) AS push, round(half_loss, 8) AS half_loss, round(lose, 8) AS lose FROM masses"


@query("over_under_masses", f"WITH {mass_sql('(x + y)', '1.5e0', 13)} {_ROUND}", ("matches", "strengths"))
def over_under_masses(spark, sf_dir):
    return _rounded(S.masses(cells(spark, sf_dir), F.col("x") + F.col("y"), S.TOTAL_LINES))


@query("handicap_masses", f"WITH {mass_sql('(y - x)', '-3e0', 25)} {_ROUND}", ("matches", "strengths"))
def handicap_masses(spark, sf_dir):
    """Masses of the away margin over each line: the away side's handicap seen from its line."""
    return _rounded(S.masses(cells(spark, sf_dir), F.col("y") - F.col("x"), S.HANDICAP_LINES))


@query(
    "fair_total_line",
    f"WITH {mass_sql('(x + y)', '1.5e0', 13)}, c AS (SELECT home, away, line, (win + half_win / 2) / (win + half_win / 2 + lose + half_loss / 2) AS cover FROM masses), b AS (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY round(abs(cover - 0.5e0), 12), line) AS k FROM c) SELECT home, away, line, round(cover, 8) AS cover FROM b WHERE k = 1",
    ("matches", "strengths"),
)
def fair_total_line(spark, sf_dir):
    return S.fair_line(S.masses(cells(spark, sf_dir), F.col("x") + F.col("y"), S.TOTAL_LINES)).select("home", "away", "line", F.round("cover", 8).alias("cover"))


@query(
    "settlement_pricing",
    f"WITH {mass_sql('(x + y)', '1.5e0', 13)} SELECT home, away, line, round(win * 0.9e0 + half_win * 0.45e0 - half_loss / 2 - lose, 8) AS ev, round(win + lose + (half_win + half_loss) / 2, 8) AS at_risk, round(1 / ((win + half_win / 2) / (win + half_win / 2 + lose + half_loss / 2)), 6) AS fair_odds FROM masses",
    ("matches", "strengths"),
)
def settlement_pricing(spark, sf_dir):
    m = [F.col(c) for c in ("win", "half_win", "half_loss", "lose")]
    table = S.masses(cells(spark, sf_dir), F.col("x") + F.col("y"), S.TOTAL_LINES)
    return table.select("home", "away", "line", F.round(settlement_ev(*m, F.lit(1.9)), 8).alias("ev"), F.round(stake_at_risk(*m), 8).alias("at_risk"), F.round(1 / push_adjusted(*m), 6).alias("fair_odds"))


@query(
    "corner_distribution",
    """WITH r AS (SELECT comp, avg(hc + ac) AS rate FROM matches WHERE hc IS NOT NULL AND ac IS NOT NULL GROUP BY comp), g AS (SELECT unnest(range(0, 21)) AS k), p AS (SELECT comp, k, exp(-rate) * pow(rate, k) / CAST(factorial(CAST(k AS INT)) AS DOUBLE) AS m FROM r, g)
SELECT comp, round(sum(CASE WHEN k > 9.5e0 THEN m ELSE 0 END) / sum(m), 8) AS over95, round(sum(CASE WHEN k = 10 THEN m ELSE 0 END) / sum(m), 8) AS push10 FROM p GROUP BY comp""",
    ("matches",),
)
def corner_distribution(spark, sf_dir):
    """Poisson masses of total corners, cut at twenty and renormalised."""
    rate = domain(spark, sf_dir, "matches").where("hc IS NOT NULL AND ac IS NOT NULL").groupBy("comp").agg(F.avg(F.col("hc") + F.col("ac")).alias("rate"))
    p = rate.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("m", S.poisson(F.col("k"), F.col("rate")))
    part = lambda c: F.round(F.sum(F.when(c, F.col("m")).otherwise(0.0)) / F.sum("m"), 8)
    return p.groupBy("comp").agg(part(F.col("k") > 9.5).alias("over95"), part(F.col("k") == 10).alias("push10"))


@query(
    "corner_dispersion",
    "SELECT comp, round(greatest(0, least(1, (var_samp(hc) - avg(hc)) / (avg(hc) * avg(hc)))), 8) AS dispersion FROM matches GROUP BY comp",
    ("matches",),
)
def corner_dispersion(spark, sf_dir):
    return L.dispersion(domain(spark, sf_dir, "matches"), "hc", "comp").select("comp", F.round("dispersion", 8).alias("dispersion"))


@query(
    "corner_handicap",
    """WITH r AS (SELECT comp, avg(hc) AS lh, avg(ac) AS la FROM matches GROUP BY comp), g AS (SELECT unnest(range(0, 21)) AS k), c AS (SELECT comp, x.k - y.k AS d, exp(-lh) * pow(lh, x.k) / CAST(factorial(CAST(x.k AS INT)) AS DOUBLE) * exp(-la) * pow(la, y.k) / CAST(factorial(CAST(y.k AS INT)) AS DOUBLE) AS w FROM r, g x, g y)
SELECT comp, round(sum(CASE WHEN d > 1.5e0 THEN w ELSE 0 END) / sum(w), 8) AS cover FROM c GROUP BY comp""",
    ("matches",),
)
def corner_handicap(spark, sf_dir):
    """Difference of two Poisson counts beyond a corner and a half."""
    r = domain(spark, sf_dir, "matches").groupBy("comp").agg(F.avg("hc").alias("lh"), F.avg("ac").alias("la"))
    k = F.sequence(F.lit(0), F.lit(20))
    c = r.select("*", F.explode(k).alias("x")).select("*", F.explode(k).alias("y")).withColumn("w", S.poisson(F.col("x"), F.col("lh")) * S.poisson(F.col("y"), F.col("la")))
    return c.groupBy("comp").agg(F.round(F.sum(F.when(F.col("x") - F.col("y") > 1.5, F.col("w")).otherwise(0.0)) / F.sum("w"), 8).alias("cover"))


@query(
    "negative_binomial_tail",
    """WITH r AS (SELECT comp, avg(hc + ac) AS rate FROM matches GROUP BY comp), k AS (SELECT unnest(range(10, 41)) AS k)
SELECT comp, round(sum(exp(lgamma(k + 10) - lgamma(k + 1) - lgamma(10) + 10 * ln(10 / (10 + rate)) + k * ln(rate / (10 + rate)))), 8) AS over95 FROM r, k GROUP BY comp""",
    ("matches",),
)
def negative_binomial_tail(spark, sf_dir):
    """Tail beyond nine and a half corners under negative-binomial counts."""
    m = domain(spark, sf_dir, "matches")
    rate = m.groupBy("comp").agg(F.avg(F.col("hc") + F.col("ac")).alias("rate"), F.lit(0.1).alias("dispersion"))
    masses = rate.withColumn("p", S.negative_binomial(F.col("rate"), F.col("dispersion"), 40))
    return masses.select("comp", F.round(F.aggregate(F.slice("p", 11, 31), F.lit(0.0), lambda a, x: a + x), 8).alias("over95"))


@query("fit_team_strengths")
def fit_team_strengths(spark, sf_dir):
    """Strengths by competition; an iterative fit, tested by recovery of known strengths."""
    return L.fit_strengths(domain(spark, sf_dir, "matches"))


@query("fit_corner_rates")
def fit_corner_rates(spark, sf_dir):
    return L.fit_counts(domain(spark, sf_dir, "matches"))


@query("calibrated_probabilities")
def calibrated_probabilities(spark, sf_dir):
    """Isotonic calibration of the predictions; an iterative fit."""
    rows = domain(spark, sf_dir, "predictions").where("p IS NOT NULL")
    model = L.isotonic(rows, "p", "y")
    return model.transform(rows.withColumn("features", F.col("p"))).select("pred_id", "p", F.col("prediction").alias("calibrated"))


@query("outcome_classifier")
def outcome_classifier(spark, sf_dir):
    """Class probabilities of results from rolling form; an iterative fit."""
    m = domain(spark, sf_dir, "matches")
    form = W.team_rows(m).where("at_home = 1").select("match_id", W.mean_last(F.col("gf"), 5, True).alias("gf5"), W.mean_last(F.col("ga"), 5, True).alias("ga5"))
    rows = m.select("match_id", "ftr").join(form, "match_id")
    model = L.outcome_classifier(rows, ["gf5", "ga5"], "ftr")
    return model.transform(rows.select("match_id", F.col("gf5").cast("double"), F.col("ga5").cast("double"))).select("match_id", F.col("prediction").cast("int").alias("best"))


@query(
    "corner_rates_by_side",
    """WITH m2 AS (SELECT comp, home, away, hc, ac FROM matches WHERE hc IS NOT NULL AND ac IS NOT NULL)
SELECT comp, 'home' AS side, home AS team, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(hc) AS DOUBLE), 3) AS corners_for, round(CAST(sum(ac) AS DOUBLE), 3) AS corners_against FROM m2 GROUP BY comp, home
UNION ALL SELECT comp, 'away', away, CAST(count(*) AS BIGINT), round(CAST(sum(ac) AS DOUBLE), 3), round(CAST(sum(hc) AS DOUBLE), 3) FROM m2 GROUP BY comp, away""",
    ("matches",),
)
def corner_rates_by_side(spark, sf_dir):
    """Corners that the fitted Poisson models of each side expect by team: greatest likelihood makes them the observed totals."""
    m = domain(spark, sf_dir, "matches")
    rates = L.count_rates(m)
    played = m.where("hc IS NOT NULL AND ac IS NOT NULL").groupBy("comp", "home", "away").agg(F.count("*").alias("n"))
    expected = played.join(rates, ["comp", "home", "away"])
    total = lambda rate: F.round(F.sum(F.col("n") * F.col(rate)), 3)
    one = lambda side, mine, its: expected.groupBy("comp", F.lit(side).alias("side"), F.col(side).alias("team")).agg(F.sum("n").alias("n"), total(mine).alias("corners_for"), total(its).alias("corners_against"))
    return one("home", "rate_home", "rate_away").unionByName(one("away", "rate_away", "rate_home"))


@query("corner_dispersion_around_rates")
def corner_dispersion_around_rates(spark, sf_dir):
    """Over-dispersion of total corners around their fitted rates, and the chance of more than nine; tested against direct least squares."""
    rates = L.count_rates(domain(spark, sf_dir, "matches"))
    masses = rates.withColumn("p", S.negative_binomial(F.col("rate_home") + F.col("rate_away"), F.col("dispersion"), 40))
    return masses.select("comp", "home", "away", "rate_home", "rate_away", "dispersion", F.aggregate(F.slice("p", 11, 31), F.lit(0.0), lambda a, x: a + x).alias("over95"))


def _form_rows(spark, sf_dir):
    m = domain(spark, sf_dir, "matches")
    side = lambda at_home, name: W.team_rows(m).select("match_id", "at_home", W.mean_last(F.col("gf"), 5, True).alias(f"{name}_for"), W.mean_last(F.col("ga"), 5, True).alias(f"{name}_against")).where(F.col("at_home") == at_home).drop("at_home")
    return m.select("match_id", "match_date", "ftr").join(side(1, "home"), "match_id").join(side(0, "away"), "match_id")


FORM = ["home_for", "home_against", "away_for", "away_against"]


@query("boosted_outcome_probabilities")
def boosted_outcome_probabilities(spark, sf_dir):
    """Outcome probabilities of every match by boosted trees over both sides' form, calibrated on the later quarter of days."""
    rows = _form_rows(spark, sf_dir)
    return L.boosted_outcomes(rows, FORM).transform(rows.select("match_id", *FORM)).select("match_id", "ph", "pd", "pa")


@query("boosted_feature_importances")
def boosted_feature_importances(spark, sf_dir):
    """Features by their weight in each outcome's trees, heaviest first."""
    weights = L.boosted_outcomes(_form_rows(spark, sf_dir), FORM).importances(spark)
    return weights.withColumn("rank", F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc("importance"), "feature")))
