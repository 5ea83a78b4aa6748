"""The value-bet query from fixtures to slots, the walk-forward backtest, names and small projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scaling as X
from ..functions.pricing import capped_kelly, expected_value
from ..operators import backtest as B
from ..operators import names as N
from ..operators import recommend as R
from ..operators import score_matrix as S
from ..operators import windows as W
from ..projection import domain
from ..registry import query
from ..streaming.jobs import stored
from .columns import first_family, settled
from .scores import CELLS_SQL, mass_sql


@query(
    "value_bets",
    f"""WITH {CELLS_SQL.strip()}, prob AS (SELECT home, away, sum(CASE WHEN x > y THEN w ELSE 0 END) / sum(w) AS ph, sum(CASE WHEN x = y THEN w ELSE 0 END) / sum(w) AS pd, sum(CASE WHEN x < y THEN w ELSE 0 END) / sum(w) AS pa FROM cells GROUP BY home, away),
o AS (SELECT match_id, CASE WHEN b365h > 1 AND b365d > 1 AND b365a > 1 THEN [b365h, b365d, b365a] WHEN avgh > 1 AND avgd > 1 AND avga > 1 THEN [avgh, avgd, avga] ELSE [maxh, maxd, maxa] END AS o FROM odds),
legs AS (SELECT m.match_id, match_date, 'H' AS selection, ph AS p, o[1] AS odds FROM matches m JOIN prob USING (home, away) JOIN o ON m.match_id = o.match_id UNION ALL SELECT m.match_id, match_date, 'D', pd, o[2] FROM matches m JOIN prob USING (home, away) JOIN o ON m.match_id = o.match_id
  UNION ALL SELECT m.match_id, match_date, 'A', pa, o[3] FROM matches m JOIN prob USING (home, away) JOIN o ON m.match_id = o.match_id),
e AS (SELECT *, round(p * odds - 1, 9) AS ev FROM legs), k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, selection) AS k FROM e WHERE ev >= 0.05e0 AND ev <= 0.5e0 AND NOT (odds > 15 AND p > 0.1e0)),
s AS (SELECT *, row_number() OVER (PARTITION BY match_date ORDER BY ev DESC, match_id) AS slot FROM k WHERE k = 1)
SELECT match_date, CAST(slot AS INT) AS slot, match_id, selection, round(odds, 6) AS odds, round(ev, 6) AS ev, round(least(least(greatest((p * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0), 6) AS stake_pct FROM s WHERE slot <= 5""",
    ("matches", "odds", "strengths"),
)
def value_bets(spark, sf_dir):
    """Price all fixtures, coalesce odds, gate by value and sanity, best leg a match, five a day, capped stakes."""
    matches = domain(spark, sf_dir, "matches")
    prob = S.outcome(S.scores(S.rates(matches, domain(spark, sf_dir, "strengths"))))
    odds = domain(spark, sf_dir, "odds").select("match_id", first_family().alias("o"))
    legs = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), F.col(p).alias("p"), F.col(f"o.{o}").alias("odds")) for s, p, o in (("H", "ph", "h"), ("D", "pd", "d"), ("A", "pa", "a"))))).alias("leg")
    rows = matches.select("match_id", "match_date", "home", "away").join(prob, ["home", "away"]).join(odds, "match_id").select("match_id", "match_date", legs).select("match_id", "match_date", "leg.*")
    rows = rows.withColumn("ev", F.round(expected_value(F.col("p"), F.col("odds")), 9)).where("ev BETWEEN 0.05 AND 0.5 AND NOT (odds > 15 AND p > 0.1)")
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("ev"), "selection"))).where("k = 1")
    slots = best.withColumn("slot", F.row_number().over(Window.partitionBy("match_date").orderBy(F.desc("ev"), "match_id"))).where("slot <= 5")
    return slots.select("match_date", "slot", "match_id", "selection", F.round("odds", 6).alias("odds"), F.round("ev", 6).alias("ev"), F.round(capped_kelly(F.col("p"), F.col("odds")), 6).alias("stake_pct"))


@query("walk_forward_backtest")
def walk_forward_backtest(spark, sf_dir):
    """Bankroll by day over folds of half a year from a year after the first match to the last; strengths are refitted for each
    fold, so there is no SQL."""
    matches = domain(spark, sf_dir, "matches")
    odds = domain(spark, sf_dir, "odds").select("match_id", first_family().alias("o")).select("match_id", "o.h", "o.d", "o.a")
    return B.ledger(B.walk_forward(matches, odds, B.folds_of(matches, 1, 6)))


@query("name_resolution")
def name_resolution(spark, sf_dir):
    """Misspelt brand names back to brands; similarity has no SQL form, so it is tested on names with known answers."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand")
    brands = part.select(F.xxhash64("p_type").alias("entity"), F.col("p_type").alias("alias")).distinct()
    typed = part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("X"))).otherwise(F.lower("p_type")).alias("name"))
    return N.resolve(typed, brands)


@query(
    "perspective_results",
    "SELECT team, w, count(*) AS n FROM (SELECT home AS team, CASE ftr WHEN 'H' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END AS w FROM matches UNION ALL SELECT away, CASE ftr WHEN 'A' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END FROM matches) t GROUP BY 1, 2",
    ("matches",),
)
def perspective_results(spark, sf_dir):
    rows = W.team_rows(domain(spark, sf_dir, "matches"))
    letter = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    return rows.groupBy("team", letter.alias("w")).agg(F.count("*").alias("n"))


@query("normal_labels", "SELECT CASE bet_id % 5 WHEN 0 THEN 'WIN' WHEN 1 THEN 'LOSS' WHEN 2 THEN 'VOID' WHEN 3 THEN 'HALF_WIN' ELSE 'PENDING' END AS label, count(*) AS n FROM bets GROUP BY 1", ("bets",))
def normal_labels(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, ("won", " Lost", "REFUND", "half_won", "pending"))), (F.col("bet_id") % 5).cast("int"))
    return domain(spark, sf_dir, "bets").groupBy(X.normal_label(raw).alias("label")).agg(F.count("*").alias("n"))


@query("kpi_statuses", "SELECT comp, count(*) AS n FROM bets b JOIN matches m ON b.match_id = m.match_id WHERE market = '1X2' AND status <> 'PENDING' GROUP BY comp", ("matches", "bets"))
def kpi_statuses(spark, sf_dir):
    """Whole results only; half results can't come from three-way bets."""
    return settled(spark, sf_dir).where("market = '1X2' AND status <> 'PENDING' AND label IN ('WIN', 'LOSS', 'PUSH')").groupBy("comp").agg(F.count("*").alias("n"))


@query(
    "sample_weights",
    """WITH n AS (SELECT team, season, count(*) AS n FROM (SELECT home AS team, season FROM matches UNION ALL SELECT away, season FROM matches) t GROUP BY 1, 2) SELECT team, season, round(least(n / 300e0, 1), 8) AS weight, round(CASE WHEN n < 200 THEN least(0.01e0, 0.005e0) ELSE 0.01e0 END, 8) AS cap FROM n""",
    ("matches",),
)
def sample_weights(spark, sf_dir):
    n = W.team_rows(domain(spark, sf_dir, "matches")).groupBy("team", "season").agg(F.count("*").alias("n"))
    return n.select("team", "season", F.round(X.sample_weight(F.col("n"), 300), 8).alias("weight"), F.round(X.new_team_cap(F.lit(0.01), F.col("n") < 200), 8).alias("cap"))


@query("tier_scales", "SELECT match_id, CASE WHEN home >= 15 OR away >= 15 OR match_id % 4 = 0 THEN 0.8e0 ELSE 1e0 END AS scale FROM matches", ("matches",))
def tier_scales(spark, sf_dir):
    weight = F.when(F.col("match_id") % 4 != 0, 0.9)
    return domain(spark, sf_dir, "matches").select("match_id", X.tier_scale(F.col("home") < 15, F.col("away") < 15, weight).alias("scale"))


@query("confidence_scale", "SELECT bet_id, round(CASE WHEN bet_id % 2 = 0 THEN p_model * 100 ELSE least(p_model * 150, 100) END, 6) AS confidence FROM bets WHERE p_model >= 0.02e0", ("bets",))
def confidence_scale(spark, sf_dir):
    x = F.when(F.col("bet_id") % 2 == 0, F.col("p_model")).otherwise(F.col("p_model") * 150)
    return domain(spark, sf_dir, "bets").where("p_model >= 0.02").select("bet_id", F.round(X.confidence_percent(x), 6).alias("confidence"))


@query("line_disparities", "SELECT bet_id, 0.25e0 * round(abs(line - 2.6e0) / 0.25e0) AS gap FROM bets WHERE market = 'OU'", ("bets",))
def line_disparities(spark, sf_dir):
    return domain(spark, sf_dir, "bets").where("market = 'OU'").select("bet_id", X.line_disparity(F.col("line"), F.lit(2.6)).alias("gap"))


@query(
    "tiered_ensemble",
    """WITH t AS (SELECT pred_id, CASE WHEN pred_id % 101 >= 85 THEN 'A' WHEN pred_id % 101 >= 50 THEN 'B' ELSE 'X' END AS tier, ph, pd, pa FROM predictions),
b AS (SELECT *, CASE tier WHEN 'A' THEN 0.4e0 * ph + 0.35e0 * pa + 0.25e0 / 3 WHEN 'B' THEN 0.6e0 * ph + 0.4e0 / 3 ELSE 1e0 / 3 END AS h, CASE tier WHEN 'A' THEN 0.4e0 * pd + 0.35e0 * pd + 0.25e0 / 3 WHEN 'B' THEN 0.6e0 * pd + 0.4e0 / 3 ELSE 1e0 / 3 END AS d,
  CASE tier WHEN 'A' THEN 0.4e0 * pa + 0.35e0 * ph + 0.25e0 / 3 WHEN 'B' THEN 0.6e0 * pa + 0.4e0 / 3 ELSE 1e0 / 3 END AS a FROM t)
SELECT pred_id, tier, round((0.85e0 * h / (h + d + a) + 0.05e0) , 8) AS h FROM b""",
    ("predictions",),
)
def tiered_ensemble(spark, sf_dir):
    """Member weights by data tier, then the pull toward a uniform market; without a tier the forecast is uniform."""
    tier = X.quality_tier(F.col("pred_id") % 101, 85.0, 50.0, "X")
    rows = domain(spark, sf_dir, "predictions").withColumn("tier", tier)
    third = F.lit(1.0 / 3)
    mix = lambda x, y: F.when(F.col("tier") == "A", 0.40 * F.col(x) + 0.35 * F.col(y) + 0.25 * third).when(F.col("tier") == "B", 0.60 * F.col(x) + 0.40 * third).otherwise(third)
    parts = [mix("ph", "pa"), mix("pd", "pd"), mix("pa", "ph")]
    total = parts[0] + parts[1] + parts[2]
    return rows.select("pred_id", "tier", F.round(X.pulled([p / total for p in parts], [third] * 3)[0], 8).alias("h"))


@query(
    "upcoming_within_days",
    "SELECT comp, count(*) AS n FROM matches WHERE match_date >= (SELECT max(match_date) - 60 FROM matches) AND match_date <= (SELECT max(match_date) - 46 FROM matches) AND comp NOT IN ('3-MEDIUM') GROUP BY comp",
    ("matches",),
)
def upcoming_within_days(spark, sf_dir):
    """A closed range of fourteen days, seen from sixty days before the newest match, without leagues whose feed is stale."""
    matches = domain(spark, sf_dir, "matches")
    today = matches.agg(F.date_sub(F.max("match_date"), 60).alias("today"))
    m = matches.join(F.broadcast(today), F.col("match_date").between(F.col("today"), F.date_add("today", 14)))  # one row is broadcast
    return m.where(~F.col("comp").isin("3-MEDIUM")).groupBy("comp").agg(F.count("*").alias("n"))


@query(
    "team_profile",
    """WITH t AS (SELECT home AS team, match_id, match_date, fthg AS gf, ftag AS ga, comp FROM matches UNION ALL SELECT away, match_id, match_date, ftag, fthg, comp FROM matches), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS k FROM t)
SELECT team, count(*) AS n, round(avg(gf), 8) AS gf, round(avg(ga), 8) AS ga, count(DISTINCT comp) AS comps, min(match_date) AS since FROM r WHERE k <= 10 GROUP BY team""",
    ("matches",),
)
def team_profile(spark, sf_dir):
    ranked = W.team_rows(domain(spark, sf_dir, "matches")).withColumn("k", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id")))).where("k <= 10")
    return ranked.groupBy("team").agg(F.count("*").alias("n"), F.round(F.avg("gf"), 8).alias("gf"), F.round(F.avg("ga"), 8).alias("ga"), F.count_distinct("comp").alias("comps"), F.min("match_date").alias("since"))


@query(
    "strength_table",
    "SELECT team, round(att + def, 8) AS net, CAST(rank() OVER (ORDER BY att + def DESC) AS INT) AS place FROM strengths",
    ("strengths",),
)
def strength_table(spark, sf_dir):
    net = F.round(F.col("att") + F.col("def"), 8)
    return domain(spark, sf_dir, "strengths").select("team", net.alias("net"), F.rank().over(Window.orderBy(F.desc(F.col("att") + F.col("def")))).alias("place"))


def _priced_fixtures(spark, sf_dir):
    """Fixtures with the prices of one book; a handicap needs both its prices, a total too."""
    c = F.col
    odds = domain(spark, sf_dir, "odds").select("match_id", c("b365h").alias("h"), c("b365d").alias("d"), c("b365a").alias("a"), F.when(c("b365_o25").isNotNull(), 2.5).alias("total"), c("b365_o25").alias("over"), c("b365_u25").alias("under"), c("ahh").alias("handicap"), c("b365ahh").alias("ah_home"), c("b365aha").alias("ah_away"))
    return domain(spark, sf_dir, "matches").select("match_id", "match_date", "comp", "home", "away").join(odds, "match_id")


def _leg_sql():
    """Masses of every leg of the priced fixtures, as a chain of common table expressions ending in ``legs``."""
    totals = mass_sql("(x + y)", "2.5e0", 1).replace("lines AS", "t_lines AS").replace("cells, lines)", "cells, t_lines)").replace(", r AS (", ", t_r AS (").replace("FROM r GROUP", "FROM t_r GROUP").replace("masses AS", "t AS")
    margins = mass_sql("(x - y)", "-1.5e0", 13).split(", lines AS", 1)[1].replace("FROM cells, lines)", "FROM cells, m_lines)").replace(", r AS (", ", m_r AS (").replace("FROM r GROUP", "FROM m_r GROUP").replace("masses AS", "m AS")
    return f"""{totals}, m_lines AS{margins},
o AS (SELECT home, away, sum(CASE WHEN x > y THEN w ELSE 0 END) / sum(w) AS ph, sum(CASE WHEN x = y THEN w ELSE 0 END) / sum(w) AS pd, sum(CASE WHEN x < y THEN w ELSE 0 END) / sum(w) AS pa FROM cells GROUP BY home, away),
f AS (SELECT match_id, home, away, odds.* EXCLUDE (match_id) FROM matches JOIN odds USING (match_id)),
legs AS (SELECT match_id, 'H' AS leg, NULL::DOUBLE AS line, b365h AS price, ph AS win, 0e0 AS half_win, 0e0 AS half_loss, 1 - ph AS lose FROM f JOIN o USING (home, away)
UNION ALL SELECT match_id, 'D', NULL, b365d, pd, 0e0, 0e0, 1 - pd FROM f JOIN o USING (home, away)
UNION ALL SELECT match_id, 'A', NULL, b365a, pa, 0e0, 0e0, 1 - pa FROM f JOIN o USING (home, away)
UNION ALL SELECT match_id, 'Over', 2.5e0, b365_o25, win, half_win, half_loss, lose FROM f JOIN t USING (home, away) WHERE b365_o25 IS NOT NULL
UNION ALL SELECT match_id, 'Under', 2.5e0, b365_u25, lose, half_loss, half_win, win FROM f JOIN t USING (home, away) WHERE b365_o25 IS NOT NULL
UNION ALL SELECT match_id, 'AH home', ahh, b365ahh, win, half_win, half_loss, lose FROM f JOIN m ON f.home = m.home AND f.away = m.away AND m.line = -f.ahh
UNION ALL SELECT match_id, 'AH away', -ahh, b365aha, lose, half_loss, half_win, win FROM f JOIN m ON f.home = m.home AND f.away = m.away AND m.line = -f.ahh),
v AS (SELECT *, (win + half_win / 2) / (win + half_win / 2 + lose + half_loss / 2) AS p, win * (price - 1) + half_win * (price - 1) / 2 - half_loss / 2 - lose AS ev FROM legs WHERE price > 1)"""


@query(
    "priced_legs",
    f"""WITH RECURSIVE {_leg_sql()}, s AS (SELECT match_id, leg, price - 1 AS b, win, half_win, half_loss, lose, 0e0 AS lo, 1 - 1e-9 AS hi, 0 AS k FROM v WHERE line IS NOT NULL AND ev > 0
  UNION ALL SELECT match_id, leg, b, win, half_win, half_loss, lose, CASE WHEN d > 0 THEN m ELSE lo END, CASE WHEN d > 0 THEN hi ELSE m END, k + 1 FROM (
    SELECT *, win * b / (1 + m * b) + half_win * b / 2 / (1 + m * b / 2) - half_loss * 0.5e0 / (1 - m * 0.5e0) - lose / (1 - m) AS d FROM (SELECT *, (lo + hi) / 2 AS m FROM s WHERE k < 50) t) u)
SELECT v.match_id, v.leg, line, round(price, 6) AS price, round(p, 8) AS p, round(ev, 8) AS ev, round(1 / p, 6) AS fair,
  round(CASE WHEN line IS NULL THEN least(least(greatest((p * price - 1) / (price - 1), 0), 1) * 0.1e0, 0.01e0) ELSE least(coalesce((lo + hi) / 2, 0) * 0.1e0, 0.01e0) END, 7) AS stake, ev >= 0.05e0 AS recommended
FROM v LEFT JOIN (SELECT match_id, leg, lo, hi FROM s WHERE k = 50) z ON z.match_id = v.match_id AND z.leg = v.leg""",
    ("matches", "odds", "strengths"),
)
def priced_legs(spark, sf_dir):
    """Seven legs of every fixture with probability, value, fair price, stake and flag."""
    fixtures = stored(_priced_fixtures(spark, sf_dir), "fixtures")
    rates = S.rates(fixtures, domain(spark, sf_dir, "strengths")).select("home", "away", "lh", "la", F.lit(S.RHO).alias("rho"), F.lit(False).alias("is_new"))
    legs = R.priced_legs(fixtures, rates, ["home", "away"])
    r = lambda c, n: F.round(c, n).alias(c)
    return legs.select("match_id", "leg", (F.col("line") + 0.0).alias("line"), r("price", 6), r("p", 8), r("ev", 8), r("fair", 6), r("stake", 7), "recommended")


@query("legs_by_fitted_version")
def legs_by_fitted_version(spark, sf_dir):
    """Legs of every fixture after the first year by the newest half-yearly fit that began before it; a fit has no SQL."""
    matches = domain(spark, sf_dir, "matches")
    windows = B.folds_of(matches, 1, 6)
    begins = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(windows, 1)], "fold int, version date")
    bundle = stored(B.fit_folds(matches, windows).join(begins, "fold").drop("fold"), "fits")
    fixtures = stored(R.versions_as_of(_priced_fixtures(spark, sf_dir), bundle).where("version IS NOT NULL"), "fixtures")
    return R.priced_legs(fixtures, stored(R.rates_of(fixtures, bundle), "rates"), ["comp", "version", "home", "away"])
