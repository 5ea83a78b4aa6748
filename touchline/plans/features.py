"""Queries over team histories and equity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.pricing import xg_strict
from ..operators import enrich as E
from ..operators import windows as W
from ..projection import domain
from ..registry import query
from .columns import SETTLED_SQL, settled

TEAM_SQL = """team_rows AS (
  SELECT match_id, match_date, comp, season, home AS team, away AS opponent, 1 AS at_home, fthg AS gf, ftag AS ga, hst AS sot, hc AS corners, hs AS shots FROM matches
  UNION ALL SELECT match_id, match_date, comp, season, away, home, 0, ftag, fthg, awst, ac, aws FROM matches
)"""
ORDER = "PARTITION BY team ORDER BY match_date, match_id"


def rows(spark, sf_dir):
    return W.team_rows(domain(spark, sf_dir, "matches"))


@query(
    "rolling_stats_skip_missing",
    f"""WITH {TEAM_SQL}, kept AS (SELECT * FROM team_rows WHERE sot IS NOT NULL OR corners IS NOT NULL OR shots IS NOT NULL)
SELECT match_id, team, round(avg(sot) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 8) AS sot5, round(avg(corners) OVER ({ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 8) AS corners10 FROM kept""",
    ("matches",),
)
def rolling_stats_skip_missing(spark, sf_dir):
    kept = rows(spark, sf_dir).where("sot IS NOT NULL OR corners IS NOT NULL OR shots IS NOT NULL")
    return kept.select("match_id", "team", F.round(W.mean_last(F.col("sot"), 5, True), 8).alias("sot5"), F.round(W.mean_last(F.col("corners"), 10, True), 8).alias("corners10"))


@query(
    "rolling_form",
    f"""WITH {TEAM_SQL}
SELECT match_id, team, round(avg(gf) OVER w3, 8) AS gf3, round(avg(ga) OVER w5, 8) AS ga5,
  round(CASE WHEN count(corners) OVER w10 = count(*) OVER w10 THEN avg(corners) OVER w10 END, 8) AS corners10,
  CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w5 AS BIGINT) AS form5 FROM team_rows
WINDOW w3 AS ({ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS ({ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS ({ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    ("matches",),
)
def rolling_form(spark, sf_dir):
    points = W.result_points(F.col("gf"), F.col("ga"))
    return rows(spark, sf_dir).select(
        "match_id", "team", F.round(W.mean_last(F.col("gf"), 3, False), 8).alias("gf3"), F.round(W.mean_last(F.col("ga"), 5, False), 8).alias("ga5"),
        F.round(W.mean_last(F.col("corners"), 10, False), 8).alias("corners10"), W.sum_last(points, 5).alias("form5"),
    )


@query(
    "rest_days",
    f"""WITH {TEAM_SQL}, g AS (SELECT match_id, team, date_diff('day', lag(match_date) OVER ({ORDER}), match_date) AS gap FROM team_rows)
SELECT match_id, team, CAST(gap AS INT) AS rest, CAST(CASE WHEN gap > 30 THEN 14 ELSE gap END AS INT) AS rest_capped FROM g""",
    ("matches",),
)
def rest_days(spark, sf_dir):
    return rows(spark, sf_dir).select("match_id", "team", W.rest_days().alias("rest"), W.rest_days(30).cast("int").alias("rest_capped"))


@query(
    "match_density",
    f"""WITH {TEAM_SQL}, d AS (SELECT *, date_diff('day', DATE '1970-01-01', match_date) AS n FROM team_rows)
SELECT match_id, team, CAST(count(*) OVER (PARTITION BY team ORDER BY n RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY team, n) + row_number() OVER (PARTITION BY team, n ORDER BY match_id) - 1 AS BIGINT) AS n14 FROM d""",
    ("matches",),
)
def match_density(spark, sf_dir):
    return rows(spark, sf_dir).select("match_id", "team", W.density(14).cast("long").alias("n14"))


@query(
    "rotation_flag",
    f"""WITH {TEAM_SQL}, d AS (SELECT *, date_diff('day', DATE '1970-01-01', match_date) AS n FROM team_rows), f AS (
SELECT comp, count(*) OVER (PARTITION BY team ORDER BY n RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY team, n) + row_number() OVER (PARTITION BY team, n ORDER BY match_id) - 1 AS n14 FROM d)
SELECT comp, count(*) FILTER (WHERE n14 >= 4 AND comp = '1-URGENT') AS rotated, count(*) AS n FROM f GROUP BY comp""",
    ("matches",),
)
def rotation_flag(spark, sf_dir):
    """Four matches or more in fourteen days before a cup match; one competition stands for the cup."""
    flagged = rows(spark, sf_dir).withColumn("n14", W.density(14))
    return flagged.groupBy("comp").agg(F.count_if((F.col("n14") >= 4) & (F.col("comp") == "1-URGENT")).alias("rotated"), F.count("*").alias("n"))


@query(
    "point_in_time_imputation",
    """WITH d AS (SELECT match_date, sum(hc) AS s, count(hc) AS n FROM matches GROUP BY match_date),
m AS (SELECT match_date, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS prior FROM d WINDOW w AS (ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, round(coalesce(hc, prior, 0), 8) AS imputed FROM matches JOIN m USING (match_date)""",
    ("matches",),
)
def point_in_time_imputation(spark, sf_dir):
    return W.imputed_by_earlier_days(domain(spark, sf_dir, "matches"), "match_date", "hc").select("match_id", F.round("imputed", 8).alias("imputed"))


@query(
    "opponent_adjusted_rolling",
    f"""WITH {TEAM_SQL}, t AS (SELECT *, gf * (CASE WHEN opponent >= 15 THEN 0.8e0 ELSE 1e0 END) AS v FROM team_rows)
SELECT match_id, team, round(avg(v) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 8) AS adj5 FROM t""",
    ("matches",),
)
def opponent_adjusted_rolling(spark, sf_dir):
    """Goals against the lower tier (teams from 15 on) count 0.8."""
    scaled = F.col("gf") * F.when(F.col("opponent") >= 15, 0.8).otherwise(1.0)
    return rows(spark, sf_dir).select("match_id", "team", F.round(W.mean_last(scaled, 5, True), 8).alias("adj5"))


@query(
    "multi_competition_last",
    f"""WITH {TEAM_SQL} SELECT match_id, team, lag(comp) OVER ({ORDER}) AS last_comp, lag(match_date) OVER ({ORDER}) AS last_date FROM team_rows""",
    ("matches",),
)
def multi_competition_last(spark, sf_dir):
    return rows(spark, sf_dir).select("match_id", "team", F.lag("comp").over(W.by_team()).alias("last_comp"), F.lag("match_date").over(W.by_team()).alias("last_date"))


@query(
    "time_decay_weights",
    """WITH l AS (SELECT max(match_date) AS latest FROM matches) SELECT season, round(sum(exp(-0.0018e0 * date_diff('day', match_date, latest))), 6) AS weight FROM matches, l GROUP BY season""",
    ("matches",),
)
def time_decay_weights(spark, sf_dir):
    matches = domain(spark, sf_dir, "matches")
    latest = matches.agg(F.max("match_date").alias("latest"))
    weight = F.exp(-0.0018 * F.date_diff("latest", "match_date"))
    return matches.crossJoin(F.broadcast(latest)).groupBy("season").agg(F.round(F.sum(weight), 6).alias("weight"))  # one row is broadcast


@query(
    "head_to_head",
    """SELECT least(home, away) AS a, greatest(home, away) AS b, count(*) AS n, count(*) FILTER (WHERE ftr = 'D') AS draws, max(match_date) AS last FROM matches GROUP BY 1, 2""",
    ("matches",),
)
def head_to_head(spark, sf_dir):
    return domain(spark, sf_dir, "matches").groupBy(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("ftr") == "D").alias("draws"), F.max("match_date").alias("last"))


@query(
    "last_five_form",
    f"""WITH {TEAM_SQL}, r AS (SELECT team, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS w, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS k FROM team_rows)
SELECT team, string_agg(w, '' ORDER BY k) AS form FROM r WHERE k <= 5 GROUP BY team""",
    ("matches",),
)
def last_five_form(spark, sf_dir):
    ranked = rows(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id")))).where("k <= 5")
    letter = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    listed = ranked.groupBy("team").agg(F.sort_array(F.collect_list(F.struct("k", letter.alias("w")))).alias("ws"))
    return listed.select("team", F.array_join("ws.w", "").alias("form"))


DAILY_SQL = f"""{SETTLED_SQL.strip()}, daily AS (SELECT day, sum(pnl) AS pnl, sum(stake) AS staked FROM priced GROUP BY day),
curve AS (SELECT day, pnl, 10000 + sum(pnl) OVER (ORDER BY day) AS equity FROM daily), peaked AS (SELECT *, greatest(10000, max(equity) OVER (ORDER BY day)) AS peak FROM curve)"""


def daily(spark, sf_dir):
    return settled(spark, sf_dir).groupBy("day").agg(F.sum("pnl").alias("pnl"), F.sum("stake").alias("staked"))


@query("daily_pnl", f"WITH {DAILY_SQL} SELECT day, round(pnl, 4) AS pnl, round(staked, 4) AS staked FROM daily", ("matches", "bets"))
def daily_pnl(spark, sf_dir):
    return daily(spark, sf_dir).select("day", F.round("pnl", 4).alias("pnl"), F.round("staked", 4).alias("staked"))


@query("equity_curve", f"WITH {DAILY_SQL} SELECT day, round(equity, 3) AS equity, round(peak, 3) AS peak FROM peaked", ("matches", "bets"))
def equity_curve(spark, sf_dir):
    return W.equity(daily(spark, sf_dir), "day", "pnl", 10_000.0).select("day", F.round("equity", 3).alias("equity"), F.round("peak", 3).alias("peak"))


@query("max_drawdown", f"WITH {DAILY_SQL} SELECT round(min((equity - peak) / peak), 8) AS drawdown_low, round(max((peak - equity) / peak), 8) AS drawdown_high FROM peaked", ("matches", "bets"))
def max_drawdown(spark, sf_dir):
    """Both conventions: at most zero, and at least zero."""
    curve = W.equity(daily(spark, sf_dir), "day", "pnl", 10_000.0)
    return curve.agg(F.round(F.min((F.col("equity") - F.col("peak")) / F.col("peak")), 8).alias("drawdown_low"), F.round(F.max((F.col("peak") - F.col("equity")) / F.col("peak")), 8).alias("drawdown_high"))


@query(
    "sharpe",
    f"WITH {DAILY_SQL}, s AS (SELECT equity / lag(equity, 1, 10000) OVER (ORDER BY day) - 1 AS r FROM curve) SELECT round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe FROM s",
    ("matches", "bets"),
)
def sharpe(spark, sf_dir):
    curve = W.equity(daily(spark, sf_dir), "day", "pnl", 10_000.0)
    step = F.col("equity") / F.coalesce(F.lag("equity").over(Window.orderBy("day")), F.lit(10_000.0)) - 1
    return curve.select(step.alias("r")).agg(F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(365.0)), 6).alias("sharpe"))


@query(
    "longest_losing_streak",
    f"""WITH {SETTLED_SQL.strip()}, s AS (SELECT market, r, row_number() OVER (PARTITION BY market ORDER BY day, bet_id) - row_number() OVER (PARTITION BY market, r < 0 ORDER BY day, bet_id) AS g FROM priced),
c AS (SELECT market, g, count(*) AS n FROM s WHERE r < 0 GROUP BY market, g) SELECT market, max(n) AS streak FROM c GROUP BY market""",
    ("matches", "bets"),
)
def longest_losing_streak(spark, sf_dir):
    """Pushes break a streak too.  A day is folded first, so only a row a day and market meets its neighbours."""
    lost = F.col("r") < 0
    day = Window.partitionBy("market", "day")
    marked = settled(spark, sf_dir).select("market", "day", "bet_id", lost.alias("lost"), F.row_number().over(day.orderBy("bet_id")).alias("k"), F.count("*").over(day).alias("bets"))
    runs = marked.where("lost").withColumn("g", F.col("k") - F.row_number().over(day.orderBy("bet_id")))
    runs = runs.groupBy("market", "day", "bets", "g").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    of_day = runs.groupBy("market", "day").agg(
        F.max("n").alias("best"), F.max(F.when(F.col("first") == 1, F.col("n")).otherwise(0)).alias("head"), F.max(F.when(F.col("last") == F.col("bets"), F.col("n")).otherwise(0)).alias("tail"), (F.max("n") == F.max("bets")).alias("whole")
    )
    every = marked.select("market", "day").distinct().join(of_day.withColumnRenamed("market", "m").withColumnRenamed("day", "d"), (F.col("market") == F.col("m")) & F.col("day").eqNullSafe(F.col("d")), "left")
    days = every.select("market", "day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("best", "head", "tail")), F.coalesce("whole", F.lit(False)).alias("whole"))
    over = Window.partitionBy("market").orderBy("day")
    # a block is a day that is not lost whole and the lost days after it
    blocks = days.withColumn("g", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(over)).groupBy("market", "g").agg(
        F.max("best").alias("best"), F.sum(F.when(F.col("whole"), F.col("best")).otherwise(F.col("tail"))).alias("run"), F.max(F.when(~F.col("whole"), F.col("head"))).alias("head")
    )
    joined = blocks.withColumn("through", F.coalesce(F.lag("run").over(Window.partitionBy("market").orderBy("g")), F.lit(0)) + F.coalesce("head", F.lit(0)))
    return joined.groupBy("market").agg(F.max(F.greatest("best", "run", "through")).alias("streak")).where("streak > 0")


@query(
    "bankroll_compounding",
    f"""WITH {SETTLED_SQL.strip()}, d AS (SELECT day, sum(pnl / stake * 1e-4) AS r FROM priced GROUP BY day)
SELECT day, round(10000 * exp(sum(ln(1 + r)) OVER (ORDER BY day)), 2) AS bankroll FROM d""",
    ("matches", "bets"),
)
def bankroll_compounding(spark, sf_dir):
    """All bets of a day stake a share of its opening bankroll, so days multiply."""
    days = settled(spark, sf_dir).groupBy("day").agg(F.sum(F.col("pnl") / F.col("stake") * 1e-4).alias("r"))
    return days.select("day", F.round(10_000 * F.exp(F.sum(F.ln(1 + F.col("r"))).over(Window.orderBy("day"))), 2).alias("bankroll"))


@query(
    "cumulative_pnl",
    f"""WITH {SETTLED_SQL.strip()} SELECT bet_id, market, round(sum(pnl) OVER (PARTITION BY market, season ORDER BY day NULLS LAST, bet_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM priced""",
    ("matches", "bets"),
)
def cumulative_pnl(spark, sf_dir):
    """Sums of earlier days from a table of days, and the day's own running sum."""
    key = ("market", "season")
    rows = settled(spark, sf_dir).select("bet_id", *key, "day", "pnl")
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*key, "day").agg(F.sum("pnl").alias("own")).select(*(F.col(c).alias(f"d_{c}") for c in (*key, "day")), F.coalesce(F.sum("own").over(before), F.lit(0.0)).alias("carried"))
    within = Window.partitionBy(*key, "day").orderBy("bet_id").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in (*key, "day")]
    return rows.withColumn("own", F.sum("pnl").over(within)).join(days, same).select("bet_id", "market", F.round(F.col("carried") + F.col("own"), 4).alias("running"))


@query(
    "walk_forward_splits",
    """WITH s AS (SELECT min(match_date) AS lo, max(match_date) AS hi FROM matches), k AS (SELECT unnest(range(0, (SELECT CAST(date_diff('month', min(match_date), max(match_date)) // 6 + 1 AS BIGINT) FROM matches))) AS i),
t AS (SELECT i, lo, CAST(lo + to_months(CAST(24 + 6 * i AS INT)) AS DATE) AS a, CAST(lo + to_months(CAST(30 + 6 * i AS INT)) AS DATE) AS b, hi FROM s, k)
SELECT CAST(i AS INT) AS fold, count(*) FILTER (WHERE match_date < a) AS train, count(*) FILTER (WHERE match_date >= a AND match_date < b) AS test FROM t JOIN matches ON match_date < b WHERE b <= hi GROUP BY i""",
    ("matches",),
)
def walk_forward_splits(spark, sf_dir):
    """Expanding training window from two years on, half-open tests of six months."""
    matches = domain(spark, sf_dir, "matches")
    span = matches.agg(F.min("match_date").alias("lo"), F.max("match_date").alias("hi"))
    folds = span.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.floor(F.months_between("hi", "lo") / 6).cast("int"))).alias("fold"))
    folds = folds.select("fold", F.add_months("lo", 24 + 6 * F.col("fold")).alias("a"), F.add_months("lo", 30 + 6 * F.col("fold")).alias("b"), "hi").where("b <= hi")
    by_day = matches.groupBy("match_date").count()
    met = by_day.join(F.broadcast(folds), F.col("match_date") < F.col("b"))  # a row for each half-year is broadcast
    return met.groupBy("fold").agg(F.sum(F.when(F.col("match_date") < F.col("a"), F.col("count")).otherwise(0)).alias("train"), F.sum(F.when(F.col("match_date") >= F.col("a"), F.col("count")).otherwise(0)).alias("test"))


_SIDE = """SELECT bet_id, x.rest, x.n, x.xg FROM asked JOIN looked x ON asked.{side} = x.team AND asked.match_date = x.day"""


@query(
    "bets_enriched",
    f"""WITH t AS (SELECT home AS team, match_date AS day, match_id, hs * 0.1e0 + hst * 0.3e0 AS xg FROM matches UNION ALL SELECT away, match_date, match_id, aws * 0.1e0 + awst * 0.3e0 FROM matches),
asked AS (SELECT bet_id, home, away, match_date FROM bets JOIN matches USING (match_id)),
days AS (SELECT DISTINCT team, day FROM t),
h AS (SELECT team, list({{'day': day, 'xg': xg}} ORDER BY day, match_id) AS past FROM t GROUP BY team),
e AS (SELECT days.team, days.day, list_filter(past, lambda x: x.day < days.day) AS before FROM days JOIN h USING (team)),
looked AS (SELECT team, day, date_diff('day', before[-1].day, day) AS rest, len(list_filter(before, lambda x: x.day >= e.day - 14)) AS n, list_avg(list_transform(list_filter(before, lambda x: x.xg IS NOT NULL)[-5:], lambda x: x.xg)) AS xg FROM e),
h1 AS ({_SIDE.format(side="home")}), a1 AS ({_SIDE.format(side="away")})
SELECT bet_id, CAST(h1.rest AS INT) AS home_rest_days, CAST(a1.rest AS INT) AS away_rest_days, CAST(h1.n AS BIGINT) AS home_n, CAST(a1.n AS BIGINT) AS away_n, round(h1.xg, 8) AS home_xg, round(a1.xg, 8) AS away_xg,
  h1.n >= 3 AS home_risk, CASE WHEN h1.rest IS NULL THEN '' WHEN h1.n >= 3 THEN 'busy' WHEN h1.rest <= 3 THEN 'short rest' ELSE 'fresh' END || ' / ' || CASE WHEN a1.rest IS NULL THEN '' WHEN a1.n >= 3 THEN 'busy' WHEN a1.rest <= 3 THEN 'short rest' ELSE 'fresh' END AS fatigue
FROM h1 JOIN a1 USING (bet_id)""",
    ("matches", "bets"),
)
def bets_enriched(spark, sf_dir):
    """Rest, density, measured form and rotation risk of both sides of every bet, in one merge with all history."""
    m = domain(spark, sf_dir, "matches")
    history = E.team_history(m, xg_strict(F.col("hs"), F.col("hst")), xg_strict(F.col("aws"), F.col("awst")))
    bets = domain(spark, sf_dir, "bets").select("bet_id", "match_id").join(m.select("match_id", "home", "away", F.col("match_date").alias("day")), "match_id")
    r = E.enriched(bets, history)
    return r.select("bet_id", "home_rest_days", "away_rest_days", F.col("home_matches_in_lookback").alias("home_n"), F.col("away_matches_in_lookback").alias("away_n"), F.round("home_rolling_xg", 8).alias("home_xg"), F.round("away_rolling_xg", 8).alias("away_xg"), F.col("home_rotation_risk").alias("home_risk"), "fatigue")
