"""Queries that rank and choose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.pricing import capped_kelly, expected_value
from ..operators import selection as S
from ..projection import domain
from ..registry import query


def legs(spark, sf_dir):
    return domain(spark, sf_dir, "bets").withColumn("ev", expected_value(F.col("p_model"), F.col("odds")))


@query(
    "best_leg_per_match",
    "WITH e AS (SELECT *, p_model * odds - 1 AS ev FROM bets), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, bet_id) AS k FROM e WHERE ev <= 0.5e0) SELECT match_id, bet_id, round(ev, 8) AS ev FROM r WHERE k = 1",
    ("bets",),
)
def best_leg_per_match(spark, sf_dir):
    return S.best_per_group(legs(spark, sf_dir).where("ev <= 0.5"), ["match_id"], [F.desc("ev"), F.col("bet_id")]).select("match_id", "bet_id", F.round("ev", 8).alias("ev"))


@query(
    "daily_slots",
    """WITH e AS (SELECT *, p_model * odds - 1 AS ev FROM bets), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, bet_id) AS k FROM e WHERE ev >= 0.05e0 AND ev <= 0.5e0),
d AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ev DESC, bet_id) AS slot FROM r WHERE k = 1) SELECT day, CAST(slot AS INT) AS slot, bet_id FROM d WHERE slot <= 5""",
    ("bets",),
)
def daily_slots(spark, sf_dir):
    """One leg a match, then five a day."""
    best = S.best_per_group(legs(spark, sf_dir).where("ev BETWEEN 0.05 AND 0.5"), ["match_id"], [F.desc("ev"), F.col("bet_id")])
    return S.top_per_group(best, ["day"], [F.desc("ev"), F.col("bet_id")], 5).select("day", F.col("rank").alias("slot"), "bet_id")


@query(
    "remaining_slots_today",
    """WITH e AS (SELECT *, p_model * odds - 1 AS ev FROM bets), p AS (SELECT day, count(*) AS placed FROM bets WHERE status = 'PENDING' GROUP BY day),
r AS (SELECT e.day, bet_id, coalesce(placed, 0) AS placed, row_number() OVER (PARTITION BY e.day ORDER BY ev DESC, bet_id) AS k FROM e LEFT JOIN p ON e.day = p.day WHERE status <> 'PENDING') SELECT day, bet_id FROM r WHERE k <= greatest(0, 5 - placed)""",
    ("bets",),
)
def remaining_slots_today(spark, sf_dir):
    rows = legs(spark, sf_dir)
    placed = rows.where("status = 'PENDING'").groupBy("day").agg(F.count("*").alias("placed"))
    open_ = rows.where("status <> 'PENDING'").join(placed, "day", "left")
    left = F.greatest(F.lit(0), 5 - F.coalesce("placed", F.lit(0)))
    return S.top_per_group(open_, ["day"], [F.desc("ev"), F.col("bet_id")], left).select("day", "bet_id")


@query(
    "top_value_bets",
    "SELECT bet_id, round(p_model * odds - 1, 8) AS ev FROM bets WHERE p_model * odds - 1 <= 0.5e0 ORDER BY p_model * odds - 1 DESC, bet_id LIMIT 50",
    ("bets",),
)
def top_value_bets(spark, sf_dir):
    return legs(spark, sf_dir).where("ev <= 0.5").orderBy(F.desc("ev"), "bet_id").limit(50).select("bet_id", F.round("ev", 8).alias("ev"))


@query(
    "multi_league_merge",
    """WITH e AS (SELECT b.*, m.comp, CASE WHEN b.bet_id % 6 = 0 THEN NULL ELSE p_model * odds - 1 END AS ev FROM bets b JOIN matches m ON b.match_id = m.match_id), a AS (SELECT *, count(ev) OVER (PARTITION BY comp) AS real FROM e),
r AS (SELECT comp, bet_id, row_number() OVER (PARTITION BY comp ORDER BY ev DESC NULLS LAST, bet_id) AS k FROM a WHERE ev IS NOT NULL OR real = 0) SELECT comp, CAST(k AS INT) AS k, bet_id FROM r WHERE k <= 20""",
    ("matches", "bets"),
)
def multi_league_merge(spark, sf_dir):
    """Rows without a value go where any row of the league has one; then the league's first twenty."""
    comps = domain(spark, sf_dir, "matches").select("match_id", "comp")
    rows = legs(spark, sf_dir).withColumn("ev", F.when(F.col("bet_id") % 6 != 0, F.col("ev"))).join(comps, "match_id")
    real = rows.groupBy("comp").agg(F.count("ev").alias("real"))
    kept = rows.join(real, "comp").where("ev IS NOT NULL OR real = 0")
    return S.top_per_group(kept, ["comp"], [F.desc_nulls_last("ev"), F.col("bet_id")], 20).select("comp", F.col("rank").alias("k"), "bet_id")


@query(
    "new_team_gate",
    """WITH n AS (SELECT team, count(*) AS n FROM (SELECT home AS team FROM matches WHERE season = 1995 UNION ALL SELECT away FROM matches WHERE season = 1995) t GROUP BY team), l AS (SELECT avg(n) AS a FROM n)
SELECT m.comp, count(*) FILTER (WHERE (h.n < a AND w.n < a) OR ((h.n < a OR w.n < a) AND m.comp = '1-URGENT')) AS gated, count(*) AS n FROM matches m JOIN n h ON m.home = h.team JOIN n w ON m.away = w.team, l GROUP BY m.comp""",
    ("matches",),
)
def new_team_gate(spark, sf_dir):
    """Both sides thin, or one side thin in a cup, is refused; below-average appearances stand for thin."""
    m = domain(spark, sf_dir, "matches")
    n = m.where("season = 1995").select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("a")))).withColumn("thin", F.col("n") < F.col("a"))  # one row is broadcast
    rows = m.join(n.select(F.col("team").alias("home"), F.col("thin").alias("ht")), "home").join(n.select(F.col("team").alias("away"), F.col("thin").alias("at")), "away")
    gated = (F.col("ht") & F.col("at")) | ((F.col("ht") | F.col("at")) & (F.col("comp") == "1-URGENT"))
    return rows.groupBy("comp").agg(F.count_if(gated).alias("gated"), F.count("*").alias("n"))


@query(
    "greedy_exposure",
    """WITH RECURSIVE c AS (SELECT bet_id, day, comp, CAST(substr(comp, 1, 1) AS INT) AS lg, least(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0) AS s, row_number() OVER (PARTITION BY day ORDER BY bet_id) AS k FROM bets b JOIN (SELECT match_id, comp FROM matches) m ON b.match_id = m.match_id),
f AS (SELECT day AS d, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bet_id, CAST(NULL AS VARCHAR) AS comp, CAST(0 AS DOUBLE) AS s, FALSE AS ok, CAST(0 AS DOUBLE) AS total, [0e0, 0e0, 0e0, 0e0, 0e0] AS used FROM (SELECT DISTINCT day FROM c) t
UNION ALL SELECT d, k, x.bet_id, x.comp, x.s, x.ok, total + CASE WHEN x.ok THEN x.s ELSE 0 END, list_transform(used, lambda v, i: v + CASE WHEN x.ok AND i = lg THEN x.s ELSE 0 END)
FROM (SELECT f.d, f.total, f.used, c.*, c.s > 0 AND f.total + c.s <= 0.05e0 + 1e-12 AND f.used[c.lg] + c.s <= 0.03e0 + 1e-12 AS ok FROM f JOIN c ON c.day = f.d AND c.k = f.n + 1) x)
SELECT bet_id, d AS day, comp, round(s, 8) AS stake_pct, ok AS accepted FROM f WHERE n > 0""",
    ("bets", "matches"),
)
def greedy_exposure(spark, sf_dir):
    """Stakes accepted in order against the caps of day and league."""
    comps = domain(spark, sf_dir, "matches").select("match_id", "comp")
    rows = legs(spark, sf_dir).join(comps, "match_id").withColumn("stake_pct", capped_kelly(F.col("p_model"), F.col("odds"))).select("bet_id", "day", "comp", "stake_pct")
    return S.exposure_fold(rows, "day", "comp", ["bet_id"], "stake_pct").withColumn("stake_pct", F.round("stake_pct", 8))


@query(
    "correlated_legs",
    """WITH e AS (SELECT *, p_model * odds - 1 AS ev FROM bets), r AS (SELECT bet_id, row_number() OVER (PARTITION BY match_id ORDER BY bet_id) AS k FROM e WHERE ev >= 0.05e0) SELECT bet_id, CASE WHEN k = 1 THEN 1e0 ELSE 0.7e0 END AS factor FROM r""",
    ("bets",),
)
def correlated_legs(spark, sf_dir):
    """Legs after a match's first accepted one are discounted."""
    k = F.row_number().over(Window.partitionBy("match_id").orderBy("bet_id"))
    return legs(spark, sf_dir).where("ev >= 0.05").select("bet_id", F.when(k == 1, 1.0).otherwise(0.7).alias("factor"))


@query(
    "played_fixture_filter",
    "SELECT comp, count(*) AS upcoming FROM matches m WHERE match_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM matches p WHERE p.match_id % 5 <> 0 AND p.home = m.home AND p.away = m.away AND p.season = m.season AND p.comp = m.comp) GROUP BY comp",
    ("matches",),
)
def played_fixture_filter(spark, sf_dir):
    m = domain(spark, sf_dir, "matches")
    key = ["home", "away", "season", "comp"]
    return m.where("match_id % 5 = 0").join(m.where("match_id % 5 <> 0").select(*key), key, "left_anti").groupBy("comp").agg(F.count("*").alias("upcoming"))


@query(
    "hot_signals",
    """WITH l AS (SELECT max(observed_at) AS now FROM quotes), h AS (SELECT quote_id, match_id, value, price FROM quotes, l WHERE observed_at > now - INTERVAL 24 HOUR AND (price >= 4.5e0 OR abs(price - 3) >= 1.8e0)),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY quote_id) AS k FROM h) SELECT match_id, quote_id FROM r WHERE k = 1""",
    ("quotes",),
)
def hot_signals(spark, sf_dir):
    """Large value or line move within a day of the last quote, one signal a match."""
    q = domain(spark, sf_dir, "quotes")
    now = q.agg(F.max("observed_at").alias("now"))
    hot = q.crossJoin(F.broadcast(now)).where("observed_at > now - INTERVAL 24 HOURS AND (price >= 4.5 OR abs(price - 3) >= 1.8)")  # one row is broadcast
    return hot.groupBy("match_id").agg(F.min("quote_id").alias("quote_id"))


def since_last(matches, days):
    """Matches from so many days before the newest one on."""
    newest = matches.agg(F.date_sub(F.max("match_date"), days).alias("since"))
    return matches.join(F.broadcast(newest), F.col("match_date") >= F.col("since")).drop("since")  # one row is broadcast


@query(
    "fixture_list",
    "SELECT match_date, comp, home, away, match_id FROM matches WHERE match_date >= (SELECT max(match_date) - 31 FROM matches) ORDER BY match_date, comp, home, match_id",
    ("matches",),
)
def fixture_list(spark, sf_dir):
    """Fixtures of the table's last month, sorted for display."""
    return since_last(domain(spark, sf_dir, "matches"), 31).select("match_date", "comp", "home", "away", "match_id").orderBy("match_date", "comp", "home", "match_id")


@query("market_price_top3", "WITH r AS (SELECT match_id, selection, quote_id, row_number() OVER (PARTITION BY match_id, selection ORDER BY price DESC, quote_id) AS k FROM quotes) SELECT match_id, selection, quote_id, CAST(k AS INT) AS k FROM r WHERE k <= 3", ("quotes",))
def market_price_top3(spark, sf_dir):
    return S.top_per_group(domain(spark, sf_dir, "quotes"), ["match_id", "selection"], [F.desc("price"), F.col("quote_id")], 3).select("match_id", "selection", "quote_id", F.col("rank").alias("k"))
