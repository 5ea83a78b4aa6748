"""Queries that summarise bets, predictions and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.pricing import capped_kelly
from ..operators import metrics as M
from ..projection import domain
from ..registry import query
from .columns import SETTLED_SQL, settled


@query(
    "backtest_summary",
    f"""WITH {SETTLED_SQL.strip()}
SELECT count(*) AS n, round(count(*) FILTER (WHERE r > 0) / CAST(count(*) FILTER (WHERE r <> 0) AS DOUBLE), 8) AS hit_rate, round(sum(pnl), 3) AS pnl, round(sum(pnl) / sum(stake), 8) AS roi, round(avg(pnl / stake), 8) AS yield,
  round(avg(p_model * odds - 1), 8) AS avg_ev, round(avg(odds), 8) AS avg_odds, round(avg(stake), 8) AS avg_stake FROM priced""",
    ("matches", "bets"),
)
def backtest_summary(spark, sf_dir):
    r = F.col("r")
    return settled(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.count_if(r > 0) / F.count_if(r != 0), 8).alias("hit_rate"), F.round(F.sum("pnl"), 3).alias("pnl"), F.round(F.sum("pnl") / F.sum("stake"), 8).alias("roi"),
        F.round(F.avg(F.col("pnl") / F.col("stake")), 8).alias("yield"), F.round(F.avg(F.col("p_model") * F.col("odds") - 1), 8).alias("avg_ev"), F.round(F.avg("odds"), 8).alias("avg_odds"), F.round(F.avg("stake"), 8).alias("avg_stake"),
    )


@query(
    "market_breakdown_dense",
    f"""WITH {SETTLED_SQL.strip()}, d AS (SELECT unnest(['1X2', 'OU', 'AH', 'CORNERS']) AS market)
SELECT d.market, count(bet_id) AS n, round(coalesce(sum(pnl), 0), 4) AS pnl FROM d LEFT JOIN priced p ON p.market = d.market GROUP BY d.market""",
    ("matches", "bets"),
)
def market_breakdown_dense(spark, sf_dir):
    """Every market has a row, empty ones too."""
    wanted = spark.createDataFrame([("1X2",), ("OU",), ("AH",), ("CORNERS",)], "market string")
    found = settled(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    return wanted.join(found, "market", "left").select("market", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("pnl", F.lit(0.0)), 4).alias("pnl"))


@query(
    "journal_summary",
    f"""WITH {SETTLED_SQL.strip()}
SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, round(sum(CASE WHEN status = 'PENDING' THEN stake ELSE 0 END), 4) AS pending_stake, round(sum(CASE WHEN status <> 'PENDING' THEN pnl ELSE 0 END), 4) AS pnl,
  count(*) FILTER (WHERE status <> 'PENDING' AND r > 0) AS w, count(*) FILTER (WHERE status <> 'PENDING' AND r < 0) AS l, count(*) FILTER (WHERE status <> 'PENDING' AND r = 0) AS p,
  round(avg(CASE WHEN status <> 'PENDING' THEN odds / close_odds - 1 END), 8) AS clv,
  round(avg(CASE WHEN status <> 'PENDING' AND r <> 0 THEN pow(p_model - CASE WHEN r > 0 THEN 1 ELSE 0 END, 2) END), 8) AS brier FROM priced""",
    ("matches", "bets"),
)
def journal_summary(spark, sf_dir):
    open_, r = F.col("status") == "PENDING", F.col("r")
    done = ~open_
    won = F.when(r > 0, 1.0).otherwise(0.0)
    return settled(spark, sf_dir).agg(
        F.count_if(open_).alias("pending"), F.round(F.sum(F.when(open_, F.col("stake")).otherwise(0.0)), 4).alias("pending_stake"), F.round(F.sum(F.when(done, F.col("pnl")).otherwise(0.0)), 4).alias("pnl"),
        F.count_if(done & (r > 0)).alias("w"), F.count_if(done & (r < 0)).alias("l"), F.count_if(done & (r == 0)).alias("p"),
        F.round(F.avg(F.when(done, F.col("odds") / F.col("close_odds") - 1)), 8).alias("clv"), F.round(F.avg(F.when(done & (r != 0), F.pow(F.col("p_model") - won, 2))), 8).alias("brier"),
    )


@query(
    "performance_lookback",
    f"""WITH {SETTLED_SQL.strip()}, x AS (SELECT max(day) AS last FROM priced)
SELECT comp, count(*) AS n, round(100e0 * count(*) FILTER (WHERE r > 0) / count(*), 6) AS win_pct, round(100 * sum(pnl) / sum(stake), 6) AS roi_pct, round(100 * avg(CASE WHEN abs(p_model * odds - 1) <= 2 THEN p_model * odds - 1 ELSE (p_model * odds - 1) / 100 END), 6) AS ev_pct
FROM priced, x WHERE day > last - 90 AND status = 'SETTLED' GROUP BY comp""",
    ("matches", "bets"),
)
def performance_lookback(spark, sf_dir):
    """The last ninety days; expected values within two are fractions, others per cent."""
    bets = settled(spark, sf_dir).where("status = 'SETTLED'")
    last = settled(spark, sf_dir).agg(F.max("day").alias("last"))
    ev = F.col("p_model") * F.col("odds") - 1
    recent = bets.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last", 90))  # one row is broadcast
    return recent.groupBy("comp").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("r") > 0) / F.count("*"), 6).alias("win_pct"), F.round(100 * F.sum("pnl") / F.sum("stake"), 6).alias("roi_pct"), F.round(100 * F.avg(F.when(F.abs(ev) <= 2, ev).otherwise(ev / 100)), 6).alias("ev_pct"))


@query("season_counts", "SELECT season, comp, count(*) AS n FROM matches GROUP BY season, comp", ("matches",))
def season_counts(spark, sf_dir):
    return domain(spark, sf_dir, "matches").groupBy("season", "comp").agg(F.count("*").alias("n"))


@query(
    "team_corner_rates",
    """WITH h AS (SELECT home AS team, avg(hc) AS hr, count(hc) AS hn FROM matches GROUP BY home), a AS (SELECT away AS team, avg(ac) AS ar, count(ac) AS an FROM matches GROUP BY away)
SELECT coalesce(h.team, a.team) AS team, round((coalesce(hr, 0) * coalesce(hn, 0) + coalesce(ar, 0) * coalesce(an, 0)) / nullif(coalesce(hn, 0) + coalesce(an, 0), 0), 8) AS rate FROM h FULL JOIN a ON h.team = a.team""",
    ("matches",),
)
def team_corner_rates(spark, sf_dir):
    """Home and away aggregates meet in a full join and recombine by their sizes."""
    m = domain(spark, sf_dir, "matches")
    home = m.groupBy(F.col("home").alias("team")).agg(F.avg("hc").alias("hr"), F.count("hc").alias("hn"))
    away = m.groupBy(F.col("away").alias("team")).agg(F.avg("ac").alias("ar"), F.count("ac").alias("an"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = home.join(away, "team", "full")
    return both.select("team", F.round(F.try_divide(z("hr") * z("hn") + z("ar") * z("an"), z("hn") + z("an")), 8).alias("rate"))


@query("appearance_counts", "SELECT team, count(*) AS n FROM (SELECT home AS team FROM matches UNION ALL SELECT away FROM matches) t GROUP BY team", ("matches",))
def appearance_counts(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))


@query(
    "dominant_competition",
    """WITH c AS (SELECT team, comp, count(*) AS n FROM (SELECT home AS team, comp FROM matches UNION ALL SELECT away, comp FROM matches) t WHERE comp <> '1-URGENT' GROUP BY team, comp),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, comp) AS k FROM c) SELECT team, comp, n FROM r WHERE k = 1""",
    ("matches",),
)
def dominant_competition(spark, sf_dir):
    """The competition a team plays most, cups aside; ties go to the smaller name."""
    counts = domain(spark, sf_dir, "matches").where("comp <> '1-URGENT'").select(F.explode(F.array("home", "away")).alias("team"), "comp").groupBy("team", "comp").agg(F.count("*").alias("n"))
    best = counts.groupBy("team").agg(F.min_by(F.struct("comp", "n"), F.struct(-F.col("n"), F.col("comp"))).alias("b"))
    return best.select("team", "b.comp", "b.n")


@query(
    "thin_teams",
    """WITH c AS (SELECT season, team, count(*) AS n FROM (SELECT season, home AS team FROM matches UNION ALL SELECT season, away FROM matches) t GROUP BY season, team) SELECT season, count(*) FILTER (WHERE n < 200) AS thin, count(*) AS teams FROM c GROUP BY season""",
    ("matches",),
)
def thin_teams(spark, sf_dir):
    n = domain(spark, sf_dir, "matches").select("season", F.explode(F.array("home", "away")).alias("team")).groupBy("season", "team").agg(F.count("*").alias("n"))
    return n.groupBy("season").agg(F.count_if(F.col("n") < 200).alias("thin"), F.count("*").alias("teams"))


EDGES_SQL = "edges AS (SELECT unnest(range(0, 10)) AS b, unnest([0.0e0, 0.1e0, 0.2e0, 0.30000000000000004e0, 0.4e0, 0.5e0, 0.6000000000000001e0, 0.7000000000000001e0, 0.8e0, 0.9e0]) AS lo, unnest([0.1e0, 0.2e0, 0.30000000000000004e0, 0.4e0, 0.5e0, 0.6000000000000001e0, 0.7000000000000001e0, 0.8e0, 0.9e0, 1.0e0]) AS hi)"


@query(
    "reliability_table",
    f"""WITH {EDGES_SQL} SELECT CAST(b AS INT) AS bin, count(p) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS mean_y FROM edges LEFT JOIN predictions ON p >= lo AND (p < hi OR (b = 9 AND p <= hi)) GROUP BY b""",
    ("predictions",),
)
def reliability_table(spark, sf_dir):
    return M.reliability(domain(spark, sf_dir, "predictions"), "p", "y").select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("mean_y", 8).alias("mean_y"))


@query(
    "calibration_by_market",
    f"""WITH {EDGES_SQL}, v AS (SELECT * FROM predictions WHERE p IS NOT NULL), b AS (SELECT market, b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM v JOIN edges ON p >= lo AND (p < hi OR (b = 9 AND p <= hi)) GROUP BY market, b),
e AS (SELECT market, sum(n * abs(mp - my)) / sum(n) AS ece FROM b GROUP BY market),
s AS (SELECT market, count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS ll FROM v GROUP BY market)
SELECT s.market, s.n, round(brier, 8) AS brier, round(ll, 8) AS log_loss, round(ece, 8) AS ece FROM s JOIN e ON s.market IS NOT DISTINCT FROM e.market""",
    ("predictions",),
)
def calibration_by_market(spark, sf_dir):
    """Brier score, log-loss and calibration error; the null market is a group."""
    return M.binary_metrics(domain(spark, sf_dir, "predictions"), "p", "y", "market").select("market", "n", *(F.round(c, 8).alias(c) for c in ("brier", "log_loss", "ece")))


@query(
    "multiclass_scores",
    """WITH v AS (SELECT * FROM predictions WHERE ftr IN ('H', 'D', 'A'))
SELECT count(*) AS n, round(avg(pow(ph - CASE ftr WHEN 'H' THEN 1 ELSE 0 END, 2) + pow(pd - CASE ftr WHEN 'D' THEN 1 ELSE 0 END, 2) + pow(pa - CASE ftr WHEN 'A' THEN 1 ELSE 0 END, 2)), 8) AS brier,
  round(avg(-ln(CASE ftr WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END)), 8) AS log_loss FROM v""",
    ("predictions",),
)
def multiclass_scores(spark, sf_dir):
    return M.multiclass(domain(spark, sf_dir, "predictions"), {"H": "ph", "D": "pd", "A": "pa"}, "ftr").select("n", F.round("brier", 8).alias("brier"), F.round("log_loss", 8).alias("log_loss"))


@query(
    "model_drift",
    """WITH x AS (SELECT max(day) AS now FROM predictions), v AS (SELECT p, y, CASE WHEN day >= now - 30 THEN 'recent' ELSE 'baseline' END AS win FROM predictions, x WHERE p IS NOT NULL AND day >= now - 60),
s AS (SELECT avg(CASE WHEN win = 'recent' THEN pow(p - y, 2) END) AS r, avg(CASE WHEN win = 'baseline' THEN pow(p - y, 2) END) AS b FROM v)
SELECT round(r, 8) AS recent, round(b, 8) AS baseline, r > b * 1.15e0 AS alert FROM s""",
    ("predictions",),
)
def model_drift(spark, sf_dir):
    """The recent window is closed on both ends, the one before half-open."""
    rows = domain(spark, sf_dir, "predictions").where("p IS NOT NULL")
    now = domain(spark, sf_dir, "predictions").agg(F.max("day").alias("now"))
    err = F.pow(F.col("p") - F.col("y"), 2)
    near = rows.crossJoin(F.broadcast(now)).where(F.col("day") >= F.date_sub("now", 60))  # one row is broadcast
    recent = F.col("day") >= F.date_sub("now", 30)
    both = near.agg(F.avg(F.when(recent, err)).alias("recent"), F.avg(F.when(~recent, err)).alias("baseline"))
    return both.select(F.round("recent", 8).alias("recent"), F.round("baseline", 8).alias("baseline"), (F.col("recent") > F.col("baseline") * 1.15).alias("alert"))


@query(
    "data_quality_scores",
    """WITH l AS (SELECT max(observed_at) AS now FROM quotes), q AS (SELECT match_id, count(DISTINCT selection) AS sels, count(DISTINCT book) AS books, max(observed_at) AS seen, count(*) FILTER (WHERE price <= 1.05e0) AS conflicts FROM quotes GROUP BY match_id),
s AS (SELECT match_id, 100e0 * sels / 3 AS coverage, greatest(0, 100e0 - 5 * greatest(0, (epoch_us(now) - epoch_us(seen)) / 3600e6 - 1)) AS freshness, greatest(0, 100e0 - 25 * conflicts) AS consistency FROM q, l)
SELECT match_id, round(coverage, 4) AS coverage, round(freshness, 4) AS freshness, round(consistency, 4) AS consistency, round((coverage + freshness + consistency) / 3, 4) AS score,
  CASE WHEN (coverage + freshness + consistency) / 3 >= 80 THEN 'A' WHEN (coverage + freshness + consistency) / 3 >= 60 THEN 'B' ELSE 'C' END AS tier FROM s""",
    ("quotes",),
)
def data_quality_scores(spark, sf_dir):
    quotes = domain(spark, sf_dir, "quotes")
    now = quotes.agg(F.max("observed_at").alias("now"))
    q = quotes.groupBy("match_id").agg(F.count_distinct("selection").alias("sels"), F.max("observed_at").alias("seen"), F.count_if(F.col("price") <= 1.05).alias("conflicts")).crossJoin(F.broadcast(now))  # one row is broadcast
    hours = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))) / 3.6e9
    s = q.select("match_id", (100.0 * F.col("sels") / 3).alias("coverage"), F.greatest(F.lit(0.0), 100.0 - 5 * F.greatest(F.lit(0.0), hours - 1)).alias("freshness"), F.greatest(F.lit(0.0), 100.0 - 25 * F.col("conflicts")).alias("consistency"))
    score = (F.col("coverage") + F.col("freshness") + F.col("consistency")) / 3
    return s.select("match_id", *(F.round(c, 4).alias(c) for c in ("coverage", "freshness", "consistency")), F.round(score, 4).alias("score"), F.when(score >= 80, "A").when(score >= 60, "B").otherwise("C").alias("tier"))


@query(
    "missing_rates",
    """SELECT season, round(avg(CASE WHEN hs IS NULL THEN 1e0 ELSE 0e0 END), 8) AS hs, round(avg(CASE WHEN ac IS NULL THEN 1e0 ELSE 0e0 END), 8) AS ac FROM matches GROUP BY season""",
    ("matches",),
)
def missing_rates(spark, sf_dir):
    return domain(spark, sf_dir, "matches").groupBy("season").agg(*(F.round(F.avg(F.col(c).isNull().cast("double")), 8).alias(c) for c in ("hs", "ac")))


@query(
    "season_mean_imputation",
    """WITH m AS (SELECT season, avg(hst) AS v FROM matches GROUP BY season) SELECT match_id, round(coalesce(hst, v, 0), 8) AS hst FROM matches JOIN m USING (season)""",
    ("matches",),
)
def season_mean_imputation(spark, sf_dir):
    rows = domain(spark, sf_dir, "matches")
    means = rows.groupBy("season").agg(F.avg("hst").alias("v"))
    return rows.join(means, "season").select("match_id", F.round(F.coalesce("hst", "v", F.lit(0.0)), 8).alias("hst"))


@query(
    "sharp_consensus",
    """WITH s AS (SELECT * FROM quotes WHERE book IN ('click', 'purchase') AND observed_at <= TIMESTAMP '2024-01-20 00:00:00'), t AS (SELECT match_id, max(observed_at) AS tick FROM s GROUP BY match_id)
SELECT s.match_id, selection, round(avg(price), 8) AS price FROM s JOIN t ON s.match_id = t.match_id AND observed_at = tick GROUP BY s.match_id, selection""",
    ("quotes",),
)
def sharp_consensus(spark, sf_dir):
    """Mean price at the latest sharp tick of each match; a selection not quoted at that tick has none."""
    sharp = domain(spark, sf_dir, "quotes").where("book IN ('click', 'purchase') AND observed_at <= timestamp_ntz'2024-01-20 00:00:00'")
    ticks = sharp.groupBy("match_id").agg(F.max("observed_at").alias("observed_at"))
    return sharp.join(ticks, ["match_id", "observed_at"]).groupBy("match_id", "selection").agg(F.round(F.avg("price"), 8).alias("price"))


@query(
    "lineage_aggregate",
    """SELECT match_id, book, max(observed_at) AS seen_last, count(*) AS n_raw, CAST(sum(quote_id) AS BIGINT) AS id_sum FROM quotes GROUP BY match_id, book""",
    ("quotes",),
)
def lineage_aggregate(spark, sf_dir):
    return domain(spark, sf_dir, "quotes").groupBy("match_id", "book").agg(F.max("observed_at").alias("seen_last"), F.count("*").alias("n_raw"), F.sum("quote_id").alias("id_sum"))


@query(
    "point_in_time_leaks",
    """WITH q AS (SELECT match_id, observed_at, CASE WHEN quote_id % 17 = 0 THEN NULL ELSE observed_at END AS seen FROM quotes)
SELECT match_id, count(*) FILTER (WHERE seen <= TIMESTAMP '2024-01-15 00:00:00') AS usable, count(*) FILTER (WHERE seen > TIMESTAMP '2024-01-15 00:00:00') AS leaks FROM q GROUP BY match_id""",
    ("quotes",),
)
def point_in_time_leaks(spark, sf_dir):
    """Rows without a time are left out but are no leak; the bound is inclusive."""
    seen = F.when(F.col("quote_id") % 17 != 0, F.col("observed_at"))
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return domain(spark, sf_dir, "quotes").groupBy("match_id").agg(F.count_if(seen <= cut).alias("usable"), F.count_if(seen > cut).alias("leaks"))


@query(
    "exposure_by_day",
    """SELECT day, count(*) AS n, round(sum(stake_pct), 6) AS asked, round(least(sum(stake_pct), 0.05e0), 6) AS granted FROM (SELECT day, least(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0) AS stake_pct FROM bets) b GROUP BY day""",
    ("bets",),
)
def exposure_by_day(spark, sf_dir):
    """Shares asked and granted by day; they are summed to twenty places, so that a sum beside a tie does not hang on the order of rows."""
    total = F.sum(capped_kelly(F.col("p_model"), F.col("odds")).cast("decimal(28,20)")).cast("double")
    return domain(spark, sf_dir, "bets").groupBy("day").agg(F.count("*").alias("n"), F.round(total, 6).alias("asked"), F.round(F.least(total, F.lit(0.05)), 6).alias("granted"))
