"""Stores as functions from old and new rows to the new table; lookups, pools, drift and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import score_matrix as S
from ..projection import domain
from ..registry import query
from ..sources import sinks
from ..streaming import jobs
from .selection import since_last

DRIFT_DAYS, MISSING_ALERT, DROP_ALERT = 180, 0.005, 0.15
PRIOR_MATCHES = 40.0


@query("journal_without_deleted", "SELECT market, count(*) AS n FROM bets WHERE bet_id % 7 <> 0 GROUP BY market", ("bets",))
def journal_without_deleted(spark, sf_dir):
    """The journal after deletions by id."""
    b = domain(spark, sf_dir, "bets").select("bet_id", "market")
    deleted = b.where("bet_id % 7 = 0").select("bet_id")
    return b.join(deleted, "bet_id", "left_anti").groupBy("market").agg(F.count("*").alias("n"))


@query("history_cleared", "SELECT bet_id, market FROM bets WHERE market = 'OU'", ("bets",))
def history_cleared(spark, sf_dir):
    """A written history replaced by an empty one, which keeps its columns, then one market put back."""
    b, path = domain(spark, sf_dir, "bets").select("bet_id", "market"), jobs.shared_folder(spark, "history")
    sinks.replace_table(b, path)
    sinks.replace_table(b.limit(0), path)
    sinks.append_rows(b.where("market = 'OU'"), path)
    return spark.read.parquet(path)


@query("snapshots_appended", "SELECT day, count(*) AS n, round(sum(p_model), 4) AS p FROM (SELECT day, p_model FROM bets WHERE bet_id % 2 = 0 UNION ALL SELECT day, p_model FROM bets WHERE bet_id % 5 = 0) t GROUP BY day", ("bets",))
def snapshots_appended(spark, sf_dir):
    """An append-only store takes every row, the same bet again too."""
    b = domain(spark, sf_dir, "bets").select("bet_id", "day", "p_model")
    return b.where("bet_id % 2 = 0").unionByName(b.where("bet_id % 5 = 0")).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("p_model"), 4).alias("p"))


@query("competitions_upserted", "SELECT comp, CASE WHEN count(*) > (SELECT count(*) / count(DISTINCT comp) FROM matches) THEN 0.9e0 ELSE 1e0 END AS weight FROM matches GROUP BY comp UNION ALL SELECT DISTINCT c_mktsegment, 0.5e0 FROM customer", ("matches",))
def competitions_upserted(spark, sf_dir):
    """Competitions that grew beyond the mean get a new weight, those not known yet come in with their own."""
    sizes = domain(spark, sf_dir, "matches").groupBy("comp").agg(F.count("*").alias("n"))
    old = sizes.select("comp", F.lit(1.0).alias("weight"))
    grown = sizes.join(F.broadcast(sizes.agg(F.avg("n").alias("mean"))), F.col("n") > F.col("mean")).select("comp", F.lit(0.9).alias("new_weight"))  # one row is broadcast
    unknown = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("comp")).distinct().withColumn("new_weight", F.lit(0.5))
    new = grown.unionByName(unknown)
    return old.join(new, "comp", "full").select("comp", F.coalesce("new_weight", "weight").alias("weight"))


@query(
    "entities_found_or_made",
    """WITH a AS (SELECT CAST(n_nationkey AS INT) AS team, n_name AS name, lower(n_name) AS key FROM nation WHERE n_nationkey % 2 = 0), q AS (SELECT n_nationkey AS source_id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE n_name || ' X' END AS name FROM nation)
SELECT source_id, coalesce(i.team, n.team, k.team) AS team, CASE WHEN i.team IS NOT NULL THEN 'id' WHEN n.team IS NOT NULL THEN 'name' WHEN k.team IS NOT NULL THEN 'key' ELSE 'new' END AS step
FROM q LEFT JOIN a i ON q.source_id = i.team AND q.source_id % 4 = 0 LEFT JOIN a n ON q.name = n.name LEFT JOIN a k ON lower(q.name) = k.key""",
)
def entities_found_or_made(spark, sf_dir):
    """By the source's id, by alias, by folded key; what is left is new and unmapped."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    known = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("int").alias("team"), F.col("n_name").alias("name"))
    ids = known.where("team % 4 = 0").select(F.col("team").cast("long").alias("source_id"), F.col("team").alias("by_id"))
    names = known.groupBy("name").agg(F.min("team").alias("by_name"))
    keys = known.groupBy(F.lower("name").alias("key")).agg(F.min("team").alias("by_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    spelt = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit(" X")))
    asked = n.select(F.col("n_nationkey").cast("long").alias("source_id"), spelt.alias("name")).withColumn("key", F.lower("name"))
    met = asked.join(ids, "source_id", "left").join(names, "name", "left").join(keys, "key", "left")
    step = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("by_key").isNotNull(), "key").otherwise("new")
    return met.select("source_id", F.coalesce("by_id", "by_name", "by_key").alias("team"), step.alias("step"))


@query("alias_variants", "SELECT team, name FROM (SELECT CAST(n_nationkey AS INT) AS team, n_name AS name FROM nation UNION SELECT CAST(n_nationkey AS INT), lower(n_name) FROM nation UNION SELECT CAST(n_nationkey AS INT), 'FC ' || n_name FROM nation) t")
def alias_variants(spark, sf_dir):
    """All strings that stand for a team."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("team"), F.col("n_name").alias("name"))
    return n.select("team", F.explode(F.array("name", F.lower("name"), F.concat(F.lit("FC "), "name"))).alias("name")).distinct()


@query("teams_by_code", "SELECT m.match_id, CAST(n.n_nationkey AS INT) AS team FROM matches m LEFT JOIN nation n ON upper(substr(md5(n.n_name), 1, 8)) = upper(substr(md5((SELECT any_value(x.n_name) FROM nation x WHERE x.n_nationkey = m.home)), 1, 8)) AND (m.match_id % 2 = 0 OR n.n_regionkey < 3)", ("matches",))
def teams_by_code(spark, sf_dir):
    """A feed's team code, with a scope where the row has one."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("team"), F.upper(F.substring(F.md5(F.col("n_name").cast("binary")), 1, 8)).alias("code"), F.col("n_regionkey").alias("scope"))
    asked = domain(spark, sf_dir, "matches").select("match_id", "home").join(n.select(F.col("team").alias("home"), "code"), "home")
    return asked.join(n, (asked["code"] == n["code"]) & ((F.col("match_id") % 2 == 0) | (F.col("scope") < 3)), "left").select("match_id", "team")


@query("fresh_leagues", "WITH j AS (SELECT comp, day FROM bets b JOIN matches m ON b.match_id = m.match_id) SELECT comp, count(*) AS n FROM j GROUP BY comp HAVING max(day) = (SELECT max(day) FROM j)", ("bets", "matches"))
def fresh_leagues(spark, sf_dir):
    """Bets of leagues whose newest bet is of the newest day of all; a star among the stale ones drops all."""
    rows = domain(spark, sf_dir, "bets").join(domain(spark, sf_dir, "matches").select("match_id", "comp"), "match_id").where("trim(comp) <> ''")
    newest = rows.groupBy("comp").agg(F.max("day").alias("day"))
    stale = newest.join(F.broadcast(newest.agg(F.max("day").alias("newest"))), F.col("day") < F.col("newest")).select("comp")  # one row is broadcast
    starred = stale.agg(F.count_if(F.col("comp") == "*").alias("stars"))
    kept = rows.join(stale, "comp", "left_anti").crossJoin(F.broadcast(starred)).where("stars = 0")  # one row is broadcast
    return kept.groupBy("comp").agg(F.count("*").alias("n"))


@query("feeds_to_refresh", "SELECT comp FROM (SELECT comp, max(match_date) AS newest FROM matches GROUP BY comp) c, (SELECT max(match_date) AS hi FROM matches) t WHERE date_diff('day', newest, hi) >= 1", ("matches",))
def feeds_to_refresh(spark, sf_dir):
    """Feeds whose newest row is a day old or more."""
    m = domain(spark, sf_dir, "matches")
    newest = m.groupBy("comp").agg(F.max("match_date").alias("newest"))
    return newest.crossJoin(F.broadcast(m.agg(F.max("match_date").alias("hi")))).where(F.date_diff("hi", "newest") >= 1).select("comp")  # one row is broadcast


@query("last_training_rows", "SELECT comp, match_id FROM (SELECT comp, match_id, row_number() OVER (PARTITION BY comp ORDER BY match_date DESC, match_id DESC) AS k FROM matches) t WHERE k <= 50", ("matches",))
def last_training_rows(spark, sf_dir):
    order = Window.partitionBy("comp").orderBy(F.desc("match_date"), F.desc("match_id"))
    return domain(spark, sf_dir, "matches").withColumn("k", F.row_number().over(order)).where("k <= 50").select("comp", "match_id")


@query("earliest_unpriced", "SELECT match_id, match_date FROM (SELECT m.match_id, match_date, row_number() OVER (PARTITION BY comp ORDER BY match_date, m.match_id) AS k FROM matches m JOIN odds o ON m.match_id = o.match_id WHERE b365h IS NULL) t WHERE k <= 10", ("matches", "odds"))
def earliest_unpriced(spark, sf_dir):
    """The first ten fixtures of a league that have no price."""
    odds = domain(spark, sf_dir, "odds").where("b365h IS NULL").select("match_id")
    order = Window.partitionBy("comp").orderBy("match_date", "match_id")
    return domain(spark, sf_dir, "matches").join(odds, "match_id").withColumn("k", F.row_number().over(order)).where("k <= 10").select("match_id", "match_date")


@query("pooled_upcoming", "SELECT comp, match_id, match_date FROM matches WHERE comp IN ('1-URGENT', '3-MEDIUM') AND match_date >= (SELECT max(match_date) - 200 FROM matches)", ("matches",))
def pooled_upcoming(spark, sf_dir):
    """Several competitions' fixtures as one table."""
    m = since_last(domain(spark, sf_dir, "matches"), 200).select("comp", "match_id", "match_date")
    return m.where("comp = '1-URGENT'").unionByName(m.where("comp = '3-MEDIUM'"))


@query("top_flight_teams", "SELECT home AS team FROM matches WHERE comp = '1-URGENT' UNION SELECT away FROM matches WHERE comp = '1-URGENT'", ("matches",))
def top_flight_teams(spark, sf_dir):
    return domain(spark, sf_dir, "matches").where("comp = '1-URGENT'").select(F.explode(F.array("home", "away")).alias("team")).distinct()


@query("teams_with_history", "SELECT team, EXISTS (SELECT 1 FROM matches m WHERE (m.home = s.team OR m.away = s.team) AND m.comp = '2-HIGH' AND m.season = 1997) AS known FROM strengths s", ("strengths", "matches"))
def teams_with_history(spark, sf_dir):
    """Whether a team has any finished match of a competition and season; those without carry a badge."""
    played = domain(spark, sf_dir, "matches").where("comp = '2-HIGH' AND season = 1997").select(F.explode(F.array("home", "away")).alias("team")).distinct().withColumn("known", F.lit(True))
    return domain(spark, sf_dir, "strengths").select("team").join(played, "team", "left").select("team", F.coalesce("known", F.lit(False)).alias("known"))


@query("source_coverage", "SELECT match_id, round(100e0 * len(list_intersect(['view', 'click', 'lost'], list(DISTINCT book))) / 3, 6) AS score FROM quotes GROUP BY match_id", ("quotes",))
def source_coverage(spark, sf_dir):
    """Share of the expected sources that a match has."""
    expected = F.array(F.lit("view"), F.lit("click"), F.lit("lost"))
    present = domain(spark, sf_dir, "quotes").groupBy("match_id").agg(F.collect_set("book").alias("books"))  # a set of sources: few
    return present.select("match_id", F.round(100.0 * F.size(F.array_intersect(expected, "books")) / F.size(expected), 6).alias("score"))


@query(
    "data_drift",
    f"""WITH t AS (SELECT max(day) AS hi FROM predictions), w AS (SELECT comp, p, day > hi - {DRIFT_DAYS} AS recent FROM predictions, t),
a AS (SELECT comp, avg(CASE WHEN p IS NULL THEN 1e0 ELSE 0e0 END) FILTER (WHERE recent) AS miss, avg(p) FILTER (WHERE recent) AS s1, avg(p) FILTER (WHERE NOT recent) AS s0 FROM w GROUP BY comp)
SELECT comp, round(miss, 8) AS missing, round((s0 - s1) / s0, 8) AS score_drop, miss > {MISSING_ALERT}e0 AS missing_alert, coalesce((s0 - s1) / s0 > {DROP_ALERT}e0, FALSE) AS score_alert FROM a""",
    ("predictions",),
)
def data_drift(spark, sf_dir):
    """Missing rate of the recent window, and its mean score against all before."""
    rows = domain(spark, sf_dir, "predictions")
    now = rows.agg(F.max("day").alias("hi"))
    marked = rows.crossJoin(F.broadcast(now)).withColumn("recent", F.col("day") > F.date_sub("hi", DRIFT_DAYS))  # one row is broadcast
    mean = lambda c, recent: F.avg(F.when(F.col("recent") == recent, c))
    a = marked.groupBy("comp").agg(mean(F.col("p").isNull().cast("double"), True).alias("miss"), mean(F.col("p"), True).alias("s1"), mean(F.col("p"), False).alias("s0"))
    drop = (F.col("s0") - F.col("s1")) / F.nullif(F.col("s0"), F.lit(0.0))
    return a.select("comp", F.round("miss", 8).alias("missing"), F.round(drop, 8).alias("score_drop"), (F.col("miss") > MISSING_ALERT).alias("missing_alert"), F.coalesce(drop > DROP_ALERT, F.lit(False)).alias("score_alert"))


@query(
    "prediction_summary",
    """SELECT CAST(grouping(market) AS INT) AS over_markets, CAST(grouping(comp) AS INT) AS over_comps, market, comp, count(*) AS n, round(avg((p - y) * (p - y)), 8) AS brier, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS hit_rate
FROM predictions WHERE p IS NOT NULL GROUP BY GROUPING SETS ((), (market), (comp))""",
    ("predictions",),
)
def prediction_summary(spark, sf_dir):
    """Overall, by market and by competition in one pass."""
    rows = domain(spark, sf_dir, "predictions").where("p IS NOT NULL")
    sets = rows.groupingSets([[], ["market"], ["comp"]], "market", "comp")
    out = sets.agg(F.grouping("market").cast("int").alias("over_markets"), F.grouping("comp").cast("int").alias("over_comps"), F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("b"), F.avg("p").alias("m"), F.avg("y").alias("h"))
    return out.select("over_markets", "over_comps", "market", "comp", "n", F.round("b", 8).alias("brier"), F.round("m", 8).alias("mean_p"), F.round("h", 8).alias("hit_rate"))


@query("odds_snapshots_as_of", "SELECT match_id, quote_id, round(price, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY observed_at DESC, quote_id DESC) AS k FROM quotes WHERE observed_at <= (SELECT max(observed_at) - INTERVAL 5 DAY FROM quotes)) t WHERE k = 1", ("quotes",))
def odds_snapshots_as_of(spark, sf_dir):
    """The append-only snapshot store as it was five days before its newest row."""
    q = domain(spark, sf_dir, "quotes")
    cut = q.agg((F.max("observed_at") - F.expr("INTERVAL 5 DAYS")).alias("cut"))
    old = q.crossJoin(F.broadcast(cut)).where("observed_at <= cut")  # one row is broadcast
    best = old.groupBy("match_id").agg(F.max_by(F.struct("quote_id", "price"), F.struct("observed_at", "quote_id")).alias("b"))
    return best.select("match_id", "b.quote_id", F.round("b.price", 6).alias("price"))


@query(
    "recommended_legs",
    """WITH l AS (SELECT o.match_id, unnest(['H', 'D', 'A', 'Over', 'Under', 'AH home', 'AH away']) AS leg, unnest([b365h, b365d, b365a, b365_o25, b365_u25, b365ahh, b365aha]) AS price FROM odds o) SELECT match_id, leg, round(price, 6) AS price FROM l WHERE price > 1""",
    ("odds",),
)
def recommended_legs(spark, sf_dir):
    """Up to seven legs of a fixture, those with a price."""
    legs = (("H", "b365h"), ("D", "b365d"), ("A", "b365a"), ("Over", "b365_o25"), ("Under", "b365_u25"), ("AH home", "b365ahh"), ("AH away", "b365aha"))
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("leg"), F.col(c).alias("price")) for n, c in legs))).alias("l")
    return domain(spark, sf_dir, "odds").select("match_id", every).select("match_id", "l.leg", F.round("l.price", 6).alias("price")).where("price > 1")


@query(
    "weak_prior_rates",
    f"""WITH t AS (SELECT home AS team, comp, fthg AS g FROM matches UNION ALL SELECT away, comp, ftag FROM matches), l AS (SELECT comp, avg(g) AS mean FROM t GROUP BY comp), n AS (SELECT team, comp, count(*) AS n, sum(g) AS s FROM t GROUP BY team, comp)
SELECT team, n.comp, round((s + {PRIOR_MATCHES}e0 * mean) / (n + {PRIOR_MATCHES}e0), 8) AS rate FROM n JOIN l ON n.comp = l.comp""",
    ("matches",),
)
def weak_prior_rates(spark, sf_dir):
    """Scoring rates of thin teams drawn to their league's mean by a prior of forty matches."""
    goals = domain(spark, sf_dir, "matches").select("comp", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("fthg").alias("g")), F.struct(F.col("away").alias("team"), F.col("ftag").alias("g")))).alias("r")).select("comp", "r.*")
    teams = goals.groupBy("team", "comp").agg(F.count("*").alias("n"), F.sum("g").alias("s"))
    leagues = teams.groupBy("comp").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return teams.join(leagues, "comp").select("team", "comp", F.round((F.col("s") + PRIOR_MATCHES * F.col("mean")) / (F.col("n") + PRIOR_MATCHES), 8).alias("rate"))


@query("weighted_rates", "SELECT m.home, m.away, round(exp(h.att - a.def + 0.25e0) * CASE WHEN m.home % 2 = 0 THEN 0.9e0 ELSE 1e0 END, 8) AS lh FROM (SELECT DISTINCT home, away FROM matches) m JOIN strengths h ON m.home = h.team JOIN strengths a ON m.away = a.team", ("matches", "strengths"))
def weighted_rates(spark, sf_dir):
    """Scoring rates times the weight of a team's league."""
    rates = S.rates(domain(spark, sf_dir, "matches"), domain(spark, sf_dir, "strengths"))
    weight = F.when(F.col("home") % 2 == 0, 0.9).otherwise(1.0)
    return rates.select("home", "away", F.round(F.col("lh") * weight, 8).alias("lh"))


@query("synthetic_matches", "SELECT i AS match_id, CAST(DATE '2020-01-01' + CAST(i * 3 % 700 AS INT) AS DATE) AS match_date, CAST(i * 7 % 20 AS INT) AS home, CAST((i * 7 + 1 + i % 19) % 20 AS INT) AS away, CASE WHEN i % 10 < 5 THEN 'A' WHEN i % 10 < 8 THEN 'B' ELSE 'X' END AS tier FROM (SELECT o_orderkey AS i FROM orders) t")
def synthetic_matches(spark, sf_dir):
    """Matches made from the number of an order alone, in three bands of quality."""
    i = F.col("o_orderkey")
    tier = F.when(i % 10 < 5, "A").when(i % 10 < 8, "B").otherwise("X")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(i.alias("match_id"), F.date_add(F.lit("2020-01-01").cast("date"), (i * 3 % 700).cast("int")).alias("match_date"), (i * 7 % 20).cast("int").alias("home"), ((i * 7 + 1 + i % 19) % 20).cast("int").alias("away"), tier.alias("tier"))
