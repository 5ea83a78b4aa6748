"""Queries over joins and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import upsert as U
from ..projection import domain
from ..registry import query

NEAREST_SQL = """WITH b AS (SELECT match_id AS bet_id, home, away, CAST(match_date + CAST(match_id % 3 - 1 AS INT) AS DATE) AS day FROM matches),
r AS (SELECT bet_id, m.match_id, row_number() OVER (PARTITION BY bet_id ORDER BY CASE WHEN m.match_id % 6 = 0 THEN 1 ELSE 0 END, abs(date_diff('day', day, m.match_date)), m.match_id) AS k
  FROM b JOIN matches m ON b.home = m.home AND b.away = m.away AND abs(date_diff('day', day, m.match_date)) <= 1)
SELECT bet_id, match_id FROM r WHERE k = 1"""
RANGE_SQL = """WITH p AS (SELECT quote_id, match_id, CAST(epoch_us(observed_at) // 1000000 AS BIGINT) AS moment FROM quotes), w AS (SELECT match_id, moment AS low, moment + 7200 AS high, quote_id AS w_id FROM p)
SELECT w_id, count(*) AS n FROM p JOIN w ON p.match_id = w.match_id AND moment >= low AND moment < high GROUP BY w_id"""
REST_SQL = """WITH a AS (SELECT home AS team, match_date FROM matches UNION SELECT away, match_date FROM matches), d AS (SELECT team, match_date, lag(match_date) OVER (PARTITION BY team ORDER BY match_date) AS last FROM a)
SELECT m.match_id, CAST(date_diff('day', last, m.match_date) AS INT) AS rest FROM matches m JOIN d ON d.team = m.home AND d.match_date = m.match_date"""


@query(
    "as_of_quote",
    """WITH b AS (SELECT quote_id AS ask_id, match_id, observed_at AS asked FROM quotes WHERE book = 'view'), q AS (SELECT * FROM quotes WHERE book <> 'view'),
r AS (SELECT ask_id, b.match_id, quote_id, price, row_number() OVER (PARTITION BY ask_id ORDER BY observed_at DESC, quote_id DESC) AS k FROM b LEFT JOIN q ON b.match_id = q.match_id AND q.observed_at <= asked)
SELECT ask_id, match_id, quote_id, round(price, 6) AS price FROM r WHERE k = 1""",
    ("quotes",),
)
def as_of_quote(spark, sf_dir):
    """The latest quote of another book at each view."""
    quotes = domain(spark, sf_dir, "quotes")
    asked = quotes.where("book = 'view'").select(F.col("quote_id").alias("ask_id"), "match_id", F.col("observed_at").alias("asked"))
    other = quotes.where("book <> 'view'")
    return J.as_of(asked, other, "match_id", "asked", "observed_at", ["quote_id", "price"], "quote_id").select("ask_id", "match_id", "quote_id", F.round("price", 6).alias("price"))


@query(
    "nearest_result_within_a_day",
    NEAREST_SQL,
    ("matches",),
)
def nearest_result_within_a_day(spark, sf_dir):
    """Rows with a result win over nearer rows without; one match in six stands for those without."""
    m = domain(spark, sf_dir, "matches")
    bets = m.select(F.col("match_id").alias("bet_id"), "home", "away", F.date_add("match_date", (F.col("match_id") % 3 - 1).cast("int")).alias("day"))
    order = [F.when(F.col("match_id") % 6 == 0, 1).otherwise(0), F.abs(F.date_diff("match_date", "day")), F.col("match_id")]
    return J.nearest_day(bets, m.select("match_id", "home", "away", "match_date"), ["home", "away"], "day", "match_date", 1, "bet_id", order).select("bet_id", "match_id")


@query("nearest_result_of_every_match", NEAREST_SQL, ("matches",))
def nearest_result_of_every_match(spark, sf_dir):
    """The same answer under its earlier name."""
    return nearest_result_within_a_day(spark, sf_dir)


@query(
    "three_pass_odds_ladder",
    """WITH f AS (SELECT match_id, home, away, match_date, season FROM matches), a AS (SELECT home, away, match_date, max(match_id * 1e-2) AS v FROM matches WHERE match_id % 3 = 0 GROUP BY 1, 2, 3),
b AS (SELECT home, away, season, max(match_id * 1e-2) AS v FROM matches WHERE match_id % 5 = 0 GROUP BY 1, 2, 3), c AS (SELECT home, away, max(match_id * 1e-2) AS v FROM matches WHERE match_id % 7 = 0 GROUP BY 1, 2)
SELECT f.match_id, round(coalesce(a.v, b.v, c.v), 6) AS price FROM f LEFT JOIN a ON f.home = a.home AND f.away = a.away AND f.match_date = a.match_date
LEFT JOIN b ON f.home = b.home AND f.away = b.away AND f.season = b.season LEFT JOIN c ON f.home = c.home AND f.away = c.away""",
    ("matches",),
)
def three_pass_odds_ladder(spark, sf_dir):
    m = domain(spark, sf_dir, "matches").withColumn("price", F.col("match_id") * 1e-2)
    passes = [(m.where("match_id % 3 = 0"), ["home", "away", "match_date"]), (m.where("match_id % 5 = 0"), ["home", "away", "season"]), (m.where("match_id % 7 = 0"), ["home", "away"])]
    return J.ladder(m.drop("price"), passes, "price").select("match_id", F.round("price", 6).alias("price"))


@query(
    "range_join_windows",
    RANGE_SQL,
    ("quotes",),
)
def range_join_windows(spark, sf_dir):
    """Quotes within the two hours from each quote of their match."""
    p = domain(spark, sf_dir, "quotes").select("quote_id", "match_id", F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("at"))
    w = p.select("match_id", F.col("at").alias("low"), (F.col("at") + 7200).alias("high"), F.col("quote_id").alias("w_id"))
    return J.within_bands(p, w, "match_id", "at", "low", "high", 7200).groupBy("w_id").agg(F.count("*").alias("n"))


@query("range_join_windows_of_every_quote", RANGE_SQL, ("quotes",))
def range_join_windows_of_every_quote(spark, sf_dir):
    """The same answer under its earlier name."""
    return range_join_windows(spark, sf_dir)


@query(
    "closing_quote_near_kickoff",
    """WITH k AS (SELECT match_id, max(observed_at) - INTERVAL 2 HOUR AS kickoff FROM quotes GROUP BY match_id), d AS (SELECT q.match_id, selection, quote_id, price, abs(epoch_us(observed_at) - epoch_us(kickoff)) AS gap FROM quotes q JOIN k ON q.match_id = k.match_id),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, selection ORDER BY CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END, gap, quote_id) AS n FROM d)
SELECT match_id, selection, quote_id, round(price, 6) AS price FROM r WHERE n = 1""",
    ("quotes",),
)
def closing_quote_near_kickoff(spark, sf_dir):
    """Quotes within half an hour of kickoff first, else any, by smallest gap."""
    q = domain(spark, sf_dir, "quotes")
    kick = q.groupBy("match_id").agg((F.max("observed_at") - F.expr("INTERVAL 2 HOURS")).alias("kickoff"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = q.join(kick, "match_id").withColumn("gap", F.abs(us("observed_at") - us("kickoff")))
    best = d.groupBy("match_id", "selection").agg(F.min_by(F.struct("quote_id", "price"), F.struct((F.col("gap") > 1_800_000_000), F.col("gap"), F.col("quote_id"))).alias("b"))
    return best.select("match_id", "selection", "b.quote_id", F.round("b.price", 6).alias("price"))


@query(
    "role_playing_join",
    """WITH t AS (SELECT CAST(n_nationkey AS INT) AS team, n_name AS name FROM nation) SELECT m.match_id, h.name AS home_name, a.name AS away_name FROM matches m JOIN t h ON m.home = h.team LEFT JOIN t a ON m.away = a.team""",
    ("matches",),
)
def role_playing_join(spark, sf_dir):
    teams = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("team"), F.col("n_name").alias("name"))
    home, away = (teams.select(F.col("team").alias(k), F.col("name").alias(f"{k}_name")) for k in ("home", "away"))
    return domain(spark, sf_dir, "matches").join(home, "home").join(away, "away", "left").select("match_id", "home_name", "away_name")


@query("existing_key_anti_join", "SELECT match_id FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.match_id % 2 = 0 AND o.home = m.home AND o.away = m.away AND o.match_date = m.match_date)", ("matches",))
def existing_key_anti_join(spark, sf_dir):
    m = domain(spark, sf_dir, "matches")
    known = m.where("match_id % 2 = 0").select("home", "away", "match_date").distinct()
    return m.join(known, ["home", "away", "match_date"], "left_anti").select("match_id")


@query(
    "match_dedup_range",
    """WITH old AS (SELECT * FROM matches WHERE match_id % 2 = 0), r AS (SELECT n.match_id, o.match_id AS same_as, row_number() OVER (PARTITION BY n.match_id ORDER BY abs(date_diff('day', n.match_date, o.match_date)), o.match_id) AS k
FROM matches n JOIN old o ON n.home = o.home AND n.away = o.away AND n.comp = o.comp AND abs(date_diff('day', n.match_date, o.match_date)) <= 1 WHERE n.match_id % 2 = 1) SELECT match_id, same_as FROM r WHERE k = 1""",
    ("matches",),
)
def match_dedup_range(spark, sf_dir):
    m = domain(spark, sf_dir, "matches")
    new = m.where("match_id % 2 = 1").select("match_id", "home", "away", "comp", "match_date")
    old = m.where("match_id % 2 = 0").select(F.col("match_id").alias("same_as"), "home", "away", "comp", F.col("match_date").alias("old_date"))
    gap = F.abs(F.date_diff("match_date", "old_date"))
    return J.nearest_day(new, old, ["home", "away", "comp"], "match_date", "old_date", 1, "match_id", [gap, F.col("same_as")]).select("match_id", "same_as")


@query(
    "rest_lookup_as_of",
    REST_SQL,
    ("matches",),
)
def rest_lookup_as_of(spark, sf_dir):
    """Days since the home side's last earlier match, for every match."""
    m = domain(spark, sf_dir, "matches")
    played = m.select(F.explode(F.array("home", "away")).alias("team"), F.date_add("match_date", 1).alias("from"), F.col("match_date").alias("last"), F.unix_date("match_date").alias("n")).distinct()
    asked = m.select("match_id", F.col("home").alias("team"), F.col("match_date").alias("day"))
    return J.as_of(asked, played, "team", "day", "from", ["last"], "n").select("match_id", F.date_diff("day", "last").alias("rest"))


@query("rest_lookup_of_every_match", REST_SQL, ("matches",))
def rest_lookup_of_every_match(spark, sf_dir):
    """The same answer under its earlier name."""
    return rest_lookup_as_of(spark, sf_dir)


@query(
    "upsert_matches",
    """WITH new AS (SELECT match_id, CAST(fthg + 1 AS INT) AS fthg FROM matches WHERE match_id % 3 = 0) SELECT m.match_id, coalesce(n.fthg, m.fthg) AS fthg FROM matches m LEFT JOIN new n ON m.match_id = n.match_id""",
    ("matches",),
)
def upsert_matches(spark, sf_dir):
    m = domain(spark, sf_dir, "matches").select("match_id", "fthg")
    new = m.where("match_id % 3 = 0").select("match_id", (F.col("fthg") + 1).cast("int").alias("fthg"))
    return U.upsert(m, new, ["match_id"], ["fthg"])


@query(
    "merge_supplied_columns",
    """SELECT match_id, CASE WHEN match_id % 4 = 0 AND match_id % 8 <> 0 THEN 99 ELSE hs END AS hs, CASE WHEN match_id % 4 = 0 AND match_id % 12 <> 0 THEN 77 ELSE hc END AS hc FROM matches""",
    ("matches",),
)
def merge_supplied_columns(spark, sf_dir):
    m = domain(spark, sf_dir, "matches")
    new = m.where("match_id % 4 = 0").select("match_id", F.when(F.col("match_id") % 8 != 0, 99).alias("hs"), F.when(F.col("match_id") % 12 != 0, 77).alias("hc"))
    return U.merge_supplied(m.select("match_id", "hs", "hc"), new, ["match_id"], ["hs", "hc"])


@query(
    "keep_last_by_key",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY home, away, match_date ORDER BY match_id DESC) AS k FROM matches) SELECT match_id, home, away, match_date FROM r WHERE k = 1""",
    ("matches",),
)
def keep_last_by_key(spark, sf_dir):
    return U.keep_last(domain(spark, sf_dir, "matches").select("match_id", "home", "away", "match_date"), ["home", "away", "match_date"], ["match_id"])


@query(
    "journal_insert_if_absent",
    """WITH old AS (SELECT DISTINCT match_id, market, selection FROM bets WHERE bet_id % 3 = 0), r AS (SELECT b.*, row_number() OVER (PARTITION BY b.match_id, b.market, b.selection ORDER BY bet_id) AS k FROM bets b
WHERE bet_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.match_id = b.match_id AND o.market = b.market AND o.selection = b.selection)) SELECT bet_id FROM r WHERE k = 1""",
    ("bets",),
)
def journal_insert_if_absent(spark, sf_dir):
    b = domain(spark, sf_dir, "bets").select("bet_id", "match_id", "market", "selection")
    return U.insert_absent(b.where("bet_id % 3 = 0"), b.where("bet_id % 3 <> 0"), ["match_id", "market", "selection"], ["bet_id"]).select("bet_id")


@query("compare_and_set_settle", "SELECT CASE WHEN status = 'PENDING' AND bet_id % 2 = 0 THEN 'WIN' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE status = 'PENDING' AND bet_id % 2 = 0) AS changed FROM bets GROUP BY 1", ("bets",))
def compare_and_set_settle(spark, sf_dir):
    b = domain(spark, sf_dir, "bets").select("bet_id", "status")
    done = U.compare_and_set(b, b.where("bet_id % 2 = 0").select("bet_id", F.lit("WIN").alias("status")), "bet_id", "status", "PENDING")
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("partition_overwrite", "SELECT comp, count(*) AS n, CAST(sum(CASE WHEN comp = '2-HIGH' THEN match_id + 1 ELSE match_id END) AS BIGINT) AS s FROM matches GROUP BY comp", ("matches",))
def partition_overwrite(spark, sf_dir):
    m = domain(spark, sf_dir, "matches").select("comp", "match_id")
    new = m.where("comp = '2-HIGH'").select("comp", (F.col("match_id") + 1).alias("match_id"))
    return U.replace_partition(m, new, "comp").groupBy("comp").agg(F.count("*").alias("n"), F.sum("match_id").alias("s"))


@query(
    "union_best_source",
    """WITH u AS (SELECT match_id, home, away, match_date, 0 AS k FROM matches WHERE match_id % 2 = 0 UNION ALL SELECT match_id, home, away, match_date, 1 FROM matches WHERE match_id % 3 = 0 UNION ALL SELECT match_id, home, away, match_date, 2 FROM matches),
r AS (SELECT *, row_number() OVER (PARTITION BY match_date, home, away ORDER BY k, match_id) AS n FROM u) SELECT match_id, home, away, match_date FROM r WHERE n = 1""",
    ("matches",),
)
def union_best_source(spark, sf_dir):
    m = domain(spark, sf_dir, "matches").select("match_id", "home", "away", "match_date")
    return U.union_by_rank([m.where("match_id % 2 = 0"), m.where("match_id % 3 = 0"), m], ["match_date", "home", "away"], ["match_id"])


@query(
    "lake_append_idempotent",
    """SELECT book, count(DISTINCT md5(CAST(match_id AS VARCHAR) || '|' || props)) AS n FROM quotes GROUP BY book""",
    ("quotes",),
)
def lake_append_idempotent(spark, sf_dir):
    """Rows of equal source and payload enter once."""
    q = domain(spark, sf_dir, "quotes").select("book", F.md5(F.concat_ws("|", F.col("match_id").cast("string"), F.col("props")).cast("binary")).alias("h"))
    return q.distinct().groupBy("book").agg(F.count("*").alias("n"))


@query("lineage_back_join", "SELECT q.match_id, count(*) AS n, count(e.event_id) AS found FROM quotes q LEFT JOIN events e ON e.event_id = q.quote_id * 2 GROUP BY q.match_id", ("quotes",))
def lineage_back_join(spark, sf_dir):
    """Prediction rows back to raw rows, missing ones counted."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    q = domain(spark, sf_dir, "quotes")
    return q.join(raw, raw["event_id"] == q["quote_id"] * 2, "left").groupBy("match_id").agg(F.count("*").alias("n"), F.count("event_id").alias("found"))
