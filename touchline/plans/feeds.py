"""Queries that write files and read them back, a settled stream, and columns on names, days and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import payloads as P
from ..functions import scaling as X
from ..functions import strings as S
from ..projection import domain
from ..registry import query
from ..sources import events, files, sinks
from ..streaming import jobs, settlement
from .columns import SETTLED_SQL
from .inference import listed, sql_list

CLUBS = ("FC Köln", "Málaga  CF", "AFC Ajax", "Real & Sociedad", "Twin", "São Paulo SC")
BOOKS = ("Pinnacle", " pinnacle  sports", "Betfair Exchange", "Corner Shop", "betfair")


@query(
    "season_files",
    """SELECT comp AS div, match_date, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, fthg, ftag, ftr, hs FROM matches WHERE season = 1997""",
    ("matches",),
)
def season_files(spark, sf_dir):
    """A season written as the files that the reader takes, with days first and results missing where they can be told."""
    m = domain(spark, sf_dir, "matches").where("season = 1997")
    text = lambda c: F.col(c).cast("string")
    rows = m.select(F.col("comp").alias("Div"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"), text("home").alias("HomeTeam"), text("away").alias("AwayTeam"), text("fthg").alias("FTHG"), text("ftag").alias("FTAG"), F.when(F.col("match_id") % 3 != 0, F.col("ftr")).alias("FTR"), text("hs").alias("HS"))
    path = jobs.shared_folder(spark, "season")
    sinks.export_csv(rows, path)
    read = files.clean_matches(files.season_csv(spark, path), 1997)
    return read.select(F.col("Div").alias("div"), F.col("Date").alias("match_date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"), F.col("FTHG").alias("fthg"), F.col("FTAG").alias("ftag"), F.col("FTR").alias("ftr"), F.col("HS").alias("hs"))


@query("appended_history", "SELECT market, count(*) AS n, round(sum(stake), 2) AS stake FROM (SELECT market, stake FROM bets WHERE bet_id % 2 = 0 UNION ALL SELECT market, stake FROM bets WHERE bet_id % 3 = 0) t GROUP BY market", ("bets",))
def appended_history(spark, sf_dir):
    """A history appended to twice and read."""
    b = domain(spark, sf_dir, "bets").select("bet_id", "market", "stake")
    path = jobs.shared_folder(spark, "history")
    sinks.append_rows(b.where("bet_id % 2 = 0"), path)
    sinks.append_rows(b.where("bet_id % 3 = 0"), path)
    return spark.read.parquet(path).groupBy("market").agg(F.count("*").alias("n"), F.round(F.sum("stake"), 2).alias("stake"))


@query("settled_batches", f"WITH {SETTLED_SQL.strip()} SELECT bet_id, round(pnl, 4) AS pnl FROM priced WHERE r IS NOT NULL", ("matches", "bets"))
def settled_batches(spark, sf_dir):
    """A stream of bets against a stream of results that is there before them, settled into a journal."""
    return _replayed(spark, sf_dir, F.lit(False), "0 hours", None).select("bet_id", F.round("pnl", 4).alias("pnl"))


PATIENCE_DAYS = 20
MATCHES_A_KEY = 5_000


def _replayed(spark, sf_dir, missing, grace, patience):
    """All bets settled by two runs of one stream, over what was known by the middle of the table's time and over the rest.

    Results become known an hour after the end of the day's matches, every third match's five days later; ``missing`` ones never.
    """
    m = domain(spark, sf_dir, "matches").withColumn("kickoff", F.col("match_date").cast("timestamp") + F.make_dt_interval(hours=F.lit(15)))
    hours = lambda n: F.make_dt_interval(hours=n)
    after = F.when(F.col("match_id") % 3 == 0, 120).when(F.col("match_id") % 7 == 0, 1).otherwise(3)
    none = F.lit(None).cast("long")
    results = m.where(~missing).select("match_id", (F.col("kickoff") + hours(after)).alias("known_at"), F.lit("FINISHED").alias("status"), F.col("fthg").cast("long").alias("fthg"), F.col("ftag").cast("long").alias("ftag"), none.alias("hc"), none.alias("ac"))
    bets = domain(spark, sf_dir, "bets").join(m.select("match_id", "kickoff"), "match_id")
    bets = bets.select("bet_id", "match_id", (F.col("kickoff") - hours(F.lit(24))).alias("placed_at"), "kickoff", "market", "selection", "line", "odds", F.col("stake").cast("double").alias("stake"))
    priced = lambda *cs: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, "HDA")), F.array(*map(F.col, cs))), lambda _, v: v > 1)
    odds = domain(spark, sf_dir, "odds").join(m.select("match_id", "kickoff"), "match_id")
    quote = lambda minutes, *cs: odds.select("match_id", (F.col("kickoff") - F.make_dt_interval(mins=F.lit(minutes))).alias("observed_at"), "kickoff", F.lit("1X2").alias("market"), F.lit(None).cast("double").alias("line"), priced(*cs).alias("prices")).where("size(prices) > 0")
    quotes = quote(360, "b365h", "b365d", "b365a").unionByName(quote(10, "psch", "pscd", "psca"))
    tables = {"bets": (bets, "placed_at"), "results": (results, "known_at"), "quotes": (quotes, "observed_at")}
    paths = {k: jobs.shared_folder(spark, k) for k in (*tables, "journal", "log")}
    buckets = max(settlement.BUCKETS, -(-m.count() // MATCHES_A_KEY))  # a key's state stays as it is when tables grow
    middle = m.agg(F.timestamp_seconds((F.unix_seconds(F.min("kickoff")) + F.unix_seconds(F.max("kickoff"))) / 2).alias("middle"))
    for early in (True, False):
        for name, (rows, known) in tables.items():
            part = rows.join(F.broadcast(middle), (F.col(known) <= F.col("middle")) == F.lit(early)).drop("middle")  # one row
            part.write.mode("append").parquet(paths[name])
        streams = [spark.readStream.schema(rows.schema).parquet(paths[name]) for name, (rows, _) in tables.items()]
        settlement.settle_to(settlement.settled(settlement.paired(*streams, grace=grace, patience=patience, buckets=buckets)), paths["journal"], paths["log"])
    return spark.read.parquet(paths["journal"])


@query(
    "settled_late_results",
    f"""WITH k AS (SELECT *, CAST(match_date AS TIMESTAMP) + INTERVAL 15 HOUR AS kickoff FROM matches),
g AS (SELECT *, CASE WHEN match_id % 10 = 0 THEN NULL ELSE kickoff + to_hours(CASE WHEN match_id % 3 = 0 THEN 120 WHEN match_id % 7 = 0 THEN 1 ELSE 3 END) END AS known FROM k),
w AS (SELECT greatest(max(known), max(kickoff) - INTERVAL 10 MINUTE) - INTERVAL 1 HOUR AS clock FROM g),
c AS (SELECT o.match_id, CASE WHEN psch > 1 THEN [psch, pscd, psca] ELSE [b365h, b365d, b365a] END AS o FROM odds o),
s AS (SELECT b.*, g.known, g.kickoff, fthg, ftag, c.o[CASE selection WHEN 'H' THEN 1 WHEN 'D' THEN 2 WHEN 'A' THEN 3 END] AS price,
    CASE WHEN c.o[1] > 1 THEN 1 / c.o[1] + 1 / c.o[2] + 1 / c.o[3] ELSE 1 END AS total, w.clock
  FROM bets b JOIN g USING (match_id) JOIN c USING (match_id) CROSS JOIN w),
r AS (SELECT *, CASE market
    WHEN '1X2' THEN CASE WHEN selection = CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END THEN 2 ELSE -2 END
    WHEN 'OU' THEN CAST((sign(fthg + ftag - floor(line * 2) / 2) + sign(fthg + ftag - ceil(line * 2) / 2)) * CASE selection WHEN 'Over' THEN 1 ELSE -1 END AS INT)
    ELSE CAST(sign((fthg - ftag) * CASE selection WHEN 'Home' THEN 1 ELSE -1 END + floor(line * 2) / 2) + sign((fthg - ftag) * CASE selection WHEN 'Home' THEN 1 ELSE -1 END + ceil(line * 2) / 2) AS INT) END AS rank FROM s)
SELECT bet_id, CASE WHEN known IS NULL THEN 'VOID' ELSE ['LOST', 'HALF_LOSS', 'VOID', 'HALF_WIN', 'WON'][rank + 3] END AS status,
  round(CASE WHEN known IS NULL THEN 0 WHEN rank > 0 THEN stake * (odds - 1) * rank / 2e0 ELSE stake * rank / 2e0 END, 4) AS pnl,
  round(CASE WHEN known IS NOT NULL AND market = '1X2' AND price > 1 AND odds > 1 THEN ln(odds / (price * total)) END, 6) AS clv,
  CASE WHEN known IS NULL THEN kickoff + INTERVAL {PATIENCE_DAYS} DAY ELSE greatest(known, kickoff + INTERVAL 2 HOUR) END AS settled_at
FROM r WHERE CASE WHEN known IS NULL THEN clock >= kickoff + INTERVAL {PATIENCE_DAYS} DAY ELSE greatest(clock, known) >= kickoff + INTERVAL 2 HOUR END""",
    ("matches", "odds", "bets"),
)
def settled_late_results(spark, sf_dir):
    """Bets settled by results that come late or never, with closing-line value; those without a result are void in the end."""
    done = _replayed(spark, sf_dir, F.col("match_id") % 10 == 0, "2 hours", f"{PATIENCE_DAYS} days")
    return done.select("bet_id", "status", F.round("pnl", 4).alias("pnl"), F.round("clv", 6).alias("clv"), F.col("settled_at").cast("timestamp_ntz").alias("settled_at"))


@query("folded_names", f"SELECT match_id, CASE c WHEN 'FC Köln' THEN 'koln' WHEN 'Málaga  CF' THEN 'malagacf' WHEN 'AFC Ajax' THEN 'ajax' WHEN 'Real & Sociedad' THEN 'realsociedad' WHEN 'Twin' THEN 'twin' ELSE 'saopaulosc' END AS key, CASE c WHEN 'FC Köln' THEN 'koln_M' WHEN 'Málaga  CF' THEN 'malaga_M' WHEN 'AFC Ajax' THEN 'ajax_M' WHEN 'Real & Sociedad' THEN 'real-and-sociedad_M' WHEN 'Twin' THEN 'twin_M' ELSE 'sao-paulo_M' END AS scoped FROM (SELECT match_id, {sql_list(CLUBS)} AS c FROM matches) t", ("matches",))
def folded_names(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", S.folded_key(listed(CLUBS)).alias("key"), S.team_key(listed(CLUBS), F.lit("M")).alias("scoped"))


@query("sharp_books", f"SELECT match_id, match_id % {len(BOOKS)} <> 3 AS sharp FROM matches", ("matches",))
def sharp_books(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", S.is_sharp(listed(BOOKS)).alias("sharp"))


@query("day_labels", "SELECT match_id, CASE match_id % 4 WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE dayname(match_date + CAST(match_id % 4 AS INT)) END AS label FROM matches", ("matches",))
def day_labels(spark, sf_dir):
    day = F.date_add("match_date", (F.col("match_id") % 4).cast("int"))
    return domain(spark, sf_dir, "matches").select("match_id", D.day_label(day, F.col("match_date")).alias("label"))


@query("kickoffs_passed", "SELECT match_id, CASE WHEN match_id % 2 = 0 THEN match_id % 24 ELSE 15 END + 2 <= 17 AS passed FROM matches", ("matches",))
def kickoffs_passed(spark, sf_dir):
    """At seventeen hours of the match day, with two hours of grace; a bare day counts from its fifteenth hour."""
    midnight = F.col("match_date").cast("timestamp")
    hours = lambda n: F.make_dt_interval(hours=n)
    kickoff = F.when(F.col("match_id") % 2 == 0, midnight + hours((F.col("match_id") % 24).cast("int")))
    return domain(spark, sf_dir, "matches").select("match_id", D.kickoff_passed(kickoff, F.col("match_date"), midnight + hours(F.lit(17))).alias("passed"))


@query("payload_hashes", """SELECT match_id, sha256('{"away":"' || away || '","home":"' || home || '"}') AS hash FROM matches""", ("matches",))
def payload_hashes(spark, sf_dir):
    """Equal payloads have equal hashes in whatever order their keys come."""
    text = lambda c: F.col(c).cast("string")
    payload = F.when(F.col("match_id") % 2 == 0, F.create_map(F.lit("home"), text("home"), F.lit("away"), text("away"))).otherwise(F.create_map(F.lit("away"), text("away"), F.lit("home"), text("home")))
    return domain(spark, sf_dir, "matches").select("match_id", P.canonical_hash(payload).alias("hash"))


@query("value_units", "SELECT bet_id, round(CASE WHEN bet_id % 2 = 0 THEN p_model ELSE p_model * 250 / CASE WHEN p_model * 250 <= 2 THEN 1 ELSE 100 END END, 8) AS ev, CASE WHEN p_model * 100 >= 80 THEN 'A' WHEN p_model * 100 >= 60 THEN 'B' ELSE 'C' END AS tier FROM bets", ("bets",))
def value_units(spark, sf_dir):
    """Values per cent and as fractions in one unit, and tiers by score."""
    raw = F.when(F.col("bet_id") % 2 == 0, F.col("p_model")).otherwise(F.col("p_model") * 250)
    return domain(spark, sf_dir, "bets").select("bet_id", F.round(X.ev_fraction(raw), 8).alias("ev"), X.quality_tier(F.col("p_model") * 100).alias("tier"))


EVENTS_A_FILE = 300


def _feed_folder(spark, sf_dir):
    """All matches as event feeds, of which every fifth is still to be played; a competition's section begins each file's part."""
    m, c = domain(spark, sf_dir, "matches"), F.col
    seconds = F.unix_seconds(c("match_date").cast("timestamp")) + 54_000
    played = c("match_id") % 5 != 0
    field = lambda k, v: F.concat(F.lit(f"{k}÷"), v.cast("string"), F.lit("¬"))
    goals = F.when(played, F.concat(field("AG", c("fthg")), field("AH", c("ftag")))).otherwise("")
    section = F.concat(field("AA", c("match_id")), field("AD", seconds), field("AB", F.when(played, 3).otherwise(1)), field("AE", F.concat(F.lit("Team "), c("home"), F.lit(" (Eng)"))), field("AF", F.concat(F.lit("Team "), c("away"))), goals)
    files = m.agg(F.greatest(F.ceil(F.count("*") / EVENTS_A_FILE), F.lit(1)).cast("int")).first()[0]
    parts = m.select(c("comp"), F.pmod(F.xxhash64("match_id"), F.lit(files)).cast("int").alias("part"), section.alias("s"))
    texts = parts.groupBy("part", "comp").agg(F.concat_ws("~", F.collect_list("s")).alias("s")).select("part", F.concat(F.lit("ZA÷"), c("comp"), F.lit("¬~"), c("s")).alias("s"))
    whole = texts.groupBy("part").agg(F.concat_ws("~", F.collect_list("s")).alias("value")).select("value")
    path = jobs.shared_folder(spark, "event-feeds")
    whole.write.option("lineSep", "~").option("maxRecordsPerFile", 1).text(path)  # a file a row: a task writes many files
    return path


@query(
    "feed_results",
    "SELECT CAST(match_id AS VARCHAR) AS event_id, match_date + INTERVAL 15 HOUR AS kickoff, 'Team ' || home AS home, 'Team ' || away AS away, fthg, ftag, comp AS competition FROM matches WHERE match_id % 5 <> 0",
    ("matches",),
)
def feed_results(spark, sf_dir):
    """Finished events read back from delimited feeds, with the competitions that their files name."""
    found = events.team_results(spark, _feed_folder(spark, sf_dir))
    return found.select("event_id", F.col("kickoff").cast("timestamp_ntz").alias("kickoff"), "home", "away", "fthg", "ftag", "competition")


@query(
    "feed_fixtures_streamed",
    "SELECT comp AS competition, count(*) AS n, CAST(min(match_date) + INTERVAL 15 HOUR AS TIMESTAMP) AS first FROM matches WHERE match_id % 5 = 0 GROUP BY comp",
    ("matches",),
)
def feed_fixtures_streamed(spark, sf_dir):
    """Events still to be played from the same feeds, read as a stream of files."""
    streamed = jobs.run_to_table(events.events(events.feed_files(spark, _feed_folder(spark, sf_dir), stream=True), False), "fixtures")
    return streamed.groupBy("competition").agg(F.count("*").alias("n"), F.min("kickoff").cast("timestamp_ntz").alias("first"))
