"""Queries over journals, snapshots, entities and policy grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scaling as X
from ..functions.pricing import capped_kelly, devig_multiplicative, settlement_kelly
from ..operators import score_matrix as S
from ..operators import windows as W
from ..operators import snapshots
from ..projection import domain
from ..registry import query
from .columns import RANK_SQL, settled
from .scores import cells, mass_sql


@query(
    "settlement_kelly",
    f"""WITH RECURSIVE {mass_sql("(x + y)", "1.5e0", 13)}, s AS (SELECT home, away, line, win, half_win, half_loss, lose, 0e0 AS lo, 1 - 1e-9 AS hi, 0 AS k FROM masses WHERE win * 1.1e0 + half_win * 0.55e0 - half_loss / 2 - lose > 0
  UNION ALL SELECT home, away, line, win, half_win, half_loss, lose, CASE WHEN d > 0 THEN m ELSE lo END, CASE WHEN d > 0 THEN hi ELSE m END, k + 1 FROM (
    SELECT *, win * 1.1e0 / (1 + m * 1.1e0) + half_win * 0.55e0 / (1 + m * 0.55e0) - half_loss * 0.5e0 / (1 - m * 0.5e0) - lose / (1 - m) AS d FROM (SELECT *, (lo + hi) / 2 AS m FROM s WHERE k < 50) t) u)
SELECT home, away, line, round((lo + hi) / 2, 6) AS f FROM s WHERE k = 50 UNION ALL SELECT home, away, line, 0e0 FROM masses WHERE NOT win * 1.1e0 + half_win * 0.55e0 - half_loss / 2 - lose > 0""",
    ("matches", "strengths"),
)
def settlement_kelly_fractions(spark, sf_dir):
    """Growth-optimal stakes on totals at 2.10, halves and pushes included."""
    table = S.masses(cells(spark, sf_dir), F.col("x") + F.col("y"), S.TOTAL_LINES)
    f = settlement_kelly(*(F.col(c) for c in ("win", "half_win", "half_loss", "lose")), F.lit(2.1))
    return table.select("home", "away", "line", F.round(f, 6).alias("f"))


@query(
    "market_pull_grid",
    """WITH g AS (SELECT unnest(range(0, 21)) / 20e0 AS w), e AS (SELECT w, avg(abs((1 - w) * ph + w * pa - CASE ftr WHEN 'H' THEN 1 ELSE 0 END)) AS mae FROM predictions, g GROUP BY w) SELECT w, round(mae, 8) AS mae FROM e ORDER BY round(mae, 10), w LIMIT 1""",
    ("predictions",),
)
def market_pull_grid(spark, sf_dir):
    """The mixing weight of least absolute error on a grid; the first best stays.  One pass sums all grid points."""
    y = F.when(F.col("ftr") == "H", 1.0).otherwise(0.0)
    errors = [F.avg(F.abs((1 - w) * F.col("ph") + w * F.col("pa") - y)).alias(f"e{i}") for i, w in enumerate(X.PULL_GRID)]
    summed = domain(spark, sf_dir, "predictions").agg(*errors)
    rows = summed.select(F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"e{i}").alias("mae")) for i, w in enumerate(X.PULL_GRID)))).alias("g")).select("g.*")
    return rows.orderBy(F.round("mae", 10), "w").limit(1).select("w", F.round("mae", 8).alias("mae"))


@query(
    "ablation_by_weight",
    """WITH g AS (SELECT unnest([0e0, 0.2e0, 0.4e0]) AS w) SELECT w, count(*) FILTER (WHERE ((1 - w) * p_model + w * 0.5e0) * odds - 1 >= 0.05e0) AS picked, round(avg(CASE WHEN ((1 - w) * p_model + w * 0.5e0) * odds - 1 >= 0.05e0 THEN odds END), 8) AS odds FROM bets, g GROUP BY w""",
    ("bets",),
)
def ablation_by_weight(spark, sf_dir):
    rows = domain(spark, sf_dir, "bets").withColumn("w", F.explode(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.4))))
    hit = ((1 - F.col("w")) * F.col("p_model") + F.col("w") * 0.5) * F.col("odds") - 1 >= 0.05
    return rows.groupBy("w").agg(F.count_if(hit).alias("picked"), F.round(F.avg(F.when(hit, F.col("odds"))), 8).alias("odds"))


@query(
    "market_probabilities",
    "SELECT match_id, round(CASE WHEN b365h > 1 AND b365d > 1 AND b365a > 1 THEN (1 / b365h) / (1 / b365h + 1 / b365d + 1 / b365a) ELSE 1e0 / 3 END, 8) AS ph FROM odds",
    ("odds",),
)
def market_probabilities(spark, sf_dir):
    """Margin-free market, or uniform where a price is missing."""
    ph = devig_multiplicative(*(F.col(c) for c in ("b365h", "b365d", "b365a")))[0]
    return domain(spark, sf_dir, "odds").select("match_id", F.round(F.coalesce(ph, F.lit(1.0 / 3)), 8).alias("ph"))


@query(
    "journals_union",
    """SELECT CASE WHEN bet_id % 3 = 0 THEN 'one' WHEN bet_id % 3 = 1 THEN 'two' ELSE 'three' END AS league, status, count(*) AS n, round(sum(stake), 4) AS stake FROM bets GROUP BY 1, 2""",
    ("bets",),
)
def journals_union(spark, sf_dir):
    """Journals of several leagues as one, each tagged."""
    b = domain(spark, sf_dir, "bets")
    parts = [b.where(F.col("bet_id") % 3 == i).withColumn("league", F.lit(n)) for i, n in enumerate(("one", "two", "three"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("league", "status").agg(F.count("*").alias("n"), F.round(F.sum("stake"), 4).alias("stake"))


@query(
    "latest_quotes_first_parseable",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY observed_at DESC, quote_id DESC) AS k FROM quotes), f AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY k) AS j FROM r WHERE k <= 8 AND price > 2) SELECT match_id, quote_id, CAST(k AS INT) AS k FROM f WHERE j = 1""",
    ("quotes",),
)
def latest_quotes_first_parseable(spark, sf_dir):
    """Of the latest eight rows of a match the first with a usable price."""
    k = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("observed_at"), F.desc("quote_id")))
    latest = domain(spark, sf_dir, "quotes").withColumn("k", k).where("k <= 8 AND price > 2")
    return latest.groupBy("match_id").agg(F.min_by(F.struct("quote_id", "k"), "k").alias("b")).select("match_id", "b.quote_id", "b.k")


@query(
    "monitor_cycle",
    """WITH l AS (SELECT max(observed_at) AS now FROM quotes) SELECT book, count(*) FILTER (WHERE match_id % 7 = 0) AS unmapped, round((epoch_us(any_value(now)) - epoch_us(max(observed_at))) / 3600e6, 6) AS age_hours FROM quotes, l GROUP BY book""",
    ("quotes",),
)
def monitor_cycle(spark, sf_dir):
    q = domain(spark, sf_dir, "quotes")
    now = q.agg(F.max("observed_at").alias("now"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    by = q.crossJoin(F.broadcast(now)).groupBy("book")  # one row is broadcast
    return by.agg(F.count_if(F.col("match_id") % 7 == 0).alias("unmapped"), F.round((us(F.max("now")) - us(F.max("observed_at"))) / 3.6e9, 6).alias("age_hours"))


@query("alias_union", "SELECT home AS team, array_to_string(list_sort(list_distinct(list('T' || (match_id % 4)))), ',') AS aliases FROM matches GROUP BY home", ("matches",))
def alias_union(spark, sf_dir):
    alias = F.concat(F.lit("T"), (F.col("match_id") % 4).cast("string"))
    return domain(spark, sf_dir, "matches").groupBy(F.col("home").alias("team")).agg(F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"))


@query(
    "snapshot_flatten",
    """SELECT match_id, selection, count(*) AS n, round(max(price), 6) AS best FROM quotes GROUP BY 1, 2""",
    ("quotes",),
)
def snapshot_flatten(spark, sf_dir):
    """Nested snapshots (match, books, markets as maps) flattened to quotes again."""
    q = domain(spark, sf_dir, "quotes")
    nested = q.groupBy("match_id", "book", "quote_id").agg(F.map_from_entries(F.collect_list(F.struct("selection", "price"))).alias("market")).groupBy("match_id", "book").agg(F.collect_list("market").alias("markets"))
    flat = nested.select("match_id", F.explode("markets").alias("market")).select("match_id", F.explode("market").alias("selection", "price"))
    return flat.groupBy("match_id", "selection").agg(F.count("*").alias("n"), F.round(F.max("price"), 6).alias("best"))


@query(
    "upcoming_features",
    """WITH t AS (SELECT home AS team, match_id, match_date, fthg AS gf FROM matches UNION ALL SELECT away, match_id, match_date, ftag FROM matches), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS k FROM t)
SELECT team, round(avg(gf) FILTER (WHERE k <= 5), 8) AS gf5, CAST(date_diff('day', max(match_date), max(day)) AS INT) AS rest, count(*) FILTER (WHERE match_date >= day - 14) AS n14 FROM r, (SELECT max(match_date) + 10 AS day FROM matches) d GROUP BY team""",
    ("matches",),
)
def upcoming_features(spark, sf_dir):
    """The features a fixture of a later day would see, from each team's last rows."""
    k = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id")))
    m = domain(spark, sf_dir, "matches")
    fixture = m.agg(F.date_add(F.max("match_date"), 10).alias("day"))
    rows, day = W.team_rows(m).withColumn("k", k).crossJoin(F.broadcast(fixture)), F.col("day")  # one row is broadcast
    return rows.groupBy("team").agg(F.round(F.avg(F.when(F.col("k") <= 5, F.col("gf"))), 8).alias("gf5"), F.date_diff(F.max(day), F.max("match_date")).alias("rest"), F.count_if(F.col("match_date") >= F.date_sub(day, 14)).alias("n14"))


@query(
    "season_profit_table",
    f"""WITH s AS (SELECT b.stake, b.odds, m.season, m.comp, {RANK_SQL} AS r FROM bets b JOIN matches m ON b.match_id = m.match_id)
SELECT season, comp, count(*) AS n, round(sum(CASE WHEN r > 0 THEN stake * (odds - 1) * r / 2 ELSE stake * r / 2e0 END), 4) AS pnl FROM s GROUP BY ROLLUP (season, comp)""",
    ("matches", "bets"),
)
def season_profit_table(spark, sf_dir):
    return settled(spark, sf_dir).rollup("season", "comp").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(
    "stake_policy_compare",
    "SELECT market, round(sum(least(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0)), 6) AS capped, round(sum(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0), 6) AS fractional FROM bets GROUP BY market",
    ("bets",),
)
def stake_policy_compare(spark, sf_dir):
    p, o = F.col("p_model"), F.col("odds")
    return domain(spark, sf_dir, "bets").groupBy("market").agg(F.round(F.sum(capped_kelly(p, o)), 6).alias("capped"), F.round(F.sum(capped_kelly(p, o, cap=1.0)), 6).alias("fractional"))


def _odds_payloads(spark, sf_dir):
    """Odds as payloads of six shapes, by match."""
    o, c = domain(spark, sf_dir, "odds"), F.col
    h, d, a, over, under = c("b365h"), c("b365d"), c("b365a"), c("b365_o25"), c("b365_u25")
    names = lambda *ks: F.struct(*(x.alias(k) for k, x in zip(ks, (h, d, a))))
    ident, k = c("match_id").cast("string"), c("match_id") % 6
    text = lambda x: x.cast("string")
    shapes = [
        F.struct(ident.alias("match_id"), F.array(F.struct(F.lit("B365").alias("bookmaker"), *(x.alias(n) for n, x in zip(("home", "draw", "away"), (h, d, a))))).alias("odds")),
        F.struct(ident.alias("canonical_match_id"), F.lit("B365").alias("source"), F.array(F.struct(F.lit("1X2").alias("market"), F.struct(text(h).alias("H"), text(d).alias("X"), text(a).alias("2")).alias("odds"))).alias("odds")),
        F.struct(ident.alias("fixture_id"), F.array(F.struct(F.lit("B365").alias("name"), F.struct(names("H", "D", "A").alias("1X2"), F.struct(over.alias("Over"), under.alias("U")).alias("OU")).alias("markets"))).alias("bookmakers")),
        F.struct(ident.alias("match_id"), F.array(F.struct(F.lit("B365").alias("bookmaker"), F.array(F.struct(F.lit("1X2").alias("market_type"), names("1", "draw_odds", "odds_away").alias("odds"))).alias("markets"))).alias("bookmakers")),
        F.struct(ident.alias("match_id"), F.lit("B365").alias("bookmaker"), F.struct(names("home", "draw", "away").alias("1X2")).alias("markets")),
        F.struct(ident.alias("match_id"), F.lit("B365").alias("source"), h.alias("odds_home"), d.alias("odds_draw"), a.alias("odds_away"), F.lit(2.5).alias("line"), F.lit(True).alias("H")),
    ]
    payload = F.coalesce(*(F.when(k == i, F.to_json(s)) for i, s in enumerate(shapes)))
    return o.select("match_id", payload.alias("payload"), h.alias("b365h"))


@query(
    "payload_quotes",
    """WITH p AS (SELECT match_id, unnest(['H', 'D', 'A']) AS selection, unnest([b365h, b365d, b365a]) AS price FROM odds
UNION ALL SELECT match_id, unnest(['over', 'under']), unnest([b365_o25, b365_u25]) FROM odds WHERE match_id % 6 = 2)
SELECT match_id, 'B365' AS bookmaker, CASE WHEN selection IN ('over', 'under') THEN 'OU' ELSE '1X2' END AS market, selection, round(price, 6) AS price FROM p WHERE price > 1""",
    ("odds",),
)
def payload_quotes(spark, sf_dir):
    """Quotes out of payloads of every nesting, read without a schema."""
    q = snapshots.quotes_of(_odds_payloads(spark, sf_dir))
    return q.select(F.col("match_id").cast("long").alias("match_id"), "bookmaker", "market", "selection", F.round("price", 6).alias("price"))


@query(
    "payload_closing_prices",
    """SELECT match_id, CASE WHEN b365h > 1 THEN round(b365h, 6) END AS home, CASE WHEN b365h > 1 THEN round(b365h * (1 / b365h + 1 / b365d + 1 / b365a), 6) END AS fair
FROM odds WHERE match_id % 6 = 4""",
    ("odds",),
)
def payload_closing_prices(spark, sf_dir):
    """Closing home price, and without its margin, from payloads that nest the market under its name."""
    rows, args = _odds_payloads(spark, sf_dir).where("match_id % 6 = 4"), (F.col("payload"), F.lit("1X2"), F.lit("Home"))
    priced = rows.select("match_id", snapshots.closing_price(*args).alias("home"), snapshots.closing_prices(*args).alias("all"))
    margin = F.aggregate("all", F.lit(0.0), lambda t, x: t + 1.0 / x)
    return priced.select("match_id", F.round("home", 6).alias("home"), F.round(F.col("home") * margin, 6).alias("fair"))
