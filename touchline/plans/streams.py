"""Queries that run as streams over what the event files hold, and readers of raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pricing import capped_kelly
from ..projection import domain
from ..registry import query
from ..streaming import jobs, paper
from ..streaming.settlement import settle_to


@query(
    "stream_price_windows",
    "SELECT date_trunc('day', observed_at) AS start, book, count(*) AS n, round(avg(price), 8) AS price FROM quotes GROUP BY 1, 2",
    ("quotes",),
)
def stream_price_windows(spark, sf_dir):
    table = jobs.run_to_table(jobs.price_windows(jobs.quote_stream(spark, f"{sf_dir}/events*.parquet")), "price-windows", "complete")
    return table.select(F.col("start").cast("timestamp_ntz").alias("start"), "book", "n", F.round("price", 8).alias("price"))


@query(
    "stream_signals_once",
    "SELECT DISTINCT match_id, book, date_trunc('day', observed_at) AS day FROM quotes WHERE price >= 4.5e0",
    ("quotes",),
)
def stream_signals_once(spark, sf_dir):
    """A replay of all files in one batch: files come in no order of time, and later batches would drop late rows."""
    table = jobs.run_to_table(jobs.signals_once(jobs.quote_stream(spark, f"{sf_dir}/events*.parquet", None)), "signals")
    return table.select("match_id", "book", F.col("day").cast("timestamp_ntz").alias("day"))


@query(
    "stream_exposure",
    """WITH RECURSIVE c AS (SELECT bet_id, day, s, row_number() OVER (PARTITION BY day ORDER BY bet_id) AS k FROM (SELECT bet_id, day, least(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0) AS s FROM bets) b WHERE s > 0),
f AS (SELECT day AS d, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bet_id, FALSE AS ok, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT day FROM c) t
UNION ALL SELECT d, k, c.bet_id, total + s <= 0.05e0 + 1e-12, total + CASE WHEN total + s <= 0.05e0 + 1e-12 THEN s ELSE 0 END FROM f JOIN c ON c.day = f.d AND c.k = f.n + 1)
SELECT d AS day, bet_id, ok AS accepted FROM f WHERE n > 0""",
    ("bets",),
)
def stream_exposure(spark, sf_dir):
    """Stakes accepted by a stateful fold."""
    bets = domain(spark, sf_dir, "bets").select("day", "bet_id", capped_kelly(F.col("p_model"), F.col("odds")).alias("stake_pct")).where("stake_pct > 0")
    source = jobs.shared_folder(spark, "bets")
    bets.write.parquet(source)
    return jobs.run_to_table(jobs.exposure_stream(spark.readStream.schema(bets.schema).parquet(source)), "exposure")


@query(
    "page_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT link) AS links, min(link) AS first FROM l GROUP BY page_id""",
)
def page_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("link").alias("links"), F.min("link").alias("first"))


@query("page_hosts", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query(
    "paper_trades",
    """WITH RECURSIVE o AS (SELECT pred_id, comp, dense_rank() OVER (ORDER BY comp) AS lg, day, day::TIMESTAMP + to_hours(CAST(pred_id % 24 AS INT)) AS known, 40 + pred_id % 61 AS score, 60 + pred_id % 41 AS conf, pred_id % 11 = 0 AS no_bet,
  unnest([0, 1, 2]) AS k, unnest(['H', 'D', 'A']) AS selection, unnest([ph, pd, pa]) AS p, unnest([b365h, b365d, b365a]) AS price FROM predictions JOIN odds ON pred_id = match_id),
g AS (SELECT pred_id * 4 + k AS obs_id, *, CASE WHEN no_bet THEN 'pipeline' WHEN price IS NULL OR price <= 1 OR p <= 0 THEN 'invalid' WHEN score < 50 THEN 'data' WHEN p * price - 1 < 0.05e0 THEN 'ev' ELSE 'ok' END AS gate FROM o),
c AS (SELECT *, least(greatest((p * price - 1) / (price - 1), 0), 1) * 0.1e0 * (least(score, 100) / 100e0) * (least(conf, 100) / 100e0) AS scaled, row_number() OVER (PARTITION BY day ORDER BY known, obs_id) AS at FROM g WHERE gate = 'ok'),
f AS (SELECT day AS d, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS obs_id, '' AS why, 0e0 AS stake, 0e0 AS total, list_transform(range(20), lambda x: 0e0) AS used, CAST([] AS BIGINT[]) AS opened FROM (SELECT DISTINCT day FROM c) t
UNION ALL SELECT d, n + 1, id, why, CASE WHEN why = 'ok' THEN s ELSE 0 END, total + CASE WHEN why = 'ok' THEN s ELSE 0 END, list_transform(used, lambda x, i: CASE WHEN i = lg AND why = 'ok' THEN x + s ELSE x END), CASE WHEN why = 'ok' THEN list_append(opened, pred_id) ELSE opened END
FROM (SELECT *, CASE WHEN s <= 0 THEN 'zero' WHEN s > 0.05e0 - total + 1e-15 THEN 'day cap' WHEN s > 0.03e0 - used[lg] + 1e-15 THEN 'league cap' ELSE 'ok' END AS why
  FROM (SELECT f.d, f.n, f.total, f.used, f.opened, c.obs_id AS id, c.lg, c.pred_id, least(c.scaled * CASE WHEN list_contains(f.opened, c.pred_id) THEN 0.7e0 ELSE 1e0 END, 0.01e0) AS s FROM f JOIN c ON c.day = f.d AND c.at = f.n + 1) x) y)
SELECT g.obs_id, g.selection, coalesce(f.why, g.gate) AS gate, round(coalesce(f.stake, 0), 9) AS stake FROM g LEFT JOIN f ON f.obs_id = g.obs_id""",
    ("predictions", "odds"),
)
def paper_trades(spark, sf_dir):
    """Decisions on every priced outcome of every prediction, in the order they became known, within caps of day and league."""
    c, n = F.col, F.col("pred_id")
    outcomes = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("selection"), c(p).alias("p"), c(o).alias("odds")) for k, (s, p, o) in enumerate((("H", "ph", "b365h"), ("D", "pd", "b365d"), ("A", "pa", "b365a")))))).alias("o")
    both = domain(spark, sf_dir, "predictions").join(domain(spark, sf_dir, "odds").withColumnRenamed("match_id", "pred_id"), "pred_id")
    known = c("day").cast("timestamp") + F.make_dt_interval(hours=(n % 24).cast("int"))
    rows = both.select(n.alias("match_id"), known.alias("known_at"), c("comp").alias("league"), F.lit("1X2").alias("market"), outcomes, (40 + n % 61).cast("double").alias("data_score"), (60 + n % 41).cast("double").alias("confidence"), (n % 11 == 0).alias("no_bet"))
    rows = rows.select((c("match_id") * 4 + c("o.k")).alias("obs_id"), "match_id", "known_at", "league", "market", "o.selection", "o.p", "o.odds", "data_score", "confidence", "no_bet")
    after = rows.agg((F.max("known_at") + F.make_dt_interval(days=F.lit(10))).alias("known_at"))  # moves the clock past the last row
    source, journal, log = (jobs.shared_folder(spark, x) for x in ("observations", "trades", "log"))
    rows.unionByName(after, allowMissingColumns=True).write.parquet(source)
    settle_to(paper.paper_trades(spark.readStream.schema(rows.schema).parquet(source)), journal, log)
    return spark.read.schema(paper.DECIDED).parquet(journal).select("obs_id", "selection", "gate", F.round("stake", 9).alias("stake"))
