"""Queries over names, dates and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import payloads as J
from ..functions import strings as S
from ..projection import domain
from ..registry import query


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("slugs", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') AS folded FROM customer")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", S.slug(F.col("c_name")).alias("slug"), S.folded_key(F.col("c_mktsegment")).alias("folded"))


@query("accent_folding", "SELECT doc_id, lower(strip_accents(regexp_extract(text, '^[A-Za-zàáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ]+'))) AS word FROM documents")
def accent_folding(spark, sf_dir):
    word = F.regexp_extract("text", "^[A-Za-zàáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ]+", 0)
    return read(spark, sf_dir, "documents").select("doc_id", F.lower(S.strip_accents(word)).alias("word"))


@query("match_keys", "SELECT match_id, strftime(match_date, '%Y-%m-%d') || '|T' || home || '|T' || away AS key FROM matches", ("matches",))
def match_keys(spark, sf_dir):
    team = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    return domain(spark, sf_dir, "matches").select("match_id", S.match_key(F.col("match_date"), team("home"), team("away")).alias("key"))


@query(
    "score_parsing",
    """WITH s AS (SELECT match_id, CASE WHEN match_id % 10 = 0 THEN 'n/a' ELSE fthg || ' - ' || ftag END AS s FROM matches) SELECT match_id, CASE WHEN s <> 'n/a' THEN CAST(split_part(s, ' - ', 1) AS INT) END AS h, CASE WHEN s <> 'n/a' THEN CAST(split_part(s, ' - ', 2) AS INT) END AS a FROM s""",
    ("matches",),
)
def score_parsing(spark, sf_dir):
    text = F.when(F.col("match_id") % 10 == 0, "n/a").otherwise(F.concat_ws(" - ", F.col("fthg").cast("string"), F.col("ftag").cast("string")))
    h, a = S.parse_score(F.col("s"))
    return domain(spark, sf_dir, "matches").select("match_id", text.alias("s")).select("match_id", h.alias("h"), a.alias("a"))


@query(
    "selection_parsing",
    "SELECT bet_id, market || ' ' || selection AS label, CASE WHEN line IS NOT NULL THEN round(line, 2) END AS line FROM bets",
    ("bets",),
)
def selection_parsing(spark, sf_dir):
    """Selections written as text are parsed back to label and line."""
    written = F.concat_ws(" ", "market", "selection", F.format_string("%.2f", F.col("line")))
    plain = F.when(F.col("line").isNull(), F.concat_ws(" ", "market", "selection")).otherwise(written)
    label, line = S.parse_selection(F.col("s"))
    return domain(spark, sf_dir, "bets").select("bet_id", plain.alias("s")).select("bet_id", label.alias("label"), line.alias("line"))


@query("market_families", "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'corners' WHEN 1 THEN 'ah' WHEN 2 THEN 'ou' ELSE '1x2' END AS family, count(*) AS n FROM lineitem GROUP BY 1")
def market_families(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, "Total Corners 9.5").when(k == 1, "Asian Handicap").when(k == 2, "Over/Under 2.5").otherwise("1X2 Full Time")
    return read(spark, sf_dir, "lineitem").groupBy(S.market_family(text).alias("family")).agg(F.count("*").alias("n"))


@query("humanised_codes", "SELECT o_orderkey, 'Vissel ' || upper(substr(lower(split_part(o_orderpriority, '-', 2)), 1, 1)) || substr(lower(split_part(o_orderpriority, '-', 2)), 2) AS name FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def humanised_codes(spark, sf_dir):
    code = F.concat(F.lit("JP_VISSEL_"), F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
    return read(spark, sf_dir, "orders").where("o_orderpriority <> '4-NOT SPECIFIED'").select("o_orderkey", S.humanise(code).alias("name"))


@query(
    "day_first_dates",
    "SELECT match_id, CASE WHEN match_id % 7 = 0 THEN NULL ELSE match_date END AS day FROM matches",
    ("matches",),
)
def day_first_dates(spark, sf_dir):
    """Both year lengths parse, other text is null."""
    long, short = F.date_format("match_date", "dd/MM/yyyy"), F.date_format("match_date", "dd/MM/yy")
    text = F.when(F.col("match_id") % 7 == 0, "soon").when((F.col("match_id") % 2 == 0) & (F.year("match_date") >= 2000), short).otherwise(long)
    return domain(spark, sf_dir, "matches").select("match_id", D.day_first(text).alias("day"))


@query(
    "season_labels",
    """WITH s AS (SELECT match_id, CAST(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END AS INT) AS start FROM matches) SELECT match_id, start, lpad(CAST(start % 100 AS VARCHAR), 2, '0') || lpad(CAST((start + 1) % 100 AS VARCHAR), 2, '0') AS code FROM s""",
    ("matches",),
)
def season_labels(spark, sf_dir):
    start = D.season_start(F.col("match_date"))
    return domain(spark, sf_dir, "matches").select("match_id", start.cast("int").alias("start"), D.season_code(start).alias("code"))


@query("kickoffs_utc", "SELECT match_id, CAST(match_date AS TIMESTAMP) + INTERVAL 15 HOUR - CASE WHEN month(match_date) BETWEEN 5 AND 8 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS kickoff FROM matches WHERE month(match_date) IN (1, 2, 5, 6, 7, 8, 12)", ("matches",))
def kickoffs_utc(spark, sf_dir):
    m = domain(spark, sf_dir, "matches").where("month(match_date) IN (1, 2, 5, 6, 7, 8, 12)")
    return m.select("match_id", D.uk_to_utc(F.col("match_date"), F.lit(None).cast("string")).cast("timestamp_ntz").alias("kickoff"))


@query(
    "local_day_window",
    """WITH l AS (SELECT TIMESTAMP '2024-01-10 17:30:00' AS now) SELECT CAST(count(*) AS BIGINT) AS n FROM quotes, l WHERE observed_at >= TIMESTAMP '2024-01-10 17:00:00' AND observed_at <= greatest(TIMESTAMP '2024-01-12 16:59:59', now + INTERVAL 48 HOUR)""",
    ("quotes",),
)
def local_day_window(spark, sf_dir):
    low, high = D.local_window(F.expr("timestamp'2024-01-10 17:30:00'"))
    at = F.col("observed_at").cast("timestamp")
    return domain(spark, sf_dir, "quotes").where((at >= low) & (at <= high)).agg(F.count("*").alias("n"))


@query("payload_values", "SELECT book, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k FROM quotes GROUP BY book", ("quotes",))
def payload_values(spark, sf_dir):
    k = F.from_json("props", "map<string,string>")
    return domain(spark, sf_dir, "quotes").groupBy("book").agg(F.sum(J.first_key(k, ("k", "value")).cast("long")).alias("k"))


@query(
    "probability_payloads",
    """SELECT pred_id, round(ph / (ph + pd + pa), 8) AS h, round(pa / (ph + pd + pa), 8) AS a FROM predictions WHERE pred_id % 3 <> 0""",
    ("predictions",),
)
def probability_payloads(spark, sf_dir):
    """Three spellings of the keys; payloads without an away side give nothing."""
    p = domain(spark, sf_dir, "predictions")
    h, d, a = (F.col(c).cast("string") for c in ("ph", "pd", "pa"))
    k = F.col("pred_id") % 3
    payload = F.when(k == 0, F.create_map(F.lit("home"), h)).when(k == 1, F.create_map(F.lit("home"), h, F.lit("draw"), d, F.lit("away"), a)).otherwise(F.create_map(F.lit("1"), h, F.lit("x"), d, F.lit("2"), a))
    parsed = p.select("pred_id", J.probabilities(payload).alias("q")).where("q IS NOT NULL")
    return parsed.select("pred_id", F.round("q.h", 8).alias("h"), F.round("q.a", 8).alias("a"))


@query(
    "main_line",
    """WITH o AS (SELECT match_id, selection, max(price) AS hi, min(price) AS lo FROM quotes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(abs(hi - lo), 9), -lo, selection) AS k FROM o) SELECT match_id, selection, round(hi, 6) AS over FROM r WHERE k = 1""",
    ("quotes",),
)
def main_line(spark, sf_dir):
    o = domain(spark, sf_dir, "quotes").groupBy("match_id", "selection").agg(F.max("price").alias("hi"), F.min("price").alias("lo"))
    arrays = o.groupBy("match_id").agg(F.collect_list(F.struct(F.col("selection").alias("line"), F.col("hi").alias("over"), F.col("lo").alias("under"))).alias("pairs"))
    return arrays.select("match_id", J.main_line(F.col("pairs")).alias("m")).select("match_id", F.col("m.line").alias("selection"), F.round("m.over", 6).alias("over"))
