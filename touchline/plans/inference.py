"""Queries on what names, labels and addresses say, and on markets read from rows and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inference as I
from ..functions import markets as M
from ..functions import strings as S
from ..projection import domain
from ..registry import query

ROUNDS = ("Final", "Semi-finals", "Quarter-final", "Round of 16", "1/8", "Round 1", "", "R16", "QF", "Group B")
SIDES = ("Sangyo XI", "Tokyo", "Tokyo University", "Academy XI", "U21 Select", "Sanfrecce", "High School Select", "Amateur Club", "", "Waseda Univ.")
CODES = ("EPL", "WSL", "UWCL", "LALIGA", "J_WOMEN_1", "FA_W_CUP", "ACL", "NWCL", "", " wsl ")
LABELS = ("JAPAN: J1 League", "Emperor's Cup", "ASIA: AFC Champions", "Levain", "Club Friendly", "SPAIN: LaLiga", "Premier League", "UWCL", "Women's Super League", "Other Cup", "J3")
NAMES = ("Ulsan (Kor)", " Buriram (THA) ", "Kobe", "Team (2024)", "Al Ain(UAE)")
SLUGS = ("Vissel_Kobe_vs_Kashima", "A_VS_B_C", "alone", "_vs_B", "A_vs_B_vs_C")
PAGES = ("https://www.scores.example/team/vissel-kobe/698tGI9q/", "scores.example/team/real_madrid/W8mj7MDD/results/", "https://scores.example/player/x/1", "http://scores.example/team/a-b/Zz9?x=1#top", "")
LEAGUES = ("E0, sp1,E0", "sp1", " D1 ,d1,E0,, ", "")


def parts(spark, sf_dir):
    """Part names, types, brands and sizes: the text columns that names, labels and codes are put together from."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("part"), "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("size"))


PARTS_SQL = "(SELECT p_partkey AS part, p_name, p_type, p_brand, CAST(p_size AS VARCHAR) AS size FROM part) parts"


def listed(values, key="match_id"):
    """The value that a row's id picks."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def sql_list(values, key="match_id"):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][CAST({key} % {len(values)} AS INT) + 1]"


@query("cup_rounds", f"SELECT match_id, trim(r) = '' OR NOT regexp_matches(r, 'final|semi|quarter|round\\s*of\\s*16|1/8|1/4|1/2|\\br16\\b|\\bqf\\b|\\bsf\\b', 'i') AS early FROM (SELECT match_id, {sql_list(ROUNDS)} AS r FROM matches) t", ("matches",))
def cup_rounds(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.early_cup_round(listed(ROUNDS)).alias("early"))


@query("amateur_sides", f"SELECT match_id, regexp_matches(n, 'university|univ\\.?|sangyo|college|high\\s*school|amateur|\\bacademy\\b|\\bu\\d{{2}}\\b', 'i') AS amateur FROM (SELECT match_id, {sql_list(SIDES)} AS n FROM matches) t", ("matches",))
def amateur_sides(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.amateur(listed(SIDES)).alias("amateur"))


@query("competition_genders", f"SELECT match_id, CASE WHEN regexp_matches(upper(trim(c)), 'WOMEN|WSL|UWCL|_W|WCL') THEN 'W' ELSE 'M' END AS gender FROM (SELECT match_id, {sql_list(CODES)} AS c FROM matches) t", ("matches",))
def competition_genders(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.gender(listed(CODES)).alias("gender"))


@query(
    "competition_codes",
    f"""SELECT match_id, CASE WHEN regexp_matches(c, '\\bj1\\b', 'i') THEN 'J1' WHEN regexp_matches(c, '\\bj2\\b', 'i') THEN 'J2' WHEN regexp_matches(c, '\\bj3\\b', 'i') THEN 'J3' WHEN regexp_matches(c, 'emperor', 'i') THEN 'EMPERORS_CUP'
WHEN regexp_matches(c, 'afc\\s*champions|asian\\s*champions|\\bacl\\b', 'i') THEN 'ACL' WHEN regexp_matches(c, 'j\\.?\\s*league\\s*cup|levain', 'i') THEN 'J_LEAGUE_CUP' WHEN regexp_matches(c, 'friendly', 'i') THEN 'FRIENDLY'
WHEN regexp_matches(c, '\\blaliga\\b|la\\s*liga', 'i') THEN 'LALIGA' WHEN regexp_matches(c, 'premier\\s*league', 'i') THEN 'EPL' WHEN regexp_matches(c, 'champions\\s*league\\s*women|uwcl|women.?s\\s*champions', 'i') THEN 'UWCL'
WHEN regexp_matches(c, 'women.?s\\s*super\\s*league|\\bwsl\\b', 'i') THEN 'WSL' ELSE 'OTHER' END AS code FROM (SELECT match_id, {sql_list(LABELS)} AS c FROM matches) t""",
    ("matches",),
)
def competition_codes(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.competition_code(listed(LABELS), "OTHER").alias("code"))


@query("plain_team_names", f"SELECT match_id, trim(regexp_replace(trim(n), '\\s*\\([A-Za-z]{{2,4}}\\)\\s*$', '')) AS name FROM (SELECT match_id, {sql_list(NAMES)} AS n FROM matches) t", ("matches",))
def plain_team_names(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.without_country(listed(NAMES)).alias("name"))


@query(
    "versus_slugs",
    f"""WITH t AS (SELECT match_id, {sql_list(SLUGS)} AS s FROM matches), p AS (SELECT match_id, s, length(regexp_extract(s, '^(.*?)_[vV][sS]_', 1)) AS n, regexp_matches(s, '_vs_', 'i') AS two FROM t)
SELECT match_id, replace(substr(s, 1, n), '_', ' ') AS home, replace(substr(s, n + 5), '_', ' ') AS away FROM p WHERE two AND n > 0 AND length(s) > n + 4""",
    ("matches",),
)
def versus_slugs(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.versus(listed(SLUGS)).alias("p")).where("p IS NOT NULL").select("match_id", "p.home", "p.away")


@query("team_pages", f"SELECT match_id, regexp_extract(u, '/team/([A-Za-z0-9_-]+)/([A-Za-z0-9]+)', 1) AS slug, regexp_extract(u, '/team/([A-Za-z0-9_-]+)/([A-Za-z0-9]+)', 2) AS code FROM (SELECT match_id, {sql_list(PAGES)} AS u FROM matches) t WHERE u LIKE '%/team/%'", ("matches",))
def team_pages(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", I.team_page(listed(PAGES)).alias("p")).where("p IS NOT NULL").select("match_id", "p.slug", "p.code")


@query("leagues_requested", f"SELECT match_id, array_to_string(list_distinct_in_order, ',') AS leagues FROM (SELECT match_id, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT match_id, list_transform(string_split({sql_list(LEAGUES)}, ','), lambda x: upper(trim(x))) AS l FROM matches) a) b", ("matches",))
def leagues_requested(spark, sf_dir):
    """Codes in the order of their first mention."""
    codes = F.array_distinct(F.filter(F.transform(F.split(listed(LEAGUES), ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return domain(spark, sf_dir, "matches").select("match_id", F.array_join(codes, ",").alias("leagues"))


@query("tier_counter", "SELECT CASE pred_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'X' END AS tier, count(*) AS n FROM predictions GROUP BY 1", ("predictions",))
def tier_counter(spark, sf_dir):
    """Tier labels of any spelling in three buckets."""
    raw = F.upper(F.coalesce(F.get(F.array(F.lit("model_tier_a"), F.lit("A"), F.lit("x_b"), F.lit("unknown"), F.lit(None)), (F.col("pred_id") % 5).cast("int")), F.lit("X")))
    tier = F.when(raw.rlike("TIER_A|_A$|^A$"), "A").when(raw.rlike("TIER_B|_B$|^B$"), "B").otherwise("X")
    return domain(spark, sf_dir, "predictions").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(
    "side_markets",
    """SELECT match_id, CASE WHEN b365_o25 IS NOT NULL THEN 2.5e0 ELSE 2.75e0 END AS line, round(CASE WHEN b365_o25 IS NOT NULL THEN b365_o25 ELSE maxh END, 6) AS over_price, round(CASE WHEN b365_o25 IS NOT NULL THEN b365_u25 ELSE maxa END, 6) AS under_price,
ahh AS handicap, round(b365ahh, 6) AS ah_home FROM odds""",
    ("odds",),
)
def side_markets(spark, sf_dir):
    """Totals at 2.5 goals, else at the feed's own line; the handicap if it is whole."""
    c = F.col
    total = M.total_market(c("b365_o25"), c("b365_u25"), F.lit(2.75), c("maxh"), c("maxa"))
    rows = domain(spark, sf_dir, "odds").select("match_id", total.alias("t"), M.handicap_market(c("ahh"), c("b365ahh"), c("b365aha")).alias("a"))
    return rows.select("match_id", "t.line", F.round("t.over", 6).alias("over_price"), F.round("t.under", 6).alias("under_price"), "a.handicap", F.round("a.home", 6).alias("ah_home"))


@query("closing_markets", "SELECT match_id, round(b365h, 6) AS p1, round(b365d, 6) AS p2, round(b365a, 6) AS p3 FROM odds WHERE b365h > 1 AND b365d > 1 AND b365a > 1", ("odds",))
def closing_markets(spark, sf_dir):
    """Prices of a whole closing market out of a payload; incomplete markets give none."""
    payload = F.to_json(F.struct(F.col("b365h").alias("home"), F.col("b365d").alias("X"), F.col("b365a").alias("A"), F.lit(0.5).alias("D")))
    prices = M.closing_market(F.from_json(payload, "map<string,string>"), F.lit("1X2"), F.lit("Home"))
    rows = domain(spark, sf_dir, "odds").select("match_id", prices.alias("p")).where("p IS NOT NULL")
    return rows.select("match_id", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(3)))


@query("bookmaker_quotes", "SELECT match_id, round(b365h, 6) AS h, round(b365_o25, 6) AS over_price FROM odds WHERE b365h IS NOT NULL", ("odds",))
def bookmaker_quotes(spark, sf_dir):
    """A user's prices by market and outcome."""
    text = F.concat(F.lit('{"1X2":{"H":'), F.col("b365h").cast("string"), F.lit("}"), F.when(F.col("b365_o25").isNotNull(), F.concat(F.lit(',"OU":{"Over":'), F.col("b365_o25").cast("string"), F.lit("}"))).otherwise(""), F.lit("}"))
    rows = domain(spark, sf_dir, "odds").where("b365h IS NOT NULL").select("match_id", M.bookmaker_markets(text).alias("m"))
    price = lambda market, outcome: F.round(F.try_element_at(F.try_element_at("m", F.lit(market)), F.lit(outcome)), 6)
    return rows.select("match_id", price("1X2", "H").alias("h"), price("OU", "Over").alias("over_price"))


@query("bookmaker_labels", "SELECT match_id, CASE WHEN match_id % 4 = 0 THEN 'Given' WHEN b365h IS NOT NULL THEN 'B365' WHEN psch IS NOT NULL THEN 'PS' END AS bookmaker FROM odds", ("odds",))
def bookmaker_labels(spark, sf_dir):
    given = F.when(F.col("match_id") % 4 == 0, "Given").when(F.col("match_id") % 4 == 1, " ")
    return domain(spark, sf_dir, "odds").select("match_id", M.bookmaker_label(given, ("B365", F.col("b365h")), ("PS", F.col("psch"))).alias("bookmaker"))


@query("row_payloads", """SELECT match_id, '{"match_id":' || match_id || CASE WHEN hs IS NULL THEN '' ELSE ',"hs":' || hs END || CASE WHEN aws IS NULL THEN '' ELSE ',"aws":' || aws END || ',"ftr":"' || ftr || '"}' AS payload FROM matches""", ("matches",))
def row_payloads(spark, sf_dir):
    """A row as JSON, missing values left out."""
    return domain(spark, sf_dir, "matches").select("match_id", F.to_json(F.struct("match_id", "hs", "aws", "ftr")).alias("payload"))


@query("part_cup_rounds", f"SELECT part, size <> '16' AND p_name NOT LIKE '%final%' AND p_name NOT LIKE '%semi%' AS early FROM {PARTS_SQL}")
def part_cup_rounds(spark, sf_dir):
    """Rounds named after every part: those of sixteen are late."""
    return parts(spark, sf_dir).select("part", I.early_cup_round(F.concat("p_name", F.lit(" Round of "), "size")).alias("early"))


@query("part_amateur_sides", f"SELECT part, length(size) = 2 AS amateur FROM {PARTS_SQL}")
def part_amateur_sides(spark, sf_dir):
    """Sides named after every part and an age of two digits are youth sides."""
    return parts(spark, sf_dir).select("part", I.amateur(F.concat("p_name", F.lit(" U"), "size", F.lit(" Select"))).alias("amateur"))


@query("part_competition_genders", f"SELECT part, CASE WHEN p_name LIKE 'w%' THEN 'W' ELSE 'M' END AS gender FROM {PARTS_SQL}")
def part_competition_genders(spark, sf_dir):
    """Codes of every part's type and the first letter of its name."""
    return parts(spark, sf_dir).select("part", I.gender(F.concat("p_type", F.lit("_"), F.upper(F.substring("p_name", 1, 1)))).alias("gender"))


@query("part_competition_codes", f"SELECT part, CASE WHEN size IN ('1', '2', '3') THEN 'J' || size ELSE p_brand END AS code FROM {PARTS_SQL}")
def part_competition_codes(spark, sf_dir):
    """Labels of every part's name and size; what no rule knows keeps its brand."""
    known = I.competition_code(F.concat("p_name", F.lit(": J"), "size", F.lit(" League")), "OTHER")
    return parts(spark, sf_dir).select("part", F.when(known == "OTHER", F.col("p_brand")).otherwise(known).alias("code"))


@query("customer_names_without_country", "SELECT c_custkey AS customer, c_name AS name FROM customer")
def customer_names_without_country(spark, sf_dir):
    """Every customer's name with a short country behind it, and without again."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    spelt = F.concat(F.lit(" "), "c_name", F.lit(" ("), F.substring("c_mktsegment", 1, 3), F.lit(")"))
    return c.select(F.col("c_custkey").alias("customer"), I.without_country(spelt).alias("name"))


@query("part_versus_slugs", f"SELECT part, p_name AS home, p_type || ' ' || p_brand AS away FROM {PARTS_SQL}")
def part_versus_slugs(spark, sf_dir):
    """Slugs of two sides put together from every part's columns, taken apart again."""
    slug = F.concat(F.translate("p_name", " ", "_"), F.lit("_VS_"), "p_type", F.lit("_"), "p_brand")
    return parts(spark, sf_dir).select("part", I.versus(slug).alias("p")).select("part", "p.home", "p.away")


@query("folded_customer_names", "SELECT c_custkey AS customer, regexp_replace(lower(c_name || c_mktsegment), '[^a-z0-9]', '', 'g') AS key FROM customer")
def folded_customer_names(spark, sf_dir):
    """Keys of every customer's name and segment under a club word and accents."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    accented = F.translate(F.concat("c_name", F.lit("  "), F.lower("c_mktsegment")), "eu", "éü")
    return c.select(F.col("c_custkey").alias("customer"), S.folded_key(F.concat(F.lit("FC "), accented)).alias("key"))
