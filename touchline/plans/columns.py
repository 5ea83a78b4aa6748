"""Queries over the pricing and settlement columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..projection import domain
from ..registry import query

#: Settlement rank of a bet in SQL, for the oracles.
RANK_SQL = """
CASE market WHEN '1X2' THEN CASE WHEN selection = ftr THEN 2 ELSE -2 END
  WHEN 'OU' THEN (CASE selection WHEN 'Over' THEN 1 ELSE -1 END) * CAST(sign(fthg + ftag - floor(line * 2) / 2) + sign(fthg + ftag - ceil(line * 2) / 2) AS INT)
  ELSE CAST(sign((CASE selection WHEN 'Home' THEN fthg - ftag ELSE ftag - fthg END) + floor(line * 2) / 2)
    + sign((CASE selection WHEN 'Home' THEN fthg - ftag ELSE ftag - fthg END) + ceil(line * 2) / 2) AS INT) END"""
SETTLED_SQL = f"""
settled AS (
  SELECT b.*, m.comp, m.match_date, m.season, {RANK_SQL} AS r FROM bets b JOIN matches m ON b.match_id = m.match_id
), priced AS (
  SELECT *, CASE WHEN r > 0 THEN stake * (odds - 1) * r / 2 ELSE stake * r / 2e0 END AS pnl FROM settled
)"""


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets joined to results, with rank, label, profit and pay-out."""
    bets, matches = domain(spark, sf_dir, "bets"), domain(spark, sf_dir, "matches").select("match_id", "comp", "match_date", "season", "fthg", "ftag")
    rows = bets.join(matches, "match_id").withColumn("r", P.rank_of_bet(F.col("market"), F.col("selection"), F.col("line"), F.col("fthg"), F.col("ftag")))
    r, odds, stake = F.col("r"), F.col("odds"), F.col("stake")
    return rows.withColumns({"label": P.label(r), "pnl": P.profit(r, odds, stake), "payout": P.payout(r, odds, stake)})


@query(
    "settlement_by_market",
    f"""WITH {SETTLED_SQL.strip()}
SELECT market, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, count(*) FILTER (WHERE r = 0) AS pushes, count(*) FILTER (WHERE r < 0) AS losses,
  round(sum(stake), 4) AS staked, round(sum(pnl), 4) AS pnl, round(sum(pnl) / sum(stake), 8) AS roi FROM priced GROUP BY market""",
    ("matches", "bets"),
)
def settlement_by_market(spark, sf_dir):
    return settled(spark, sf_dir).groupBy("market").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("r") > 0).alias("wins"),
        F.count_if(F.col("r") == 0).alias("pushes"),
        F.count_if(F.col("r") < 0).alias("losses"),
        F.round(F.sum("stake"), 4).alias("staked"),
        F.round(F.sum("pnl"), 4).alias("pnl"),
        F.round(F.sum("pnl") / F.sum("stake"), 8).alias("roi"),
    )


@query(
    "settlement_labels",
    f"""WITH {SETTLED_SQL.strip()}
SELECT bet_id, CASE r WHEN 2 THEN 'WIN' WHEN 1 THEN 'HALF_WIN' WHEN 0 THEN 'PUSH' WHEN -1 THEN 'HALF_LOSS' ELSE 'LOSS' END AS label,
  round(pnl, 6) AS pnl, round(stake + pnl, 6) AS payout FROM priced""",
    ("matches", "bets"),
)
def settlement_labels(spark, sf_dir):
    return settled(spark, sf_dir).select("bet_id", "label", F.round("pnl", 6).alias("pnl"), F.round("payout", 6).alias("payout"))


@query(
    "settlement_legacy_labels",
    f"""WITH {SETTLED_SQL.strip()}
SELECT market, CASE WHEN r > 0 THEN 'WIN' WHEN r = 0 THEN 'PUSH' ELSE 'LOSS' END AS label, count(*) AS n FROM priced GROUP BY 1, 2""",
    ("matches", "bets"),
)
def settlement_legacy_labels(spark, sf_dir):
    """The older vocabulary, in which halves collapse."""
    short = F.when(F.col("r") > 0, "WIN").when(F.col("r") == 0, "PUSH").otherwise("LOSS")
    return settled(spark, sf_dir).groupBy("market", short.alias("label")).agg(F.count("*").alias("n"))


@query(
    "settlement_v2_labels",
    f"""WITH {SETTLED_SQL.strip()}
SELECT CASE r WHEN 2 THEN 'WON' WHEN 1 THEN 'HALF_WON' WHEN 0 THEN 'VOID' WHEN -1 THEN 'HALF_LOST' ELSE 'LOST' END AS status, count(*) AS n, round(sum(pnl), 4) AS pnl FROM priced GROUP BY 1""",
    ("matches", "bets"),
)
def settlement_v2_labels(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in (("WIN", "WON"), ("HALF_WIN", "HALF_WON"), ("PUSH", "VOID"), ("HALF_LOSS", "HALF_LOST"), ("LOSS", "LOST")) for x in pair))
    return settled(spark, sf_dir).groupBy(names[F.col("label")].alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(
    "expected_value_and_kelly",
    """SELECT bet_id, round(p_model * odds - 1, 8) AS ev, round(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1), 8) AS kelly,
  round(least(least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) * 0.1e0, 0.01e0), 8) AS stake_pct FROM bets""",
    ("bets",),
)
def expected_value_and_kelly(spark, sf_dir):
    p, o = F.col("p_model"), F.col("odds")
    return domain(spark, sf_dir, "bets").select("bet_id", F.round(P.expected_value(p, o), 8).alias("ev"), F.round(P.full_kelly(p, o), 8).alias("kelly"), F.round(P.capped_kelly(p, o), 8).alias("stake_pct"))


@query(
    "devig_multiplicative",
    """WITH v AS (SELECT match_id, 1 / b365h AS h, 1 / b365d AS d, 1 / b365a AS a FROM odds WHERE b365h > 1 AND b365d > 1 AND b365a > 1)
SELECT match_id, round(h + d + a, 8) AS overround, round(h / (h + d + a), 8) AS ph, round(d / (h + d + a), 8) AS pd, round(a / (h + d + a), 8) AS pa FROM v""",
    ("odds",),
)
def devig_multiplicative(spark, sf_dir):
    o = [F.col(c) for c in ("b365h", "b365d", "b365a")]
    ph, pd, pa = P.devig_multiplicative(*o)
    rows = domain(spark, sf_dir, "odds").select("match_id", F.round(P.overround(*o), 8).alias("overround"), F.round(ph, 8).alias("ph"), F.round(pd, 8).alias("pd"), F.round(pa, 8).alias("pa"))
    return rows.where("overround IS NOT NULL")


@query(
    "devig_additive",
    """WITH v AS (SELECT match_id, 1 / b365h AS h, 1 / b365d AS d, 1 / b365a AS a FROM odds WHERE b365h > 1 AND b365d > 1 AND b365a > 1),
c AS (SELECT match_id, greatest(h - (h + d + a - 1) / 3, 0) AS h, greatest(d - (h + d + a - 1) / 3, 0) AS d, greatest(a - (h + d + a - 1) / 3, 0) AS a FROM v)
SELECT match_id, round(h / (h + d + a), 8) AS ph, round(d / (h + d + a), 8) AS pd, round(a / (h + d + a), 8) AS pa FROM c""",
    ("odds",),
)
def devig_additive(spark, sf_dir):
    ph, pd, pa = P.devig_additive(*(F.col(c) for c in ("b365h", "b365d", "b365a")))
    return domain(spark, sf_dir, "odds").where("b365h > 1 AND b365d > 1 AND b365a > 1").select("match_id", F.round(ph, 8).alias("ph"), F.round(pd, 8).alias("pd"), F.round(pa, 8).alias("pa"))


@query(
    "devig_shin",
    """WITH RECURSIVE v AS (SELECT match_id, 1 / maxh AS h, 1 / maxd AS d, 1 / maxa AS a, 1 / maxh + 1 / maxd + 1 / maxa AS t FROM odds),
s AS (SELECT match_id, h, d, a, t, 0e0 AS lo, 1 - 1e-9 AS hi, 0 AS k FROM v WHERE t > 1 UNION ALL
  SELECT match_id, h, d, a, t, CASE WHEN f > 1 THEN m ELSE lo END, CASE WHEN f > 1 THEN hi ELSE m END, k + 1 FROM (
    SELECT *, (sqrt(m * m + 4 * (1 - m) * h * h / t) + sqrt(m * m + 4 * (1 - m) * d * d / t) + sqrt(m * m + 4 * (1 - m) * a * a / t) - 3 * m) / (2 * (1 - m)) AS f
    FROM (SELECT *, (lo + hi) / 2 AS m FROM s WHERE k < 60) x) y),
z AS (SELECT match_id, h, d, a, t, (lo + hi) / 2 AS z FROM s WHERE k = 60),
q AS (SELECT match_id, (sqrt(z * z + 4 * (1 - z) * h * h / t) - z) / (2 * (1 - z)) AS h, (sqrt(z * z + 4 * (1 - z) * d * d / t) - z) / (2 * (1 - z)) AS d, (sqrt(z * z + 4 * (1 - z) * a * a / t) - z) / (2 * (1 - z)) AS a FROM z
  UNION ALL SELECT match_id, h, d, a FROM v WHERE t <= 1)
SELECT match_id, round(h / (h + d + a), 6) AS ph, round(d / (h + d + a), 6) AS pd, round(a / (h + d + a), 6) AS pa FROM q""",
    ("odds",),
)
def devig_shin(spark, sf_dir):
    rows = domain(spark, sf_dir, "odds").withColumn("p", P.devig_shin(*(F.col(c) for c in ("maxh", "maxd", "maxa"))))
    return rows.select("match_id", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("ph", "pd", "pa"))))


FAMILIES = (("b365h", "b365d", "b365a"), ("avgh", "avgd", "avga"), ("maxh", "maxd", "maxa"), ("psch", "pscd", "psca"))


def first_family(families=FAMILIES, names=("b365", "avg", "max", "ps")):
    """The first family whose whole triple is valid, as a struct with its name."""
    picks = [F.when(P.valid_price(F.col(h)) & P.valid_price(F.col(d)) & P.valid_price(F.col(a)), F.struct(F.lit(n).alias("family"), F.col(h).alias("h"), F.col(d).alias("d"), F.col(a).alias("a"))) for n, (h, d, a) in zip(names, families)]
    return F.coalesce(*picks)


@query(
    "odds_family_coalesce",
    """SELECT match_id, CASE WHEN b365h > 1 AND b365d > 1 AND b365a > 1 THEN 'b365' WHEN avgh > 1 AND avgd > 1 AND avga > 1 THEN 'avg' ELSE 'max' END AS family,
  round(CASE WHEN b365h > 1 AND b365d > 1 AND b365a > 1 THEN b365h WHEN avgh > 1 AND avgd > 1 AND avga > 1 THEN avgh ELSE maxh END, 6) AS h FROM odds""",
    ("odds",),
)
def odds_family_coalesce(spark, sf_dir):
    return domain(spark, sf_dir, "odds").withColumn("o", first_family()).select("match_id", "o.family", F.round("o.h", 6).alias("h"))


@query(
    "closing_family_coalesce",
    """SELECT CASE WHEN psch > 1 AND pscd > 1 AND psca > 1 THEN 'psc' WHEN avgh > 1 AND avgd > 1 AND avga > 1 THEN 'avgc' WHEN b365h > 1 AND b365d > 1 AND b365a > 1 THEN 'b365c' ELSE 'maxc' END AS family,
  count(*) AS n FROM odds GROUP BY 1""",
    ("odds",),
)
def closing_family_coalesce(spark, sf_dir):
    order = (FAMILIES[3], FAMILIES[1], FAMILIES[0], FAMILIES[2])
    return domain(spark, sf_dir, "odds").groupBy(first_family(order, ("psc", "avgc", "b365c", "maxc"))["family"].alias("family")).agg(F.count("*").alias("n"))


@query(
    "fair_closing",
    """SELECT match_id, round((1 / psch) / (1 / psch + 1 / pscd + 1 / psca), 8) AS fair_h FROM odds WHERE psch > 1 AND pscd > 1 AND psca > 1""",
    ("odds",),
)
def fair_closing(spark, sf_dir):
    fair = P.devig_multiplicative(F.col("psch"), F.col("pscd"), F.col("psca"))[0]
    return domain(spark, sf_dir, "odds").select("match_id", F.round(fair, 8).alias("fair_h")).where("fair_h IS NOT NULL")


@query(
    "two_way_fair",
    """SELECT match_id, round((1 / b365_o25) / (1 / b365_o25 + 1 / b365_u25), 8) AS over_fair, round((1 / b365ahh) / (1 / b365ahh + 1 / b365aha), 8) AS home_fair
FROM odds WHERE b365_o25 > 1 AND b365_u25 > 1""",
    ("odds",),
)
def two_way_fair(spark, sf_dir):
    over, home = P.devig_multiplicative(F.col("b365_o25"), F.col("b365_u25"))[0], P.devig_multiplicative(F.col("b365ahh"), F.col("b365aha"))[0]
    return domain(spark, sf_dir, "odds").select("match_id", F.round(over, 8).alias("over_fair"), F.round(home, 8).alias("home_fair")).where("over_fair IS NOT NULL")


@query(
    "odds_sanity_band",
    """SELECT count(*) FILTER (WHERE avgh > 1) AS valid, count(*) FILTER (WHERE avgh > 1 AND 1 / avgh + 1 / avgd + 1 / avga BETWEEN 1.0e0 AND 1.3e0) AS sane FROM odds""",
    ("odds",),
)
def odds_sanity_band(spark, sf_dir):
    o = P.overround(F.col("avgh"), F.col("avgd"), F.col("avga"))
    return domain(spark, sf_dir, "odds").agg(F.count_if(o.isNotNull()).alias("valid"), F.count_if(o.between(1.0, 1.3)).alias("sane"))


@query(
    "american_to_decimal",
    """WITH a AS (SELECT o_orderkey AS k, CAST(o_orderkey % 801 - 400 AS INT) AS a FROM orders)
SELECT k, round(CASE WHEN a > 0 THEN 1 + a / 100e0 WHEN a < 0 THEN 1 + 100e0 / abs(a) END, 3) AS price FROM a""",
)
def american_to_decimal(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("k"), P.american_to_decimal(F.col("o_orderkey") % 801 - 400).alias("price"))


@query(
    "closing_line_value",
    f"""WITH {SETTLED_SQL.strip()}
SELECT market, round(avg(odds / close_odds - 1), 8) AS clv_ratio, round(avg(ln(odds / close_odds)), 8) AS clv_log, round(avg(CASE WHEN odds > close_odds THEN 1e0 ELSE 0e0 END), 8) AS beat_share FROM priced GROUP BY market""",
    ("matches", "bets"),
)
def closing_line_value(spark, sf_dir):
    o, c = F.col("odds"), F.col("close_odds")
    return settled(spark, sf_dir).groupBy("market").agg(F.round(F.avg(P.clv_ratio(o, c)), 8).alias("clv_ratio"), F.round(F.avg(P.clv_log(o, c)), 8).alias("clv_log"), F.round(F.avg((o > c).cast("double")), 8).alias("beat_share"))


@query(
    "commission_pnl",
    f"""WITH {SETTLED_SQL.strip()}
SELECT market, round(sum(CASE WHEN pnl > 0 THEN pnl * 0.98e0 ELSE pnl END), 4) AS net FROM priced GROUP BY market""",
    ("matches", "bets"),
)
def commission_pnl(spark, sf_dir):
    return settled(spark, sf_dir).groupBy("market").agg(F.round(F.sum(P.commission(F.col("pnl"), 0.02)), 4).alias("net"))


@query(
    "xg_proxies",
    """SELECT match_id, round(coalesce(hs, 0) * 0.1e0 + coalesce(hst, 0) * 0.3e0, 6) AS xg_lenient, round(aws * 0.1e0 + awst * 0.3e0, 6) AS xg_strict FROM matches""",
    ("matches",),
)
def xg_proxies(spark, sf_dir):
    return domain(spark, sf_dir, "matches").select("match_id", F.round(P.xg_proxy(F.col("hs"), F.col("hst")), 6).alias("xg_lenient"), F.round(P.xg_strict(F.col("aws"), F.col("awst")), 6).alias("xg_strict"))


@query(
    "sanity_and_edge_gates",
    """SELECT market, count(*) FILTER (WHERE ev >= 0.05e0) AS edge, count(*) FILTER (WHERE ev <= 0.5e0 AND NOT (market = '1X2' AND odds > 3.5e0 AND p_model > 0.4e0)) AS sane,
  count(*) FILTER (WHERE odds BETWEEN 1.4e0 AND 3.5e0) AS band FROM (SELECT *, p_model * odds - 1 AS ev FROM bets) b GROUP BY market""",
    ("bets",),
)
def sanity_and_edge_gates(spark, sf_dir):
    ev = P.expected_value(F.col("p_model"), F.col("odds"))
    longshot = (F.col("market") == "1X2") & (F.col("odds") > 3.5) & (F.col("p_model") > 0.4)
    return domain(spark, sf_dir, "bets").groupBy("market").agg(F.count_if(ev >= 0.05).alias("edge"), F.count_if((ev <= 0.5) & ~longshot).alias("sane"), F.count_if(F.col("odds").between(1.4, 3.5)).alias("band"))


@query(
    "temperature_softmax",
    """SELECT pred_id, round(pow(ph, 1 / 1.5e0) / (pow(ph, 1 / 1.5e0) + pow(pd, 1 / 1.5e0) + pow(pa, 1 / 1.5e0)), 8) AS h,
  round(0.85e0 * ph + 0.15e0 / 3, 8) AS pulled FROM predictions""",
    ("predictions",),
)
def temperature_softmax(spark, sf_dir):
    """Softened probabilities and the pull toward a uniform market."""
    warm = [F.exp(F.ln(F.col(c)) / 1.5) for c in ("ph", "pd", "pa")]
    return domain(spark, sf_dir, "predictions").select("pred_id", F.round(warm[0] / (warm[0] + warm[1] + warm[2]), 8).alias("h"), F.round(0.85 * F.col("ph") + 0.15 / 3, 8).alias("pulled"))


@query(
    "weighted_blend_missing_members",
    """WITH e AS (SELECT pred_id, CASE WHEN pred_id % 5 = 0 THEN NULL ELSE ph END AS a, CASE WHEN pred_id % 7 = 0 THEN NULL ELSE pd END AS b, pa AS c FROM predictions)
SELECT pred_id, round((coalesce(a * 0.4e0, 0) + coalesce(b * 0.35e0, 0) + c * 0.25e0) / (CASE WHEN a IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.35e0 END + 0.25e0), 8) AS p FROM e""",
    ("predictions",),
)
def weighted_blend_missing_members(spark, sf_dir):
    """Members that are missing leave and the weights are renormalised."""
    rows = domain(spark, sf_dir, "predictions")
    members = [(F.when(F.col("pred_id") % 5 != 0, F.col("ph")), 0.40), (F.when(F.col("pred_id") % 7 != 0, F.col("pd")), 0.35), (F.col("pa"), 0.25)]
    total = sum((F.coalesce(m * w, F.lit(0.0)) for m, w in members), F.lit(0.0))
    weight = sum((F.when(m.isNull(), 0.0).otherwise(w) for m, w in members), F.lit(0.0))
    return rows.select("pred_id", F.round(total / weight, 8).alias("p"))


@query(
    "risk_stake",
    """WITH e AS (SELECT *, p_model * odds - 1 AS ev, least(greatest((p_model * odds - 1) / (odds - 1), 0), 1) AS k, match_id % 101 AS score FROM bets)
SELECT bet_id, CASE WHEN score < 50 THEN 'data' WHEN ev < 0.05e0 THEN 'ev' WHEN k <= 0 THEN 'kelly' ELSE 'ok' END AS gate,
  round(CASE WHEN score < 50 OR ev < 0.05e0 OR k <= 0 THEN 0e0 ELSE least(k * 0.1e0 * score / 100e0 * (CASE WHEN bet_id % 4 = 0 THEN 0.7e0 ELSE 1e0 END), 0.01e0) END, 8) AS stake_pct FROM e""",
    ("bets",),
)
def risk_stake(spark, sf_dir):
    """Gates in order (data score, edge, Kelly), then Kelly by data score and correlation discount, capped."""
    p, o, score = F.col("p_model"), F.col("odds"), F.col("match_id") % 101
    ev, k = P.expected_value(p, o), P.full_kelly(p, o)
    gate = F.when(score < 50, "data").when(ev < 0.05, "ev").when(k <= 0, "kelly").otherwise("ok")
    discount = F.when(F.col("bet_id") % 4 == 0, 0.7).otherwise(1.0)
    pct = F.when(gate == "ok", F.least(k * P.KELLY_MULTIPLIER * score / 100.0 * discount, F.lit(P.STAKE_CAP))).otherwise(0.0)
    return domain(spark, sf_dir, "bets").select("bet_id", gate.alias("gate"), F.round(pct, 8).alias("stake_pct"))
