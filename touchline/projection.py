"""Domain tables (matches, odds, bets, quotes, predictions) projected from the driver's tables by integer arithmetic.

Each projection is one SQL text that Spark and DuckDB read alike; everything above it is written twice, independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: (source tables, SQL) by domain table.
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "matches": (
        ("orders",),
        """
SELECT match_id, match_date, home, away, fthg, ftag,
  CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END AS ftr, comp, season,
  CASE WHEN match_id % 11 = 0 THEN NULL ELSE CAST(match_id % 17 + 3 AS INT) END AS hs,
  CASE WHEN match_id % 11 = 0 THEN NULL ELSE CAST(match_id % 7 AS INT) END AS hst,
  CASE WHEN match_id % 13 = 0 THEN NULL ELSE CAST(match_id % 15 + 2 AS INT) END AS aws,
  CASE WHEN match_id % 13 = 0 THEN NULL ELSE CAST(match_id % 6 AS INT) END AS awst,
  CASE WHEN match_id % 11 = 0 THEN NULL ELSE CAST(match_id % 9 AS INT) END AS hc,
  CASE WHEN match_id % 13 = 0 THEN NULL ELSE CAST(match_id % 8 AS INT) END AS ac
FROM (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, CAST(o_custkey % 20 AS INT) AS home,
    CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS INT) AS away, CAST(o_orderkey % 5 AS INT) AS fthg,
    CAST((o_orderkey * 7 + o_custkey) % 4 AS INT) AS ftag, o_orderpriority AS comp,
    CAST(extract(year FROM o_orderdate) AS INT) AS season
  FROM orders
) m""",
    ),
    "odds": (
        ("orders",),
        """
SELECT o_orderkey AS match_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1.05e0 + (o_orderkey % 173) * 2e-2 END AS b365h,
  2.6e0 + (o_orderkey % 61) * 3e-2 AS b365d, 1.1e0 + (o_orderkey % 149) * 3e-2 AS b365a,
  CASE WHEN o_orderkey % 5 = 0 THEN 1.0e0 ELSE 1.07e0 + (o_orderkey % 167) * 2e-2 END AS avgh,
  2.7e0 + (o_orderkey % 59) * 3e-2 AS avgd, 1.12e0 + (o_orderkey % 151) * 3e-2 AS avga,
  1.1e0 + (o_orderkey % 163) * 2e-2 AS maxh, 2.8e0 + (o_orderkey % 53) * 3e-2 AS maxd, 1.15e0 + (o_orderkey % 157) * 3e-2 AS maxa,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.06e0 + (o_orderkey % 179) * 2e-2 END AS psch,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 2.65e0 + (o_orderkey % 67) * 3e-2 END AS pscd,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.13e0 + (o_orderkey % 139) * 3e-2 END AS psca,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1.5e0 + (o_orderkey % 97) * 1e-2 END AS b365_o25,
  1.6e0 + (o_orderkey % 89) * 1e-2 AS b365_u25,
  CAST(o_orderkey % 13 - 6 AS INT) * 0.25e0 AS ahh, 1.7e0 + (o_orderkey % 47) * 1e-2 AS b365ahh, 1.72e0 + (o_orderkey % 43) * 1e-2 AS b365aha
FROM orders""",
    ),
    "bets": (
        ("lineitem",),
        """
SELECT l_orderkey * 8 + l_linenumber AS bet_id, l_orderkey AS match_id,
  CASE l_linenumber % 3 WHEN 0 THEN '1X2' WHEN 1 THEN 'OU' ELSE 'AH' END AS market,
  CASE l_linenumber % 3 WHEN 0 THEN CASE part % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END
    WHEN 1 THEN CASE part % 2 WHEN 0 THEN 'Over' ELSE 'Under' END ELSE CASE part % 2 WHEN 0 THEN 'Home' ELSE 'Away' END END AS selection,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 1.5e0 + (part % 13) * 0.25e0 ELSE (part % 25 - 12) * 0.25e0 END AS line,
  1.3e0 + ((part + supp) % 270) * 1e-2 AS odds, quantity AS stake, (part % 97 + 1) * 1e-2 AS p_model,
  1.25e0 + ((part * 3 + supp) % 280) * 1e-2 AS close_odds, CAST(ship AS DATE) AS day,
  CASE WHEN part % 10 = 0 THEN 'PENDING' ELSE 'SETTLED' END AS status
FROM (
  SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_quantity) AS quantity, max(l_shipdate) AS ship
  FROM lineitem GROUP BY l_orderkey, l_linenumber
) b""",
    ),
    "quotes": (
        ("events",),
        """
SELECT event_id AS quote_id, user_id % 50 AS match_id, ts AS observed_at, event_type AS book,
  CASE event_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS selection,
  1.0e0 + event_id % 400 * 1e-2 AS price, value, props
FROM events""",
    ),
    "predictions": (
        ("orders",),
        """
SELECT o_orderkey AS pred_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS comp,
  CASE o_orderkey % 4 WHEN 0 THEN '1X2' WHEN 1 THEN 'OU' WHEN 2 THEN 'AH' ELSE NULL END AS market,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE (o_orderkey % 101) * 1e-2 END AS p,
  CAST(CASE WHEN (o_orderkey * 13 + o_custkey) % 100 < o_orderkey % 101 THEN 1 ELSE 0 END AS INT) AS y,
  (1 + o_orderkey % 5) / (1e0 + o_orderkey % 5 + 1 + o_orderkey % 3 + 1 + o_orderkey % 4) AS ph,
  (1 + o_orderkey % 3) / (1e0 + o_orderkey % 5 + 1 + o_orderkey % 3 + 1 + o_orderkey % 4) AS pd,
  (1 + o_orderkey % 4) / (1e0 + o_orderkey % 5 + 1 + o_orderkey % 3 + 1 + o_orderkey % 4) AS pa,
  CASE o_custkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'D' WHEN 2 THEN 'A' ELSE 'X' END AS ftr
FROM orders""",
    ),
    "strengths": (
        ("nation",),
        """
SELECT CAST(n_nationkey AS INT) AS team, (n_nationkey * 7 % 11 - 5) * 5e-2 AS att, (n_nationkey * 3 % 13 - 6) * 4e-2 AS def
FROM nation WHERE n_nationkey < 20""",
    ),
}


def with_tables(sql: str, names: tuple[str, ...]) -> str:
    """``sql`` with the named domain tables as common table expressions."""
    if not names:
        return sql
    tables = ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables}, {body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {tables}, {body[5:]}"
    return f"WITH {tables} {body}"


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame; the session's own views stay as they are."""
    sources, sql = TABLES[name]
    for t in sources:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources})
