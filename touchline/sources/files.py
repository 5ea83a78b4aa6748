"""Readers with fixed schemas: season files, fixtures, league feeds, odds feeds, delimited feeds and embedded JSON.

Every reader names its columns, so a scan reads only what a query selects; bad numbers and days become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_first, uk_to_utc
from ..functions.pricing import american_to_decimal
from ..functions.strings import parse_score, squeeze

#: Columns of season files.
TEXT_COLUMNS = ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTR", "HTR")
COUNT_COLUMNS = ("FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST", "HC", "AC")
PRICE_COLUMNS = ("B365H", "B365D", "B365A", "AvgH", "AvgD", "AvgA", "MaxH", "MaxD", "MaxA", "PSH", "PSD", "PSA", "PSCH", "PSCD", "PSCA", "B365>2.5", "B365<2.5", "Avg>2.5", "Avg<2.5", "Max>2.5", "Max<2.5", "AHh", "B365AHH", "B365AHA", "AvgAHH", "AvgAHA", "MaxAHH", "MaxAHA")
RENAMED = {f"{family}{sign}2.5": f"{family}_{side}25" for family in ("B365", "Avg", "Max") for sign, side in ((">", "O"), ("<", "U"))}
FEED_SCHEMA = "fixtures struct<firstUnplayedMatch:int, allMatches:array<struct<id:string, round:string, home:struct<name:string>, away:struct<name:string>, status:struct<utcTime:string, finished:boolean, cancelled:boolean, scoreStr:string>>>>"
ODDS_FEED_SCHEMA = "events array<struct<id:string, date:string, competitions:array<struct<competitors:array<struct<homeAway:string, team:struct<displayName:string>>>, odds:array<struct<homeTeamOdds:struct<moneyLine:int>, awayTeamOdds:struct<moneyLine:int>, drawOdds:struct<moneyLine:int>>>>>>>"


def season_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Season files by header, any columns, all as text; missing known columns are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    get = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    return raw.select(*(get(c).cast("string").alias(RENAMED.get(c, c)) for c in (*TEXT_COLUMNS, *COUNT_COLUMNS, *PRICE_COLUMNS)))


def clean_matches(raw: DataFrame, season_start: int | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Typed finished matches: day-first dates, whole goals, result derived where invalid; rows without key or goals go."""
    prices = [RENAMED.get(c, c) for c in PRICE_COLUMNS]
    out = raw.withColumns({c: F.col(c).try_cast("double").cast("int") for c in COUNT_COLUMNS} | {c: F.col(c).try_cast("double") for c in prices} | {"Date": day_first(F.trim("Date"))})
    out = out.withColumns({c: alias_name(squeeze(F.col(c)), aliases or {}) for c in ("HomeTeam", "AwayTeam")})
    out = out.where("Date IS NOT NULL AND HomeTeam IS NOT NULL AND AwayTeam IS NOT NULL AND FTHG IS NOT NULL AND FTAG IS NOT NULL")
    derived = F.when(F.col("FTHG") > F.col("FTAG"), "H").when(F.col("FTHG") < F.col("FTAG"), "A").otherwise("D")
    given = F.upper(F.trim("FTR"))
    out = out.withColumn("FTR", F.when(given.isin("H", "D", "A"), given).otherwise(derived))
    return out if season_start is None else out.withColumns({"SeasonStart": F.lit(season_start), "Season": F.lit(f"{season_start}-{(season_start + 1) % 100:02d}")})


def alias_name(name: Column, aliases: dict[str, str]) -> Column:
    out = name
    for a, b in aliases.items():
        out = F.when(name == a, b).otherwise(out)
    return out


def seasons_csv(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Several seasons as one frame."""
    frames = [clean_matches(season_csv(spark, p), start) for start, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fixtures_csv(spark: SparkSession, path: str, division: str) -> DataFrame:
    """Fixtures of one division with a UTC kickoff."""
    raw = season_csv(spark, path).where(F.col("Div") == division)
    day = day_first(F.trim("Date"))
    clock = F.when(F.col("Time").rlike(r"^\d{1,2}:\d{2}$"), F.lpad("Time", 5, "0"))
    prices = {RENAMED.get(c, c): F.col(RENAMED.get(c, c)).try_cast("double") for c in PRICE_COLUMNS}
    return raw.withColumns(prices | {"Date": day, "Kickoff": uk_to_utc(day, clock)}).where("Date IS NOT NULL")


def league_feed(spark: SparkSession, path: str, finished: bool, with_file: bool = False) -> DataFrame:
    """Rows of a league feed: finished matches with goals, or the schedule from its first unplayed index on."""
    raw = spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(path)
    file = [F.col("_metadata.file_path").alias("file")] if with_file else []
    rows = raw.select(*file, F.col("fixtures.firstUnplayedMatch").alias("first"), F.posexplode("fixtures.allMatches").alias("i", "m"))
    h, a = parse_score(F.col("m.status.scoreStr"))
    out = rows.select(*(["file"] if with_file else []), "i", "first", F.col("m.id").alias("id"), F.col("m.home.name").alias("home"), F.col("m.away.name").alias("away"), F.col("m.round").alias("round"), F.try_to_timestamp("m.status.utcTime").alias("kickoff"), h.alias("fthg"), a.alias("ftag"), F.coalesce("m.status.finished", F.lit(False)).alias("finished"), F.coalesce("m.status.cancelled", F.lit(False)).alias("cancelled"))
    kept = out.where("finished AND fthg IS NOT NULL") if finished else out.where("NOT finished AND NOT cancelled AND i >= coalesce(first, 0)")
    return kept.drop("i", "first", "finished", "cancelled")


def odds_feed(spark: SparkSession, path: str) -> DataFrame:
    """Decimal prices from a feed of American ones; the last event of a pair stays."""
    raw = spark.read.schema(ODDS_FEED_SCHEMA).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("events").alias("i", "e")).select("i", "e.id", "e.date", F.get("e.competitions", F.lit(0)).alias("c"))
    side = lambda k: F.get(F.transform(F.filter("c.competitors", lambda x: x["homeAway"] == k), lambda x: x["team"]["displayName"]), F.lit(0))
    o = rows.select("i", "id", "date", side("home").alias("home"), side("away").alias("away"), F.get("c.odds", F.lit(0)).alias("o"))
    priced = o.select("i", "id", "home", "away", *(american_to_decimal(F.col(f"o.{f}.moneyLine")).alias(n) for n, f in (("h", "homeTeamOdds"), ("d", "drawOdds"), ("a", "awayTeamOdds"))))
    return priced.groupBy("home", "away").agg(F.max_by(F.struct("id", "h", "d", "a"), "i").alias("r")).select("home", "away", "r.*")


def delimited_feed(spark: SparkSession, path: str) -> DataFrame:
    """Sections split by ``~``, fields by ``¬``, keys from values by ``÷``: one map a section, with its place."""
    sections = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "~")).alias("place", "section"))
    fields = F.filter(F.split("section", "¬"), lambda f: F.contains(f, F.lit("÷")))
    entries = F.transform(fields, lambda f: F.struct(F.split_part(f, F.lit("÷"), F.lit(1)).alias("k"), F.split_part(f, F.lit("÷"), F.lit(2)).alias("v")))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])))
    return sections.select("place", last.alias("fields")).where(F.size("fields") > 0)


def embedded_json(html: Column, schema: str, marker: str = "__DATA__") -> Column:
    """The JSON that a page assigns to ``marker``, parsed by a schema."""
    return F.from_json(F.nullif(F.regexp_extract(html, marker + r"\s*=\s*(\{.*?\})\s*;", 1), F.lit("")), schema)


def league_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row a league from a JSON object keyed by code; keys that begin with an underscore are remarks."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")
    return raw.select(entries).where(~F.col("e.key").startswith("_")).select(F.col("e.key").alias("code"), F.from_json("e.value", "name string, country string, weight double, cup boolean, seasons array<int>").alias("s")).select("code", "s.*")
