"""Event feeds of teams, seasons and fixtures, and a price tab's JSON: the same reading for a folder as a batch and as a stream.

A feed file is sections split by ``~``; a section names a competition or is an event.  Files are read whole by Spark's text
source, so any store that Spark reads will do; a file's sections are taken in order in one expression, so competitions carry over
to the events after them without a shuffle, and a filter on columns of the events is a filter on what leaves that expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.inference import competition_code, without_country
from ..functions.pricing import let
from .files import league_feed

#: A feed's field codes and its state of a finished event.
EVENT_ID, STARTS, STATE, HOME, AWAY, HOME_GOALS, AWAY_GOALS = "AA", "AD", "AB", "AE", "AF", "AG", "AH"
COMPETITION, COMPETITION_SHORT, COMPETITION_PATH = "ZA", "ZK", "ZL"
HOME_HASH, AWAY_HASH, HOME_SLUG, AWAY_SLUG = "PX", "PY", "WU", "WV"
FINISHED = "3"
#: Names of scope and markets in a price tab, and its fields.
FULL_TIME, THREE_WAY, TOTALS, HANDICAP = "FULL_TIME", "HOME_DRAW_AWAY", "OVER_UNDER", "ASIAN_HANDICAP"
TAB = "struct<data:struct<findOddsByEventId:struct<settings:struct<bookmakers:array<struct<bookmaker:struct<id:string,name:string>>>>,eventParticipants:array<struct<id:string,type:struct<side:string>>>,odds:array<struct<bookmakerId:string,bettingType:string,bettingScope:string,odds:array<struct<eventParticipantId:string,value:string,selection:string,handicap:struct<value:string>>>>>>>>"


def _fields(section: Column) -> Column:
    """A section's fields as a map; of repeated keys the last counts."""
    parts = F.transform(F.filter(F.split(section, "¬"), lambda f: F.contains(f, F.lit("÷"))), lambda f: F.struct(F.split_part(f, F.lit("÷"), F.lit(1)).alias("k"), F.split_part(f, F.lit("÷"), F.lit(2)).alias("v")))

    def mapped(parts: Column) -> Column:
        last = lambda keys: F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(parts, lambda e: e["k"] == k), -1)["v"])))
        return let(F.array_distinct(F.transform(parts, lambda e: e["k"])), lambda keys: F.when(F.size(keys) == F.size(parts), F.map_from_entries(parts)).otherwise(last(keys)))

    return let(parts, mapped)


def _with_competition(text: Column) -> Column:
    """Maps of the event sections, each with the names of the last competition section before it."""
    named = lambda x: F.map_contains_key(x["m"], COMPETITION) | F.map_contains_key(x["m"], COMPETITION_SHORT)
    get = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    head = lambda x: F.struct(x["i"].alias("i"), F.coalesce(get(x["m"], COMPETITION), get(x["m"], COMPETITION_SHORT)).alias("competition"), get(x["m"], COMPETITION_SHORT).alias("short"), get(x["m"], COMPETITION_PATH).alias("path"))
    last = lambda heads, i: F.try_element_at(F.filter(heads, lambda h: h["i"] < i), F.lit(-1))
    sections = F.filter(F.transform(F.split(text, "~"), _fields), lambda m: F.size(m) > 0)

    def placed(all_of: Column) -> Column:
        def with_heads(heads: Column) -> Column:
            event = lambda x, h, n: F.struct(n["competition"].alias("competition"), h["short"].alias("short"), h["path"].alias("path"), x["m"].alias("fields"))
            known = F.filter(heads, lambda h: h["competition"].isNotNull())
            return F.transform(F.filter(all_of, lambda x: ~named(x)), lambda x: event(x, last(heads, x["i"]), last(known, x["i"])))

        return let(F.transform(F.filter(all_of, named), head), with_heads)

    return let(F.transform(sections, lambda m, i: F.struct(i.alias("i"), m.alias("m"))), placed)


def events(texts: DataFrame, finished: bool, unknown: str = "Unknown") -> DataFrame:
    """Events of whole feed files (column ``value``, and ``file`` if there): finished ones with goals, or those that are not.

    Sections without an id, a home side or a start are no events; a finished event without both goals is none either.
    """
    kept = [c for c in ("file",) if c in texts.columns]
    rows = texts.select(*kept, F.explode(_with_competition(F.col("value"))).alias("e")).select(*kept, "e.*")
    get = lambda k: F.nullif(F.trim(F.try_element_at("fields", F.lit(k))), F.lit(""))
    seconds, name = get(STARTS).try_cast("long"), F.coalesce("competition", "short", F.lit(unknown))
    out = rows.select(
        *kept,
        get(EVENT_ID).alias("event_id"),
        F.timestamp_seconds(F.nullif(seconds, F.lit(0))).alias("kickoff"),
        without_country(get(HOME)).alias("home"),
        without_country(get(AWAY)).alias("away"),
        get(HOME_GOALS).try_cast("int").alias("fthg"),
        get(AWAY_GOALS).try_cast("int").alias("ftag"),
        name.alias("competition"),
        competition_code(name, "OTHER").alias("comp"),
        F.col("path"),
        (F.coalesce(get(STATE), F.lit("")) == FINISHED).alias("finished"),
        *(get(k).alias(n) for k, n in ((HOME_HASH, "home_hash"), (AWAY_HASH, "away_hash"))),
        *(F.nullif(F.trim(get(k), F.lit("/")), F.lit("")).alias(n) for k, n in ((HOME_SLUG, "home_slug"), (AWAY_SLUG, "away_slug"))),
    ).where("event_id IS NOT NULL AND home IS NOT NULL AND kickoff IS NOT NULL")
    return out.where("finished AND fthg IS NOT NULL AND ftag IS NOT NULL").drop("finished") if finished else out.where("NOT finished").drop("finished", "fthg", "ftag")


def feed_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Whole feed files of a folder, with their names; of a growing folder as a stream."""
    reader = (spark.readStream if stream else spark.read).option("wholetext", True)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def once(found: DataFrame, newest: str = "file") -> DataFrame:
    """One row an event: the one of the last file that holds it."""
    cols = [c for c in found.columns if c != "event_id"]
    return found.groupBy("event_id").agg(F.max_by(F.struct(*cols), F.struct(newest, *(c for c in cols if c != newest))).alias("r")).select("event_id", "r.*")


def team_results(spark: SparkSession, path: str) -> DataFrame:
    """Finished events of team feeds."""
    return once(events(feed_files(spark, path), True))


def season_results(spark: SparkSession, path: str, competition: str | None = None) -> DataFrame:
    """Finished events of season pages, of one competition code if asked for."""
    found = events(feed_files(spark, path), True)
    return once(found if competition is None else found.where(F.col("comp") == competition))


def fixture_events(spark: SparkSession, path: str) -> DataFrame:
    """Events still to be played, with hashes and slugs of both teams."""
    return once(events(feed_files(spark, path), False))


def cup_seasons(spark: SparkSession, path: str, seasons: int) -> DataFrame:
    """Finished matches of the newest ``seasons`` files of a folder that have any, one row a match."""
    rows = league_feed(spark, path, True, with_file=True)
    newest = rows.select("file").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("file"))))  # one row a season
    kept = rows.join(newest.where(F.col("k") <= seasons).select("file"), "file")
    return once(kept.withColumnRenamed("id", "event_id")).withColumnRenamed("event_id", "id")


def finished_results(matches: DataFrame, competition: str | None = None) -> DataFrame:
    """Rows with a decided result, of one competition if asked for."""
    done = matches.where(F.col("ftr").isNotNull() & (F.trim("ftr") != ""))
    return done if competition is None else done.where(F.col("comp") == competition)


def canonical_teams(rows: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("home", "away")) -> DataFrame:
    """Team columns rewritten by ``aliases(alias, name)``; names that have no alias stay."""
    out = rows
    for i, c in enumerate(columns):
        named = aliases.groupBy(F.col("alias").alias(f"alias_{i}")).agg(F.min("name").alias(f"name_{i}"))
        out = out.join(named, F.col(c) == F.col(f"alias_{i}"), "left").withColumn(c, F.coalesce(f"name_{i}", c)).drop(f"alias_{i}", f"name_{i}")
    return out.select(*rows.columns)


def tab_prices(tabs: DataFrame, preference: list[str]) -> DataFrame:
    """``event_id, bookmaker, h, d, a, total, over, under, handicap, ah_home, ah_away`` of price tabs (event_id, value: JSON).

    Full-time markets only.  The three-way market is that of the first book by preference (others follow in the tab's order)
    with three prices above one; totals and handicap are those of the first book that has any.
    """
    price = lambda x: F.when(x.try_cast("double") > 1, x.try_cast("double"))
    e = tabs.select("event_id", F.from_json("value", TAB)["data"]["findOddsByEventId"].alias("t")).where("t IS NOT NULL")
    sides = lambda s: F.get(F.filter("t.eventParticipants", lambda p: p["type"]["side"] == s), F.lit(0))["id"]
    books = F.coalesce(F.map_from_entries(F.transform(F.filter("t.settings.bookmakers", lambda b: b["bookmaker"]["id"].isNotNull()), lambda b: F.struct(b["bookmaker"]["id"], b["bookmaker"]["name"]))), F.create_map().cast("map<string,string>"))
    markets = F.coalesce(F.filter("t.odds", lambda m: m["bettingScope"] == FULL_TIME), F.array().cast("array<struct<bookmakerId:string,bettingType:string,bettingScope:string,odds:array<struct<eventParticipantId:string,value:string,selection:string,handicap:struct<value:string>>>>>"))
    rank = lambda b: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preference)), b), F.lit(0).cast("long")), F.lit(len(preference) + 1).cast("long")) if preference else F.lit(0).cast("long")
    of = lambda kind: F.transform(F.array_sort(F.transform(F.filter("m", lambda x: x["bettingType"] == kind), lambda x, i: F.struct(rank(x["bookmakerId"]).alias("r"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    value = lambda odds, test: price(F.get(F.filter(odds, test), F.lit(0))["value"])

    def triple(x: Column) -> Column:
        return F.struct(
            x["bookmakerId"].alias("book"),
            value(x["odds"], lambda o: o["eventParticipantId"] == F.col("home_id")).alias("h"),
            value(x["odds"], lambda o: o["eventParticipantId"].isNull()).alias("d"),
            value(x["odds"], lambda o: o["eventParticipantId"] == F.col("away_id")).alias("a"),
        )

    rows = e.select("event_id", books.alias("books"), sides("HOME").alias("home_id"), sides("AWAY").alias("away_id"), markets.alias("m"))
    rows = rows.select("*", of(THREE_WAY).alias("x12"), F.get(of(TOTALS), F.lit(0)).alias("ou"), F.get(of(HANDICAP), F.lit(0)).alias("ah"))
    whole = F.get(F.filter(F.transform("x12", triple), lambda t: t["h"].isNotNull() & t["d"].isNotNull() & t["a"].isNotNull()), F.lit(0))
    lined = lambda market, test: F.filter(f"{market}.odds", lambda o: test(o) & (o["value"].try_cast("double") > 1))
    line = lambda o: o["handicap"]["value"].try_cast("double")
    rows = rows.select("*", whole.alias("w"), lined("ou", lambda o: F.upper(o["selection"]) == "OVER").alias("overs"), lined("ou", lambda o: F.upper(o["selection"]) == "UNDER").alias("unders"), lined("ah", lambda o: o["eventParticipantId"] == F.col("home_id")).alias("homes"), lined("ah", lambda o: o["eventParticipantId"] == F.col("away_id")).alias("aways"))
    gap = lambda p, q: F.round(F.abs(p["value"].cast("double") - q["value"].cast("double")), 9)
    pairs = lambda left, right, sign: F.flatten(F.transform(left, lambda p: F.transform(F.filter(right, lambda q: line(q) == sign * line(p)), lambda q: F.struct(gap(p, q).alias("gap"), line(p).alias("line"), p["value"].cast("double").alias("one"), q["value"].cast("double").alias("two")))))
    rows = rows.select("event_id", "books", "w", F.array_min(pairs("overs", "unders", 1)).alias("t"), F.array_min(pairs("homes", "aways", -1)).alias("g"))
    return rows.select("event_id", F.coalesce(F.try_element_at("books", F.col("w.book")), F.col("w.book")).alias("bookmaker"), "w.h", "w.d", "w.a", F.col("t.line").alias("total"), F.col("t.one").alias("over"), F.col("t.two").alias("under"), F.col("g.line").alias("handicap"), F.col("g.one").alias("ah_home"), F.col("g.two").alias("ah_away"))
