"""Odds snapshots of no fixed schema: every shape in which feeds nest books, markets and prices, read as variants.

A payload is parsed once.  Each branch casts the piece it needs to an array or a map of variants, which is null where the piece
has another shape, so branches need no schema and no Python.  Prices are numbers, or strings of numbers, above one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of outcomes, best first.
ALIASES = {
    "H": ("H", "home", "odds_home", "1", "home_odds"),
    "D": ("D", "draw", "odds_draw", "X", "draw_odds"),
    "A": ("A", "away", "odds_away", "2", "away_odds"),
    "over": ("over", "odds_over", "O", "Over"),
    "under": ("under", "odds_under", "U", "Under"),
    "ah_home": ("ah_home", "odds_ah_home", "odds_home_handicap", "AHH"),
    "ah_away": ("ah_away", "odds_ah_away", "odds_away_handicap", "AHA"),
}
#: Keys of a payload that are no outcomes.
NO_OUTCOMES = ("match_id", "canonical_match_id", "fixture_id", "timestamp", "observed_at", "as_of", "bookmaker", "name", "source", "market", "market_type", "line", "handicap", "markets", "bookmakers", "odds", "is_sharp", "is_soft")
#: Keys by which a payload without any list is known to be a market itself.
FLAT = ("home", "draw", "away", "odds_home", "H", "over", "under")
#: Outcomes of a closing market by the spellings it is searched for.
CLOSING = {"home": ("H", "home", "1", "Home"), "draw": ("D", "draw", "X", "Draw"), "away": ("A", "away", "2", "Away"), "over": ("over", "Over", "O"), "under": ("under", "Under", "U")}
#: Keys of a single closing price.
SCALAR = ("closing_odds", "odds", "price", "decimal_odds")
HANDICAPS = ("AH", "ASIAN", "ASIAN HANDICAP")


def at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def first_text(v: Column, *keys: str) -> Column:
    """The first of several keys that holds any text."""
    texts = (F.trim(at(v, f"$.{k}", "string")) for k in keys)
    return F.coalesce(*(F.when(t != "", t) for t in texts))


def valid_prices(entries: Column) -> Column:
    """The entries of a map of variants that are prices."""
    numbers = F.transform_values(entries, lambda _, x: at(x, "$", "double"))
    return F.map_filter(numbers, lambda _, p: p.isNotNull() & (p > 1.0))


def prices_of(item: Column) -> Column:
    """Prices by outcome of one market: its nested ``odds``, else its own keys; unknown keys keep their names."""
    found = valid_prices(F.coalesce(at(item, "$.odds", "map<string,variant>"), at(item, "$", "map<string,variant>")))

    def named(p: Column) -> Column:
        used = F.array(*(F.coalesce(*(F.when(F.map_contains_key(p, k), k) for k in keys)) for keys in ALIASES.values()))
        canon = F.filter(F.arrays_zip(F.array(*map(F.lit, ALIASES)).alias("name"), used.alias("key")), lambda e: e["key"].isNotNull())
        known = F.map_from_entries(F.transform(canon, lambda e: F.struct(e["name"], F.try_element_at(p, e["key"]))))
        other = F.map_filter(p, lambda k, _: ~k.isin(*NO_OUTCOMES) & ~F.exists(used, lambda u: F.coalesce(u == k, F.lit(False))) & ~F.map_contains_key(known, k))
        return F.map_concat(known, other)

    return F.element_at(F.transform(F.array(found), named), 1)


def _item(branch: str, book: Column, market: Column, when: Column, item: Column) -> Column:
    return F.struct(F.lit(branch).alias("branch"), book.alias("bookmaker"), market.alias("market"), when.alias("observed"), prices_of(item).alias("prices"))


def _market_name(v: Column) -> Column:
    return F.coalesce(first_text(v, "market", "market_type"), F.lit("1X2"))


def _each(items: Column, body) -> Column:
    return F.coalesce(F.transform(items, body), F.array())


def _of_map(markets: Column, branch: str, book: Column, when: Column) -> Column:
    return _each(F.map_entries(markets), lambda e: _item(branch, book, e["key"], when, e["value"]))


def quotes_of(snapshots: DataFrame, payload: str = "payload") -> DataFrame:
    """``match_id, branch, bookmaker, market, observed, selection, price``: a row for each price of each payload.

    Branches: a list under ``odds``, one under ``bookmakers`` with markets as a map, a list or the book's own keys, a list or map
    under ``markets``, and, if none of them has a price, the payload itself.  Payloads without a match have no rows.
    """
    v = F.col("v")
    when, book = first_text(v, "timestamp", "observed_at", "as_of"), first_text(v, "bookmaker", "source")
    listed = _each(at(v, "$.odds", "array<variant>"), lambda x: _item("odds", F.coalesce(first_text(x, "bookmaker", "name", "source"), book), _market_name(x), F.coalesce(first_text(x, "timestamp", "observed_at"), when), x))

    def of_book(x: Column) -> Column:
        name, seen = F.coalesce(first_text(x, "name", "bookmaker"), F.lit("unknown")), F.coalesce(first_text(x, "timestamp", "observed_at"), when)
        as_map, as_list = at(x, "$.markets", "map<string,variant>"), at(x, "$.markets", "array<variant>")
        own = F.array(_item("bookmakers", name, F.coalesce(first_text(x, "market"), F.lit("1X2")), seen, x))
        return F.when(as_map.isNotNull(), _of_map(as_map, "bookmakers", name, seen)).when(as_list.isNotNull(), _each(as_list, lambda m: _item("bookmakers", name, _market_name(m), seen, m))).otherwise(own)

    books = F.flatten(_each(at(v, "$.bookmakers", "array<variant>"), of_book))
    markets = F.concat(
        _of_map(at(v, "$.markets", "map<string,variant>"), "markets", book, when),
        _each(at(v, "$.markets", "array<variant>"), lambda m: _item("markets", F.coalesce(first_text(m, "bookmaker"), book), _market_name(m), F.coalesce(first_text(m, "timestamp"), when), m)),
    )
    match = first_text(v, "match_id", "canonical_match_id", "fixture_id")
    rows = snapshots.select(F.try_parse_json(payload).alias("v")).select(match.alias("match_id"), "v", listed.alias("a"), books.alias("b"), markets.alias("c")).where("match_id IS NOT NULL")
    with_prices = lambda x: F.filter(x, lambda e: F.size(e["prices"]) > 0)
    rows = rows.withColumn("items", F.concat(*(with_prices(F.col(c)) for c in "abc")))
    flat = F.array(_item("flat", book, _market_name(v), when, v))
    is_flat = F.exists(F.map_keys(at(v, "$", "map<string,variant>")), lambda k: k.isin(*FLAT))
    items = F.when(F.size("items") > 0, F.col("items")).when(is_flat, flat)
    each = rows.select("match_id", F.explode(items).alias("e")).select("match_id", "e.*")
    return each.select("match_id", "branch", "bookmaker", "market", F.try_to_timestamp("observed").alias("observed"), F.explode("prices").alias("selection", "price"))


def _closing_map(v: Column, market: Column) -> Column:
    """Prices of a market: under ``odds``, ``markets``, ``prices`` or the payload itself, and there under the market's name if it has one."""
    held = F.coalesce(*(at(v, p, "map<string,variant>") for p in ("$.odds", "$.markets", "$.prices", "$")))

    def inside(m: Column) -> Column:
        nested = (at(F.try_element_at(m, k), "$", "map<string,variant>") for k in (F.upper(F.trim(market)), F.lower(F.trim(market)), F.lit("1X2")))
        return valid_prices(F.coalesce(*nested, m))

    return F.element_at(F.transform(F.array(held), inside), 1)


def _outcome(prices: Column, name: str) -> Column:
    return F.coalesce(*(F.try_element_at(prices, F.lit(k)) for k in CLOSING[name]))


def closing_price(payload: Column, market: Column, selection: Column) -> Column:
    """Closing price of a selection, from a map of any nesting or a single number."""
    v, s = F.try_parse_json(payload), F.lower(F.trim(selection))
    held = _closing_map(v, market)
    single = F.when(at(v, "$.odds", "map<string,variant>").isNull(), F.coalesce(*(F.when(F.schema_of_variant(at(v, f"$.{k}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (at(v, f"$.{k}", "double") > 1), at(v, f"$.{k}", "double")) for k in SCALAR)))

    def of(p: Column) -> Column:
        side = F.when(s.contains("draw") | s.isin("d", "x"), _outcome(p, "draw")).when(s.contains("away") | s.isin("a", "2"), _outcome(p, "away")).when(s.contains("over"), _outcome(p, "over")).when(s.contains("under"), _outcome(p, "under")).otherwise(_outcome(p, "home"))
        plain = F.when(~s.contains("over") & ~s.contains("under"), F.coalesce(*(F.try_element_at(p, x) for x in (selection, F.initcap(selection), F.upper(selection)))))
        return F.coalesce(side, plain)

    return F.coalesce(single, F.element_at(F.transform(F.array(held), of), 1))


def closing_prices(payload: Column, market: Column, selection: Column) -> Column:
    """All prices of the selection's closing market, in its order; null unless the market is complete."""
    held, s = _closing_map(F.try_parse_json(payload), market), F.lower(F.trim(selection))

    def of(p: Column) -> Column:
        group = lambda *names: F.array(*(_outcome(p, n) for n in names))
        return F.when(s.contains("over") | s.contains("under"), group("over", "under")).when(F.upper(F.trim(market)).isin(*HANDICAPS), group("home", "away")).otherwise(group("home", "draw", "away"))

    return F.element_at(F.transform(F.array(held), lambda p: F.when(~F.exists(of(p), lambda x: x.isNull()), of(p))), 1)
