"""Side markets of a fixture, closing markets of a payload, bookmaker labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of an outcome's price in a payload.
OUTCOME_KEYS = {"home": ("H", "home", "1", "Home"), "draw": ("D", "draw", "X", "Draw"), "away": ("A", "away", "2", "Away"), "over": ("over", "Over", "O"), "under": ("under", "Under", "U")}


def total_market(over: Column, under: Column, line: Column, over_other: Column, under_other: Column) -> Column:
    """``line, over, under``: the pair at 2.5 goals, else the pair at a line of its own; null without either."""
    own = F.when(over.isNotNull() & under.isNotNull(), F.struct(F.lit(2.5).alias("line"), over.alias("over"), under.alias("under")))
    other = F.when(line.isNotNull() & over_other.isNotNull() & under_other.isNotNull(), F.struct(line.alias("line"), over_other.alias("over"), under_other.alias("under")))
    return F.coalesce(own, other)


def handicap_market(line: Column, home: Column, away: Column) -> Column:
    """``handicap, home, away``, or null if a part is missing."""
    return F.when(line.isNotNull() & home.isNotNull() & away.isNotNull(), F.struct(line.alias("handicap"), home.alias("home"), away.alias("away")))


def outcome_price(prices: Column, outcome: str) -> Column:
    """The first price beyond 1 among an outcome's names in a map of texts."""
    found = [F.try_element_at(prices, F.lit(k)).try_cast("double") for k in OUTCOME_KEYS[outcome]]
    return F.coalesce(*(F.when(p > 1, p) for p in found))


def closing_market(prices: Column, market: Column, selection: Column) -> Column:
    """All outcome prices of a bet's market, for its margin; null unless all are there."""
    complete = lambda names: F.when(F.reduce(F.array(*(outcome_price(prices, n).isNotNull() for n in names)), F.lit(True), lambda a, b: a & b), F.array(*(outcome_price(prices, n) for n in names)))
    total = F.lower(selection).rlike("over|under")
    return F.when(total, complete(("over", "under"))).when(F.upper(F.trim(market)).isin("AH", "ASIAN", "ASIAN HANDICAP"), complete(("home", "away"))).otherwise(complete(("home", "draw", "away")))


def bookmaker_markets(text: Column) -> Column:
    """A user's prices, JSON by market and outcome, as a map of maps; null for other texts."""
    return F.from_json(text, "map<string,map<string,double>>")


def bookmaker_label(given: Column, *priced: tuple[str, Column]) -> Column:
    """The label given, else that of the first family with a price."""
    out = F.lit(None).cast("string")
    for name, price in reversed(priced):
        out = F.when(price.isNotNull(), name).otherwise(out)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), out)
