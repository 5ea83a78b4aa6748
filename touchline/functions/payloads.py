"""Column functions on JSON payloads, maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_KEYS = {"h": ("home", "h", "1"), "d": ("draw", "d", "x"), "a": ("away", "a", "2")}


def first_key(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first of several keys that a string map has, as a number."""
    return F.coalesce(*(F.try_element_at(payload, F.lit(k)) for k in keys)).cast("double")


def probabilities(payload: Column) -> Column:
    """Probabilities by alias keys, normalised; null unless all three are there and positive."""
    h, d, a = (first_key(payload, PROBABILITY_KEYS[k]) for k in "hda")
    total = h + d + a
    return F.when(total > 0, F.struct((h / total).alias("h"), (d / total).alias("d"), (a / total).alias("a")))


def canonical_hash(payload: Column) -> Column:
    """SHA-256 of a string map written with sorted keys."""
    entries = F.array_sort(F.map_entries(payload))
    return F.sha2(F.to_json(F.map_from_entries(entries)).cast("binary"), 256)


def main_line(pairs: Column) -> Column:
    """Of an array of (line, over, under) the pair of closest prices; ties go to the higher least price."""
    keyed = F.transform(pairs, lambda p: F.struct(F.round(F.abs(p["over"] - p["under"]), 9).alias("gap"), (-F.least(p["over"], p["under"])).alias("low"), p["line"].alias("line"), p["over"].alias("over"), p["under"].alias("under")))
    return F.array_min(keyed)
