"""Names to known entities: by folded key, then the most similar known key, found by an index of character pairs.

Keys are folded in any script: compatibility forms are decomposed, marks dropped, case folded; letters and digits of every
script stay.  A key without any letter or digit matches nothing.

The similarity of two keys is twice their matched characters over all characters.  For a ratio of at least ``t`` and ``s``
characters together, ``t * s / 2`` characters match, in at most one block more than there are unmatched characters, so both keys
share at least ``(1.5 * t - 1) * s - 1`` pairs of neighbours (and ``t * s / 2`` single characters).  Hence keys meet only if

* one of the rarest pairs of one is among the rarest pairs of the other, as many of each as leave too few for the bound,
* their lengths allow the ratio, and their shared pairs and characters reach both bounds.

What is left is compared exactly.  Nothing above ``t`` is lost.  Names without a match at ``threshold`` ask again at ``floor``,
by single characters, for the score they are staged with; it is 0 if no key reaches ``floor``.

Scale: rarity is counted once over the known keys; a frequent pair is an entry only of keys that have little else.  Distinct
names and keys only, so repeated rows cost nothing; pairs that meet are counted, never collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.strings import CLUB_WORDS

THRESHOLD = 0.8
#: Least score with which a name is staged.
FLOOR = 0.5
#: From this ratio on, keys that are not both of three characters or fewer share a pair.
PAIRS_FROM = 0.8

_CLUB = re.compile(rf"^({'|'.join(CLUB_WORDS)})\s+")


def fold(name: str | None) -> str | None:
    """Letters and digits of a name in lower case and without marks; one club word is dropped from the front."""
    if name is None:
        return None
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", name).casefold())
    plain = " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())
    return "".join(c for c in _CLUB.sub("", plain) if c.isalnum())


@F.pandas_udf(StringType())
def fold_key(names: pd.Series) -> pd.Series:
    """``fold`` of a column; no built-in function decomposes characters."""
    return names.map(fold, na_action="ignore")


def least_shared(t: float, size: int, together: Column) -> Column:
    """Least number of grams of ``size`` characters that keys share whose ratio is at least ``t``."""
    bound = (1.5 * t - 1) * together - 1 if size == 2 else t * together / 2
    return F.ceil(bound - 1e-9)


def grams(keys: DataFrame, size: int) -> DataFrame:
    """``key, length, gram``: grams of each key, numbered where they repeat; short keys have their characters besides."""
    length = F.char_length("key")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring("key", i, F.lit(n)))
    of_size = F.when(length >= size, pieces(size)).otherwise(F.array().cast("array<string>"))
    rows = keys.select("key", length.alias("length"), F.explode(of_size).alias("piece"))
    k = F.row_number().over(Window.partitionBy("key", "piece").orderBy(F.lit(0)))
    rows = rows.select("key", "length", F.concat_ws("\x00", "piece", k.cast("string")).alias("gram"))
    if size == 1:
        return rows
    short = keys.where(length <= 3).select("key", length.alias("length"), F.explode(F.array_distinct(pieces(1))).alias("gram"))
    return rows.unionByName(short)


def _rarest(rows: DataFrame, often: DataFrame, t: float, size: int) -> DataFrame:
    """The rarest grams of each key, all but as many as any similar key must share; gram entries of short keys all stay."""
    shortest = F.ceil(F.col("length") * t / (2 - t) - 1e-9)
    spare = F.greatest(least_shared(t, size, F.col("length") + shortest), F.lit(1))
    n = F.col("length") - (size - 1)
    ranked = rows.join(often, "gram", "left").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("often", F.lit(0)), "gram")))
    return ranked.where((F.col("k") <= n - spare + 1) | (F.col("length") <= 3)).select("key", "length", "gram")


def _sharing(t: float, size: int):
    """Pairs of keys that share as many characters, and as many grams, as the ratio needs."""

    def shared(a: str, b: str, n: int) -> int:
        parts = lambda k: Counter(k[i : i + n] for i in range(len(k) - n + 1))
        return sum((parts(a) & parts(b)).values())

    def enough(a: str, b: str) -> bool:
        together = len(a) + len(b)
        return 2 * shared(a, b, 1) >= t * together - 1e-9 and (size == 1 or shared(a, b, 2) >= (1.5 * t - 1) * together - 1 - 1e-9)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([enough(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    return run


def candidates(names: DataFrame, keys: DataFrame, t: float) -> DataFrame:
    """``key, other``: pairs of a name's key and a known key that may reach the ratio ``t``; none that does is missing."""
    size = 2 if t >= PAIRS_FROM else 1
    known = grams(keys, size)
    often = known.groupBy("gram").agg(F.count("*").alias("often"))
    mine = _rarest(grams(names, size), often, t, size)
    theirs = _rarest(known, often, t, size).select(F.col("key").alias("other"), F.col("length").alias("other_length"), "gram")
    fits = 2 * F.least("length", "other_length") >= (t - 1e-9) * (F.col("length") + F.col("other_length"))
    met = mine.join(theirs, "gram").where(fits).select("key", "other").distinct()
    return met.mapInArrow(_sharing(t, size), "key string, other string")


def _compared(t: float):
    schema = pa.schema([("key", pa.string()), ("other", pa.string()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for key, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                score = SequenceMatcher(None, key, other).ratio()
                if score >= t:
                    rows.append((key, other, score))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [[]] * 3, schema.types)], schema=schema)

    return run


def similar(names: DataFrame, keys: DataFrame, t: float) -> DataFrame:
    """``key, other, score`` of all pairs of ``names(key)`` and ``keys(key)`` whose ratio is at least ``t``."""
    return candidates(names, keys, t).mapInArrow(_compared(t), "key string, other string, score double")


def resolve(names: DataFrame, entities: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """``name, entity, score, step`` for distinct names; ``entities``: entity (of any type that orders), alias.

    Keys that several entities share match none by key.  ``fuzzy``: the most similar key, the smaller entity on ties;
    ``staged``: no key reaches ``threshold``; the score is that of the best key from ``floor`` on, else 0.
    """
    known = entities.select("entity", fold_key(F.col("alias")).alias("key")).where("key <> ''").distinct()
    unique = known.groupBy("key").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).where("n = 1").drop("n")
    owner = known.groupBy("key").agg(F.min("entity").alias("entity")).withColumnRenamed("key", "other")
    asked = names.select("name").distinct().withColumn("key", fold_key(F.col("name")))
    exact = asked.join(unique, "key").select("name", "entity", F.lit(1.0).alias("score"), F.lit("key").alias("step"))
    left = asked.join(unique, "key", "left_anti")
    keys, queries = known.select("key").distinct(), left.where("key <> ''").select("key").distinct()

    def best(t: float, of: DataFrame) -> DataFrame:
        met = similar(of, keys, t).join(owner, "other")
        return met.groupBy("key").agg(F.min_by(F.struct("entity", "score"), F.struct(-F.col("score"), "entity")).alias("b")).select("key", "b.entity", "b.score")

    found = best(threshold, queries)
    fuzzy = left.join(found, "key").select("name", "entity", "score", F.lit("fuzzy").alias("step"))
    rest = left.join(found.select("key"), "key", "left_anti")
    near = best(floor, rest.where("key <> ''").select("key").distinct()) if floor < threshold else found.limit(0)
    staged = rest.join(near.drop("entity"), "key", "left").select("name", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit("staged").alias("step"))
    return exact.unionByName(fuzzy).unionByName(staged, allowMissingColumns=True).select("name", "entity", "score", "step")
