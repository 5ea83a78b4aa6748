"""Mixing sources to target weights: budgets in words, filled by whole documents through a subset-sum over their lengths.

Sources weigh 1, 2, 3, 1, ... in code-point order (null last) and share all words by weight.  No target passes three times its
source; what lies above goes to the other sources by weight.  A source gives ``target // source_size`` whole rounds of all its
documents.  The rest of its budget is filled from its counts of documents by exact length: every length first gives its share,
the longest lengths bring the rest within ``WINDOW`` words, and a bounded-knapsack dynamic programme over the lengths and
counts left finds the reachable sum nearest to it.  Which documents of a length are taken follows a seeded hash of their ids.

Scale: texts are read once, for their lengths; from there on rows are a few numbers.  Counts by length are summed before they
move, and the programme of a source reads one row for each distinct length, never one for each document; its array has at most
two windows of sums, whatever the table.  Documents of a length are split into ``BUCKETS`` by the seeded hash; whole buckets are
taken, and the bucket in which the budget ends is ranked by input partition, so copies of one length, source or id share no task.

Defined results: null text has size 0, and a document of size 0 is taken 0 words; null source is a source of its own; null and
repeated ids count row by row (equal rows of the last bucket are told apart by their place in the table); an empty table gives
no rows; extra columns are ignored.  The same table gives the same rows again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored, unstore

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words of a source's budget that the dynamic programme fills.
WINDOW = 1 << 20
#: Parts of the documents of one source and length, by seeded hash.
BUCKETS = 1024
SEED = 20

TAKES = "source string, size long, rounds long, extra long"
_TAKES = pa.schema([("source", pa.string()), ("size", pa.int64()), ("rounds", pa.int64()), ("extra", pa.int64())])


def nearest_sum(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size give the sum nearest to ``budget`` (the smaller one on ties); sizes are positive."""
    chosen = [0] * len(sizes)
    if budget <= 0 or not any(counts):
        return chosen
    most = min(2 * budget, sum(s * c for s, c in zip(sizes, counts)))  # nothing is nearer than a sum beyond
    reach, by = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32)
    reach[0] = True
    pieces: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        left, part = min(counts[i], most // sizes[i]), 1
        while left and not (budget <= most and reach[budget]):
            k = min(part, left)
            new = np.flatnonzero(reach[: most + 1 - k * sizes[i]] & ~reach[k * sizes[i] :]) + k * sizes[i]
            reach[new], by[new] = True, len(pieces)
            pieces.append((i, k))
            left, part = left - k, 2 * part
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:  # a sum was first reached by its piece from a sum of earlier pieces
        i, k = pieces[by[at]]
        chosen[i] += k
        at -= k * sizes[i]
    return chosen


def documents_of_lengths(sizes: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length fill ``budget`` words, at most the words there are."""
    total = sum(s * c for s, c in zip(sizes, counts))
    taken = [c * budget // total if total else 0 for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if rest <= window:
            break
        k = min(counts[i] - taken[i], -(-(rest - window) // sizes[i]), rest // sizes[i])
        taken[i] += k
        rest -= k * sizes[i]
    left = [(i, counts[i] - taken[i]) for i in range(len(sizes)) if counts[i] > taken[i] and (rest <= window or sizes[i] <= rest)]
    if rest > window:  # only lengths beyond the rest are left
        return taken
    for (i, _), k in zip(left, nearest_sum([sizes[i] for i, _ in left], [c for _, c in left], rest)):
        taken[i] += k
    return taken


def _takes(lengths: pa.Table) -> pa.Table:
    """Rounds and extra documents by length of one source; one row for each of its lengths."""
    sizes, counts = lengths.column("size").to_pylist(), lengths.column("n").to_pylist()
    whole, target = lengths.column("source_size")[0].as_py(), lengths.column("target")[0].as_py()
    rounds, budget = divmod(round(target), whole)
    extra = documents_of_lengths(sizes, counts, budget)
    return pa.Table.from_arrays([lengths.column("source"), lengths.column("size"), pa.array([rounds] * len(sizes), pa.int64()), pa.array(extra, pa.int64())], schema=_TAKES)


def source_targets(lengths: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, size, n``: windows over one row a source.

    Sources are filled in the order of room for each unit of weight; those that reach their limit are a prefix of this order.
    """
    sums = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    room = weighed.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum(MOST_REPEATS * F.col("source_size")).over(before), F.lit(0)),
            "weights": F.sum("weight").over(after),
        }
    )
    full = MOST_REPEATS * F.col("source_size").cast("decimal(38,0)") * F.col("weights") <= F.col("weight").cast("decimal(38,0)") * F.col("rest")
    level = F.max(F.when(~F.col("full"), F.struct("weights", "rest"))).over(everything)  # the first open source has the largest sum of weights
    filled = room.withColumn("full", full).withColumn("level", level)
    target = F.when(F.col("full"), (MOST_REPEATS * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level.rest") / F.col("level.weights"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` of every document row."""
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(BUCKETS)).cast("int")), "sizes")
    lengths = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = stored(source_targets(lengths), "targets")
    named = lambda t: t.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    with_target = lengths.where("size > 0").join(named(targets), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")) == F.col("source_key")).drop("source_key")
    takes = stored(named(with_target.groupBy("source").applyInArrow(_takes, TAKES)), "takes")
    partly = takes.where("extra > 0").select("source_key", "size", "extra")
    sized = rows.join(partly, ["source_key", "size"]).groupBy("source_key", "size", "extra", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source_key", "size").orderBy("bucket"))  # at most BUCKETS rows
    last = sized.withColumn("upto", upto).where("upto - n < extra AND extra <= upto")
    last = stored(last.select("source_key", "size", F.col("bucket").alias("last"), (F.col("extra") - F.col("upto") + F.col("n")).alias("need")), "last-buckets")
    known = rows.join(takes.join(last, ["source_key", "size"], "left"), ["source_key", "size"], "left")
    known = known.withColumn("part", F.when(F.col("bucket") == F.col("last"), F.shiftright("place", 33)))
    contested = known.where("part IS NOT NULL")
    shares = contested.groupBy("source_key", "size", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = stored(shares.select("source_key", "size", "part", earlier.alias("earlier")), "shares")
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "part").orderBy("place"))  # rows of one input partition
    ranked = contested.withColumn("rank", rank).join(shares, ["source_key", "size", "part"])
    more = ranked.withColumn("more", F.col("earlier") + F.col("rank") <= F.col("need"))
    settled = known.where("part IS NULL").withColumn("more", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)))
    cols = ("doc_id", "source", "source_key", "size", "rounds", "more")
    both = settled.select(*cols).unionByName(more.select(*cols))
    out = both.join(named(targets), "source_key")
    taken = F.col("size") * (F.coalesce(F.col("rounds"), F.lit(0)) + F.col("more").cast("long"))
    out = stored(out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source"), "mix")
    unstore(rows, lengths, targets, takes, last, shares)
    return out
