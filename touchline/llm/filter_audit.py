"""Filter interaction audit: what each of five filters removes, in every order, from additive counters of failure masks.

Exact duplicates are found by a range sort on fingerprint, text and id.  Partitions are cut by fingerprint, id and place, so a
text with very many copies is shared by partitions; within one, rows are sorted by fingerprint, text and id and compared with
their predecessors.  A row of a partition's first fingerprint whose id is the least there of its text can't be decided within
it: earlier partitions that hold this text end with its fingerprint.  So a partition tells the texts of its first and of its
last fingerprint (one each, unless fingerprints collide), and a join of these few by the whole text decides the open rows.

The other four filters are Column expressions over the sorted rows.  From there on a row is an id, a part and a mask of five
bits; labels join to these, and counters by part, mask and label give every figure: an order's step removes the rows whose mask
has its filter's bit and none of an earlier one.

Scale: texts move once, in the range sort.  Counters are summed before they move; a part has at most 128 of them.

Defined results: null text is empty; null source is the part named by the empty string, as is the empty source; a null id is
no smaller id and has none, so such a row neither fails E nor makes one fail, and has no labels; rows of one id and text don't
fail E by each other; several labels of an id count if any says so; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored, unstore

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DUPLICATE = 1 << FILTERS.index("E")

#: kind 0: a row, ``run`` set if its E is open; 1: a text of a partition's first fingerprint; 2: one of its last.
_MARKED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("run", pa.string()), ("text", pa.large_string())])
MARKED = "kind int, doc_id long, part string, mask int, run string, text string"
_AUDIT = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in FIGURES)


def failure_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition (print, text, doc_id, part, mask) compared with their predecessors."""
    here = TaskContext.get().partitionId()
    head, runs_of_head = None, 0  # the partition's first fingerprint, and its texts so far
    last_print, last_text, first_id = None, None, None  # of the row before
    tail: list[tuple[str, int | None]] = []  # texts of the fingerprint of the row before, and their least ids

    def telling(kind: int, texts: list[tuple[str | None, int | None, str | None]]) -> pa.RecordBatch:
        n = len(texts)
        cols = [[kind] * n, [t[1] for t in texts], [None] * n, [None] * n, [t[2] for t in texts], [t[0] for t in texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MARKED.types)], schema=_MARKED)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        prints, ids, texts = b.column(0).to_numpy(), b.column(2), b.column(1).cast(pa.large_string())
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        id_of = pc.fill_null(ids, 0).to_numpy()
        same_print = np.empty(n, bool)
        same_print[0] = last_print is not None and prints[0] == last_print
        same_print[1:] = prints[1:] == prints[:-1]
        same = same_print.copy()
        same[0] &= texts[0].as_py() == last_text
        if n > 1:
            same[1:] &= pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(~same)
        run = np.cumsum(~same)  # 0: the run of the row before the batch
        least = np.concatenate([[first_id or 0], id_of[begins]])[run]
        least_known = np.concatenate([[first_id is not None], known[begins]])[run]
        fails = known & least_known & (id_of > least)
        if head is None:
            head = prints[0]
        in_head = prints == head
        heads_here = begins[in_head[begins]]
        numbers = runs_of_head + np.cumsum(~same & in_head) - 1
        runs_of_head += len(heads_here)
        is_open = in_head & known & least_known & (id_of == least)
        run_name = pa.array([f"{here}-{k}" if o else None for k, o in zip(numbers.tolist(), is_open.tolist())], pa.string())
        mask = b.column(4).to_numpy() + np.where(fails, DUPLICATE, 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids, b.column(3), pa.array(mask.astype(np.int32)), run_name, pa.nulls(n, pa.large_string())], schema=_MARKED)
        if len(heads_here):
            yield telling(1, [(texts[i].as_py(), ids[i].as_py(), f"{here}-{numbers[i]}") for i in heads_here.tolist()])
        last_print, last_text = prints[-1], texts[n - 1].as_py()
        begun = begins[prints[begins] == last_print].tolist()
        goes_on = bool(same_print[: int(np.flatnonzero(prints == last_print)[0]) + 1].all())  # the fingerprint came into the batch
        tail = (tail if goes_on else []) + [(texts[i].as_py(), ids[i].as_py()) for i in begun]
        first_id = int(least[-1]) if least_known[-1] else None
    if tail:
        yield telling(2, [(t, i, None) for t, i in tail])


def failure_masks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, part, mask`` of every row, the stored table it reads)."""
    rows = docs.select(
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("print"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    parted = rows.repartitionByRange("print", F.col("doc_id").asc_nulls_last(), "place")
    ordered = parted.sortWithinPartitions("print", "text", F.col("doc_id").asc_nulls_last())
    marked = stored(ordered.select("print", "text", "doc_id", "part", failure_mask(F.col("text")).alias("mask")).mapInArrow(_compared, MARKED), "marked")
    smallest = marked.where("kind = 2").groupBy("text").agg(F.min("doc_id").alias("least"))
    heads = marked.where("kind = 1").select("text", "run", F.col("doc_id").alias("first"))
    repeated = heads.join(smallest, "text").where("least < first").select("run", F.lit(DUPLICATE).alias("also"))
    decided = marked.where("kind = 0").join(repeated, "run", "left")
    return decided.select("doc_id", "part", (F.col("mask") + F.coalesce("also", F.lit(0))).alias("mask")), marked


def _figures(counters: pa.Table) -> pa.Table:
    """All orders and steps of one part from its counters, at most one for each mask."""
    n, good, toxic = (np.zeros(1 << len(FILTERS), np.int64) for _ in range(3))
    masks = counters.column("mask").to_numpy()
    for into, c in ((n, "n"), (good, "good"), (toxic, "toxic")):
        np.add.at(into, masks, counters.column(c).to_numpy())
    every, bit_of = np.arange(1 << len(FILTERS)), {f: 1 << i for i, f in enumerate(FILTERS)}
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            bit = bit_of[f]
            failing, reached = (every & bit) > 0, (every & before) == 0
            out = failing & reached
            removed = int(n[out].sum())
            shapley[f] += removed
            rows.append((order, step, f, int(n[reached & ~failing].sum()), removed, int(n[failing & ~reached].sum()), int(n[bit]), int(good[out].sum()), int(toxic[out].sum())))
            before |= bit
    cols = list(zip(*((*r[:2], *r[3:], shapley[r[2]]) for r in rows)))
    part = counters.column("part")[0].as_py()
    arrays = [pa.array([part] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
    return pa.Table.from_arrays(arrays, schema=pa.schema(_AUDIT + [(c, pa.int64()) for c in FIGURES]))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and counts: 600 rows a part."""
    masks, marked = failure_masks(docs)
    said = lambda c, name: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name)
    by_id = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality", "good"), said("toxic", "toxic"))
    seen = masks.join(by_id, "doc_id", "left")
    counters = seen.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    counters = stored(counters, "mask-counters")
    unstore(marked)
    return counters.groupBy("part").applyInArrow(_figures, AUDIT)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
  FROM s
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), t AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS prior
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)
), r AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & prior > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, t GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
