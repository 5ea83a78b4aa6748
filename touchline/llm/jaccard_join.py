"""Exact n-gram Jaccard join by partitioning the universe of shingles into segments (pigeonhole with allocation).

A document's set holds its distinct ``WIDTH``-word shingles as 64-bit hashes.  Sets whose Jaccard similarity reaches
``PERCENT`` differ in at most H shingles, so if the universe is cut into segments and segment i is allowed e_i differences
with sum(e_i + 1) > H, some segment agrees within its allowance.  Every size band has its own number of segments.  A set is
indexed in its band under the hash of each segment's subset, and, in the band's deletable segments, under the subsets with
one shingle taken out.  It probes its own band (for partners not larger) and lower ones that hold possible partners, with
allowances -1 (skip), 0 or 1 by cost: index entries are counted over all sets, and a set pays for its sum by the probes that
meet fewest entries, so subsets that many sets share are skipped wherever others suffice.

Sets that meet under a chosen key are tied to the key's smallest indexed member; what is tied together is a family, and
every candidate pair lies in one.  Since popular keys are skipped, families are little more than the groups of similar sets.
They are verified exactly, in blocks of bounded size: a prefix filter by the family's own rarest shingles proposes pairs,
whole sets decide, and a union-find skips pairs that are already linked, so a block emits at most one link for each of its
members.  Equal sets are first collapsed to one representative.  Thus every link between different sets is found or implied,
and a group of thousands of copies emits thousands of rows, not millions.

Scale: keys are counted with map-side sums and come back by a plain join, which adaptive execution splits where a key is
hot; only keys that two sets share travel further.  Keys are packed in binary until copies are collapsed; sets are rebuilt
from text only for documents that met another.  Nothing is broadcast by hand or collected.

Defined results: documents without words have empty sets, link with nothing and are their own component; null ids take no
part (component null); rows with an equal id are one node that has the links of all its rows; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, connected, release, stored, unstore, word_hashes, words_in

WIDTH = 4
PERCENT = 85
#: Ratio of a size band's bounds.
BAND = 1.5
#: One segment in so many is deletable, three at least.
DELETABLE = 8
#: Sets in a block of a family.
BLOCK = 4096
#: Keys in a partition of the key shuffles.
KEYS_PER_PARTITION = 1_500_000
#: Texts hashed together.
TEXTS_AT_ONCE = 200
INDEX, PROBE = 1, 2

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each UTF-8 text; fewer words than a shingle count as one."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        raw, begin, last, n = words_in(texts[at : at + TEXTS_AT_ONCE])
        words = word_hashes(raw, begin, last)
        stop = np.cumsum(n)
        for a, b in zip((stop - n).tolist(), stop.tolist()):
            yield _shingles(words[a:b], width)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, width)
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) + 0xC2B2AE3D27D4EB4E * k) % (1 << 64) | 1) for i in range(k)]
    out = h[: n - k + 1] * odd[0]
    for i in range(1, k):
        out = mix(out) + h[i : n - k + 1 + i] * odd[i]
    return np.unique(mix(out))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets([text], width))


@lru_cache(None)
def bands(upto: int, ratio: float = BAND) -> list[int]:
    """Lower bounds of size bands from 1 to beyond ``upto``."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def differences(a: int, b: int, percent: int) -> int:
    """Most elements in which sets of sizes a and b can differ and still reach ``percent``."""
    return (100 - percent) * (a + b) // (100 + percent)


def n_segments(low: int, high: int, percent: int) -> int:
    """Segments of the band [low, high): one more than any prober's differences."""
    top = high - 1
    return differences(top, top * 100 // percent, percent) + 1


@lru_cache(100_000)
def schemes(n: int, percent: int) -> tuple[tuple[int, int, int, int], ...]:
    """(band, segments, first deletable segment, sum of (e_i + 1) that probes must reach) of a set of ``n``, its own band first."""
    low = bands(1 << max(8, int(n).bit_length() + 1))
    b = int(np.searchsorted(low, n, side="right")) - 1
    out = []
    for at in range(b, -1, -1):
        if at < b and -(-percent * n // 100) >= low[at + 1]:
            break
        m = n_segments(low[at], low[at + 1], percent)
        out.append((at, m, m - max(min(m, 3), m // DELETABLE), differences(n, min(n, low[at + 1] - 1), percent) + 1))
    return tuple(out)


def packed_keys(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """Keys of a set by scheme (each segment's subset, then subsets without one shingle), and the sizes of deletable segments."""
    keys, sizes = [], []
    mixed_all = mix(tokens)
    for band, m, first, _ in schemes(len(tokens), percent):
        segment = ((tokens >> np.uint64(9)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        count = np.bincount(segment, minlength=m)
        stop = np.cumsum(count)
        mixed = mixed_all[order]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        sums = total[stop] - total[stop - count]
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        cut = int(stop[first - 1]) if first else 0
        of = segment[order[cut:]]
        keys += [mix(sums + salt), mix(sums[of] - mixed[cut:] + salt[of])]
        sizes.append(count[first:])
    return np.concatenate(keys).tobytes() + np.concatenate(sizes).astype(np.uint16).tobytes()


#: A unit is a scheme's number, a mark of subsets without one shingle, and a segment.
SEGMENT_BITS, SCHEME_SHIFT = 24, 25


def unpacked_keys(n: int, packed: bytes, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, units) of a set of ``n`` shingles."""
    plan = schemes(n, percent)
    room = 2 * sum(m - first for _, m, first, _ in plan)
    keys, sizes = np.frombuffer(packed[: len(packed) - room], np.uint64), np.frombuffer(packed[len(packed) - room :], np.uint16)
    units, at = [], 0
    for k, (_, m, first, _) in enumerate(plan):
        of = np.repeat(np.arange(first, m), sizes[at : at + m - first])
        at += m - first
        units += [np.arange(m) | k << SCHEME_SHIFT, of | 1 << SEGMENT_BITS | k << SCHEME_SHIFT]
    return keys, np.concatenate(units).astype(np.int32)


def keys_of(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All index and possible probe keys of a set; the two lowest bits hold the role."""
    if not len(tokens):
        return np.empty(0, np.uint64)
    keys, units = unpacked_keys(len(tokens), packed_keys(tokens, percent), percent)
    return (keys & ~np.uint64(3)) | np.where(units < 1 << SCHEME_SHIFT, INDEX | PROBE, PROBE).astype(np.uint64)


def allocated(n: int, units: np.ndarray, cost: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which of a set's shared keys it probes; ``cost``: index entries of other sets under each, units not named meet none.

    A segment pays one difference for its subset and one more for its subsets without a shingle; each scheme buys the sum it
    needs where that meets fewest entries.
    """
    chosen = np.zeros(len(units), bool)
    for k, (_, m, first, need) in enumerate(schemes(n, percent)):
        mine = np.flatnonzero(units >> SCHEME_SHIFT == k)
        segment, loose = units[mine] & ((1 << SEGMENT_BITS) - 1), (units[mine] >> SEGMENT_BITS & 1).astype(bool)
        price = np.zeros((2, m))
        np.add.at(price, (loose.astype(int), segment), cost[mine])
        price[1, :first] = np.inf
        price[1] = np.maximum(price[1], price[0])  # taken only beside the whole subset
        order = np.argsort(price.ravel(), kind="stable")[:need]
        taken = np.zeros(2 * m, bool)
        taken[order] = True
        chosen[mine] = taken.reshape(2, m)[loose.astype(int), segment] & (cost[mine] > 0)
    return chosen


def _signed(it: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            n, digest, keys = [], [], []
            for tokens in shingle_sets(as_bytes(part.column(1)), width):
                n.append(len(tokens))
                digest.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                keys.append(packed_keys(tokens, percent) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "digest", "keys"])


def _exploded(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [unpacked_keys(n, k, percent) for n, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                if found:
                    rep = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(k) for k, _ in found])
                    keys, units = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rep), pa.array(units)], names=["key", "rep", "unit"])

    return run


def _allocate(percent: int):
    """The shared keys that each set probes, of its ``meets``: unit, key and index entries."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, reps = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sizes = b.column(1).to_pylist()
            lists = b.column(2)
            stop = lists.value_lengths().to_numpy().cumsum()
            flat = lists.flatten()
            unit, key, entries = (flat.field(i).to_numpy() for i in range(3))
            for rep, n, a, z in zip(b.column(0).to_pylist(), sizes, [0, *stop[:-1].tolist()], stop.tolist()):
                units = unit[a:z]
                take = allocated(n, units, entries[a:z] - (units < 1 << SCHEME_SHIFT), percent)  # its own entry is no cost
                keys.append(key[a:z][take])
                reps.append(np.full(int(take.sum()), rep))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(reps))], names=["key", "rep"])

    return run


def family_ties(reps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a set and the smallest indexed set under a key that one of them chose to probe; ``reps``: rep, n, keys."""
    keys = reps.mapInArrow(_exploded(percent), "key long, rep long, unit int")
    own = F.col("unit") < 1 << SCHEME_SHIFT
    shared = keys.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(own).alias("entries")).where("rows > 1 AND entries > 0").select("key", "entries")
    shared = stored(shared, "shared-keys")
    release(reps.sparkSession)
    met = stored(keys.join(shared, "key").select("key", "rep", "unit", "entries"), "meetings")
    release(reps.sparkSession)
    meets = met.groupBy("rep").agg(F.collect_list(F.struct("unit", "key", "entries")).alias("meets"))
    probes = stored(meets.join(reps.select("rep", "n"), "rep").select("rep", "n", "meets").mapInArrow(_allocate(percent), "key long, rep long"), "probes")
    index = met.where(own).join(probes.select("key").distinct(), "key", "left_semi").select("key", "rep")
    hubs = index.groupBy("key").agg(F.min("rep").alias("hub"))
    ties = probes.unionByName(index).join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    ties = stored(ties, "ties")
    unstore(shared, met, probes)
    release(reps.sparkSession)
    return ties


def _sets(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(as_bytes(part.column(1)), width)], pa.binary())], names=["id", "tokens"])

    return run


def links_within(sets: list[np.ndarray], block: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of a group (a spanning forest); sets of one block meet only if there is one block."""
    token, rank = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(np.bincount(rank), kind="stable")
    place = np.empty(len(token), np.int32)
    place[order] = np.arange(len(token), dtype=np.int32)
    ranks = np.split(place[rank], np.cumsum([len(s) for s in sets])[:-1])
    ranks = [np.sort(r) for r in ranks]  # rarest shingles of the family first
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found, across = [], len(set(block)) > 1
    index: dict[int, list[int]] = {}
    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        rx, n = ranks[x], len(ranks[x])
        least = -(-percent * n // 100)
        prefix = rx[: n - least + 1].tolist()
        for y in {y for t in prefix for y in index.get(t, ())}:
            if len(ranks[y]) < least or (across and block[x] == block[y]) or root(x) == root(y):
                continue
            both = np.concatenate([rx, ranks[y]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                parent[root(x)] = root(y)
                found.append((x, y))
        for t in prefix:
            index.setdefault(t, []).append(x)
    return found


def _family_links(percent: int):
    def settle(ids: list[int], blocks: list[int], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        pairs = links_within([np.frombuffer(r, np.uint64) for r in raw], blocks, percent) if len(ids) > 1 else []
        if pairs:
            a, b = (np.array([ids[k] for k in side], np.int64) for side in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, blocks, raw = None, [], [], []
        for b in it:
            for key, i, k, tokens in zip(zip(*(b.column(c).to_pylist() for c in range(3))), *(b.column(c).to_pylist() for c in (3, 4, 5))):
                if key != held:
                    yield from settle(ids, blocks, raw)
                    held, ids, blocks, raw = key, [], [], []
                ids.append(i)
                blocks.append(k)
                raw.append(tokens)
        yield from settle(ids, blocks, raw)

    return run


def family_links(families: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """``a, b``: links of ``families(id, comp)`` over ``sets(id, tokens)``, block by block.

    Sets link only if the smaller has ``percent`` of the larger's size, so in a family of several blocks a block holds sets
    of one size range, whose ratio is a little over 100 / ``percent``, and meets the blocks of its own range and the next ones.
    """
    sets = sets.withColumn("n", F.octet_length("tokens") / 8)
    span = F.floor(F.log("n") / (math.log(100 / percent) + 0.001))
    placed = families.join(sets.select("id", "n").distinct(), "id").withColumn("span", span)
    counts = placed.groupBy("comp", "span").agg(F.count("*").alias("k"))
    cuts = F.map_from_entries(F.collect_list(F.struct("span", F.ceil(F.col("k") / BLOCK))))  # an entry for each size range
    placed = placed.join(counts.groupBy("comp").agg(F.sum("k").alias("size"), cuts.alias("cuts")), "comp")

    def blocks(of: Column) -> Column:
        first = F.shiftleft(of, 32)
        n = F.try_element_at("cuts", of)
        return F.when(n.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(first, first + n - 1))

    several = F.col("size") > BLOCK
    own = F.shiftleft("span", 32) + F.pmod(F.xxhash64("id", "n"), F.try_element_at("cuts", F.col("span")))
    met = F.concat(*(blocks(F.col("span") + k) for k in (-1, 0, 1)))
    zero = F.lit(0).cast("long")
    placed = placed.withColumn("block", F.when(several, own).otherwise(zero)).withColumn("other", F.explode(F.when(several, met).otherwise(F.array(zero))))
    placed = placed.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "n", "block")
    rows = placed.join(sets, ["id", "n"]).select("comp", "i", "j", "id", "block", "tokens")
    return rows.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_family_links(percent), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(rows.mapInArrow(lambda it: _signed(it, width, percent), "doc_id long, n_shingles long, digest binary, keys binary"), "signatures")
    total = signed.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // 8 // KEYS_PER_PARTITION))
    sig = stored(signed.select("doc_id", "n_shingles", "digest"), "set-digests")
    first = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    reps = stored(first.select("rep", "n", "keys"), "representatives")
    unstore(signed)
    release(spark)
    ties = family_ties(reps, percent)
    unstore(reps)
    release(spark)

    families = stored(connected(ties), "families")
    wanted = rows.join(families.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").distinct()
    sets = stored(wanted.mapInArrow(_sets(width), "id long, tokens binary"), "sets")
    release(spark)
    links = stored(family_links(families, sets, percent, parts), "links")
    unstore(ties, families, sets)

    able = sig.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    shared = able.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    same_id = able.join(shared, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = stored(connected(links.unionAll(same_id.where("a <> b"))), "components")
    placed = able.join(classes, "digest").join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    alone = sig.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionAll(alone)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest id of their component (all those without an id)."""
    gone = jaccard_components(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
