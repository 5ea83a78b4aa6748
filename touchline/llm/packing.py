"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

``tokenised`` turns documents into pieces of at most ``capacity`` tokens; ``packed`` assigns pieces to sequences.  Pieces
that fill a sequence need no search.  The others are dealt by a hash into shards of about ``SHARD_ITEMS``; every shard is
evolved on several islands.  A crossover injects whole well-filled bins of one parent into the other, removes bins that
hold a duplicate, and places displaced pieces by best fit.  Between rounds each island's elite moves to the next island of
its shard.  A shard at its lower bound (total length over capacity) stops at once, others when ``GENERATIONS`` children in a
row were no better than the best.  The emptiest bins of all shards are then opened, and their pieces packed in the same way
until they fit one shard.

Scale: one text pass, one shuffle of piece rows; shard size is constant, and what shards leave part-filled meets in ever fewer
shards, so few sequences are lost, whatever the corpus.  Rows are dealt with their place in the table, so repeated rows
spread like others; state tables are written between rounds.

Defined results: null text is empty (the closing id alone); repeated rows are packed each; null ids are carried; empty
tables give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_text, stored, unstore

CAPACITY = 2048
SHARD_ITEMS = 4096
ISLANDS = 4
ROUNDS = 2
POPULATION = 6
#: Children without progress after which an island stops.
GENERATIONS = 8
#: Bins of a shard that are opened again, while there are several shards.
OPENED = 2
#: Fill from which a bin counts as well filled.
WELL_FILLED = 0.995
#: Words kept by a worker before its memory of encoded words is emptied.
MEMO_WORDS = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Fixed pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder(dict):
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, remembering words between texts.

    With byte-level pre-tokenization a single space always opens the next piece, so a text may be cut before single spaces
    and its words encoded apart.  Texts with other white space beside a cut, or with the special token, are encoded whole.
    The mapping itself holds words between single spaces; a trailing space marks a text's first word.
    """

    #: White space other than blanks and line feeds.
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        import tiktoken

        with open(path) as f:
            file = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.special = [*special]
        encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.encode_whole = lambda text: encoding.encode(text, allowed_special="all")
        self.encode_word = encoding.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = self.encode_word(word[:-1] if word[-1] == " " else " " + word)
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or "\n " in text or " \n" in text or text[-1] == "\n" or any(t in text for t in self.special) or self.OTHER_SPACE.search(text):
            return np.array(self.encode_whole(text), "<u4").tobytes()
        words[0] += " "
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece of a cut document may be shorter."""
    n = len(ids) // 4
    cuts = [0, *range(n - capacity * ((n - 1) // capacity), n, capacity), n] if n > capacity else [0, n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def _tokeniser(path: str, capacity: int, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(path).encode, np.array([end_id], "<u4").tobytes()
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = [(doc, *p) for doc, text in zip(part.column(0).to_pylist(), as_text(part.column(1))) for p in pieces_of(encode(text) + end, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES_SCHEMA.types)], schema=PIECES_SCHEMA)

    return run


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every whole text.  ``vocabulary``: path of a byte-level tokenizer file, present on every machine."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokeniser(vocabulary, capacity, end_id), PIECES)


class Packing:
    """Bins over item sizes with O(1) best fit: a bit mask of the residuals that some bin has."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _shelve(self, k: int) -> None:
        self.by_room[self.room[k]].append(k)
        self.mask |= 1 << self.room[k]

    def add_bin(self, items: list[int], room: int | None = None) -> None:
        self.bins.append(list(items))
        self.room.append(self.capacity - sum(self.sizes[i] for i in items) if room is None else room)
        self._shelve(len(self.bins) - 1)

    def best_fit(self, items) -> None:
        for i in items:
            size = self.sizes[i]
            fits = self.mask >> size
            if not fits:
                self.add_bin([i])
                continue
            room = size + (fits & -fits).bit_length() - 1
            k = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
            self.bins[k].append(i)
            self.room[k] -= size
            self._shelve(k)

    def labels(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for k, items in enumerate(self.bins):
            out[items] = k
        return out

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (squared fill)."""
        return -len(self.bins), sum(((self.capacity - r) / self.capacity) ** 2 for r in self.room)


def from_labels(labels: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    out, order = Packing(sizes, capacity), np.argsort(labels, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        out.add_bin(group.tolist())
    return out


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """``a`` with half of ``b``'s well-filled bins injected; bins with duplicates go, displaced items are best-fitted."""
    good = [k for k, r in enumerate(b.room) if r <= b.capacity * (1 - WELL_FILLED)] or list(range(len(b.bins)))
    chosen = [k for k in good if rng.random() < 0.5]
    taken = {i for k in chosen for i in b.bins[k]}
    bins, rooms, loose = [], [], []
    for items, room in zip(a.bins, a.room):
        if taken.isdisjoint(items):
            bins.append(items)
            rooms.append(room)
        else:
            loose += [i for i in items if i not in taken]
    bins += [b.bins[k] for k in chosen]
    rooms += [b.room[k] for k in chosen]
    reopened = set(sorted(range(len(bins)), key=lambda k: -rooms[k])[: max(1, len(bins) // 50)])  # the emptiest bins open again
    child = Packing(a.sizes, a.capacity)
    for k, (items, room) in enumerate(zip(bins, rooms)):
        if k in reopened:
            loose += items
        else:
            child.add_bin(items, room)
    child.best_fit(sorted(loose, key=lambda i: -a.sizes[i]))
    return child


def evolve(sizes: list[int], population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """A population, best first, after ``generations`` children in a row that were no better; the worst gives way."""
    rng, n = random.Random(seed), len(sizes)
    if not n:
        return [np.empty(0, np.int32)]
    least = -(-sum(sizes) // capacity)
    people = [from_labels(p, sizes, capacity) for p in population]
    while len(people) < POPULATION:
        first = Packing(sizes, capacity)
        blur = 0.0 if not people else 0.15
        first.best_fit(sorted(range(n), key=lambda i: (-sizes[i] * (1 + blur * rng.random()), i)))
        people.append(first)
        if len(first.bins) == least:
            break
    people.sort(key=Packing.fitness, reverse=True)
    idle = 0
    while idle < generations and len(people) > 1 and len(people[0].bins) > least:
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng)
        best = people[0].fitness()
        if child.fitness() > people[-1].fitness():
            people[-1] = child
            people.sort(key=Packing.fitness, reverse=True)
        idle = 0 if people[0].fitness() > best else idle + 1
    return [p.labels() for p in people[:POPULATION]]


ITEM_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
STATE = "shard long, island int, n_bins int, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, population array<binary>"


def _evolver(capacity: int, round_no: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            rows = []
            for r in frame.itertuples(index=False):
                sizes = [x["length"] for x in r.items]
                before = [np.frombuffer(p, np.int32) for p in r.population]
                after = evolve(sizes, before, capacity, hash((int(r.shard), int(r.island), round_no)))
                rows.append((r.shard, r.island, len(np.unique(after[0])), r.items, [p.tobytes() for p in after]))
            yield pd.DataFrame(rows, columns=["shard", "island", "n_bins", "items", "population"])

    return run


def _placer(level: int, opened: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of each shard with sequence and offset; those of its ``opened`` emptiest bins with neither."""
        for frame in it:
            for r in frame.itertuples(index=False):
                items = pd.DataFrame(list(r.items), columns=list(ITEM_COLUMNS))
                items["bin"] = np.frombuffer(r.population[0], np.int32)
                items = items.sort_values(["bin", "doc_id", "piece"], kind="stable", na_position="last")
                items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
                items["sequence_id"] = 2 * ((level << 56) + (int(r.shard) << 32) + items["bin"].astype("int64"))
                emptiest = items.groupby("bin")["length"].sum().sort_values(kind="stable").index[:opened]
                items = items.astype({"doc_id": "Int64", "sequence_id": "Int64", "offset": "Int64"})
                items.loc[items["bin"].isin(emptiest), ["sequence_id", "offset"]] = pd.NA
                yield items[[*ITEM_COLUMNS, "sequence_id", "offset"]]

    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every piece with its ``sequence_id`` and gapless ``offset``.  ``pieces``: a written table, read several times."""
    full = pieces.where(F.col("length") == capacity).select(*ITEM_COLUMNS, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, out, level = pieces.where(F.col("length") < capacity), full, 0
    while True:
        shards = max(1, -(-loose.count() // shard_items))
        placed = stored(_evolved(loose, shards, capacity, islands, rounds, level), "placed")
        out = out.unionByName(placed.where("sequence_id IS NOT NULL"))
        if shards == 1:
            return out
        loose, level = placed.where("sequence_id IS NULL").select(*ITEM_COLUMNS), level + 1


def _evolved(loose: DataFrame, shards: int, capacity: int, islands: int, rounds: int, level: int) -> DataFrame:
    """One level of packing; with several shards the pieces of each one's emptiest bins come back without a place."""
    spark = loose.sparkSession
    item = F.struct(*ITEM_COLUMNS)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    dealt = loose.withColumn("shard", shard).groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = dealt.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.lit(0).alias("n_bins"), "items", F.array().cast("array<binary>").alias("population"))
    state = state.repartition(max(1, min(shards * islands, 4 * spark.sparkContext.defaultParallelism)) if shards < 1000 else shards, "shard", "island")
    for k in range(rounds):
        nxt = stored(state.mapInPandas(_evolver(capacity, k), STATE), "islands")
        if k:
            unstore(made)
        made = nxt
        if k + 1 < rounds:
            elite = made.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite"))
            state = made.join(elite, ["shard", "island"]).withColumn("population", F.concat(F.array("elite"), F.slice("population", 1, POPULATION - 1))).drop("elite")
    best = made.groupBy("shard").agg(F.min_by(F.struct("items", "population"), F.struct("n_bins", "island")).alias("b")).select("shard", "b.items", "b.population")
    return best.mapInPandas(_placer(level, OPENED if shards > 1 else 0), PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole documents and pack them."""
    return packed(stored(tokenised(docs, vocabulary, capacity), "pieces"), capacity)
