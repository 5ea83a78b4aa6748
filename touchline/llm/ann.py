"""Nearest neighbours by largest inner product over balanced posting lists with replicated boundary vectors.

Vectors are dealt into bands of norm, each at most a square root of two wide (the last holds all smaller ones).  In a band, inner
products become distances by one more coordinate, the norm missing to the band's largest.  A band's centroids are fitted by
k-means with a price on full lists, on at most ``SAMPLE`` vectors chosen by a hash of their ids; the whole table is indexed.  Prices
belong to the distance from then on, for vectors and queries alike, so lists stay near one size; a list that is still beyond
``CAPACITY`` times the mean gives up replicas, then gives its excess to the next list of each vector.  A vector enters its nearest list and, if it lies
near a boundary, up to ``REPLICAS`` lists that are almost as near and not shadowed by one already taken.  A query leaves out the
bands whose norms can't reach the k-th best of some ``PROBES`` long vectors.  In the others it walks an in-memory neighbour graph
of the centroids best first and takes the lists whose distance is within ``QUERY_RATIO`` of the nearest; all bands together must
hold enough vectors.

Scale: centroids are bounded (``MAX_LISTS``), so the index that is sent to tasks is a few MB at any size.  A list longer
than ``LIST_ROWS`` is split by a hash of the id (a hot vector's copies too).  Lists are packed into shards of bounded
size; a query goes to the shards of its lists only, a shard is sent again only for every further ``QUERY_BLOCK`` queries, and
each meeting gives at most ``k`` rows a query.  Beyond ``MAX_LISTS * LIST_TARGET`` vectors lists grow with the table.

Defined results: vectors that are null, zero, of another length than most candidates, or hold null or non-finite components
take no part, nor do null ids; rows with a query's own id are no candidates; a repeated id counts once, by its best score;
ties go to the smaller id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import stored, unstore

SAMPLE = 20_000
LIST_TARGET = 256
MAX_LISTS = 2048
LIST_ROWS = 4096
SHARD_ROWS = 65_536
QUERY_BLOCK = 20_000
REPLICAS = 3
#: Distance ratios: of a replica's list to the nearest, and of a searched list to the nearest.
REPLICA_RATIO = 1.08
QUERY_RATIO = 1.15
#: A list is shadowed by a taken one whose centroid is nearer than this share of the distance to the vector.
SHADOW = 0.3
NEIGHBOURS = 24
TIE = 1e-9
#: Bands of norm; lists beyond so many times the mean size give rows away.
BANDS = 16
CAPACITY = 1.3
#: Standard deviations by which members of a list may lie nearer to a query than the list's spread says.
DEVIATIONS = 2.3
#: Lists of a band within the ratio that a query takes in any case.
NEAREST = 12
#: Long vectors of the sample by which queries leave out bands.
PROBES = 2048


def finite(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows whose vectors are vectors."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # others lose nothing as doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def valid(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both that take part: those of the length that is commonest among the vectors."""
    rows, asking = finite(vectors), finite(queries)
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    mine = F.size("embedding") == (dim["dim"] if dim else 0)
    return rows.where(mine), asking.where(mine)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def balanced_kmeans(points: np.ndarray, k: int, rounds: int = 15, settling: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and prices such that lists by squared distance plus price are near one size."""
    rng = np.random.default_rng(11)
    centre = points[rng.choice(len(points), k, replace=False)].copy()
    price, even = np.zeros(k), len(points) / k
    scale = np.var(points, 0).sum()
    for i in range(rounds + settling):
        own = ((centre**2).sum(1) - 2 * points @ centre.T + price).argmin(1)
        n = np.bincount(own, minlength=k)
        if i >= rounds and n.max() <= 1.2 * even:
            break
        price += (0.05 if i < rounds else 0.1 / (1 + 0.2 * (i - rounds))) * scale * (n / even - 1).clip(-1, 1)
        price -= price.min()
        if i < rounds:  # then only the prices settle
            sums = np.zeros_like(centre)
            np.add.at(sums, own, points)
            centre[n > 0] = sums[n > 0] / n[n > 0, None]
            if i < rounds - 3:  # the emptiest lists move into the fullest
                order = np.argsort(n, kind="stable")
                for poor, rich in zip(order, order[::-1]):
                    if n[poor] > 0.4 * even or n[rich] < 1.6 * even:
                        break
                    centre[poor], price[poor] = points[rng.choice(np.flatnonzero(own == rich))], price[rich]
    return centre, price


class Band:
    """Centroids, prices and neighbour graph of the lists of one band; lists are numbered from ``first``."""

    def __init__(self, centre: np.ndarray, price: np.ndarray, longest: float, first: int, spread: float = 0.0):
        self.centre, self.price, self.longest, self.first, self.spread = centre, price, longest, first, spread
        d = (centre**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * centre @ centre.T
        near = np.argsort(d, 1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        edges = {(a, int(b)) for a, row in enumerate(near) for b in row} | {(a, a + 1) for a in range(len(centre) - 1)}  # the chain connects all
        links: list[set[int]] = [set() for _ in centre]
        for a, b in edges:
            links[a].add(b)
            links[b].add(a)
        self.near = [np.array(sorted(x), np.int64) for x in links]
        self.entry = int((((centre - centre.mean(0)) ** 2).sum(1) + price).argmin())

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        missing = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.c_[x, missing]

    def lists_of(self, x: np.ndarray) -> list[tuple[list[int], int]]:
        """(lists of each vector: the nearest, and those almost as near that no taken list shadows; the next list)."""
        p = self.lifted(x, False)
        d = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (self.centre**2).sum(1) - 2 * p @ self.centre.T + self.price, 0))
        many = min(len(self.centre), 4 * REPLICAS)
        at = np.argpartition(d, many - 1, 1)[:, :many]
        out = []
        for i, row in enumerate(at):
            row = row[np.argsort(d[i, row], kind="stable")]
            taken: list[int] = []
            for c in row[d[i, row] <= REPLICA_RATIO * d[i, row[0]] + 1e-12].tolist():
                if all(((self.centre[c] - self.centre[t]) ** 2).sum() > (SHADOW * d[i, c]) ** 2 for t in taken):
                    taken.append(c)
                    if len(taken) == REPLICAS:
                        break
            spare = next((c for c in row.tolist() if c not in taken), taken[0])
            out.append(([c + self.first for c in taken], spare + self.first))
        return out

    def reach(self, norm: float, sure: float) -> float:
        """Squared distance from a query within which centroids have members with an inner product of ``sure``: members lie
        about ``spread`` around their centroid, of which ``DEVIATIONS`` of the standard deviation may point to the query."""
        if not np.isfinite(sure):
            return np.inf
        need = max(self.longest**2 + norm**2 - 2 * sure, 0.0)  # of a vector with that inner product
        lean = DEVIATIONS * np.sqrt(self.spread / (self.centre.shape[1] - 1))
        return (lean + np.sqrt(max(lean**2 + need - self.spread, 0.0))) ** 2

    def search(self, q: np.ndarray) -> list[tuple[float, int]]:
        """(distance, list) of the lists met for a lifted query by a best-first walk over the graph, nearest first."""
        dist = lambda c: np.sqrt(((self.centre[c] - q) ** 2).sum(-1) + self.price[c])
        seen = np.zeros(len(self.centre), bool)
        seen[self.entry] = True
        best = float(dist(self.entry))
        open_, met = [(best, self.entry)], []
        while open_:
            d, c = heapq.heappop(open_)
            if d > 1.15 * QUERY_RATIO * best and len(met) > NEIGHBOURS:
                break
            met.append((d, c + self.first))
            fresh = self.near[c][~seen[self.near[c]]]
            seen[fresh] = True
            for x, n in zip(dist(fresh).tolist(), fresh.tolist()):
                best = min(best, x)
                heapq.heappush(open_, (x, n))
        return sorted(met)


class Index:
    """Bounded part of the index: the bands, long vectors of the sample, sizes and shards of lists."""

    def __init__(self, bands: list[Band], longest: float, probe_ids: np.ndarray, probes: np.ndarray):
        self.bands, self.longest, self.probe_ids, self.probes = bands, longest, probe_ids, probes
        self.size = np.zeros(sum(len(b.centre) for b in bands), np.int64)
        self.pieces: dict[int, list[int]] = {}

    def band_of(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum(1))
        return np.clip(np.floor(2 * np.log2(self.longest / norm)), 0, BANDS - 1).astype(int)

    def lists_of(self, x: np.ndarray) -> list[tuple[list[int], int]]:
        band, out = self.band_of(x), [None] * len(x)
        for b in np.unique(band).tolist():
            at = np.flatnonzero(band == b)
            for i, found in zip(at.tolist(), self.bands[b].lists_of(x[at])):
                out[i] = found
        return out

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[int]:
        """Lists for a query: in each band that can hold one of its ``k`` nearest, those near the band's nearest list."""
        seen = np.sort((self.probes @ q)[self.probe_ids != query_id])
        sure = seen[-k] if len(seen) >= k else -np.inf  # the k-th best of all is no less
        norm = float(np.sqrt((q**2).sum()))
        out, held, left = [], 0, []
        for b, band in enumerate(self.bands):
            if b and band.longest * norm < sure - TIE * max(1.0, abs(sure)):
                break  # nor can shorter vectors
            met, far = band.search(band.lifted(q[None], True)[0]), band.reach(norm, sure)
            for i, (d, c) in enumerate(met):
                if d <= QUERY_RATIO * met[0][0] and (i < NEAREST or d * d - band.price[c - band.first] <= far):
                    out.append(c)
                    held += self.size[c]
                else:
                    left.append((d, c))
        for _, c in sorted(left):
            if held >= (k + 1) * REPLICAS:
                break
            out.append(c)
            held += self.size[c]
        return out if held >= (k + 1) * REPLICAS else list(range(len(self.size)))

    def pack(self, sizes: dict[int, int], least_shards: int) -> int:
        """Cut long lists and deal the pieces to shards, largest first; returns the number of shards."""
        pieces = []
        for c, n in sizes.items():
            self.size[c] = n
            cut = max(1, -(-n // LIST_ROWS))
            pieces += [(n // cut, c, s) for s in range(cut)]
        shards = max(1, least_shards, -(-sum(sizes.values()) // SHARD_ROWS))
        load = [(0, s) for s in range(shards)]
        at: dict[tuple[int, int], int] = {}
        for n, c, s in sorted(pieces, reverse=True):
            held, shard = heapq.heappop(load)
            at[c, s] = shard
            heapq.heappush(load, (held + n, shard))
        self.pieces = {c: [at[c, s] for s in range(max(1, -(-n // LIST_ROWS)))] for c, n in sizes.items()}
        return shards


def fit(rows: DataFrame, list_target: int = LIST_TARGET) -> Index:
    """Fit centroids on a bounded sample; ``rows``: a stored table."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")).first()
    share = min(1.0, SAMPLE / max(1, stats["n"]))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    x, ids = matrix(picked.column("embedding").combine_chunks()), picked.column("vec_id").to_numpy()
    longest = float(np.sqrt(stats["sq"])) * (1 + 1e-12)
    norm = (x**2).sum(1)
    once = np.unique(ids, return_index=True)[1]
    probes = once[np.argsort(-norm[once], kind="stable")[:PROBES]]
    index = Index([], longest, ids[probes], x[probes])
    band, first = index.band_of(x), 0
    for b in range(BANDS):
        mine = Band(np.zeros((1, x.shape[1] + 1)), np.zeros(1), longest / 2 ** (b / 2), first)
        points = np.unique(mine.lifted(x[band == b], False), axis=0)
        if len(points):
            expected = (band == b).mean() * stats["n"]
            most = max(1, int(MAX_LISTS * len(points) / max(1, len(x))))
            k = int(min(most, max(1, round(expected / list_target)), max(1, len(points) // 8)))
            centre, price = balanced_kmeans(points, k)
            own = ((centre**2).sum(1) - 2 * points @ centre.T + price).argmin(1)
            mine = Band(centre, price, mine.longest, first, float(((points - centre[own]) ** 2).sum(1).mean()))
        index.bands.append(mine)
        first += len(mine.centre)
    return Index(index.bands, longest, index.probe_ids, index.probes)


def _indexed(index: Index):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lists = index.lists_of(matrix(part.column(1)))
                take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists]))
                cols = [np.array([c for x, _ in lists for c in x], np.int32), np.array([-1 if i else s for x, s in lists for i in range(len(x))], np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), part.column(0).take(take), part.column(1).take(take)], names=["list", "next", "vec_id", "embedding"])

    return run


def hashed(ids: np.ndarray) -> np.ndarray:
    """64 mixed bits of ids."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shares_kept(own: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each list's own vectors and of its replicas that it keeps, from how many of both it has."""
    total = own + more
    room = CAPACITY * total.sum() / max(1, (total > 0).sum())
    return np.minimum(1.0, room / np.maximum(own, 1)), np.clip((room - own) / np.maximum(more, 1), 0.0, 1.0)


def overflowed(keep: tuple[np.ndarray, np.ndarray], lists: np.ndarray, spare: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The list of each posting.  Of lists beyond their capacity, replicas (``spare`` -1) go first, to no list (-1), then own
    vectors to their next list."""
    share = np.where(spare < 0, keep[1][lists], keep[0][lists])
    return np.where((hashed(ids) >> np.uint64(40)).astype(float) / (1 << 24) >= share, spare, lists)


def _moved(keep: tuple[np.ndarray, np.ndarray]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = overflowed(keep, b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy())
            held = pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(2), b.column(3)], names=["list", "vec_id", "embedding"])
            yield held.filter(pa.array(lists >= 0))

    return run


def _sharded(index: Index):
    """Posting rows with the shard of their list's piece."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shard = [index.pieces[c][(v * 0x9E3779B1 >> 7) % len(index.pieces[c])] for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", "list", "vec_id", "embedding"])

    return run


def _routed(index: Index, k: int):
    """A query row for each shard that holds a piece of its lists."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for v, q, e in zip(b.column(0).to_pylist(), matrix(b.column(1)), b.column(1).to_pylist()):
                by_shard: dict[int, set[int]] = {}
                for c in index.search(v, q, k):
                    for shard in index.pieces.get(c, ()):
                        by_shard.setdefault(shard, set()).add(c)
                rows += [(shard, v, e, sorted(lists)) for shard, lists in by_shard.items()]
            if rows:
                types = (pa.int32(), pa.int64(), b.schema.field(1).type, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["shard", "query_id", "query", "lists"])

    return run


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = (matrix(t.column(c).combine_chunks()) for t, c in ((vectors, "embedding"), (queries, "query")))
        ids, own = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        of_list = vectors.column("list").to_numpy()
        order = np.argsort(of_list, kind="stable")
        lists, start = np.unique(of_list[order], return_index=True)
        members = dict(zip(lists.tolist(), np.split(order, start[1:])))
        asked: dict[int, list[int]] = {}
        for i, ls in enumerate(queries.column("lists").to_pylist()):
            for c in ls:
                asked.setdefault(c, []).append(i)
        found: tuple[list, list, list] = ([], [], [])
        floor = np.full(len(q), -np.inf)  # the k-th best score that a query has in one list so far
        for c, who in asked.items():
            if c not in members:
                continue
            m, who = members[c], np.array(who)
            for at in range(0, len(who), 512):
                w = who[at : at + 512]
                s = q[w] @ x[m].T
                s[ids[m][None] == own[w][:, None]] = -np.inf
                if len(m) > k and len(np.unique(ids[m])) == len(m):
                    floor[w] = np.maximum(floor[w], np.partition(s, len(m) - k, 1)[:, len(m) - k])
                i, j = np.nonzero((s >= floor[w][:, None] - TIE) & np.isfinite(s))
                found[0].append(w[i])
                found[1].append(m[j])
        if not found[0]:
            return schema.empty_table()
        i, j = np.concatenate(found[0]), np.concatenate(found[1])
        if not len(i):
            return schema.empty_table()
        score = np.concatenate([(q[i[at : at + 50_000]] * x[j[at : at + 50_000]]).sum(1) for at in range(0, len(i), 50_000)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        key = np.unique(np.c_[i, ids[j]], axis=0, return_index=True)[1]  # a vector in several lists counts once
        keep = np.sort(key)
        i, j, score = i[keep], j[keep], score[keep]
        begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
        top = rank < k
        return pa.table([pa.array(own[i[top]]), pa.array(ids[j[top]]), pa.array(score[top])], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, list_target: int = LIST_TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every valid query (vec_id, embedding)."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, asking = (stored(x, name) for x, name in zip(valid(vectors, queries), ("vectors", "queries")))
    if rows.isEmpty() or asking.isEmpty():
        return spark.createDataFrame([], out)
    index, kind = fit(rows, list_target), dict(rows.dtypes)["embedding"]
    of_list = lambda t: {r["list"]: r["count"] for r in t.groupBy("list").count().collect()}  # noqa: E731  one row a list, at most MAX_LISTS and a band each
    placed = stored(rows.mapInArrow(_indexed(index), f"list int, next int, vec_id long, embedding {kind}"), "placed")
    held = np.zeros((2, len(index.size)), np.int64)
    for which, part in enumerate(("next >= 0", "next < 0")):
        for c, n in of_list(placed.where(part)).items():
            held[which, c] = n
    postings = stored(placed.mapInArrow(_moved(shares_kept(*held)), f"list int, vec_id long, embedding {kind}"), "postings")
    unstore(placed)
    shards = index.pack(of_list(postings), 2 * spark.sparkContext.defaultParallelism)
    left = postings.mapInArrow(_sharded(index), f"shard int, list int, vec_id long, embedding {kind}")
    right = stored(asking.repartition(shards).mapInArrow(_routed(index, k), f"shard int, query_id long, query {dict(asking.dtypes)['embedding']}, lists array<int>"), "routed")
    # a shard that very many queries ask for is searched in several blocks of them; others are sent once
    blocks = right.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    left = left.join(stored(blocks, "query-blocks"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = right.join(stored(blocks, "query-blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
