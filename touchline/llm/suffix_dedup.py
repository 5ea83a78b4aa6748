"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if some ``MIN_MATCH``-byte string covering it also starts earlier (smaller id, or earlier in its document).
Every such string is owned by one *anchor*: the ``GRAM``-byte gram in it of least hash, the last one on ties.  Equal
strings have equal anchors at equal offsets, so only anchors whose gram occurs twice matter.  They are dealt by gram into
shards with the bytes around them.  A shard takes its anchored suffixes in document order, in batches.  A batch gets a
suffix array with the longest common prefixes of its neighbours.  It is merge-scanned against itself and the arrays of all
levels: each suffix finds its place in the other array and walks from there both ways as long as the common prefix is long
enough for a match; what it meets is extended to the left to the strings it proves repeated.  Then the batch enters the
index, where levels of equal size merge, so a shard has logarithmically many.  A suffix that would walk too far leaves its
gram to a sort of its strings, offset by offset.

``extend_index`` keeps such a family on disk: levels are written tables of texts and anchors; a new batch is scanned against
all levels by the same code, and levels of equal size merge.

Whole copies of an earlier text are settled before, on digests, so hot groups of copies send one document.

Scale: one pass hashes the texts; one shuffle of (gram hash, place) rows, about one for 30 bytes, finds repeated grams; a
join by document cuts out their surroundings, and one shuffle deals those into shards of bounded size.  Hot grams are split
before they move: a task sends one row of a gram it has seen twice and spreads the others, and one row of equal
surroundings, the later ones being settled there by their bytes.  A gram that occurs more than ``HEAVY`` times becomes
longer grams: strings that have their anchor at nearly the same offset share more bytes than the gram, so runs are cut into
pieces of ``WIDTHS`` offsets and the bytes that all strings of a piece have to share are its gram.  Pieces whose gram is still
heavy are cut again, down to single strings, of which a task sends one.  All pieces enter the suffix arrays of a shard.

Equality is by bytes, but for whole copies, which are known by their SHA-256.

Defined results: null text is empty; a null id sorts first; rows equal in id and text are one document and lose the same
bytes; different texts with one id are ordered by a hash of the text; empty tables give empty results; extra columns pass,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import as_bytes, release, remove, renamed, stored, subfolders, unstore

MIN_MATCH = 100
GRAM = 40
#: Bytes hashed at once; positions within fit the low bits of a key.
BLOCK = 1 << 21
POSITION_BITS = 24
#: Text bytes for each partition of the two shuffles.
PARTITION_BYTES = 12 << 20
#: Suffixes in a batch of a shard's index.
BATCH = 4096
#: Neighbours that a suffix passes in an array before the strings of its gram are sorted instead of paired.
CROWD = 24
#: Occurrences of a gram beyond which its runs are cut into pieces with longer grams.
HEAVY = 1_000
#: Offsets of a piece, cut after cut.
WIDTHS = (16, 4, 1)
#: Surroundings that a task remembers.
SEEN = 400_000
NO_ID = -(1 << 63)

_POS = np.uint64((1 << POSITION_BITS) - 1)
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & ((1 << 64) - 1)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, BLOCK + 2 * MIN_MATCH), _powers(_INV, BLOCK + 2 * MIN_MATCH)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every place."""
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[raw] * _UP[: len(raw)], out=total[1:])
    x = (total[gram:] - total[:-gram]) * _DOWN[: len(raw) - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def anchors(docs: list[bytes], least: int = MIN_MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, document number, first string, anchor offset in it, further strings) of every run of strings with one anchor.

    ``docs`` together hold at most ``BLOCK`` bytes.
    """
    raw = np.frombuffer(b"".join(docs), np.uint8)
    empty = tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(raw) < least:
        return empty
    h = gram_hashes(raw, gram)
    key = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
    anchor = (_POS - (sliding_min(key, least - gram + 1) & _POS)).astype(np.int64)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(docs)), lengths)[: len(anchor)]
    place = np.arange(len(anchor))
    valid = place + least <= (begin + lengths)[doc]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])] & valid
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    run = np.add.reduceat(valid.astype(np.int64), first) - 1
    return h[anchor[first]], doc[first], first - begin[doc[first]], anchor[first] - first, run


def _anchored(least: int):
    def blocks(keys: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes], list[int]]]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for key, text in zip(keys, texts):
            for at in range(0, max(1, len(text) - least + 1), BLOCK // 2):
                piece = text[at : at + BLOCK // 2 + least - 1]
                if size + len(piece) > BLOCK:
                    yield held
                    held, size = ([], [], []), 0
                for kept, x in zip(held, (key, piece, at)):
                    kept.append(x)
                size += len(piece)
        if size:
            yield held

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.empty(0, np.uint64)  # grams that this task knows to be repeated
        for b in it:
            for keys, texts, starts in blocks(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), as_bytes(b.column(2))):
                h, doc, first, offset, more = anchors(texts, least)
                d, th = (np.array([k[i] for k in keys], np.int64)[doc] for i in (0, 1))
                place = ((first + np.array(starts, np.int64)[doc]) << 16) | (offset << 8) | more
                gram, back, times = np.unique(h, return_inverse=True, return_counts=True)
                again = times > 1
                fresh = gram[again & ~np.isin(gram, twice)]
                role = np.where((again | np.isin(gram, twice))[back], KNOWN, ASKING).astype(np.int8)
                twice = np.union1d(twice, fresh)
                none = np.zeros(len(fresh), np.int64)
                cols = [np.r_[h, fresh].view(np.int64), np.r_[d, none], np.r_[th, none], np.r_[place, none], np.r_[role, np.full(len(fresh), FLAG, np.int8)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "d", "th", "place", "role"])

    return run


#: Roles of an anchor row: is its gram repeated?; it is; a row for all those of a task that are.
ASKING, KNOWN, FLAG = 0, 1, 2
ANCHORS = "h long, d long, th long, place long, role byte"
PLACES = "h long, d long, th long, place long"


def spread(df: DataFrame, n: int, alone: str) -> DataFrame:
    """``df`` dealt by gram into ``n`` partitions; rows for which ``alone`` holds need no company and go anywhere."""
    return df.repartition(n, F.when(F.expr(alone), F.xxhash64("h", "d", "th", "place")).otherwise(F.col("h")))


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose gram hash occurs at least twice in the partition, or is known to."""
    parts = [[b.column(i).to_numpy() for i in range(5)] for b in it]
    if not parts:
        return
    *cols, role = [np.concatenate(c) for c in zip(*parts)]
    asks = role != KNOWN
    keep = ~asks
    order = np.flatnonzero(asks)[np.argsort(cols[0][asks], kind="stable")]
    same = np.flatnonzero(cols[0][order][1:] == cols[0][order][:-1])
    keep[order[same]] = keep[order[same + 1]] = True
    keep &= role != FLAG
    for at in range(0, len(keep), 500_000):
        k = np.flatnonzero(keep[at : at + 500_000]) + at
        yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in cols], names=["h", "d", "th", "place"])


AROUND = "h long, d long, th long, place long, bytes binary"
SPAN = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


class _First(set):
    """Surroundings that a task has met; emptied at ``SEEN``, which only makes it say again that something is new."""

    def new(self, around: bytes, offset: int) -> bool:
        key = around + bytes([offset])
        if key in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(key)
        return True


def _surroundings(least: int):
    """The bytes of all strings of each marked run, cut from its document; null if this task has met them before.

    Documents come in order, so what was met before starts earlier.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _First()
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = []
                for d, th, text, hs, places in zip(*(part.column(i).to_pylist() for i in range(2)), as_bytes(part.column(2)), *(part.column(i).to_pylist() for i in (3, 4))):
                    for place, h in sorted(zip(places, hs)):
                        first = place >> 16
                        around = text[first : first + (place & 255) + least]
                        rows.append((h, d, th, place, around if met.new(around, (place >> 8) & 255) else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "d", "th", "place", "bytes"])

    return run


def pieces(h: int, place: int, around: bytes, least: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(gram, place, bytes) of the pieces of a run: its strings by offset of the anchor, ``width`` offsets together."""
    first, offset, more = place >> 16, (place >> 8) & 255, place & 255
    for low in range((offset - more) // width * width, offset + 1, width):
        least_offset, most_offset = max(low, offset - more), min(low + width - 1, offset)
        begin, n = offset - most_offset, most_offset - least_offset
        shared = around[offset - low : offset + max(least - low - width + 1, 1)]  # in all strings of these offsets
        longer = xxhash.xxh3_64_intdigest(shared, seed=(h ^ low) & 0xFFFFFFFF)
        yield longer - (1 << 63), (first + begin) << 16 | most_offset << 8 | n, around[begin : begin + n + least]


def _pieces(least: int, width: int):
    """Rows ``AROUND`` of the pieces of runs that come in order; null bytes for those this task has met before."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _First()
        for b in it:
            for at in range(0, b.num_rows, 2000):
                rows = []
                for h, d, th, place, around in zip(*(c.to_pylist() for c in b.slice(at, 2000).columns)):
                    for longer, where, part in pieces(h, place, around, least, width):
                        rows.append((longer, d, th, where, part if met.new(part, (where >> 8) & 255) else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "d", "th", "place", "bytes"])

    return run


def cut_runs(around: DataFrame, least: int) -> DataFrame:
    """Rows ``AROUND`` of the pieces of runs of heavy grams; pieces whose gram occurs once are left out."""
    out = []
    for width in WIDTHS:
        open_rows = around.where("bytes IS NOT NULL").sortWithinPartitions("d", "th", "place")
        cut_now = stored(open_rows.mapInArrow(_pieces(least, width), AROUND), "pieces")
        out += [around.where("bytes IS NULL"), cut_now.where("bytes IS NULL")] if width == WIDTHS[0] else [cut_now.where("bytes IS NULL")]
        fresh = cut_now.where("bytes IS NOT NULL")
        counts = stored(fresh.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "piece-grams")
        most = HEAVY if width != WIDTHS[-1] else None
        out.append(fresh.join(counts.where(F.col("n") <= most) if most else counts, "h", "left_semi"))
        if not most or counts.where(F.col("n") > most).isEmpty():
            break
        around = fresh.join(counts.where(F.col("n") > most), "h", "left_semi")
    return _union(around.sparkSession, out)


class Suffixes:
    """Anchored suffixes of a shard: bytes before each anchor (reversed) and from it on, padded."""

    def __init__(self, h: np.ndarray, offset: np.ndarray, more: np.ndarray, context: list[bytes], least: int, gram: int):
        self.h, self.offset, self.more, self.least = h, offset, more, least
        span = least - gram  # a string starts at most so far before its anchor
        n = len(h)
        wide = np.zeros((n, least + 2 * span), np.uint8)  # anchors aligned in column span
        for i, c in enumerate(context):
            a = span - int(offset[i])
            wide[i, a : a + len(c)] = np.frombuffer(c, np.uint8)
        self.left = np.ascontiguousarray(wide[:, :span][:, ::-1])
        self.right = np.ascontiguousarray(wide[:, span : span + least])
        self.n_right = np.minimum(more + least - offset, least)

    def keys(self, of: np.ndarray) -> np.ndarray:
        """Gram and the bytes from the anchor on, as fixed-width strings that compare like suffixes."""
        gram = (self.h[of].view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(len(of), 8)
        wide = np.concatenate([gram, self.right[of], np.ones((len(of), 1), np.uint8)], 1)  # the closing byte keeps zeros at the end
        return np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel()

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes ``i`` and ``j``; -1 if their grams differ."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            unlike = self.right[a] != self.right[b]
            out[at : at + 100_000] = np.where(self.h[a] != self.h[b], -1, np.where(unlike.any(1), unlike.argmax(1), unlike.shape[1]))
        return out

    def repeated(self, late: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, lowest, highest offset) of the strings in ``late`` that ``early`` proves repeated."""
        out = []
        for at in range(0, len(late), 100_000):
            i, j = late[at : at + 100_000], early[at : at + 100_000]
            reach = lambda m, n: np.minimum(np.where((x := m[i] != m[j]).any(1), x.argmax(1), m.shape[1]), n)
            left = reach(self.left, np.minimum(self.offset[i], self.offset[j]))
            right = reach(self.right, np.minimum(self.n_right[i], self.n_right[j]))
            high = left
            low = np.maximum(self.least - right, np.maximum(self.offset[i] - self.more[i], self.offset[j] - self.more[j]))
            low = np.maximum(low, 0)
            ok = low <= high
            out.append((i[ok], low[ok], high[ok]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


class Level:
    """A suffix array (order of gram, of the bytes from the anchor on, then of age) with its neighbours' common prefixes."""

    def __init__(self, suffixes: Suffixes, of: np.ndarray, keys: np.ndarray | None = None):
        keys = suffixes.keys(of) if keys is None else keys
        order = np.argsort(keys, kind="stable")  # equal suffixes stay in the order of age
        self.s, self.array, self.keys = suffixes, of[order], keys[order]
        self.lcp = suffixes.common(self.array[:-1], self.array[1:])

    def merged(self, other: Level) -> Level:
        return Level(self.s, np.concatenate([self.array, other.array]), np.concatenate([self.keys, other.keys]))


class LogIndex:
    """Levels of suffix arrays; a level is at least twice as large as the next."""

    def __init__(self, suffixes: Suffixes):
        self.s, self.levels, self.crowded = suffixes, [], set()

    def _walk(self, late: np.ndarray, level: Level, at: np.ndarray, reach: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Meetings of ``late`` with ``level`` from the entries ``at`` on, while the common prefix ``reach`` allows a match."""
        least = self.s.least - self.s.offset[late]
        for _ in range(CROWD):
            on = reach >= least
            late, at, reach, least = late[on], at[on], reach[on], least[on]
            if not len(late):
                return
            yield late, level.array[at]
            nxt = at + step
            inside = (nxt >= 0) & (nxt < len(level.array))
            late, least, link = late[inside], least[inside], np.minimum(at, nxt)[inside]
            reach, at = np.minimum(reach[inside], level.lcp[link]), nxt[inside]
        self.crowded.update(self.s.h[late[reach >= least]].tolist())

    def _scan(self, new: Level, level: Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge scan of a batch against a level, or against itself: (suffix, other suffix) with a long common prefix."""
        late = new.array
        if new is level:
            here = np.arange(len(late))
            if len(late) > 1:
                yield from self._walk(late[1:], level, here[:-1], level.lcp, -1)
                yield from self._walk(late[:-1], level, here[1:], level.lcp, 1)
            return
        spot = np.searchsorted(level.keys, new.keys)
        for at, step in ((spot - 1, -1), (spot, 1)):
            inside = (at >= 0) & (at < len(level.array))
            yield from self._walk(late[inside], level, at[inside], self.s.common(late[inside], level.array[at[inside]]), step)

    def add(self, new: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scan a batch (its suffix numbers) against itself and all levels, then take it in."""
        level = Level(self.s, new)
        found = []
        for other in (level, *self.levels):
            for late, early in self._scan(level, other):
                mine = early < late
                found.append(self.s.repeated(late[mine], early[mine]))
        while self.levels and len(self.levels[-1].array) <= 2 * len(level.array):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return found

    def settle_crowded(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Strings of crowded grams, offset by offset: all but the earliest of equal ones are repeated."""
        found, s = [], self.s
        if not self.crowded:
            return found
        every = np.sort(np.concatenate([x.array for x in self.levels]))
        every = every[np.isin(s.h[every], np.array(sorted(self.crowded), s.h.dtype))]
        for d in range(s.left.shape[1] + 1):
            at = every[(s.offset[every] >= d) & (s.offset[every] - s.more[every] <= d)]
            if len(at) > 1:
                rows = np.concatenate([s.left[at, :d][:, ::-1], s.right[at, : s.least - d]], 1)
                text = np.ascontiguousarray(rows).view(f"S{s.least}").ravel()
                order = np.lexsort((at, text))
                same = np.r_[False, text[order][1:] == text[order][:-1]]
                gone = at[order[same]]
                found.append((gone, np.full(len(gone), d), np.full(len(gone), d)))
        return found


def _shard(least: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(it)
        if not sum(b.num_rows for b in parts):
            return
        t = pa.Table.from_batches(parts)
        h, d, th, place = (t.column(i).to_numpy() for i in range(4))
        met = t.column(4).is_null().to_numpy()
        if met.any():  # settled before the shuffle: all strings of the run are repeated
            yield from _span_batches(d[met], th[met], place[met] >> 16, (place[met] >> 16) + (place[met] & 255) + least)
            h, d, th, place = (c[~met] for c in (h, d, th, place))
            t = t.filter(pa.array(~met))
            if not len(h):
                return
        order = np.lexsort((place, th, d))
        once = np.r_[True, (d[order][1:] != d[order][:-1]) | (th[order][1:] != th[order][:-1]) | (place[order][1:] != place[order][:-1])]
        order = order[once]  # rows equal in id and text are one document
        h, d, th, place = h[order], d[order], th[order], place[order]
        first, offset, more = place >> 16, (place >> 8) & 255, place & 255
        context = t.column(4).combine_chunks().take(pa.array(order)).to_pylist()
        del t, parts
        known: dict[tuple[int, bytes], int] = {}
        fresh = np.zeros(len(h), bool)
        for i, c in enumerate(zip(offset.tolist(), context)):
            fresh[i] = known.setdefault(c, i) == i
        del known
        whole = np.flatnonzero(~fresh)  # surroundings seen before: all strings of the run are repeated
        found = [(whole, (offset - more)[whole], offset[whole])]
        left = np.flatnonzero(fresh)
        _, back, times = np.unique(h[left], return_inverse=True, return_counts=True)
        left = left[times[back] > 1]
        if len(left):
            s = Suffixes(h[left], offset[left], more[left], [context[i] for i in left.tolist()], least, gram)
            index = LogIndex(s)
            got = [x for at in range(0, len(left), BATCH) for x in index.add(np.arange(at, min(at + BATCH, len(left))))]
            found += [(left[i], low, high) for i, low, high in got + index.settle_crowded()]
        i, low, high = (np.concatenate(c) for c in zip(*found))
        anchor = first[i] + offset[i]
        yield from _span_batches(d[i], th[i], anchor - high, anchor - low + least)

    return run


def _span_batches(*cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 500_000]) for c in cols], schema=SPAN)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside merged spans."""
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


#: Names of the columns that join a document's rows; extra columns keep theirs.
OWN_D, OWN_TH, OWN_COPY, OWN_SPANS, OWN_TEXT = (f"__suffix_{x}" for x in ("d", "th", "copy", "spans", "text"))


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with an id (null first), a text hash where the id occurs in several rows (else 0) and a mark of copies; all bytes."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    ids = stored(ids, "text-ids")
    shared = stored(ids.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "shared-ids")
    classes = ids.groupBy("digest").agg(F.min("d").alias("head"), F.max("d").alias("tail")).where("head <> tail AND digest IS NOT NULL")
    copies = stored(ids.join(classes, "digest").where("d <> head").select("d", "digest").distinct(), "copies")
    # a copy is known by its id; where an id has several texts, by the digest too
    plain = copies.join(shared, "d", "left_anti").select(F.col("d").alias("__suffix_plain"))
    mixed = copies.join(shared, "d", "left_semi").select(F.col("d").alias("__suffix_mixed"), F.col("digest").alias("__suffix_digest"))
    several = shared.select(F.col("d").alias("__suffix_several"))
    out = docs.withColumn(OWN_D, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    out = out.join(several, F.col(OWN_D) == F.col("__suffix_several"), "left").join(stored(plain, "copies"), F.col(OWN_D) == F.col("__suffix_plain"), "left")
    out = out.withColumn(OWN_TH, F.when(F.col("__suffix_several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    digest = F.when(F.col("__suffix_several").isNotNull(), F.sha2(F.col("text").cast("binary"), 256))
    out = out.join(stored(mixed, "copies"), (F.col(OWN_D) == F.col("__suffix_mixed")) & (digest == F.col("__suffix_digest")), "left")
    out = out.withColumn(OWN_COPY, F.col("__suffix_plain").isNotNull() | F.col("__suffix_mixed").isNotNull())
    return out.drop("__suffix_several", "__suffix_plain", "__suffix_mixed", "__suffix_digest"), ids.agg(F.sum("size")).first()[0] or 0


def anchor_rows(texts: DataFrame, least: int) -> DataFrame:
    """Rows ``ANCHORS`` of all runs of strings of ``texts(d, th, text)``."""
    return texts.select("d", "th", "text").mapInArrow(_anchored(least), ANCHORS)


def repeated_spans(texts: DataFrame, total_bytes: int, least: int = MIN_MATCH, older: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``d, th, spans`` of the repeated strings of ``texts(d, th, text)``, texts that are not whole copies.

    ``older``: texts and anchors of an index, all of smaller ids; they make strings repeated but get no spans.
    """
    spark = texts.sparkSession
    gram = max(1, least * GRAM // MIN_MATCH)
    n = max(spark.sparkContext.defaultParallelism, -(-int(total_bytes) // PARTITION_BYTES))
    runs = anchor_rows(texts, least)
    if older is not None:
        own = stored(runs, "anchors")
        met = older[1].join(own.where(f"role <> {FLAG}").select("h").distinct(), "h", "left_semi")
        runs = own.unionByName(met.withColumn("role", F.lit(ASKING).cast("byte")))
    marked = stored(spread(runs, n, f"role = {KNOWN}").mapInArrow(_repeated, PLACES), "repeated-grams")
    release(spark)
    heavy = stored(marked.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("h"), "heavy-grams")
    every = texts if older is None else older[0].unionByName(texts)

    def cut_out(grams: DataFrame) -> DataFrame:
        per_doc = grams.groupBy("d", "th").agg(F.collect_set(F.struct("h", "place")).alias("runs")).select("d", "th", F.col("runs.h").alias("hs"), F.col("runs.place").alias("places"))
        return every.join(per_doc.hint("merge"), ["d", "th"]).select("d", "th", "text", "hs", "places").sortWithinPartitions("d", "th").mapInArrow(_surroundings(least), AROUND)

    around = cut_out(marked.join(heavy, "h", "left_anti"))
    if not heavy.isEmpty():
        around = around.unionByName(cut_runs(stored(cut_out(marked.join(heavy, "h", "left_semi")), "heavy-runs"), least))
    spans = spread(around, n, "bytes IS NULL").mapInArrow(_shard(least, gram), "d long, th long, s long, e long")
    if older is not None:
        spans = spans.join(texts.select("d", "th"), ["d", "th"], "left_semi")
    spans = stored(spans.groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    unstore(marked)
    release(spark)
    return spans


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is left is text."""
    inner = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for s, e in spans:
        while inner(s):
            s += 1
        while inner(e):
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _finished(least: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            n, gone, n_spans, digest, kept = [], [], [], [], []
            for text, copy, found in zip(as_bytes(b.column(at(OWN_TEXT))), b.column(at(OWN_COPY)).to_pylist(), b.column(at(OWN_SPANS)).to_pylist()):
                spans = merged([(x["s"], x["e"]) for x in found or ()]) if not copy else [(0, len(text))] * (len(text) >= least)
                rest = cut(text, spans)
                n.append(len(text))
                gone.append(len(text) - len(rest))
                n_spans.append(len(spans))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(cut(text, whole_characters(text, spans)).decode() if with_text else None)
            own = [(c, b.column(i)) for i, c in enumerate(b.schema.names) if c not in (OWN_TEXT, OWN_COPY, OWN_SPANS)]
            yield pa.RecordBatch.from_arrays([*(x for _, x in own), *(pa.array(x, pa.int64()) for x in (n, gone, n_spans)), pa.array(digest), pa.array(kept, pa.string())], names=[*(c for c, _ in own), *RESULT, "text"])

    return run


RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _without_spans(rows: DataFrame, spans: DataFrame, passed: list[str], least: int, with_text: bool) -> DataFrame:
    found = spans.select(F.col("d").alias("__suffix_span_d"), F.col("th").alias("__suffix_span_th"), F.col("spans").alias(OWN_SPANS))
    joined = rows.join(found, (F.col(OWN_D) == F.col("__suffix_span_d")) & (F.col(OWN_TH) == F.col("__suffix_span_th")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in passed), F.col("text").alias(OWN_TEXT), OWN_COPY, OWN_SPANS)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.select(*(F.col(f"`{c}`") for c in passed)).schema.fields)
    return joined.mapInArrow(_finished(least, with_text), f"{fields}n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def _prepared(docs: DataFrame, least: int) -> tuple[list[str], DataFrame, DataFrame, int]:
    """(columns that pass, rows with keys, ``d, th, text`` of rows that are no copies, all bytes)."""
    if not MIN_MATCH // 10 <= least <= 200:
        raise ValueError("match lengths from 10 to 200 bytes")
    passed = [c for c in docs.columns if c not in RESULT and c != "text"]
    rows, total = keyed(docs.select(*(F.col(f"`{c}`") for c in (*passed, "text"))))
    return passed, rows, rows.where(f"NOT {OWN_COPY}").select(F.col(OWN_D).alias("d"), F.col(OWN_TH).alias("th"), "text"), total


def suffix_dedup(docs: DataFrame, least: int = MIN_MATCH, with_text: bool = True) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text`` and the four result columns.

    The columns count and digest bytes; ``text`` keeps a character whole of which only some bytes are repeated.
    """
    passed, rows, texts, total = _prepared(docs, least)
    return _without_spans(rows, repeated_spans(texts, total, least), passed, least, with_text)


def extend_index(folder: str, docs: DataFrame, least: int = MIN_MATCH, with_text: bool = True) -> DataFrame:
    """``suffix_dedup`` of a new batch against the index in ``folder`` as well, which then takes the batch in.

    The index is a family of levels: ``texts(d, th, text)`` and ``anchors`` of them, whose name ends in their bytes.  A batch is
    scanned against all levels; then it becomes a level, and while the level before is at most twice as large, both merge.
    All batches of an index are cut at one length, and a batch's ids are larger than those before: else ``ValueError``.
    """
    spark = docs.sparkSession
    passed, rows, texts, total = _prepared(docs, least)
    levels = sorted(subfolders(spark, folder), key=lambda x: int(x.rsplit("-", 2)[1]))
    read = lambda level, part: spark.read.parquet(f"{folder}/{level}/{part}")
    older = None
    texts = stored(texts.distinct(), "batch")
    if levels:
        every = [_union(spark, [read(x, part) for x in levels]) for part in ("texts", "anchors")]
        last, first = every[0].agg(F.max("d")).first()[0], texts.agg(F.min("d")).first()[0]
        if last is not None and first is not None and first <= last:
            raise ValueError(f"a new batch's ids must be larger than {last}")
        older = (every[0], every[1])
    out = stored(_without_spans(rows, repeated_spans(texts, total, least, older), passed, least, with_text), "deduplicated")
    number = 1 + max([int(x.rsplit("-", 2)[1]) for x in levels], default=0)
    merging, size = [], total
    while levels and int(levels[-1].rsplit("-", 1)[1]) <= 2 * size:
        merging.append(levels.pop())
        size += int(merging[-1].rsplit("-", 1)[1])
    name = f"level-{number:06d}-{size}"
    fresh = anchor_rows(texts, least).where(f"role <> {FLAG}").drop("role")
    for part, new in (("texts", texts), ("anchors", fresh)):
        _union(spark, [new, *(read(x, part) for x in merging)]).write.parquet(f"{folder}/.{name}/{part}")
    renamed(spark, f"{folder}/.{name}", f"{folder}/{name}")
    for old in merging:
        remove(spark, f"{folder}/{old}")
    return out


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
