"""Source divergence audit: how each source's use of words differs from its language and from every other source of it.

Documents are dealt into blocks of about ``BLOCK_BYTES``, each of one language and source.  First pass: a block tells the terms of
its documents with exact document frequencies; summed, these give the kept terms of every language.  Second pass: a block's
texts, reduced to terms between single delimiters, meet those of its own terms that are kept; an Aho-Corasick automaton of these
terms, each padded with the delimiter on both sides, recounts their occurrences.  So an automaton never holds more than the terms
of a block, however large the vocabulary.  Rows are dealt by their place in the table, alike in both passes; every block carries
its number of bytes from the first pass, and the second one fails rather than count a different block.

Counts stay sparse.  A term that a group never uses has one share for the group, so the sum over all kept terms for two groups
is: kept terms times the value of two unused terms; plus, for each group, a correction for its own terms against the other's
unused share, by number of terms of equal share; plus a correction for the terms both use, summed inside tasks over the
postings of whole terms.  All arithmetic is in integers; shares are found by long division, so counts may pass 2^63 / 10^9.

Scale: texts move once in each pass, a hot source in many blocks; a block's counts are summed before they move.  The pairs of sources of a language are the result
itself.  Ranks of terms keep ``TOP`` rows a group and task before they move.

Defined results: null text, language and source are the empty string; a document is a row, so repeated rows count each time; a
group without terms has pairs, of shares of no counts, and no terms; a language without kept terms has pairs of value 0; equal
values rank by UTF-8 bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import as_bytes, release, stored, unstore

LEAST_DOCS = 3
TOP = 200
SCALE_DIGITS = 3  # shares are parts of 10^9, found three digits at a time, three times
#: Text bytes of a block, about, and most partitions that blocks are dealt to.
BLOCK_BYTES = 24 << 20
MAX_PARTITIONS = 100_000
#: Texts that an automaton reads at once.
AT_ONCE = 256
#: Pairs of postings that are in memory at once.
PAIRS = 1 << 19

#: Every byte of a text: a letter in lower case, a byte of a non-ASCII letter, or the delimiter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("slot", pa.int32()), ("term", pa.string()), ("n", pa.int64())])
TERMS = "lang string, source string, slot int, term string, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
COUNTS = "lang string, source string, term string, n long"
_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])
MET = "lang string, source string, other string, value long"


def folded(text: bytes) -> bytes:
    """Terms of a UTF-8 text, A-Z lower-cased, with delimiters around and between them."""
    return b" %s " % text.translate(_FOLD)


def term_bytes(text: bytes) -> int:
    return len(text) - text.count(b" ")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the blocks of a partition; a block's null term has the bytes of its terms."""
    found: dict[tuple[str, str, int], Counter] = {}
    sizes: Counter = Counter()
    for b in batches:
        for *block, text in zip(*(b.column(i).to_pylist() for i in range(3)), as_bytes(b.column(3))):
            terms, key = folded(text), tuple(block)
            found.setdefault(key, Counter()).update(set(terms.split()))
            sizes[key] += term_bytes(terms)
    for key, docs in found.items():
        names = [*(t.decode() for t in docs), None]
        n = [*docs.values(), sizes[key]]
        block = [pa.array([x], t).take(pa.array(np.zeros(len(n), np.int32))) for x, t in zip(key, _TERMS.types)]
        yield pa.RecordBatch.from_arrays([*block, pa.array(names, pa.string()), pa.array(n, pa.int64())], schema=_TERMS)


def _recount(texts: pa.Table, kept: pa.Table) -> pa.Table:
    """Occurrences of the kept terms of one block."""
    automaton, expected, counts = ahocorasick.Automaton(), 0, Counter()
    for term, n in zip(kept.column("term").to_pylist(), kept.column("n").to_pylist()):
        if term is None:
            expected = n
        else:
            automaton.add_word(f" {term} ", term)
    if len(automaton):
        automaton.make_automaton()
    size = 0
    for chunk in texts.column("text").chunks:
        for at in range(0, len(chunk), AT_ONCE):
            some = b"".join(map(folded, as_bytes(chunk.slice(at, AT_ONCE))))
            size += term_bytes(some)
            if len(automaton):
                counts.update(map(itemgetter(1), automaton.iter(some.decode())))
    if size != expected:
        raise RuntimeError("a block holds other texts than in the first pass")
    at = pa.array(np.zeros(len(counts), np.int32))
    block = [texts.column(c).combine_chunks().slice(0, 1).take(at) for c in ("lang", "source")]
    return pa.Table.from_arrays([*block, pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], schema=_COUNTS)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(``lang, source, slot, text`` of every row, number of blocks)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    sizes = docs.select(*named).groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = stored(sizes.select("lang", "source", F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("slots")), "group-sizes")
    rows = docs.select(*named, F.xxhash64(F.monotonically_increasing_id()).alias("place")).join(sizes.where("slots > 1"), ["lang", "source"], "left")
    slot = F.coalesce(F.pmod("place", F.col("slots")), F.lit(0)).cast("int").alias("slot")
    return rows.select("lang", "source", slot, "text"), sizes.agg(F.sum("slots")).first()[0] or 1


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(``lang, term`` in at least ``least`` documents of the language; ``lang, source, term, n`` > 0 of every group)."""
    rows, blocks = dealt(docs)
    block = ("lang", "source", "slot")
    n = min(max(int(blocks), docs.sparkSession.sparkContext.defaultParallelism), MAX_PARTITIONS)
    by_block = stored(rows.repartition(n, *block).mapInArrow(_frequencies, TERMS), "block-terms")
    release(docs.sparkSession)
    frequent = by_block.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= least)
    kept = stored(frequent.select("lang", "term"), "kept-terms")
    wanted = by_block.join(kept, ["lang", "term"], "left_semi").unionByName(by_block.where("term IS NULL"))
    met = rows.groupBy(*block).cogroup(wanted.select(*block, "term", "n").groupBy(*block))
    counts = met.applyInArrow(_recount, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = stored(counts, "postings")
    unstore(by_block)
    release(docs.sparkSession)
    return kept, counts


def _share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 * count / total) by long division."""
    thousands = 10**SCALE_DIGITS
    first = f"({count}) * {thousands}"
    second = f"({first} % ({total})) * {thousands}"
    third = f"({second} % ({total})) * {thousands}"
    return f"1 + (({first}) div ({total})) * {thousands * thousands} + (({second}) div ({total})) * {thousands} + (({third}) div ({total}))"


def _value(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms that both groups use, from (lang, [(source, p, unused)]) of whole terms: one row a task and pair."""
    number: dict[tuple[str, str], int] = {}
    sums: Counter = Counter()

    def add(deg: np.ndarray, g: np.ndarray, p: np.ndarray, unused: np.ndarray) -> None:
        start, square = np.cumsum(deg) - deg, deg * deg
        left = np.repeat(np.arange(len(g)), np.repeat(deg, deg))
        right = np.arange(len(left)) - np.repeat(np.cumsum(square) - square, square)
        right = right % np.repeat(deg, square) + np.repeat(start, square)
        apart = left != right
        left, right = left[apart], right[apart]
        both = _values(p[left], p[right]) - _values(p[left], unused[right]) - _values(unused[left], p[right]) + _values(unused[left], unused[right])
        pair, back = np.unique(g[left] << 32 | g[right], return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back, both)
        for k, v in zip(pair.tolist(), total.tolist()):
            sums[k] += v

    for b in batches:
        if not b.num_rows:
            continue
        postings, lang = b.column(1).flatten(), b.column(0).dictionary_encode()
        deg = np.diff(b.column(1).offsets.to_numpy())
        source = postings.field("source").dictionary_encode()
        place = np.repeat(lang.indices.to_numpy(), deg).astype(np.int64) << 32 | source.indices.to_numpy()
        known, back = np.unique(place, return_inverse=True)
        names = [(lang.dictionary[k >> 32].as_py(), source.dictionary[k & 0xFFFFFFFF].as_py()) for k in known.tolist()]
        g = np.array([number.setdefault(k, len(number)) for k in names], np.int64)[back]
        p, unused = (postings.field(c).to_numpy() for c in ("p", "unused"))
        end, work = np.cumsum(deg), np.cumsum(deg * deg) // PAIRS
        for rows in np.split(np.arange(len(deg)), np.flatnonzero(np.diff(work)) + 1):
            own = slice(end[rows[0]] - deg[rows[0]], end[rows[-1]])
            add(deg[rows], g[own], p[own], unused[own])
    names = list(number)
    rows = [(names[k >> 32][0], names[k >> 32][1], names[k & 0xFFFFFFFF][1], v) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _MET.types)], schema=_MET)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    kept, counts = kept_terms(docs, least)
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("n_lang")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "n_lang", "v")))
    unused = F.when(F.col("v") > 0, F.expr(_share("1", "n_group + v"))).otherwise(1)  # without kept terms it counts zero times
    groups = stored(groups.withColumn("unused", unused), "groups")
    with_share = counts.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", F.expr(_share("n + 1", "n_group + v")).alias("p"), "unused", "n_lang", "v")
    posted = with_share.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "unused")).alias("at"), F.sum("n").alias("n"), F.max("n_lang").alias("n_lang"), F.max("v").alias("v"))
    posted = stored(posted.select("lang", "term", "at", F.expr(_share("n + 1", "n_lang + v")).alias("q")), "posted")  # a term's postings: a group each
    each = posted.select("lang", "term", "q", F.explode("at").alias("a")).select("lang", "term", "q", "a.source", "a.p", "a.unused")

    pairs = groups.select("lang", "source", F.col("unused").alias("mine"), "v").join(groups.select("lang", F.col("source").alias("other"), F.col("unused").alias("its")), "lang").where("source <> other")
    neither = pairs.select("lang", "source", "other", F.expr(f"v * {_value('mine', 'its')}").alias("value"))
    alike = each.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    beside = alike.join(pairs.drop("v"), ["lang", "source"])
    one = beside.select("lang", "source", "other", F.expr(f"m * ({_value('p', 'its')} - {_value('mine', 'its')})").alias("value"))
    two = beside.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.expr(f"m * ({_value('its', 'p')} - {_value('its', 'mine')})").alias("value"))
    both = posted.select("lang", "at").mapInArrow(_meetings, MET)
    summed = neither.unionByName(one).unionByName(two).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(own))
    above = each.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_value("p", "q")).alias("value"))
    first = above.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    cols = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    out = stored(cols(ranked, "pair").unionByName(cols(first, "term")), "divergence")
    unstore(kept, counts, groups, posted)
    return out


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense
), lt AS (
  SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM lt
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term)
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
