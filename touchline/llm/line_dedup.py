"""Content-defined line chunks: repeated multi-line chunks are removed, whatever lines were put in before them.

Every line is hashed; a rolling hash over a line's hash and the one before ends a chunk where it is divisible by
``DIVISOR``, so boundaries depend on nearby lines only and move with them.  A chunk with two lines of content or more that
occurs earlier (smaller doc_id, or earlier in the same document) is removed.  Chunks meet by a 64-bit hash first; those
that meet are grouped by their bytes, so equal hashes alone remove nothing.  DataFrame functions only.

Scale: hashes are shuffled for all chunks, texts of chunks only where a hash repeats; grouping uses map-side combined
``min`` and the way back is an equi-join that adaptive execution splits where a chunk is very frequent.

Defined results: null text stays null with no lines; an empty text is one line without content; a null id sorts first;
rows with equal id and text are one document and keep or lose the same chunks; empty tables give empty results; other
columns pass through, whatever their names, except those named like the three counts, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored, unused

DIVISOR = 3
MODULUS = 2147483647
MIN_CONTENT_LINES = 2
NO_ID = -(1 << 63)
COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of chunks; a chunk is the array of its lines."""

    def cut_after(ls: Column, hs: Column) -> Column:
        rolled = lambda i: ((F.element_at(hs, i) * 31 + F.coalesce(F.get(hs, i - 2), F.lit(0)) * 17) % MODULUS) % divisor == 0
        return F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (i == F.size(ls)) | rolled(i))

    def slices(ls: Column, cuts: Column) -> Column:
        start = lambda k: F.coalesce(F.get(cuts, k - 1), F.lit(0)) + 1
        return F.transform(cuts, lambda end, k: F.slice(ls, start(k), end - start(k) + 1))

    return let(F.split(text, "\n", -1), lambda ls: let(F.transform(ls, line_hash), lambda hs: let(cut_after(ls, hs), lambda cuts: slices(ls, cuts))))


def has_content(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 0)) >= MIN_CONTENT_LINES


def _exploded(docs: DataFrame, with_text: bool, divisor: int) -> DataFrame:
    """One row per multi-line chunk: row key, place ``k``, 64-bit hash and, if asked for, the chunk's text."""
    rows = docs.select("d", "th", F.posexplode(chunks_of(F.col("text"), divisor)).alias("k", "lines")).where(has_content(F.col("lines")))
    rows = rows.select("d", "th", "k", F.array_join("lines", "\n").alias("chunk"))
    return rows.select("d", "th", "k", F.xxhash64("chunk").alias("h"), *(["chunk"] if with_text else []))


def removed_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``d, th, gone``: places of the chunks to remove, per document.  ``docs``: columns d, th, text."""
    keys = stored(_exploded(docs, False, divisor), "chunk-keys")
    again = keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    wanted = keys.join(again, "h", "left_semi").groupBy("d", "th").agg(F.collect_set("k").alias("ks"))
    met = docs.join(wanted.hint("merge"), ["d", "th"])
    picked = let(chunks_of(F.col("text"), divisor), lambda cs: F.transform("ks", lambda k: F.struct(k.alias("k"), F.get(cs, k).alias("lines"))))
    chunks = met.select("d", "th", F.explode(picked).alias("c")).select("d", "th", "c.k", "c.lines")
    chunks = stored(chunks.select("d", "th", "k", F.array_join("lines", "\n").alias("chunk")).withColumn("h", F.xxhash64("chunk")), "chunk-texts")
    place = F.struct("d", "th", "k")
    first = chunks.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = chunks.join(first, ["h", "chunk"]).where(place != F.col("first"))
    return gone.groupBy("d", "th").agg(F.collect_set("k").alias("gone"))


def line_dedup(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and the three counts."""
    passed = [c for c in docs.columns if c not in COUNTS]
    d_name, th_name, of_d, of_th, gone_name, cut_name = unused(docs, "line_d", "line_th", "line_of_d", "line_of_th", "line_gone", "line_cut")
    d, th, gone = map(F.col, (d_name, th_name, gone_name))
    keyed = docs.select(*(F.col(f"`{c}`") for c in passed), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(d_name), F.xxhash64("text").alias(th_name))
    removed = stored(removed_chunks(keyed.select(d.alias("d"), th.alias("th"), "text"), divisor), "chunks-gone")
    removed = removed.select(F.col("d").alias(of_d), F.col("th").alias(of_th), F.col("gone").alias(gone_name))
    joined = keyed.join(removed.hint("merge"), (d == F.col(of_d)) & (th == F.col(of_th)), "left")
    places = lambda cs: F.array_except(F.transform(cs, lambda c, k: k), gone)
    lines = lambda cs, ks: F.flatten(F.transform(ks, lambda k: F.get(cs, k)))
    cut = let(
        chunks_of(F.col("text"), divisor),
        lambda cs: F.struct(
            F.array_join(lines(cs, places(cs)), "\n").alias("text"),
            F.array_size(F.flatten(cs)).alias("n_lines"),
            F.array_size(lines(cs, gone)).alias("n_removed_lines"),
        ),
    )
    untouched = F.struct(
        F.col("text"), F.coalesce(F.array_size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"), F.lit(0).alias("n_removed_lines")
    )
    out = joined.withColumn(cut_name, F.when(gone.isNull(), untouched).otherwise(cut))
    rest = [F.col(f"`{c}`") for c in passed if c != "text"]
    return out.select(
        *rest,
        F.col(f"{cut_name}.text").alias("text"),
        F.col(f"{cut_name}.n_lines").cast("long").alias("n_lines"),
        F.col(f"{cut_name}.n_removed_lines").cast("long").alias("n_removed_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l
), b AS (
  SELECT *, CASE WHEN ((h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 17) % {MODULUS}) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS cut FROM h
), c AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
), g AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n, count(*) FILTER (WHERE length(trim(line)) > 0) AS m FROM c GROUP BY doc_id, k
), r AS (
  SELECT *, m >= {MIN_CONTENT_LINES} AND row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1 AS gone FROM g
)
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, CAST(sum(n) AS BIGINT) AS n_lines,
  CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks
FROM r GROUP BY doc_id
"""
