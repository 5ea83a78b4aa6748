"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams trained on trusted text.

Trusted text is that of documents whose label rows all say quality 1.  One in ``FOLDS`` trusted documents is held out of
training; those give every language its threshold, the ``QUANTILE`` of their losses (negative log-probability per byte).
Few bytes have scattered losses, so for the quantile and the verdict a text's loss is averaged with its language's median
loss at the weight of ``PRIOR_BYTES`` bytes.  ``perplexity`` is the document's own, ``threshold`` the perplexity that a text of
its language and length may have: the language's quantile, and beyond it what the prior allows to short texts.  A document
is kept unless its perplexity is beyond its threshold.

Scale: documents are dealt by a hash of the id into chunks of bounded size.  A chunk reports the distinct n-grams it holds
with their trusted counts, so what is shuffled grows with distinct n-grams, not with text.  Counts, continuation counts,
context totals and discounts are DataFrame aggregations; probabilities are equi-joins of the n-grams that occur with
count tables sharded by language and n-gram.  They go back to the chunks that asked.  Nothing is broadcast or collected.

Defined results: null text is empty (its end is scored); null language is a language of its own; a language with too little
trusted held-out text has its median plus the pooled excess of all such text over its languages' medians as threshold; with
too little altogether there are no thresholds, all are kept and perplexities are null; null ids are untrusted, as are ids
with a label row that has no quality; trusted documents in training are scored by the model that knows them; repeated rows
score alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, release, stored, unstore

ORDER = 5
FOLDS = 5
QUANTILE = 0.99
PRIOR_BYTES = 200.0
MIN_HELD_OUT = 10
CHUNK_BYTES = 32 << 20
#: Documents of a chunk whose n-grams are expanded at once.
DOCS_AT_ONCE = 1000
START, END = 2, 3

PRE = "chunk int, lang string, code long, trusted long"


def codes_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number per text): a text's n-grams, its end included, packed a byte each into an integer."""
    raw = np.frombuffer(b"".join(bytes([START]) * (order - 1) + t + bytes([END]) for t in texts), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.zeros(len(raw) - order + 1 if len(raw) else 0, np.int64)
    for i in range(order):
        code = (code << 8) | raw[i : len(raw) - order + 1 + i]
    begin = np.cumsum(n + order - 1) - n - order + 1
    keep = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return code[keep], n


def distinct_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some texts and their counts, a block of texts at a time."""
    code, count = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(texts), DOCS_AT_ONCE):
        found, n = np.unique(codes_of(texts[at : at + DOCS_AT_ONCE])[0], return_counts=True)
        code, back = np.unique(np.concatenate([code, found]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([count, n]), minlength=len(code)).astype(np.int64)
    return code, count


def chunked(docs: DataFrame, labels: DataFrame, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents and the ids of trusted training documents, both with the chunk of their id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // chunk_bytes))
    chunk = lambda key: F.pmod(key, F.lit(n)).cast("int").alias("chunk")
    by_id = F.xxhash64("doc_id")
    dealt = rows.select(chunk(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(by_id)), "doc_id", "lang", "text")  # rows without id are never trusted
    known = trusted_ids(labels).where("NOT held_out").select(chunk(by_id), "doc_id")
    return dealt.repartition(2 * n, "chunk"), known.repartition(2 * n, "chunk")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, held_out`` of the documents whose label rows all say quality 1."""
    ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1")
    return ids.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0).alias("held_out"))


def _by_language(docs: pa.Table) -> Iterator[tuple[str, list[int], list[bytes]]]:
    ids, langs, texts = docs.column("doc_id").to_pylist(), docs.column("lang").to_pylist(), as_bytes(docs.column("text"))
    for lang in sorted(set(langs)):
        at = [i for i, x in enumerate(langs) if x == lang]
        yield lang, [ids[i] for i in at], [texts[i] for i in at]


def _report(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct n-grams of a chunk by language, with their counts in trusted training text."""
    good = set(trusted.column("doc_id").to_pylist())
    schema = pa.schema([("chunk", pa.int32()), ("lang", pa.string()), ("code", pa.int64()), ("trusted", pa.int64())])
    out = [schema.empty_table()]
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    for lang, ids, texts in _by_language(docs):
        seen, count = distinct_codes([t for i, t in zip(ids, texts) if i in good])
        other, _ = distinct_codes([t for i, t in zip(ids, texts) if i not in good])
        more = np.setdiff1d(other, seen, assume_unique=True)
        code = np.concatenate([seen, more])
        n = np.concatenate([count, np.zeros(len(more), np.int64)])
        out.append(pa.table([pa.array(np.full(len(code), chunk, np.int32)), pa.array([lang] * len(code)), pa.array(code), pa.array(n)], schema=schema))
    return pa.concat_tables(out)


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def count_tables(counts: DataFrame) -> dict[int, DataFrame]:
    """``lang, code, c`` by order: counts at the highest, numbers of distinct left neighbours below it."""
    tables = {ORDER: stored(counts, "counts")}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = stored(tables[n + 1].groupBy("lang", _suffix(F.col("code"), n).alias("code")).agg(F.count("*").alias("c")), "counts")
    return tables


def with_discount(table: DataFrame) -> DataFrame:
    """``table`` with the modified Kneser-Ney discount of each row's count, from its language's counts of counts."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    stats = table.groupBy(F.col("lang").alias("d_lang")).agg(*n)
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
    raw = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)) for k in (1, 2, 3)]
    d = [F.when(r.isNull(), 0.5).otherwise(F.least(F.greatest(r, F.lit(0.1)), F.lit(k - 0.1))) for k, r in enumerate(raw, 1)]
    stats = stored(stats.select("d_lang", *(x.alias(f"d{k}") for k, x in enumerate(d, 1))), "discounts")
    joined = table.join(stats, F.col("lang") == F.col("d_lang"))
    return joined.select("lang", "code", "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))


def probabilities(asked: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """``lang, code, p`` of asked n-grams of the highest order, by joins from the lowest order up; uses up ``tables``."""
    below = None
    for n in range(1, ORDER + 1):
        want = asked.select("lang", _suffix(F.col("code"), n).alias("code")).distinct() if n < ORDER else asked.select("lang", "code")
        discounted = with_discount(tables[n])
        context = discounted.groupBy("lang", F.shiftright("code", 8).alias("ctx")).agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        joined = want.join(discounted, ["lang", "code"], "left").withColumn("ctx", F.shiftright("code", 8)).join(context, ["lang", "ctx"], "left")
        if below is None:
            lower = F.lit(1.0 / 256)
        else:
            joined = joined.withColumn("tail", _suffix(F.col("code"), n - 1)).join(below.select("lang", F.col("code").alias("tail"), F.col("p").alias("q")), ["lang", "tail"])
            lower = F.col("q")
        own = F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0))
        p = own + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * lower
        made = stored(joined.select("lang", "code", p.alias("p")), "probabilities")
        unstore(*([below] if below is not None else []), tables[n])  # read by this order only
        below = made
    return below


class Lookup:
    """Values of distinct integer codes, found by a hash slot with binary search for the slots that several share."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(12, int(len(codes)).bit_length() + 2))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[self._at(self.codes)] = np.arange(len(codes), dtype=np.int32)

    def _at(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slot[self._at(codes)]
        miss = np.flatnonzero(self.codes[at] != codes)
        at[miss] = np.searchsorted(self.codes, codes[miss])
        return self.values[at]


SCORES = "doc_id long, lang string, n_bytes long, log10_prob double"


def _score(docs: pa.Table, known: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log10_prob", pa.float64())])
    out = [schema.empty_table()]
    langs = known.column("lang").to_numpy()
    codes, logs = known.column("code").to_numpy(), known.column("log10_p").to_numpy()
    for lang, ids, texts in _by_language(docs):
        mine = langs == lang
        find = Lookup(codes[mine], logs[mine])
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            code, n = codes_of(part)
            total = np.add.reduceat(find(code), np.cumsum(n) - n)
            out.append(pa.table([pa.array(ids[at : at + 500], pa.int64()), pa.array([lang] * len(part)), pa.array(n), pa.array(total)], schema=schema))
    return pa.concat_tables(out)


def scored(docs: DataFrame, labels: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, lang, n_bytes, log10_prob`` of every document; n_bytes counts the end."""
    spark = docs.sparkSession
    rows, trusted = chunked(docs, labels, chunk_bytes)
    pre = stored(rows.groupBy("chunk").cogroup(trusted.groupBy("chunk")).applyInArrow(_report, PRE), "chunk-ngrams")
    release(spark)
    counts = pre.where("trusted > 0").groupBy("lang", "code").agg(F.sum("trusted").alias("c"))
    asked = stored(pre.select("lang", "code").distinct(), "asked")
    p = probabilities(asked, count_tables(counts))
    answers = stored(pre.select("chunk", "lang", "code").join(p, ["lang", "code"]).select("chunk", "lang", "code", F.log10("p").alias("log10_p")), "answers")
    unstore(pre, asked, p)
    release(spark)
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, SCORES)
    out = stored(out, "scores")
    unstore(answers)
    release(spark)
    return out


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_bytes, log10_prob, perplexity, threshold, kept`` of every document row."""
    scores = scored(docs, labels)
    loss = -F.col("log10_prob") / F.col("n_bytes")
    middle = stored(scores.groupBy(F.col("lang").alias("m_lang")).agg(F.percentile_approx(loss, 0.5, 10_000).alias("middle")), "medians")
    drawn = scores.join(middle, F.col("lang") == F.col("m_lang")).drop("m_lang")
    drawn = drawn.withColumn("loss", loss).withColumn("drawn", (-F.col("log10_prob") + PRIOR_BYTES * F.col("middle")) / (F.col("n_bytes") + PRIOR_BYTES))
    held = drawn.join(trusted_ids(labels).where("held_out"), "doc_id", "left_semi")
    limit = lambda c: F.percentile_approx(c, quantile, 10_000)
    own = held.groupBy(F.col("lang").alias("t_lang")).agg(F.when(F.count("*") >= MIN_HELD_OUT, limit("drawn")).alias("own"))
    pooled = held.agg(limit(F.col("drawn") - F.col("middle")).alias("excess"))
    limits = middle.crossJoin(F.broadcast(pooled)).join(own, F.col("m_lang") == F.col("t_lang"), "left")  # one row is broadcast
    limits = limits.select(F.col("m_lang").alias("t_lang"), F.coalesce("own", F.col("middle") + F.col("excess")).alias("limit"))
    out = drawn.join(stored(limits, "thresholds"), F.col("lang") == F.col("t_lang"), "left")
    allowed = F.col("limit") + (F.col("limit") - F.col("middle")) * PRIOR_BYTES / F.col("n_bytes")  # where drawn = limit
    perplexity = F.pow(F.lit(10.0), F.col("loss"))
    kept = F.col("limit").isNull() | (F.col("drawn") <= F.col("limit"))
    return out.select("doc_id", "lang", "n_bytes", "log10_prob", perplexity.alias("perplexity"), F.pow(F.lit(10.0), allowed).alias("threshold"), kept.alias("kept"))
