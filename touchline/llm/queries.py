"""Queries of the numbered corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, line_dedup, source_divergence
from .base import table


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a language model of trusted text, with its language's threshold and verdict."""
    from .ngram_quality import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the multi-line chunks that occur earlier."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC, normalised to one gzip member per record, and read back by the index."""
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, Jaccard 0.85."""
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rule and robust outlier verdict of every document."""
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes outside repeated 100-byte strings."""
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("text")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent-model scores of all documents."""
    from .gru_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by merge rounds and decoded again, as digests."""
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of weighted sources takes of each."""
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source of all documents, in every order."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources' words from those of other sources, and the terms that stand out most."""
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_bpe": op10_bpe,
    "op11_source_mix": op11_source_mix,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
    "op3_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
""",
}
