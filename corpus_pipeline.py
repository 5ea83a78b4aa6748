"""The corpus pipeline: five stages, each a (name, function) pair over what its predecessor kept.

Every stage works on all documents it is given and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.base import stored, table
from touchline.llm.jaccard_join import one_of_each
from touchline.llm.line_dedup import line_dedup
from touchline.llm.packing import best_fit_packing
from touchline.llm.quality_rules import keep_good
from touchline.llm.queries import vocabulary
from touchline.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates of this pipeline: five words a shingle, similarity 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _documents(rows: DataFrame) -> DataFrame:
    """Columns of ``documents``, ``n_chars`` counted anew."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occur earlier go from the texts."""
    return _documents(line_dedup(docs.select(*COLUMNS)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id."""
    return one_of_each(docs, NEAR_WIDTH, NEAR_PERCENT).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings go from the texts."""
    return _documents(suffix_dedup(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the outlier rule is an iterative fit, and packing is a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
