"""State changes as functions from old and new rows to the new table: upsert, merge, insert if absent, compare and set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``: a map-side combined ``max_by``, so a hot key is reduced before it moves."""
    packed = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones of their key; columns that one side lacks are null there."""
    fresh = keep_last(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_supplied(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Like an upsert, but only columns that the new row supplies are changed."""
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return old.join(fresh, keys, "full").select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows whose key the table lacks; among equal keys the first by ``order``."""
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return once.join(old.select(*keys).distinct(), keys, "left_anti")


def compare_and_set(table: DataFrame, changes: DataFrame, key: str, status: str, expected: str) -> DataFrame:
    """Rows whose status is the expected one take the change's status; ``changed`` tells which."""
    fresh = changes.select(key, F.col(status).alias("_to"))
    joined = table.join(fresh, key, "left")
    hit = F.col("_to").isNotNull() & (F.col(status) == expected)
    return joined.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn(status, F.when(hit, F.col("_to")).otherwise(F.col(status))).drop("_to")


def replace_partition(old: DataFrame, new: DataFrame, partition: str, allow_empty: bool = False) -> DataFrame:
    """The partitions that ``new`` has replace those of ``old``; an empty ``new`` changes nothing unless allowed."""
    if not allow_empty and new.isEmpty():
        return old
    return old.join(new.select(partition).distinct(), partition, "left_anti").unionByName(new)


def union_by_rank(sources: list[DataFrame], keys: list[str], tie: list[str]) -> DataFrame:
    """All sources by name; of equal keys the row of the earliest source stays."""
    ranked = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        ranked = s if ranked is None else ranked.unionByName(s, allowMissingColumns=True)
    best = Window.partitionBy(*keys).orderBy("_rank", *tie)
    return ranked.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_rank")
