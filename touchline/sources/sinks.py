"""Writers: exports and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def replace_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table; with a partition column only the partitions that ``rows`` holds."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
