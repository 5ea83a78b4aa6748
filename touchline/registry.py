"""All registered queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import projection

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query; ``tables`` are the domain tables that the oracle reads as common table expressions."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = projection.with_tables(oracle, tables)
        return f

    return keep


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value bets: fixtures priced, gated, ranked and staked."""
    return QUERIES["value_bets"](spark, sf_dir)


from . import plans  # noqa: E402,F401  registers the queries
