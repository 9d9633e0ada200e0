"""Registered queries of the retrieval operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import dense, evaluation, files, interaction, lexical, training
from quarry.plans.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (lexical, evaluation, dense, training, files, interaction)


def _bound(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each query after RM3 expansion."""
    return Tables(spark, sf_dir).run_b.where(F.col("rank") <= 10)


def queries() -> dict[str, Query]:
    return {name: _bound(make) for group in GROUPS for name, make in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for group in GROUPS for name, text in group.SQL.items()}
