"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qatlam.plans import hybrid, lexical, morphology, pairs, skew, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (texts, lexical, morphology, hybrid, pairs, skew)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.subword_frequency(spark, d)
