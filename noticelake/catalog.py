"""All registered queries of the notice operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticelake.plans import assessment, changes, documents, functions, operations, reports, sinks, sources, streaming  # noqa: F401  registers its queries
from noticelake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, updated and unchanged listings by source."""
    return QUERIES["a01_dedup_summary"](spark, sf_dir)
