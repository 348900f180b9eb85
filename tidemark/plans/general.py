"""Queries of the general data problems in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.timestamps import entry_instants
from tidemark.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant for each entry whose published date names one."""
    return entry_instants(table(spark, sf_dir, "entries"), table(spark, sf_dir, "feeds"))


QUERIES = {"p5_found": p5_found}
ORACLE: dict[str, str] = {}
