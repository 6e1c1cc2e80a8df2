"""The queries of the library and the SQL each of them is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import changes, oracle, queries, replies, rules, search, short_forms, spellings, streams, unicodes

QUERIES = queries.QUERIES | rules.QUERIES | changes.QUERIES | replies.QUERIES | search.QUERIES | short_forms.QUERIES | spellings.QUERIES | streams.QUERIES | unicodes.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | rules.ORACLE_SQL | changes.ORACLE_SQL | replies.ORACLE_SQL | search.ORACLE_SQL | short_forms.ORACLE_SQL | spellings.ORACLE_SQL | streams.ORACLE_SQL | unicodes.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_blend"](spark, sf_dir)
