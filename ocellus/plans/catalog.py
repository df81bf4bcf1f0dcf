"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ocellus.plans import search_queries, session_queries, usage_queries

QUERIES = {**usage_queries.QUERIES, **search_queries.QUERIES, **session_queries.QUERIES}
SQL = {**usage_queries.SQL, **search_queries.SQL, **session_queries.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search_queries.q_rank_fusion_best_match(spark, folder)
