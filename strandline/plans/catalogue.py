"""Registry of the engine's queries: name, plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bipartite_queries, bridge_queries, class_queries, evaluation_queries, link_queries, model_queries, pair_queries, retrieval_queries, review_queries, summary_queries, text_queries, transfer_queries, vocabulary_queries, workflow_queries

FLAGSHIP = "pair_evidence_summary"
GROUPS = (bipartite_queries, bridge_queries, class_queries, evaluation_queries, link_queries, model_queries, pair_queries, retrieval_queries, review_queries, summary_queries, text_queries, transfer_queries, vocabulary_queries, workflow_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for g in GROUPS for name, (plan, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
