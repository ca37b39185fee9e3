"""The thirteen named retrieval tools, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import graph, lexical, retrieve, series


def search_document_chunks(queries: DataFrame, knowledge: dict[str, DataFrame], top_k: int = 5) -> DataFrame:
    """``[D1] …`` lines of the nearest chunks; a question without any gets the line that says so."""
    hits = retrieve.vector_search(queries, knowledge["chunk_vectors"], top_k)
    lines = retrieve.chunk_evidence(hits, knowledge["chunks"])
    none = queries.join(lines.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(0).alias("rank"), F.lit(vocab.NO_CHUNKS).alias("line"))
    return lines.unionByName(none)


def retrieve_document_content(queries: DataFrame, chunks: DataFrame, top_k: int = 3) -> DataFrame:
    return retrieve.document_lines(lexical.keyword_search(queries, chunks, top_k), chunks)


TOOLS = {
    "hybrid_retrieve": retrieve.query_with_evidence,
    "query_gis_graph": retrieve.query_with_evidence,
    "retrieve_policy_docs": retrieve.policy_search,
    "search_document_chunks": search_document_chunks,
    "retrieve_document_content": retrieve_document_content,
    "query_point_detail": graph.point_detail,
    "query_year_summary": series.year_summary,
    "list_all_entities": partial(graph.list_entities, n=50),
    "time_series_aggregate": series.time_series,
    "compare_periods": series.compare_periods,
    "boundary_evolution_timeline": series.timeline,
    "get_entity_info": graph.entity_info,
    "get_relation_info": graph.relation_info,
}
