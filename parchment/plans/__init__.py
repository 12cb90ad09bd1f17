"""Queries by family, gathered in QUERIES and ORACLE_SQL."""

from . import audio_job_queries, function_queries, layout_queries, library_queries, misc_queries, page_queries, sequence_queries, sheet_queries, shelf_queries, source_queries, stream_queries, table_queries, text_queries, voice_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = [
    "ORACLE_SQL", "QUERIES", "audio_job_queries", "function_queries", "layout_queries", "library_queries", "misc_queries", "page_queries", "sequence_queries", "sheet_queries", "shelf_queries", "source_queries", "stream_queries", "table_queries", "text_queries", "voice_queries",
]
