"""All registered queries."""

from __future__ import annotations

from . import archive_oracle, archive_queries, corpus_oracle, corpus_queries, file_queries, matrix_oracle, matrix_queries, stream_queries

QUERIES = {
    **corpus_queries.QUERIES,
    **matrix_queries.QUERIES,
    **archive_queries.QUERIES,
    **stream_queries.QUERIES,
    **file_queries.QUERIES,
}
ORACLE = {
    **corpus_oracle.ORACLE,
    **matrix_oracle.ORACLE,
    **archive_oracle.ORACLE,
    **stream_queries.ORACLE,
    **file_queries.ORACLE,
}
