"""All registered queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pulseframe.plans import ingest_queries, join_queries, series_queries, sink_queries, stream_queries, text_queries

QUERIES = {
    **series_queries.QUERIES, **ingest_queries.QUERIES, **join_queries.QUERIES, **text_queries.QUERIES,
    **sink_queries.QUERIES, **stream_queries.QUERIES,
}
