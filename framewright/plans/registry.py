"""All queries of the library with their SQL, but those of the llm subpackage."""

from __future__ import annotations

from . import column_queries, corpus_queries, dataset_queries, extra_queries, file_queries, playback_queries, progress_queries, shape_queries

MODULES = [progress_queries, dataset_queries, shape_queries, playback_queries, corpus_queries, column_queries, extra_queries, file_queries]

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
