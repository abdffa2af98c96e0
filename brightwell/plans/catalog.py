"""All queries outside the corpus operators, with the same in DuckDB SQL."""

from __future__ import annotations

from . import chat_queries, detection_queries, graph_queries, io_queries, layout_queries, metric_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
