"""Every registered query of the engine and the SQL that checks it."""

from __future__ import annotations

from .plans import cohort_queries, graph_queries, kernel_queries, learning_queries, matrix_queries, network_queries
from .plans.network_queries import minimum_slice  # noqa: F401

QUERIES = matrix_queries.QUERIES | cohort_queries.QUERIES | network_queries.QUERIES | graph_queries.QUERIES | kernel_queries.QUERIES | learning_queries.QUERIES
ORACLE = matrix_queries.ORACLE | cohort_queries.ORACLE | network_queries.ORACLE | graph_queries.ORACLE | kernel_queries.ORACLE
