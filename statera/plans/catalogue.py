"""All registered queries."""

from statera.plans import archive_queries, check_queries, contract_queries, evidence_queries, extract_queries, index_queries, layout_queries, learning_queries, match_queries, plane_queries, reconcile_queries, record_queries, scalar_queries, scan_queries, text_queries  # noqa: F401  they register themselves
from statera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
