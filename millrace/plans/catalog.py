"""The registered queries of the rule engine and their SQL twins."""

from . import document_queries, payload_queries, piece_queries, review_queries, rule_queries, store_queries, upkeep_queries  # noqa: F401  they register their queries
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
