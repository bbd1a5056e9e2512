"""All registered queries."""

from locusweave.queries import credible_queries, file_queries, pair_queries, range_queries, score_queries, signed_queries  # noqa: F401
from locusweave.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
