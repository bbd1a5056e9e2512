"""Registered queries: library operators over tables derived from the given ones."""

from locusweave.queries.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
