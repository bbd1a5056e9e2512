"""Variant-to-gene evidence analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""

from locusweave.session import build_session, durable

__all__ = ["build_session", "durable"]
